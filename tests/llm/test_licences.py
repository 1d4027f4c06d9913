import random

from pyspark.sql import functions as F

from conftest_llm import words
from zonewise.llm.licences import TEMPLATES, candidate_blocks, classify, classify_all, license_scan


def test_every_wording_names_its_license():
    for name, text in TEMPLATES:
        got = classify(text)
        assert (got[0], got[4], got[5]) == (name, [], True)


def test_small_changes_are_told_and_large_ones_refused():
    name, text = next(t for t in TEMPLATES if t[0] == "MIT" and len(t[1]) > 200)
    got = classify(text.replace("free of charge", "without charge").replace("Software is furnished", "Work is furnished"))
    assert got[0] == name and got[5] and {"-free", "+without", "+work"} <= set(got[4])
    assert classify("Licensed under the Foo Bar Public Terms.")[5] is False
    assert classify("Licensed under CC BY-NC 4.0.")[0] == "CC-BY-NC-4.0"


def test_scan_against_planted_blocks(spark, documents):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(200):
        parts = [words(rng, rng.randrange(1, 60)).capitalize() + "." for _ in range(3)]
        if i % 4 == 0:
            j = rng.randrange(len(TEMPLATES))
            parts.insert(rng.randrange(4), TEMPLATES[j][1])
            want[i] = TEMPLATES[j]
        rows.append((i, rng.choice(["\n", " "]).join(parts), "en", "s"))
    rows += [(500, None, "en", "s"), (501, "", "en", "s"), (None, TEMPLATES[0][1], "en", "s"), (502, "copyright " * 3000, "en", "s"), (503, "license " + words(rng, 5000), "en", "s")]
    df = documents(rows, [("license", F.lit("clash"))])
    got = license_scan(df).collect()
    found = {r.doc_id: r for r in got if r.confirmed}
    assert {k: r.license for k, r in found.items()} == {**{k: t[0] for k, t in want.items()}, None: TEMPLATES[0][0]}
    for k, (_, wording) in want.items():
        r, text = found[k], dict((i, t) for i, t, _, _ in rows)[k]
        block = text[r.first_char : r.first_char + r.n_chars]
        assert wording in block and r.conditional_bytes < r.plain_bytes and r.differences == []
    assert {r.doc_id for r in got} >= {502, 503} and 500 not in {r.doc_id for r in got}
    assert license_scan(df.filter("false")).count() == 0
    assert license_scan(df.filter("doc_id = 0").unionByName(df.filter("doc_id = 0"))).count() == 2 * sum(r.doc_id == 0 for r in got)


def test_words_that_tell_licenses_apart_are_not_spared():
    wording = {(name, len(text) > 200): text for name, text in TEMPLATES}
    gpl3 = wording["GPL-3.0-or-later", True]
    lesser = gpl3.replace("GNU General", "GNU Lesser General")
    assert classify(gpl3.replace("version 3", "version 2"))[0] == "GPL-2.0-or-later"
    assert classify(gpl3.replace("GNU General", "GNU Affero General"))[0] == "AGPL-3.0-or-later"
    assert classify(lesser)[0] == "LGPL-3.0-or-later"
    assert classify(lesser.replace("version 3", "version 2.1").replace("program", "library"))[0] == "LGPL-2.1-or-later"
    assert classify(gpl3.replace("program", "library"))[0] == "GPL-3.0-or-later"
    for other in (
        gpl3.replace("version 3", "version 4"),
        gpl3.replace(", or (at your option) any later version", ""),
        wording["GPL-3.0", False][:-1] + ", or (at your option) any later version.",
        wording["Apache-2.0", True].replace("Apache License", "Educational Community License"),
        wording["CC-BY-4.0", False].replace("4.0", "2.5"),
    ):
        got = classify(other)
        assert (got[0], got[5]) == (None, False)
    cc = "This work is licensed under a Creative Commons Attribution%s International License."
    assert classify(cc % "-NoDerivatives 4.0")[0] == "CC-BY-ND-4.0"
    assert classify(cc % "-NonCommercial-NoDerivatives 4.0")[0] == "CC-BY-NC-ND-4.0"
    assert classify(cc % " 3.0")[0] is None
    numbered = wording["BSD-3-Clause", True].replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in")
    assert classify(numbered)[0] == "BSD-3-Clause"


def test_every_license_of_a_block_has_a_row(spark, documents):
    wording = {(name, len(text) > 200): text for name, text in TEMPLATES}
    mit, apache = wording["MIT", True], wording["Apache-2.0", True]
    texts = [
        ("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
        (apache + "\n" + mit, ["Apache-2.0", "MIT"]),
        (wording["AGPL-3.0-or-later", True] + " " + wording["GPL-2.0-or-later", True].replace("useful", "of use") + "\n" + mit, ["AGPL-3.0-or-later", "GPL-2.0-or-later", "MIT"]),
        ("Released under the MIT License.\n" + mit, ["MIT"]),
        ("License terms of nobody.", [None]),
    ]
    got = license_scan(documents([(i, t, "en", "s") for i, (t, _) in enumerate(texts)])).collect()
    for i, (_, want) in enumerate(texts):
        rows = [r for r in got if r.doc_id == i]
        assert sorted((r.license for r in rows), key=str) == want and all(r.confirmed == (r.license is not None) for r in rows)
    # The words on the two sides of what was taken out are not read as one wording.
    assert [r[0] for r in classify_all("Released under the Licensed under the MIT License. MIT License.")] == ["MIT"]


def test_wordings_across_the_cuts_of_a_passage_without_breaks():
    rng = random.Random(3)
    for name, text in TEMPLATES:
        flat = " ".join(w.strip(".;:!?") for w in text.split())
        for before in (0, 7, 60, 100, 119, 120, 121, 150, 239):
            whole = words(rng, before) + " " + flat + " " + words(rng, 400)
            blocks = candidate_blocks(whole)
            assert any(r[0] == name and r[5] for a, b in blocks for r in classify_all(whole[a:b])), (name, before)
            assert all(a[1] <= b[0] for a, b in zip(blocks, blocks[1:]))
