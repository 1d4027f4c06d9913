import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import words
from zonewise.llm import jaccard
from zonewise.llm.components import components
from zonewise.llm.jaccard import Scheme, jaccard_components, joined_roots, keep_one, signatures
from zonewise.session import pin, written_folder


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = {i: shingle_set(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(rng, n, size, edits):
    base = words(rng, size).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus(rng):
    texts = ["", None, "  \n", "one", "One", "one two", "a b c d", "A B c d", "a b c e", "É b c d", "é b c d"]
    texts += family(rng, 70, 40, 3) + family(rng, 50, 120, 6) + family(rng, 30, 400, 14) + family(rng, 20, 9, 1) + family(rng, 20, 3000, 60)
    passage = words(rng, 60)
    texts += [words(rng, rng.randrange(1, 80)) + " " + passage + " " + words(rng, rng.randrange(1, 80)) for _ in range(40)]
    texts += [words(rng, rng.randrange(1, 30)) for _ in range(40)]
    texts += [texts[20], texts[20], texts[90]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(10 * k + 3, texts[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("region_rows,n,percent", [(512, 4, 85), (6, 4, 85), (6, 5, 80)])
def test_components_against_all_pairs(spark, documents, monkeypatch, region_rows, n, percent):
    monkeypatch.setattr(jaccard, "REGION_ROWS", region_rows)
    monkeypatch.setattr(jaccard, "PIVOTS", min(16, region_rows))
    rows = corpus(random.Random(11))
    df = documents([(i, t, "en", "s") for i, t in rows], [("component_id", F.lit("clash"))]).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, n, percent).collect()}
    want = brute(rows, n, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 60


def test_cut_by_pivots_keeps_every_link(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION_ROWS", 10)
    monkeypatch.setattr(jaccard, "PIVOTS", 8)
    rng = random.Random(5)
    centres = [words(rng, 60).split() for _ in range(6)]
    sets = {i: np.unique(np.array([hash(w) & 0x7FFFFFFFFFFFFFFF for w in centres[i % 6]][: 60 - rng.randrange(9)], np.uint64)) for i in range(120)}
    rows = spark.createDataFrame([(1, i, s.view(np.int64).tolist(), True) for i, s in sets.items()], "region long, doc_id long, keys array<long>, home boolean")
    cut, rest = jaccard._cut(rows, 85)
    assert rest.count() == 0 and cut.select("region").distinct().count() > 1
    links = jaccard._region_links(cut, 85)
    root = {r.node: r.root for r in components(links).collect()}
    for a in sets:
        for b in sets:
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                assert root.get(a, a) == root.get(b, b)


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(2)
    for percent in (80, 85):
        scheme = Scheme(percent)
        for size in (1, 2, 5, 7, 9, 13, 20, 40, 100, 333, 2000):
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 60, size, dtype=np.uint64))
                most = int(len(a) * (100 - percent) / percent)
                gone = rng.integers(0, most + 1)
                b = np.unique(np.concatenate((a[rng.permutation(len(a))[gone // 2 :]], rng.integers(0, 1 << 60, gone - gone // 2, dtype=np.uint64))))
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                    at, sig, need = signatures([a, b], scheme)
                    shared = np.isin(sig, np.intersect1d(sig[at == 0], sig[at == 1]))
                    for i in (0, 1):
                        assert any((shared & (at == i) & (need == x)).sum() >= x % 65536 for x in set(need[at == i]))


@pytest.mark.parametrize("percent,size,gone,new", [(80, 5, 1, 0), (85, 7, 1, 0), (80, 9, 1, 1), (80, 10, 2, 0), (85, 13, 1, 1), (85, 20, 3, 0)])
def test_signatures_meet_where_small_sets_fall_in_few_parts(percent, size, gone, new):
    rng, scheme = np.random.default_rng(6), Scheme(percent)
    for _ in range(3000):
        a = rng.integers(0, 1 << 60, size, dtype=np.uint64)
        b = np.concatenate((a[gone:], rng.integers(0, 1 << 60, new, dtype=np.uint64)))
        both = size - gone
        assert 100 * both >= percent * (size + len(b) - both)
        at, sig, need = signatures([np.sort(a), np.sort(b)], scheme)
        shared = np.isin(sig, np.intersect1d(sig[at == 0], sig[at == 1]))
        for i in (0, 1):
            assert any((shared & (at == i) & (need == x)).sum() >= x % 65536 for x in set(need[at == i]))


def test_guests_are_not_linked_with_each_other():
    s = [np.arange(20, dtype=np.uint64)] * 3
    assert joined_roots(s, np.array([False, False, False]), 85).tolist() == [0, 1, 2]
    assert joined_roots(s[:2], np.array([False, False]), 85).tolist() == [0, 1]
    assert joined_roots(s, np.array([False, True, False]), 85).tolist() == [0, 0, 0]


def test_nulls_repeats_and_no_rows(spark, documents):
    t = words(random.Random(1), 30)
    df = documents([(None, t, "en", "s"), (5, t, "en", "s"), (5, t, "en", "s"), (9, t, "en", "s"), (8, None, "en", "s"), (7, "", "en", "s")])
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, None), (5, 5), (5, 5), (9, 5), (8, 8), (7, 7)], key=str)
    assert sorted((r.doc_id for r in keep_one(df).collect()), key=str) == sorted([None, 5, 8, 7], key=str)
    assert jaccard_components(df.filter("false")).count() == 0
    same_id = documents([(4, t, "en", "s"), (4, "other words of one more text", "en", "s"), (6, "other words of one more text", "en", "s"), (2, t, "en", "s")])
    assert {(r.doc_id, r.component_id) for r in jaccard_components(same_id).collect()} == {(4, 2), (6, 2), (2, 2)}


def test_filter_of_large_regions_keeps_every_linked_text(spark):
    rng = random.Random(12)
    passage = list(range(40))
    rows = []
    for i in range(120):  # texts with nothing but a common passage, each with its own rest
        rows.append((1, i, passage + [1000 + 100 * i + k for k in range(60)]))
    for i in range(120, 140):  # near copies of the first ones
        base = rows[i - 120][2]
        rows.append((1, i, base[:-rng.randrange(1, 6)] + [10**6 + i]))
    rows += [(2, i, passage) for i in range(200, 203)]
    df = spark.createDataFrame([(r, i, k, True) for r, i, k in rows], "region long, doc_id long, keys array<long>, home boolean")
    left = {(r["region"], r["doc_id"]) for r in jaccard._partnered(df, 80).collect()}
    linked = {
        (r, i) for r, i, a in rows for q, j, b in rows if r == q and i != j and 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))
    }
    assert linked <= left and len(left) < 60
    assert jaccard._partnered(df.limit(0), 80).collect() == []


def test_keep_one_of_rows_that_share_an_id(spark):
    from pyspark.sql import functions as F

    rows = [(1, "b " * 9, "x"), (1, "a " * 9, "y"), (1, None, "z"), (2, "c d e f g h", "x"), (3, "c d e f g h", "x"), (4, None, "x"), (None, "c d e f g h", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    got = sorted((tuple(r)[:3] for r in jaccard.keep_one(df).collect()), key=str)
    assert got == sorted([(1, "a " * 9, "y"), (2, "c d e f g h", "x"), (4, None, "x"), (None, "c d e f g h", "x")], key=str)


def test_components_of_forests_that_disagree(spark, monkeypatch):
    from zonewise.llm import components as module

    rng = random.Random(14)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(9)
    assert {r["node"]: r["root"] for r in components(df).collect()} == want
    monkeypatch.setattr(module, "_contracted", lambda edges: edges)  # rounds alone
    assert {r["node"]: r["root"] for r in components(df).collect()} == want
    assert components(df.limit(0)).collect() == []


def test_written_sets_go_when_nothing_reads_them(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION_ROWS", 8)
    rng = random.Random(29)
    texts = family(rng, 60, 90, 3) + [words(rng, 40) for _ in range(20)]
    docs = documents([(i, t, "en", "a") for i, t in enumerate(texts)])
    folder = written_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    kept = pin(jaccard.keep_one(docs))
    assert {r.doc_id for r in kept.collect()} == {c for _, c in brute(list(enumerate(texts)), 5, 80).values()}
    left = [spark.read.parquet(f"{folder}/{x}").columns for x in set(os.listdir(folder)) - before]
    assert docs.columns in left and not any({"keys", "need", "h1", "n_shingles"} & set(c) for c in left)


def test_rarest_shingles_part_texts_with_a_common_passage(spark):
    rng = random.Random(31)
    passage, rows = list(range(50)), []
    for family_ in range(30):  # near copies in threes; all texts hold the passage
        base = passage + [1000 * (family_ + 1) + k for k in range(70)]
        rows += [(1, 3 * family_ + i, [k for k in base if k not in set(rng.sample(base, 5))] + [10**6 + 3 * family_ + i]) for i in range(3)]
    rows += [(1, 500 + i, passage + [10**7 + 1000 * i + k for k in range(70)]) for i in range(20)]  # no partner
    rows += [(2, 900 + i, passage) for i in range(2)]
    df = spark.createDataFrame([(r, i, k, True) for r, i, k in rows], "region long, doc_id long, keys array<long>, home boolean")
    for percent in (80, 85):
        got = {r["doc_id"]: r["region"] for r in jaccard._narrowed(df, percent).collect()}
        linked = {(i, j) for r, i, a in rows for q, j, b in rows if r == q and i != j and 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b))}
        assert len(linked) > 60 and all(got[i] == got[j] for i, j in linked)
        assert not any(500 <= i < 900 for i in got) and len(set(got.values())) >= 31  # one region before
    assert jaccard._narrowed(df.limit(0), 80).collect() == []


def test_narrowing_holds_at_the_very_bound(spark):
    rng, rows = random.Random(37), []
    for i in range(60):
        size = rng.randrange(1, 40)
        a = rng.sample(range(80), size)
        same = -(-80 * size // 100)
        rows += [(1, 2 * i, a), (1, 2 * i + 1, a[:same])]
    df = spark.createDataFrame([(r, i, k, True) for r, i, k in rows], "region long, doc_id long, keys array<long>, home boolean")
    got = {r["doc_id"]: r["region"] for r in jaccard._narrowed(df, 80).collect()}
    for _, i, a in rows:
        for _, j, b in rows:
            if i < j and 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b)):
                assert got[i] == got[j]


def test_components_settle_in_one_task_when_it_holds_all_edges(spark, monkeypatch):
    from zonewise.llm import components as module

    edges = [(i, i + 1) for i in range(0, 3000) if i % 50 != 49]
    df = spark.createDataFrame(edges, "a long, b long").repartition(40)
    rounds = []
    stars = module._stars
    monkeypatch.setattr(module, "_stars", lambda sym: rounds.append(1) or stars(sym))
    want = {x: x - x % 50 for x in range(3000)}
    assert {r["node"]: r["root"] for r in components(df).collect()} == want and not rounds
    monkeypatch.setattr(module, "MOST_NODES", 500)  # the edges of several tasks
    assert {r["node"]: r["root"] for r in components(df).collect()} == want
