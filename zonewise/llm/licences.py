"""License scan: conditional compression against license templates, confirmed word by word."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def _gnu(kind: str, what: str, joint: str, version: str) -> str:
    """The header of a license of the GNU family."""
    name = f"GNU {kind}General Public License"
    return (
        f"This {what} is free software{joint} you can redistribute it and/or modify it under the terms of the {name} {version}. This {what} is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        f"FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


def _later(version: str, joint: str = ",") -> str:
    return f"as published by the Free Software Foundation{joint} either version {version} of the License, or (at your option) any later version"


# Wordings of public licenses, (license, wording).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("GPL-2.0-or-later", _gnu("", "program", ";", _later("2", ";"))),
    ("GPL-2.0-only", _gnu("", "program", ";", "version 2 as published by the Free Software Foundation")),
    ("LGPL-2.0-or-later", _gnu("Library ", "library", ";", _later("2", ";"))),
    ("LGPL-2.1-or-later", _gnu("Lesser ", "library", ";", _later("2.1", ";"))),
    ("LGPL-3.0-or-later", _gnu("Lesser ", "program", ":", _later("3"))),
    ("AGPL-3.0-or-later", _gnu("Affero ", "program", ":", _later("3"))),
)
# Words that tell licenses apart, as do numbers where a wording has some: a confirmed wording has all of them and no more.
MARKS = frozenset("""
lesser affero later only option noncommercial commercial noderivatives noderivs derivatives sharealike alike nc nd sa unported
apache mit bsd isc mozilla mpl gnu gpl lgpl agpl creative commons educational eclipse artistic european
""".split())
# Words that make a passage a candidate.
CUE = r"(?i)licen[cs]|copyright|spdx|redistribut|warrant|permission|permitted|public domain|unencumbered|neighboring rights|endorse|merchantab|creative commons|\bcc[ -]by"
_CUE = re.compile(CUE)
_BREAK = re.compile(r"\n+|(?<=[.;:!?])\s+")
_WORD = re.compile(r"[^\W_]+")
TAKEN = "\x00"  # in place of words taken out; a word of its own that no wording holds or spares
_TOKEN = re.compile(r"[^\W_]+|\x00")
LONG = 120  # words; a longer passage without a break is cut here, every part is looked at with as many words after it as a wording has
ONE_IN = 10  # differing words a confirmed wording may have: one in so many, rounded down
SCHEMA = (
    "block int, first_char long, n_chars long, license string, template int, plain_bytes int, conditional_bytes int, "
    "differences array<string>, confirmed boolean"
)


def _words(text: str) -> list[str]:
    return [w.lower() for w in _TOKEN.findall(text)]


@lru_cache(maxsize=2)
def _prepared(templates: tuple):
    import zstandard

    dicts = [zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, t in templates]
    given = [zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_content_size=False) for d in dicts]
    plain = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
    words = [_words(t) for _, t in templates]
    return plain, given, words, {w for t in words for w in t}


def _units(text: str, overlap: int) -> Iterator[tuple[int, int]]:
    """Sentences and lines; very long ones in parts of ``LONG`` words and the ``overlap`` words after them."""
    at = 0
    for found in [*_BREAK.finditer(text), None]:
        end = found.start() if found else len(text)
        starts = [m.start() for m in _WORD.finditer(text, at, end)]
        cuts = [at, *starts[LONG::LONG]]
        ends = [*starts[LONG + overlap :: LONG], *[end] * len(cuts)]
        yield from ((a, b) for a, b in zip(cuts, ends) if b > a)
        at = found.end() if found else end


def candidate_blocks(text: str, templates: tuple = TEMPLATES) -> list[tuple[int, int]]:
    """Runs of passages that hold a cue or are made of template words; a run needs a cue."""
    _, _, wordings, vocabulary = _prepared(templates)
    # A stretch that confirms the longest wording lies in one part.
    longest = max(map(len, wordings), default=0)
    blocks, run, cued = [], None, False

    def close():
        if run and cued:
            # Parts of a long passage overlap, so their runs may.
            blocks.append((blocks.pop()[0], run[1]) if blocks and run[0] < blocks[-1][1] else run)

    for a, b in _units(text, longest + longest // ONE_IN):
        part = text[a:b]
        cue = bool(_CUE.search(part))
        words = _words(part)
        if cue or words and sum(w in vocabulary for w in words) >= 0.8 * len(words):
            run, cued = (run[0] if run else a, b), cued or cue
        else:
            close()
            run, cued = None, False
    close()
    return blocks


def _marked(words: list[str], numbers: bool) -> np.ndarray:
    """Which words tell licenses apart; ``library`` does after ``gnu`` only."""
    return np.array([w in MARKS or w == TAKEN or numbers and w.isdigit() or w == "library" and i > 0 and words[i - 1] == "gnu" for i, w in enumerate(words)], bool)


def wording_differences(template: list[str], block: list[str]) -> tuple[int, list[str]]:
    """Words to change from the template to the nearest stretch of the block, as ``-gone`` and ``+new``."""
    steps = SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    while steps and steps[0][0] == "insert":
        steps = steps[1:]
    while steps and steps[-1][0] == "insert":
        steps = steps[:-1]
    said, edits = [], 0
    for kind, a, b, c, d in steps:
        if kind != "equal":
            said += [f"-{w}" for w in template[a:b]] + [f"+{w}" for w in block[c:d]]
            edits += max(b - a, d - c)
    return edits, said


def held_wording(template: list[str], block: list[str]) -> tuple[list[str], int, int] | None:
    """(differences, first word, word after the last) of the nearest stretch of the block, if it confirms the template.

    It does with at most one differing word in ``ONE_IN``, none of which tells licenses apart. The
    edit distance is exact: a difference in a marked word costs more than all that are allowed.
    """
    most = len(template) // ONE_IN
    if sum((Counter(template) & Counter(block)).values()) < len(template) - most:
        return None
    numbers = any(w.isdigit() for w in template)
    gone = np.where(_marked(template, numbers), most + 1, 1)
    new = np.where(_marked(block, numbers), most + 1, 1)
    at = {w: np.array([x == w for x in block]) for w in set(template)}
    offset = np.concatenate(([0], np.cumsum(new)))
    table = [np.zeros(len(block) + 1, np.int64)]
    for w, cost in zip(template, gone.tolist()):
        row = table[-1]
        stay = np.concatenate(([row[0] + cost], np.minimum(row[1:] + cost, row[:-1] + np.where(at[w], 0, np.maximum(cost, new)))))
        table.append(np.minimum.accumulate(stay - offset) + offset)
    final = table[-1]
    # A stretch does not end in words that are only added.
    ends = [j for j in np.flatnonzero(final <= most).tolist() if (not j or final[j] < final[j - 1] + new[j - 1]) and not _goes_on(template, block[j : j + 6])]
    if not ends:
        return None
    j = min(ends, key=lambda j: int(final[j]))
    i, last, said = len(template), j, []
    while i:
        w, here, cost = template[i - 1], int(table[i][j]), int(gone[i - 1])
        if j and here == table[i - 1][j - 1] + (0 if at[w][j - 1] else max(cost, int(new[j - 1]))):
            if not at[w][j - 1]:
                said += [f"+{block[j - 1]}", f"-{w}"]
            i, j = i - 1, j - 1
        elif here == table[i - 1][j] + cost:
            said.append(f"-{w}")
            i -= 1
        else:
            said.append(f"+{block[j - 1]}")
            j -= 1
    return said[::-1], j, last


def _goes_on(template: list[str], after: list[str]) -> bool:
    """Whether the words after a wording allow later versions too."""
    more = (["or", "later"], ["or", "any", "later"], ["or", "at", "your", "option", "any", "later"])
    return template[-1].isdigit() and any(after[: len(m)] == m for m in more)


def classify(block: str, templates: tuple = TEMPLATES) -> tuple:
    """(license, template, plain size, size given the template, differences, confirmed).

    Templates are ranked by how many bytes they save. The first whose wording the block holds, but for
    one word in ten and for no word that tells licenses apart, names the license; of equal savings the
    first template does. A block that no wording confirms keeps the differences from the best one and
    no license.
    """
    return _first(block.replace(TAKEN, " "), templates)[0]


def _first(block: str, templates: tuple) -> tuple[tuple, str | None]:
    """What ``classify`` gives, and the block without the words that confirmed it."""
    plain, given, words, _ = _prepared(templates)
    data = block.encode()
    size = len(plain.compress(data))
    ranked = sorted((len(c.compress(data)), i) for i, c in enumerate(given))
    mine = _words(block)
    for small, i in ranked:
        held = held_wording(words[i], mine)
        if held:
            said, first, last = held
            place = [m.span() for m in _TOKEN.finditer(block)]
            return (templates[i][0], i, size, small, said, True), block[: place[first][0]] + TAKEN + block[place[last - 1][1] :]
    small, i = ranked[0]
    return (None, i, size, small, wording_differences(words[i], mine)[1], False), None


def classify_all(block: str, templates: tuple = TEMPLATES) -> list[tuple]:
    """A row of ``classify`` for every license of the block, or the one that tells that there is none.

    The words that confirmed a license are taken out and the rest is classified, until nothing more is
    confirmed; the sizes of a later license are those of what was left. Further wordings of a license
    found before give no row.
    """
    rows, rest = [], block.replace(TAKEN, " ")
    while rest is not None:
        row, rest = _first(rest, templates)
        if row[5] and row[0] not in {r[0] for r in rows} or not rows:
            rows.append(row)
    return rows


def license_scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """Rows of the candidate blocks of every text: place, template, sizes, exact word differences.

    A block has one row for each license it holds, or one without a license.
    Only texts with a cue leave the engine; each is read whole. ``first_char`` counts code points.
    Null and empty texts hold no block, a null doc_id is carried, repeated rows repeat their blocks, an
    empty table gives none, further columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (doc, j, a, b - a, *row)
                for doc, text in zip(batch["doc_id"], batch["text"])
                for j, (a, b) in enumerate(candidate_blocks(text, templates))
                for row in classify_all(text[a:b], templates)
            ]
            out = pd.DataFrame(rows, columns=["doc_id", *(c.strip().split()[0] for c in SCHEMA.split(","))])
            yield out.astype({"doc_id": batch["doc_id"].dtype})

    cued = docs.filter(F.col("text").rlike(CUE)).select("doc_id", "text")
    return cued.mapInPandas(run, f"doc_id {kind}, {SCHEMA}")
