"""Benchmark decontamination: edit distance through CGK random walks and bit-sampling LSH.

Texts and items are sequences of words (letters and digits, lower case; the
characters of scripts without blanks). A CGK walk reads a window
and repeats or advances at every step as a random function of the step and the word says, so that
few edits between two windows become few differing places between two walks. Each repetition
compares walks at a few sampled places through a hash table of all items. Every window of an item's
size is a candidate start; windows that share too few word pairs with the items of that size cannot
lie within the edit bound and are not walked. For sizes at which the walks do not reach the recall,
every such window is looked at without walks. What the tables return is verified by the exact edit
distance between the item and the best stretch of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from zonewise.llm.words import PUNCTUATED, Words, mix, released, words

PERCENT = 80  # an item of n words is leaked by a stretch within n * (100 - PERCENT) / 100 edits
MIN_WORDS = 5  # shorter items are looked for word by word, without edits
RECALL = 0.95
PLACES = 2  # sampled places of a walk in one repetition
MOST_REPETITIONS = 96
BLOCK_ITEMS = 2_000  # items are searched in blocks of so many, or so many bytes
BLOCK_BYTES = 4_000_000
_U = np.uint64
_FILTER_BITS = 20


def _edits(n: int, percent: int) -> int:
    return n * (100 - percent) // 100


def _seeds(repetitions: int, steps: int) -> np.ndarray:
    """Odd multipliers, one for each repetition and step: the random functions of the walks."""
    grid = np.arange(repetitions * steps, dtype=_U).reshape(repetitions, steps)
    return mix(grid + _U(0xC0FFEE)) | _U(1)


@lru_cache(maxsize=512)
def _places(n: int, repetitions: int) -> np.ndarray:
    """The sampled steps of every repetition, among the 2 n in which a walk usually ends."""
    rng = np.random.default_rng(n)
    return np.sort(np.stack([rng.choice(2 * n, PLACES, replace=False) for _ in range(repetitions)]), axis=1)


def walk_keys(keys: np.ndarray, start: np.ndarray, end: np.ndarray, n: int, repetitions: int) -> np.ndarray:
    """LSH keys (window, repetition) of the windows of ``n`` words at ``start``, cut at ``end``."""
    steps = 2 * n
    seeds, places = _seeds(MOST_REPETITIONS, steps)[:repetitions], _places(n, MOST_REPETITIONS)[:repetitions]
    at = np.zeros((len(start), repetitions), np.int64)
    out = np.broadcast_to(np.arange(repetitions, dtype=_U), at.shape).copy()
    stop = np.minimum(end - start, n)[:, None]
    for j in range(int(places.max()) + 1 if len(places) else 0):
        inside = at < stop
        here = np.where(inside, keys[np.minimum(start[:, None] + at, len(keys) - 1)], _U(0))
        for p in range(PLACES):
            sampled = places[:, p] == j
            if sampled.any():
                out[:, sampled] = mix(out[:, sampled] * _U(31) + here[:, sampled])
        at += inside & ((here * seeds[:, j]) >> _U(63)).astype(bool)
    return out


@lru_cache(maxsize=512)
def repetitions_for(n: int, percent: int, target: float) -> int:
    """Repetitions that find the target share of random windows at the edit bound; 0 if ``MOST_REPETITIONS`` do not."""
    rng, pairs, k = np.random.default_rng(n * 1000 + percent), 200, _edits(n, percent)
    first, second = [], []
    for _ in range(pairs):
        a = list(rng.integers(1, 1 << 62, n))
        b = list(a)
        for _ in range(k):
            kind, at = rng.integers(3), int(rng.integers(max(len(b), 1)))
            if kind == 0:
                b[at] = int(rng.integers(1, 1 << 62))
            elif kind == 1 and len(b) > 1:
                del b[at]
            else:
                b.insert(at, int(rng.integers(1, 1 << 62)))
        first.append(a)
        second.append(b)

    def embed(rows):
        size = np.array([len(r) for r in rows])
        end = np.cumsum(size)
        return walk_keys(mix(np.array([x for r in rows for x in r], _U)), end - size, end, n, MOST_REPETITIONS)

    hit = embed(first) == embed(second)
    found = np.logical_or.accumulate(hit, axis=1).mean(0)
    enough = np.flatnonzero(found >= target)
    return int(enough[0]) + 1 if len(enough) else 0


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, first word, word after the last) of the stretch of ``text`` nearest to ``item``."""

    row = _edit_row(item, text, np.zeros(len(text) + 1, np.int64))
    end = int(row.argmin())
    # Read backwards from there, the nearest beginning is the shortest stretch of that distance.
    back = text[:end][::-1][: 2 * len(item) + 1]
    full = _edit_row(item[::-1], back, np.arange(len(back) + 1))
    return int(row[end]), end - int(full.argmin()), end


def _edit_row(a: np.ndarray, b: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Last row of the edit table of ``a`` against ``b``, from its first row."""
    index = np.arange(len(b) + 1)
    for i, x in enumerate(a):
        new = np.concatenate(([i + 1], np.minimum(row[1:] + 1, row[:-1] + (b != x))))
        row = np.minimum.accumulate(new - index) + index
    return row


class Items:
    """A block of benchmark items, ready to be looked for."""

    def __init__(self, ids: list, texts: list, percent: int = PERCENT, target: float = RECALL, least: int = MIN_WORDS):
        self.percent = percent
        self.ids, self.keys, short = [], [], {}
        for w in words(pa.array(texts, pa.string()), PUNCTUATED, True, True):
            ends = np.cumsum(np.bincount(w.doc, minlength=w.texts))
            for i, key in enumerate(np.split(w.key, ends[:-1])):
                if len(key):
                    self.ids.append(ids[w.first + i])
                    self.keys.append(key)
                    if len(key) < least:
                        short.setdefault(len(key), []).append(len(self.keys) - 1)
        # Items of few words: sorted hashes of the whole item, and the items.
        self.runs = {}
        for n, mine in short.items():
            run = np.concatenate([_runs(self.keys[i], n) for i in mine])
            order = np.argsort(run, kind="stable")
            self.runs[n] = (run[order], np.array(mine, np.int64)[order])
        sizes = np.array([len(k) for k in self.keys], np.int64)
        self.sizes = [int(n) for n in np.unique(sizes[sizes >= least])]
        group = {n: g for g, part in enumerate(np.array_split(np.array(self.sizes, np.int64), min(62, max(1, len(self.sizes))))) for n in part.tolist()}
        self.group = group
        pairs, bits = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for key in (k for k in self.keys if len(k) >= least):
            pairs.append(_pairs(key))
            bits.append(np.full(len(key) - 1, 1 << group[len(key)], np.int64))
        pair, bit = np.concatenate(pairs), np.concatenate(bits)
        self.pair, at = np.unique(pair, return_inverse=True)
        self.bits = np.zeros(len(self.pair), np.int64)
        np.bitwise_or.at(self.bits, at, bit)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[(self.pair >> _U(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.tables = {}
        for n in self.sizes:
            mine = np.flatnonzero(sizes == n)
            flat = np.concatenate([self.keys[i] for i in mine])
            end = np.cumsum(np.full(len(mine), n))
            r = repetitions_for(n, percent, target)
            if not r:
                self.tables[n] = (0, None, mine)
                continue
            table = walk_keys(flat, end - n, end, n, r)
            order = np.argsort(table.ravel(), kind="stable")
            self.tables[n] = (r, table.ravel()[order], np.repeat(mine, r)[order])

    def starts(self, pair: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> dict[int, np.ndarray]:
        """Window starts, by item size, with as many of the size's word pairs as the bound leaves."""
        maybe = np.flatnonzero(self.seen[(pair >> _U(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(self.pair) or not len(maybe):
            return {}
        at = np.minimum(np.searchsorted(self.pair, pair[maybe]), len(self.pair) - 1)
        real = self.pair[at] == pair[maybe]
        place, bits = maybe[real], self.bits[at[real]]
        out = {}
        for n in self.sizes:
            mine = place[(bits >> self.group[n]) & 1 == 1]
            k = _edits(n, self.percent)
            need, reach = n - 1 - 2 * k, n + k - 2
            if len(mine) < need:
                continue
            lo, hi = mine[: len(mine) - need + 1], mine[need - 1 :]
            near = (hi - lo <= reach) & (doc[lo] == doc[hi])
            lo, hi = lo[near], hi[near]
            if len(lo):
                least = np.maximum(hi - reach, begin[doc[lo]])
                out[n] = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(least, lo)]))
        return out

    def _exact(self, n: int, item: np.ndarray, start: np.ndarray, pair: np.ndarray, doc: np.ndarray, end: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """Regions of the starts for every item of ``n`` words with enough word pairs there; no walk decides."""
        k = _edits(n, self.percent)
        out = {}
        for d in np.unique(doc).tolist():
            mine = start[doc == d]
            lo, hi = int(mine[0]), int(mine[-1])
            near = np.unique(pair[lo : min(int(end[d]), hi + n + k)])
            for i in item.tolist():
                if np.isin(_pairs(self.keys[i]), near).sum() >= n - 1 - 2 * k:
                    out[d, i] = [lo, hi]
        return out

    def _whole(self, w: Words) -> Iterator[tuple[int, int, int, int, int]]:
        """The first place of every item of few words in every text, without edits."""
        for n, (table, item) in self.runs.items():
            run = _runs(w.key, n)
            inside = w.doc[: len(run)] == w.doc[n - 1 :]
            a, b = np.searchsorted(table, run, "left"), np.searchsorted(table, run, "right")
            done = set()
            for s in np.flatnonzero(inside & (b > a)).tolist():
                doc = int(w.doc[s])
                for i in item[a[s] : b[s]].tolist():
                    if (doc, i) not in done and (self.keys[i] == w.key[s : s + n]).all():
                        done.add((doc, i))
                        yield w.first + doc, i, 0, int(w.start[s]), int(w.stop[s + n - 1])

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, edits, first byte, byte after the last) of every leak, the best per row and item."""
        for w in words(column, PUNCTUATED, True, True):
            if not len(w.key) or not self.keys:
                continue
            pair = _pairs(w.key)
            inside = w.doc[:-1] == w.doc[1:]
            pair = np.where(inside, pair, _U(0))
            end = np.cumsum(np.bincount(w.doc, minlength=w.texts))
            begin = np.concatenate(([0], end[:-1]))
            yield from self._whole(w)
            regions: dict[tuple[int, int], list[int]] = {}
            for n, start in self.starts(pair, w.doc, begin).items():
                r, table, item = self.tables[n]
                if not r:
                    regions.update(self._exact(n, item, start, pair, w.doc[start], end))
                    continue
                for lo in range(0, len(start), 4096):
                    some = start[lo : lo + 4096]
                    got = walk_keys(w.key, some, end[w.doc[some]], n, r).ravel()
                    a, b = np.searchsorted(table, got, "left"), np.searchsorted(table, got, "right")
                    hit = np.flatnonzero(b > a)
                    for h in hit.tolist():
                        s = int(some[h // r])
                        for i in set(item[a[h] : b[h]].tolist()):
                            span = regions.setdefault((int(w.doc[s]), i), [s, s])
                            span[0], span[1] = min(span[0], s), max(span[1], s)
            for (doc, i), (lo, hi) in sorted(regions.items()):
                n = len(self.keys[i])
                k = _edits(n, self.percent)
                lo, hi = max(int(begin[doc]), lo - k), min(int(end[doc]), hi + n + k)
                edits, first, last = best_stretch(self.keys[i], w.key[lo:hi])
                if edits <= k and last > first:
                    yield w.first + doc, i, edits, int(w.start[lo + first]), int(w.stop[lo + last - 1])


def _pairs(key: np.ndarray) -> np.ndarray:
    return mix(key[:-1] * _U(0xD6E8FEB86659FD93) + key[1:])


def _runs(key: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; none of fewer words."""
    size = max(0, len(key) - n + 1)
    run = key[:size]
    for i in range(1, n):
        run = mix(run * _U(0xD6E8FEB86659FD93) + key[i : i + size])
    return run


def _blocks(benchmark: DataFrame, **how) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, one at a time on the driver."""
    ids, texts, held = [], [], 0
    for row in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        held += len(row.text)
        if len(ids) >= BLOCK_ITEMS or held >= BLOCK_BYTES:
            yield Items(ids, texts, **how)
            ids, texts, held = [], [], 0
    if ids:
        yield Items(ids, texts, **how)


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, target: float = RECALL, least: int = MIN_WORDS) -> DataFrame:
    """One row for every (document, item) with a stretch within the edit bound.

    ``doc_id``, ``item_id``, ``edits``, ``item_words``, ``first_byte`` and ``end_byte`` of the nearest
    stretch in the UTF-8 text. Blocks of items meet all documents, one map over the texts per block.
    Items of fewer than ``least`` words are leaked by the same words only. Null texts, and texts and
    items without words, hold no leak; a null
    doc_id or item_id is carried as it is; repeated rows give repeated leaks; empty tables give none.
    """
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, edits int, item_words int, first_byte long, end_byte long"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, percent=percent, target=target, least=least):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(items.search(batch.column(1)))
                if not rows:
                    continue
                row, item, edits, first, end = (list(x) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row)),
                        pa.array([items.ids[i] for i in item]),
                        pa.array(edits, pa.int32()),
                        pa.array([len(items.keys[i]) for i in item], pa.int32()),
                        pa.array(first, pa.int64()),
                        pa.array(end, pa.int64()),
                    ],
                    ["doc_id", "item_id", "edits", "item_words", "first_byte", "end_byte"],
                )

        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(released(run), schema))
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without a leak, filtered where they are read."""
    text_at = docs.columns.index("text")
    inner = docs.select(*[F.col(c).alias(f"_z_{i}") for i, c in enumerate(docs.columns)])
    schema = inner.schema
    for items in _blocks(benchmark, **how):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in items.search(batch.column(text_at)):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        inner = inner.mapInArrow(released(run), schema)
    return inner.select(*[F.col(f"_z_{i}").alias(c) for i, c in enumerate(docs.columns)])
