"""Words of whole Arrow batches as numpy arrays: no Python string is made for a word."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
# Everything in ASCII that is no letter or digit; bytes of longer characters belong to words.
PUNCTUATED = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
# Full-width letters and digits, by the last byte of their code points.
_WIDE = np.array([chr(0xFF00 + c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """Words of the texts ``first .. first + texts - 1`` of a batch, in order."""

    first: int
    texts: int
    doc: np.ndarray  # text of each word, from 0
    start: np.ndarray  # bytes from the start of its text
    stop: np.ndarray
    key: np.ndarray  # 64-bit hash of the folded bytes
    data: np.ndarray  # folded bytes of the slice
    origin: np.ndarray  # first byte of each text in ``data``


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n; kept while small."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[name] = table
    up, down = _powers["up"], _powers["down"]
    if len(up) > 4 * SLICE_BYTES:
        _powers.clear()
    return up[:n], down[:n]


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the task's worker, which waits for further tasks, gives free memory back to the machine."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
        if trim is not None:
            trim(0)

    return whole


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of characters of scripts without blanks, and of CJK punctuation; all of them have three or four bytes."""
    at = np.flatnonzero(data >= 0xE0)
    a = data[at].astype(np.int64)
    b, c = (data[np.minimum(at + i, len(data) - 1)].astype(np.int64) & 0x3F for i in (1, 2))
    three, point = a < 0xF0, (a & 15) << 12 | b << 6 | c
    mark = three & ((point >= 0x3000) & (point < 0x3040) & ~np.isin(point, (0x3005, 0x3006, 0x3007)) | (point > 0xFF00) & (point < 0xFF66) & ~_WIDE[point & 0xFF])
    ranges = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3100, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F))
    alone = np.zeros(len(at), bool)
    for low, high in ranges:
        alone |= three & (point >= low) & (point <= high)
    # Planes 2 and 3 hold ideographs only.
    alone |= (a == 0xF0) & (b >= 0x20) & (b < 0x40)
    return at[alone & ~mark], at[mark]


def words(column: pa.Array, separators: np.ndarray = BLANK, fold_latin: bool = False, split_unspaced: bool = False) -> Iterator[Words]:
    """Words between ``separators``, A-Z in lower case, of slices of about 512 KB of whole texts.

    ``fold_latin`` also lowers the two-byte capitals from À to Þ; ``split_unspaced`` makes a word of every
    character of scripts without blanks (Chinese, Japanese, Thai, Lao, Khmer, Burmese). Null texts hold no words.
    """
    raw, at = _bytes(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1)
        origin = at[first : last + 1] - at[first]
        data = _LOWER[raw[at[first] : at[last]]]
        if fold_latin and len(data):
            lead = np.zeros(len(data), bool)
            lead[1:] = data[:-1] == 0xC3
            data[lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
        gap = separators[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:] = False
        edge[origin] = True
        if split_unspaced and len(data):
            alone, mark = _unspaced(data)
            edge[alone] = True
            edge[alone + np.where(data[alone] >= 0xF0, 4, 3)] = True
            gap[(mark[:, None] + np.arange(3)).ravel()] = True
        opens = np.flatnonzero(~gap & (edge[:-1] | np.concatenate(([True], gap[:-1])))) if len(data) else np.zeros(0, np.int64)
        closes = np.flatnonzero(~gap & (edge[1:] | np.concatenate((gap[1:], [True])))) + 1 if len(data) else np.zeros(0, np.int64)
        up, down = _power(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        key = mix((sums[closes] - sums[opens]) * down[opens] + (closes - opens).astype(np.uint64))
        doc = np.searchsorted(origin, opens, "right") - 1
        yield Words(first, last - first, doc, opens - origin[doc], closes - origin[doc], key, data, origin)
        first = last


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``n`` words; a text of fewer words gives them all as one run."""
    k, doc = w.key, w.doc
    count = np.bincount(doc, minlength=w.texts)
    docs, keys = [], []
    if len(k) >= n:
        run = k[: len(k) - n + 1].copy()
        for i in range(1, n):
            run = run * np.uint64(0xD6E8FEB86659FD93) + k[i : len(k) - n + 1 + i]
        inside = doc[: len(run)] == doc[n - 1 :]
        docs.append(doc[: len(run)][inside])
        keys.append(mix(run[inside]))
    begin = np.concatenate(([0], np.cumsum(count)[:-1]))
    for r in range(1, n):
        few = np.flatnonzero(count == r)
        if len(few):
            run = np.full(len(few), np.uint64(r), np.uint64)
            for i in range(r):
                run = run * np.uint64(0xD6E8FEB86659FD93) + k[begin[few] + i]
            docs.append(few)
            keys.append(mix(run ^ np.uint64(0xA5A5A5A5)))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(keys)


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its runs of ``n`` words) for every row of the column."""
    for w in words(column):
        doc, key = shingles(w, n)
        order = np.argsort(doc, kind="stable")
        key = key[order]
        ends = np.cumsum(np.bincount(doc, minlength=w.texts))
        begin = 0
        for i, end in enumerate(ends.tolist()):
            yield w.first + i, np.unique(key[begin:end])
            begin = end
