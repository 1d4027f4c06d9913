"""Toxicity: a factorization machine over hashed terms, learnt from labelled documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from zonewise.llm.words import PUNCTUATED, Words, mix, released, words
from zonewise.session import pin

SAMPLE_ROWS = 20_000  # bound of the labelled sample
MAX_TERMS = 2_048  # bound of the model
STEMS = (4, 5, 6)  # letters of a word's beginning that are terms too
FACTORS = 4
THRESHOLD = 0.7


def _stems(w: Words, length: int) -> np.ndarray:
    """Terms of the first ``length`` bytes of every longer word."""
    sel = np.flatnonzero(w.stop - w.start > length)
    if not len(sel):
        return sel, np.zeros(0, np.uint64)
    at = w.origin[w.doc[sel]] + w.start[sel]
    key = np.zeros(len(sel), np.uint64)
    for i in range(length):
        key = key * np.uint64(1099511628211) + w.data[at + i].astype(np.uint64) + np.uint64(1)
    return sel, mix(key ^ np.uint64(length << 40))


def terms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, 62-bit term) pairs: words and word beginnings, in no order, with repeats."""
    docs, keys = [w.doc], [w.key]
    for length in STEMS:
        sel, key = _stems(w, length)
        docs.append(w.doc[sel])
        keys.append(key)
    return np.concatenate(docs), (np.concatenate(keys) >> np.uint64(2)).astype(np.int64)


def _distinct(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    return doc[new], term[new]


def labelled_sample(df: DataFrame, labels: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """At most ``rows`` rows with a label, in the order of a hash of the key: ``text`` and ``toxic``.

    One of several labels of a key counts as toxic if any is; rows without text are left out.
    """
    marks = labels.filter("toxic is not null").groupBy(F.col(key).alias("_z_key")).agg(F.max("toxic").alias("toxic"))
    picked = pin(marks.orderBy(F.xxhash64("_z_key"), "_z_key").limit(rows))
    return df.select(F.col(key).alias("_z_key"), "text").filter("text is not null").join(picked, "_z_key").select("text", "toxic")


def term_weights(sample: DataFrame, most: int = MAX_TERMS) -> tuple[np.ndarray, int, int]:
    """The terms that tell the classes apart best by the likelihood ratio of their document counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch.column(1).to_pylist(), np.int64)
            for w in words(batch.column(0), PUNCTUATED, True):
                doc, term = _distinct(*terms(w))
                bad = toxic[w.first + doc]
                value, at, n = np.unique(term, return_inverse=True, return_counts=True)
                hits = np.bincount(at, weights=bad, minlength=len(value)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64)), pa.array(hits)], ["term", "n", "bad"])

    sizes = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    total, bad_total = int(sizes["n"]), int(sizes["bad"])
    if not bad_total or bad_total == total:
        return np.zeros(0, np.int64), total, bad_total
    counted = sample.mapInArrow(count, "term long, n long, bad long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def part(a, b):  # a * log(a / b)
        return F.when(a > 0, a * F.log(a / b)).otherwise(0.0)

    a, n = F.col("bad").cast("double"), F.col("n").cast("double")
    share = bad_total / total
    gain = 2 * (part(a, n * share) + part(n - a, n * (1 - share)) + part(bad_total - a, (total - n) * share) + part(total - bad_total - n + a, (total - n) * (1 - share)))
    best = counted.filter("n >= 3").withColumn("gain", gain).filter("gain > 16").orderBy(F.desc("gain"), "term").limit(most)
    return np.sort(np.array([r.term for r in best.select("term").collect()], np.int64)), total, bad_total


def _known(column: pa.Array, vocabulary: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, column in the vocabulary) of the known terms of every text."""
    for w in words(column, PUNCTUATED, True):
        doc, term = terms(w)
        at = np.minimum(np.searchsorted(vocabulary, term), max(len(vocabulary) - 1, 0))
        hit = vocabulary[at] == term if len(vocabulary) else np.zeros(len(term), bool)
        doc, at = _distinct(doc[hit], at[hit])
        yield w.first, w.texts, doc, at


class Machine:
    """score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the known terms of a text."""

    def __init__(self, vocabulary: np.ndarray, factors: int = FACTORS, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        self.b = 0.0
        self.w = np.zeros(len(vocabulary))
        self.v = rng.normal(0, 0.05, (len(vocabulary), factors))

    def raw(self, n: int, doc: np.ndarray, term: np.ndarray) -> np.ndarray:
        out = np.full(n, self.b) + np.bincount(doc, self.w[term], minlength=n)
        for f in range(self.v.shape[1]):
            x = self.v[term, f]
            out += 0.5 * (np.bincount(doc, x, minlength=n) ** 2 - np.bincount(doc, x * x, minlength=n))
        return out

    def fit(self, rows: list[np.ndarray], toxic: np.ndarray, steps: int = 2_000, rate: float = 0.1, batch: int = 512, decay: float = 1e-5, seed: int = 5):
        """Logistic loss by adaptive gradient steps; toxic rows weigh as much as the rest together."""
        rng, n = np.random.default_rng(seed), len(rows)
        cost = np.where(toxic == 1, 0.5 * n / max(toxic.sum(), 1), 0.5 * n / max(n - toxic.sum(), 1))
        size = np.array([len(r) for r in rows])
        start = np.concatenate(([0], np.cumsum(size)))
        flat = np.concatenate(rows) if n else np.zeros(0, np.int64)
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        for _ in range(-(-steps // max(1, -(-n // batch)))):  # as many steps for a small sample as for a large one
            order = rng.permutation(n)
            for lo in range(0, n, batch):
                mine = order[lo : lo + batch]
                doc = np.repeat(np.arange(len(mine)), size[mine])
                shift = np.arange(len(doc)) - np.repeat(np.cumsum(size[mine]) - size[mine], size[mine])
                term = flat[np.repeat(start[mine], size[mine]) + shift]
                score = self.raw(len(mine), doc, term)
                error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - toxic[mine]) * cost[mine] / len(mine)
                each = error[doc]
                dw = np.bincount(term, each, minlength=len(self.w)) + decay * self.w
                dv = np.empty_like(self.v)
                for f in range(self.v.shape[1]):
                    x = self.v[term, f]
                    total = np.bincount(doc, x, minlength=len(mine))
                    dv[:, f] = np.bincount(term, each * (total[doc] - x), minlength=len(self.w))
                dv += decay * self.v
                db = error.sum()
                gw += dw * dw
                gv += dv * dv
                gb += db * db
                self.w -= rate * dw / np.sqrt(gw)
                self.v -= 0.2 * rate * dv / np.sqrt(gv)
                self.b -= rate * db / np.sqrt(gb)
        return self


def train(df: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, key: str = "doc_id") -> Machine:
    """Fit on at most ``rows`` labelled rows; what reaches the driver is the known terms of these rows.

    With no labels, or one class only, the machine is a constant.
    """
    sample = pin(labelled_sample(df, labels, rows, key))
    vocabulary, total, bad = term_weights(sample)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).cast(pa.int64())
            for first, n, doc, at in _known(batch.column(0), vocabulary):
                ends = np.cumsum(np.bincount(doc, minlength=n))[:-1]
                known = [x.tolist() for x in np.split(at, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(known, pa.list_(pa.int64())), toxic.slice(first, n)], ["known", "toxic"])

    machine = Machine(vocabulary)
    if not len(vocabulary):
        machine.b = float(np.log((bad + 0.5) / (total - bad + 0.5)))
        return machine
    coded = sample.mapInArrow(encode, "known array<long>, toxic long").groupBy("known", "toxic").count().orderBy("known", "toxic").collect()
    rows_known = [np.array(r.known, np.int64) for r in coded for _ in range(r["count"])]
    return machine.fit(rows_known, np.array([r.toxic for r in coded for _ in range(r["count"])], np.float64))


def score(df: DataFrame, machine: Machine, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and ``score`` in [0, 1] of every row, from its whole text alone.

    Null and empty texts, and texts without known terms, take the score of the constant. The machine
    holds at most ``MAX_TERMS`` terms and travels with the tasks.
    """
    wanted = [*carry] if text in carry else [*carry, text]
    names = [f"_z_{i}" for i in range(len(wanted))]
    given = df.select(*[F.col(c).alias(n) for c, n in zip(wanted, names)])
    at_text, kept = wanted.index(text), len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, n, doc, at in _known(batch.column(at_text), machine.vocabulary):
                out[first : first + n] = machine.raw(n, doc, at)
            scores = np.round(1 / (1 + np.exp(-np.clip(out, -30, 30))), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(scores)], [*names[:kept], "score"])

    schema = ", ".join(f"{n} {kind}" for n, kind in given.dtypes[:kept]) + ", score double"
    return given.mapInArrow(released(run), schema).select(*[F.col(n).alias(c) for n, c in zip(names, carry) if c != "score"], "score")


def held_out(key):
    """Rows whose label is never learnt."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score stays under ``threshold``, by a machine that learns from all labels."""
    machine = train(docs, labels)
    inner = docs.select(*[F.col(c).alias(f"_z_c{i}") for i, c in enumerate(docs.columns)])
    kept = score(inner, machine, f"_z_c{docs.columns.index('text')}", tuple(inner.columns)).filter(F.col("score") < threshold)
    return kept.select(*[F.col(f"_z_c{i}").alias(c) for i, c in enumerate(docs.columns)])
