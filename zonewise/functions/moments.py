"""Co-moments that merge (count, means, centred products) and least squares solved in column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from zonewise.functions.scalars import let

FLAT = 1e-8


def _pairs(width: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(width) for j in range(i, width)]


HELD_KEYS, HELD_ROWS = 4096, 50_000


def co_moments(rows: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per key ``n``, ``mean`` and ``prod``, the upper triangle of centred products, of complete rows.

    A task sums its own rows by key in numpy, holding at most about ``HELD_KEYS`` keys; what tasks found for a
    key is merged in a group of one row per task. Rows are centred on means of their own key first, so that
    nothing cancels.
    """
    full = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=list(columns))
    lead = full.select(*keys).schema
    schema = StructType([*lead]).add("n", LongType()).add("mean", ArrayType(DoubleType())).add("prod", ArrayType(DoubleType()))
    found, joined = _task_moments(list(keys), len(columns))
    return full.mapInArrow(found, schema).groupBy(*keys).applyInArrow(joined, schema)


def _task_moments(keys: Sequence[str], width: int):
    """Arrow functions: rows to moments by key of a task, and moments of one key to their union."""
    left, right = (list(t) for t in zip(*_pairs(width)))
    n_keys, most_keys, most_rows = len(keys), HELD_KEYS, HELD_ROWS

    def summed(numbers, values):
        """Numbers of the keys, counts, means and products; ``values`` has a row per column and is spent."""
        order = np.argsort(numbers, kind="stable")
        at, starts, n = np.unique(numbers[order], return_index=True, return_counts=True)
        mean = np.zeros((width, len(at)))
        for i, column in enumerate(values):
            column[:] = column[order]
            mean[i] = np.add.reduceat(column, starts) / n
            column -= np.repeat(mean[i], n)
        prod = np.stack([np.add.reduceat(values[i] * values[j], starts) for i, j in zip(left, right)])
        return at, n, mean.T, prod.T

    def stacked(pieces, count):
        """The numbers of all batches, a row per column."""
        out = np.empty((width, count))
        for row, column in zip(out, zip(*pieces)):
            np.concatenate([c.to_numpy(zero_copy_only=False) for c in column], out=row)
        return out

    def numbered(parts, known):
        """Number of each row's key, counted on in ``known``."""
        codes, levels = [], []
        for column in zip(*parts):
            coded = pa.concat_arrays(column).dictionary_encode(null_encoding="encode")
            codes.append(coded.indices.to_numpy(zero_copy_only=False))
            levels.append(coded.dictionary.to_pylist())
        each, back = np.unique(np.stack(codes, axis=1), axis=0, return_inverse=True) if n_keys > 1 else (np.arange(len(levels[0]))[:, None], codes[0])
        named = [tuple(level[c] for level, c in zip(levels, row)) for row in each.tolist()]
        return np.array([known.setdefault(name, len(known)) for name in named])[back.reshape(-1)]

    def as_lists(values):
        return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype="int32") * values.shape[1], np.ascontiguousarray(values).reshape(-1))

    def found(batches):
        def start():
            return {}, np.zeros(0), np.zeros((0, width)), np.zeros((0, len(left)))

        known, n, mean, prod = start()
        rows, count, types = [], 0, None
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                types = [field.type for field in batch.schema][:n_keys]
                rows.append((batch.columns[:n_keys], batch.columns[n_keys:]))
                count += batch.num_rows
            if count and (batch is None or count >= most_rows):
                parts, pieces = zip(*rows)
                at, more, centre, spread = summed(numbered(parts, known), stacked(pieces, count))
                rows, count = [], 0
                new = len(known) - len(n)
                n, mean, prod = (np.concatenate([a, np.zeros((new, *a.shape[1:]))]) for a in (n, mean, prod))
                share, off = more / (n[at] + more), centre - mean[at]
                prod[at] += spread + off[:, left] * off[:, right] * (n[at] * share)[:, None]
                mean[at] += off * share[:, None]
                n[at] += more
            if len(n) and not count and (batch is None or len(known) > most_keys):
                named = [pa.array([name[i] for name in known], types[i]) for i in range(n_keys)]
                table = [*named, pa.array(n.astype("int64")), as_lists(mean), as_lists(prod)]
                yield pa.RecordBatch.from_arrays(table, [*keys, "n", "mean", "prod"])
                known, n, mean, prod = start()

    def joined(table):
        n, mean, prod = (np.array(table.column(c).to_pylist(), dtype=float) for c in ("n", "mean", "prod"))
        centre = n @ mean / n.sum()
        off = mean - centre
        union = {"n": [int(n.sum())], "mean": [centre], "prod": [prod.sum(axis=0) + n @ (off[:, left] * off[:, right])]}
        one = table.slice(0, 1)
        for name, value in union.items():
            place = one.schema.get_field_index(name)
            one = one.set_column(place, one.schema.field(place), pa.array(value, one.schema.field(place).type))
        return one

    return found, joined


def merge_moments(parts: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Co-moments of the union of parts: centred products within the parts and between their means."""
    means = ", ".join(f"sum(n * mean[{i}]) / sum(n)" for i in range(width))
    total = parts.groupBy(*keys).agg(F.sum("n").alias("_n"), F.expr(f"array({means})").alias("_m"))
    off = parts.join(total, list(keys)).select(*keys, "n", "prod", "_n", "_m", F.zip_with("mean", "_m", lambda x, m: x - m).alias("_d"))
    sums = ", ".join(f"sum(prod[{t}] + n * _d[{i}] * _d[{j}])" for t, (i, j) in enumerate(_pairs(width)))
    return off.groupBy(*keys).agg(F.first("_n").alias("n"), F.first("_m").alias("mean"), F.expr(f"array({sums})").alias("prod"))


def _cholesky(system: Column, p: int) -> Column:
    """Solution of a symmetric positive system given as rows of ``p`` entries and a right side.

    The square-root-free form: rows below a pivot lose their share of it, then back-substitution.
    """
    w = p + 1

    def eliminate(m: Column, k: Column) -> Column:
        pivot = F.get(m, k * w + k)

        def entry(v: Column, t: Column) -> Column:
            row, col = F.floor(t / w).cast("int"), t % w
            return F.when(row <= k, v).otherwise(v - F.get(m, row * w + k) / pivot * F.get(m, k * w + col))

        return F.transform(m, entry)

    def back(upper: Column) -> Column:
        def step(b: Column, k: Column) -> Column:
            known = F.zip_with(F.slice(upper, k * w + k + 2, p - 1 - k), b, lambda a, x: a * x)
            rest = F.get(upper, k * w + p) - F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
            return F.concat(F.array(rest / F.get(upper, k * w + k)), b)

        return F.aggregate(F.sequence(F.lit(p - 1), F.lit(0), F.lit(-1)), F.array().cast("array<double>"), step)

    return let(F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), system, eliminate), back)


def _numbers(values: Sequence[int]) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


def ridge(width: int, penalty: float = 1e-3, flat: float = FLAT) -> Column:
    """Coefficients (intercept first) of the last variable on the others, from ``n``, ``mean`` and ``prod``.

    Variables are scaled by their population sd; a flat one gets the coefficient 0. ``penalty`` is
    added to the diagonal of the correlation matrix, so the system always has one solution.
    """
    p = width - 1
    place = {pair: t for t, pair in enumerate(_pairs(width))}
    of = [place[min(i, j), max(i, j)] for i in range(p) for j in range(width)]
    diagonal = _numbers([place[i, i] for i in range(width)])
    spread = F.transform(diagonal, lambda t: F.sqrt(F.greatest(F.get("prod", t) / F.col("n"), F.lit(0.0))))

    def solved(sd: Column) -> Column:
        def entry(t: Column, at: Column) -> Column:
            i, j = F.floor(at / width).cast("int"), at % width
            known = (F.get(sd, i) >= flat) & ((j == p) | (F.get(sd, j) >= flat))
            value = F.when(known, F.get("prod", t) / F.col("n") / F.get(sd, i) / F.when(j == p, 1.0).otherwise(F.get(sd, j))).otherwise(0.0)
            return value + F.when(i == j, F.when(known, penalty).otherwise(1.0)).otherwise(0.0)

        scaled = _cholesky(F.transform(_numbers(of), entry), p)
        slopes = F.zip_with(scaled, F.slice(sd, 1, p), lambda b, s: F.when(s >= flat, b / s).otherwise(0.0))
        # The right side was left in units of the last variable, so the slopes are too.
        return let(slopes, lambda g: F.concat(F.array(F.get("mean", F.lit(p)) - F.aggregate(F.zip_with(g, F.slice("mean", 1, p), lambda a, m: a * m), F.lit(0.0), lambda a, x: a + x)), g))

    return let(spread, solved)


def linear_score(coef: str, features: Sequence[str]) -> Column:
    out = F.col(coef)[0]
    for i, f in enumerate(features, start=1):
        out = out + F.col(coef)[i] * F.col(f)
    return out
