"""Hilbert-curve sharding: neighbours in several metadata dimensions share a shard."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from zonewise.llm.placing import positions
from zonewise.session import pin

BITS = 5
DIMENSIONS = ("source", "lang", "n_chars")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (one row each), by the transpose method."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    twist = np.zeros_like(x[0])
    q = top
    while q > 1:
        twist ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= twist
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def _curve(bits: int):
    @F.pandas_udf(T.LongType())
    def index(cells: pd.Series) -> pd.Series:
        if not len(cells):
            return pd.Series([], dtype="int64")
        return pd.Series(hilbert_index(np.stack(cells.to_numpy()), bits))

    return index


def _number_cell(df: DataFrame, column: str, bits: int) -> Column:
    """Cell of a numeric column by the quantiles of all rows, from a sketch of bounded size."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    edges = df.agg(F.percentile_approx(column, shares, 10_000)).first()[0] or []
    inside = sum((F.when(F.col(column) >= F.lit(e), 1).otherwise(0) for e in sorted(set(edges))), F.lit(0))
    return inside.cast("int")


def _text_cells(df: DataFrame, column: str, bits: int) -> DataFrame:
    """One row per value: its cell by the share of rows whose value sorts before it (null last)."""
    counts = df.groupBy(F.col(column).alias("_z_value")).agg(F.count(F.lit(1)).alias("_z_n"))
    ranked = positions(counts, [F.col("_z_value").asc_nulls_last()], "_z_rank")
    distinct = F.greatest(F.lit(1), F.lit(ranked.count()))
    cell = F.least(F.lit((1 << bits) - 1), F.floor(F.col("_z_rank") * (1 << bits) / distinct)).cast("int")
    return pin(ranked.select("_z_value", cell.alias(f"_z_cell_{column}")))


def hilbert_shards(
    df: DataFrame,
    shards: int,
    key: str = "doc_id",
    dimensions: Sequence[str] = DIMENSIONS,
    bits: int = BITS,
    ties: Sequence[str] = (),
) -> DataFrame:
    """``df`` with ``curve``, ``shard`` and ``slot``: rows sorted by curve index and cut into equal runs.

    Every dimension is quantised to ``2 ** bits`` cells: numbers by quantiles of all rows, text by
    the rank of its value. Shards differ by one row at most; slots count from 0 in each shard.
    Ties on the curve are ordered by ``ties`` and ``key``; repeated rows take neighbouring slots.
    Null numbers fall in the first cell, null text in the last, a null key sorts first. Input columns
    named like a result are replaced. An empty table gives no rows.
    """
    frame, cells = df, []
    kinds = dict(df.dtypes)
    for d in dimensions:
        if kinds[d] == "string":
            values = _text_cells(df, d, bits)
            frame = frame.join(values, F.col(d).eqNullSafe(F.col("_z_value")), "left").drop("_z_value")
            cells.append(F.coalesce(F.col(f"_z_cell_{d}"), F.lit(0)))
        else:
            cells.append(F.coalesce(_number_cell(df, d, bits), F.lit(0)))
    made = frame.withColumn("_z_cells", F.array(*cells)).withColumn("curve", _curve(bits)("_z_cells"))
    made = made.select(*[c for c in df.columns if c != "curve"], "curve")
    placed = positions(made, [F.col("curve"), *[F.col(t) for t in ties], F.col(key)], "_z_slot")
    total = df.count()
    at = F.col("_z_slot")
    # Shard s holds positions ceil(s * total / shards) .. ceil((s + 1) * total / shards) - 1.
    shard = F.floor(at * F.lit(shards) / F.lit(max(total, 1))).cast("long")
    shard = F.when(at * shards < shard * total, shard - 1).when(at * shards >= (shard + 1) * total, shard + 1).otherwise(shard)
    out = placed.withColumn("_z_shard", shard)
    first = F.floor((F.col("_z_shard") * total + shards - 1) / F.lit(shards)).cast("long")
    keep = [c for c in df.columns if c not in ("curve", "shard", "slot")]
    return out.select(*keep, "curve", F.col("_z_shard").cast("int").alias("shard"), (at - first).alias("slot"))


def shard_manifest(sharded: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Rows, and the least and greatest value of every dimension, per shard: what a reader prunes by."""
    bounds = [f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *bounds)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows by slot."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
