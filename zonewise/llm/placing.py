"""Positions along an order that never pass one task, shared by sharding and mixing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from zonewise.session import pin

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a task in its low bits


def positions(df: DataFrame, order: Sequence[Column], name: str, group: str | None = None) -> DataFrame:
    """``df`` with its 0-based position along ``order``, overall or within ``group``.

    Rows are range-partitioned once, sorted inside their range and written with the row number of
    the writing task. A table with one row per (range, group) then says how many rows stand before
    each range; it has as many rows as ranges and groups together, so nothing else is moved.
    Nulls in ``group`` form one group. A column called ``name`` is replaced. An empty table stays empty.
    """
    keys = ([F.col(group).asc_nulls_last()] if group else []) + list(order)
    placed = pin(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_z_row", F.monotonically_increasing_id()))
    placed = placed.withColumn("_z_range", F.shiftright("_z_row", _ROW_BITS))
    by = ["_z_range"] + (["_z_group"] if group else [])
    source = placed.withColumn("_z_group", F.col(group)) if group else placed
    runs = source.groupBy(*by).agg(F.count(F.lit(1)).alias("_z_n"), F.min("_z_row").alias("_z_first"))
    before = (W.partitionBy("_z_group") if group else W.partitionBy()).orderBy("_z_range").rowsBetween(W.unboundedPreceding, -1)
    starts = pin(
        runs.select(
            F.col("_z_range").alias("_z_at"),
            *([F.col("_z_group").alias("_z_of")] if group else []),
            "_z_first",
            F.coalesce(F.sum("_z_n").over(before), F.lit(0)).alias("_z_before"),
        )
    )
    on = F.col("_z_range") == F.col("_z_at")
    if group:
        on &= F.col(group).eqNullSafe(F.col("_z_of"))
    out = placed.join(starts, on).withColumn("_z_pos", F.col("_z_before") + F.col("_z_row") - F.col("_z_first"))
    keep = [F.col(c) for c in df.columns if c != name]
    return out.select(*keep, F.col("_z_pos").alias(name))
