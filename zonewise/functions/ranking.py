"""Exact order statistics and dense positions that never pull a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from zonewise.functions.scalars import one_row
from zonewise.session import pin

SKETCH_ACCURACY = 10_000


def dense_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """0-based position in the total order ``order``.

    Rows are range-partitioned once; each range is numbered on its own and shifted by
    the size of the ranges before it, so no step sorts everything in one task.
    """
    ranged = pin(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    within = W.partitionBy("_range").orderBy(*order)
    return (
        ranged.join(starts, "_range")
        .withColumn(name, F.col("_start") + F.row_number().over(within) - 1)
        .drop("_range", "_start")
    )


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1-based rank inside each key, safe for a key that holds a large share of all rows."""
    placed = dense_position(df, [F.col(k) for k in keys] + list(order), "_pos")
    placed = pin(placed)
    first = placed.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    return placed.join(first, list(keys)).withColumn(name, F.col("_pos") - F.col("_first") + 1).drop("_pos", "_first")


class Rank:
    """A wanted order statistic: ``low``/``high`` 1-based ranks and the weight of the upper one."""

    def __init__(self, near: float, low: Column, high: Column, weight: Column):
        self.near, self.low, self.high, self.weight = near, low, high, weight

    @classmethod
    def linear(cls, p: float) -> "Rank":
        """Linear interpolation between closest ranks."""
        h = (F.col("n") - 1) * F.lit(p)
        return cls(p, F.floor(h) + 1, F.ceil(h) + 1, h - F.floor(h))

    @classmethod
    def kth(cls, p: float, k: Column) -> "Rank":
        """The k-th smallest value itself; ``p`` is the share of rows it lies near."""
        return cls(p, k, k, F.lit(0.0))


def order_statistics(df: DataFrame, value: str, wanted: dict[str, Rank], keys: Sequence[str] = ()) -> DataFrame:
    """Exact order statistics, one row per key with ``n`` and a column per wanted name.

    A bounded sketch finds a narrow value band around every wanted rank. Rows outside the band
    are only counted, with the nearest value on either side kept, since the rank may lie one past
    the sketch. Rows inside are collapsed to distinct values, range-partitioned and numbered by
    running counts, so a band is never sorted in one task. A rank that is not found stops the query.
    """
    keys = list(keys)
    src = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    margin = 3.0 / SKETCH_ACCURACY
    names = list(wanted)
    edges = []
    for name in names:
        edges += [max(wanted[name].near - margin, 0.0), min(wanted[name].near + margin, 1.0)]
    bounds = src.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), F.lit(SKETCH_ACCURACY)).alias("_e"),
    )
    if keys:
        bounds = pin(bounds)
        row = src.join(bounds, keys)
    else:
        row = src.withColumn("_b", one_row(bounds)).select("_v", "_b.n", "_b._e")
    low = [F.col("_e")[2 * i] if edges[2 * i] > 0 else F.lit(float("-inf")) for i in range(len(names))]
    high = [F.col("_e")[2 * i + 1] if edges[2 * i + 1] < 1 else F.lit(float("inf")) for i in range(len(names))]
    inside = [(F.col("_v") >= lo) & (F.col("_v") <= hi) for lo, hi in zip(low, high)]
    outside = []
    for i, (lo, hi) in enumerate(zip(low, high)):
        outside += [
            F.count_if(F.col("_v") < lo).alias(f"_below{i}"),
            F.count_if(inside[i]).alias(f"_inside{i}"),
            F.max(F.when(F.col("_v") < lo, F.col("_v"))).alias(f"_before{i}"),
            F.min(F.when(F.col("_v") > hi, F.col("_v"))).alias(f"_after{i}"),
        ]
    below = row.groupBy(*keys).agg(F.first("n").alias("n"), *outside)
    # Which bands a row lies in, as the bits of one integer: a cheap grouping key.
    bits = sum((F.when(hit, 1 << i).otherwise(0) for i, hit in enumerate(inside)), F.lit(0))
    each = F.array(*[F.lit(i) for i in range(len(names))])
    band = (
        row.select(*keys, "_v", bits.alias("_in"))
        .filter("_in > 0")
        .groupBy(*keys, "_v", "_in")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(*keys, "_v", "_c", "_in", F.explode(each).alias("_i"))
        .filter(F.col("_in").bitwiseAND(F.expr("shiftleft(1, _i)")) != 0)
        .drop("_in")
    )
    ranked = running_count(band, keys + ["_i"], "_v", "_c").withColumn("_lo", F.col("_hi") - F.col("_c"))
    if keys:
        ranked = ranked.join(below, keys)
    else:
        ranked = ranked.withColumn("_b", one_row(below)).select("_v", "_i", "_hi", "_lo", "_b.*")
    aggs = []
    for i, name in enumerate(names):
        r, base, last = wanted[name], F.col(f"_below{i}"), F.col(f"_below{i}") + F.col(f"_inside{i}")
        mine = F.col("_i") == i

        def at(rank: Column) -> Column:
            here = F.when(mine & (rank > base + F.col("_lo")) & (rank <= base + F.col("_hi")), F.col("_v"))
            beside = F.when(rank == base, F.col(f"_before{i}")).when(rank == last + 1, F.col(f"_after{i}"))
            found = F.coalesce(F.max(F.coalesce(here, beside)), F.raise_error(F.lit(f"rank of {name} lies outside its band")))
            return F.when(F.max(rank) <= F.max("n"), found)  # a rank past the last row has no value

        lowest, highest = at(r.low), at(r.high)
        # Written so that two equal neighbours give back that very value.
        aggs.append((lowest + (highest - lowest) * F.max(r.weight)).alias(name))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)


def weighted_order_statistics(df: DataFrame, value: str, weight: str, wanted: dict[str, Rank], keys: Sequence[str] = ()) -> DataFrame:
    """``order_statistics`` of rows that stand ``weight`` times, as a histogram has them, from one running count.

    Equal values are collapsed first, so what is ranged and counted has the size of the histogram.
    Null and NaN values and weights of zero are no rows; a key without rows is left out.
    """
    keys = list(keys)
    src = df.select(*keys, F.col(value).cast("double").alias("_v"), F.col(weight).cast("long").alias("_c"))
    each = src.filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.col("_c") > 0)).groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
    ranked = pin(running_count(each, keys, "_v", "_c"))
    total = ranked.groupBy(*keys).agg(F.max("_hi").alias("n"))
    if keys:
        met = F.lit(True)
        for k in keys:
            met = met & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        row = ranked.join(total.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "n"), met)
    else:
        row = ranked.withColumn("n", one_row(total)["n"])

    def at(rank: Column) -> Column:
        return F.max(F.when((rank > F.col("_hi") - F.col("_c")) & (rank <= F.col("_hi")), F.col("_v")))

    aggs = []
    for name, r in wanted.items():
        lowest, highest = at(r.low), at(r.high)
        aggs.append((lowest + (highest - lowest) * F.max(r.weight)).alias(name))
    return row.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)


def running_count(df: DataFrame, groups: Sequence[str], order: str, count: str) -> DataFrame:
    """``df`` with ``_hi``, the sum of ``count`` up to and with each row of its group.

    Ranges are summed on their own; a table with a row per range and group shifts them.
    """
    ranged = pin(df.repartitionByRange(*groups, order).withColumn("_range", F.spark_partition_id()))
    before = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("_range", *groups).agg(F.sum(count).alias("_n")).select(
        "_range", *groups, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    upto = W.partitionBy("_range", *groups).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    on = ["_range", *groups]
    start_of = starts.select(*[F.col(g).alias(f"_s{j}") for j, g in enumerate(on)], "_start")
    met = F.lit(True)
    for j, g in enumerate(on):
        met = met & F.col(g).eqNullSafe(F.col(f"_s{j}"))
    shifted = ranged.withColumn("_within", F.sum(count).over(upto)).join(start_of, met)
    return shifted.select(*df.columns, (F.col("_within") + F.col("_start")).alias("_hi"))


def quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    return order_statistics(df, value, {k: Rank.linear(p) for k, p in probs.items()}, keys)
