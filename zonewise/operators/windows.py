"""Supervised windows over a date x zone panel, chronological splits and their exclusions.

Completeness is an all-zones property of a date, so it is decided on one row per date.
Calendar tables (a few thousand rows whatever the data size) are the only ones that go
through an unpartitioned window; panel rows never do.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from zonewise.functions.scalars import joined_reasons, one_row
from zonewise.session import parts_of

EPOCH = "1970-01-01"
ROW_BYTES = 64  # of a zone, a day and a rate in a sort
TRAIN, VALIDATION, TEST = "train", "validation", "test"


def day_number(col: str) -> Column:
    return F.datediff(F.col(col), F.lit(EPOCH).cast("date"))


def date_completeness(panel: DataFrame, rate: str = "rate") -> DataFrame:
    """Per reported date: zones present and zones with a finite rate (map-side combined)."""
    return panel.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_present"), F.count(F.col(rate)).alias("n_finite")
    )


def calendar(panel: DataFrame, rate: str = "rate") -> DataFrame:
    """Every day between the first and last report with its completeness; absent days count zero."""
    seen = date_completeness(panel, rate)
    days = seen.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date")
    )
    return days.join(seen, "date", "left").fillna(0, ["n_present", "n_finite"])


def origins(panel: DataFrame, n_zones: Column, lookback: int, horizon: int, stride: int = 1, rate: str = "rate") -> DataFrame:
    """One row per candidate origin with input and target completeness over the calendar."""
    days = calendar(panel, rate).withColumn("n_zones", n_zones)
    at = day_number("date")
    past = W.orderBy(at).rangeBetween(-(lookback - 1), 0)
    whole = W.orderBy(at)
    none = F.col("n_present") == 0
    part = (F.col("n_present") > 0) & (F.col("n_present") < F.col("n_zones"))
    inputs = days.withColumns(
        {
            "position": F.row_number().over(whole) - 1,
            "n_absent_input": F.sum(F.col("n_zones") - F.col("n_present")).over(past),
            "n_null_input": F.sum(F.col("n_present") - F.col("n_finite")).over(past),
            "empty_input_dates": F.collect_list(F.when(none, F.col("date").cast("string"))).over(past),
            "partial_input_dates": F.collect_list(F.when(part, F.col("date").cast("string"))).over(past),
        }
    ).drop("n_present", "n_finite")
    target = days.select(
        F.col("date").alias("target"),
        F.col("n_present").alias("t_present"),
        F.col("n_finite").alias("t_finite"),
    )
    return (
        inputs.filter((F.col("position") >= lookback - 1) & ((F.col("position") - (lookback - 1)) % stride == 0))
        .withColumnRenamed("date", "origin")
        .withColumn("target", F.date_add("origin", horizon))
        .join(target, "target")
    )


def _complete() -> Column:
    return (
        (F.col("n_absent_input") == 0)
        & (F.col("n_null_input") == 0)
        & (F.col("t_present") == F.col("n_zones"))
        & (F.col("t_finite") == F.col("n_zones"))
    )


def build_windows(
    panel: DataFrame, zones: DataFrame, lookback: int = 7, horizon: int = 7, stride: int = 1, rate: str = "rate"
) -> DataFrame:
    """Valid windows (sample_id, origin, target, input_start): complete for every zone or not at all."""
    n = zones.agg(F.count_distinct("zone").alias("n_zones"))
    ok = origins(panel, one_row(n)["n_zones"], lookback, horizon, stride, rate).filter(_complete())
    return ok.select(
        (F.row_number().over(W.orderBy("origin")) - 1).cast("long").alias("sample_id"),
        "origin",
        "target",
        F.date_sub("origin", lookback - 1).alias("input_start"),
    )


def excluded_windows(
    panel: DataFrame, zones: DataFrame, lookback: int = 7, horizon: int = 7, stride: int = 1, rate: str = "rate", sample: int = 10
) -> DataFrame:
    """Rejected origins with ordered reasons, date lists, counts and the affected zones."""
    n = zones.agg(F.count_distinct("zone").alias("n_zones"))
    bad = origins(panel, one_row(n)["n_zones"], lookback, horizon, stride, rate).filter(~_complete())
    t_absent = F.col("n_zones") - F.col("t_present")
    t_null = F.col("t_present") - F.col("t_finite")
    t_empty = F.col("t_present") == 0
    t_part = (F.col("t_present") > 0) & (F.col("t_present") < F.col("n_zones"))
    reasons = joined_reasons(
        [
            ("fully_missing_input_dates", F.size("empty_input_dates") > 0),
            ("partially_missing_input_dates", F.size("partial_input_dates") > 0),
            ("absent_input_rows", F.col("n_absent_input") > 0),
            ("missing_input_rates", F.col("n_null_input") > 0),
            ("fully_missing_target_date", t_empty),
            ("partial_target_coverage", t_part),
            ("absent_target_rows", t_absent > 0),
            ("missing_target_rates", t_null > 0),
        ]
    )
    report = bad.select(
        "origin",
        "target",
        reasons.alias("reason"),
        F.array_join("empty_input_dates", "|").alias("empty_input_dates"),
        F.array_join("partial_input_dates", "|").alias("partial_input_dates"),
        "n_absent_input",
        "n_null_input",
        t_empty.alias("target_empty"),
        t_part.alias("target_partial"),
        t_absent.alias("n_absent_target"),
        t_null.alias("n_null_target"),
    )
    hit = affected_zones(panel, zones, bad.select("origin"), lookback, horizon, rate)
    counted = hit.groupBy("origin").agg(F.count(F.lit(1)).alias("n_affected"))
    first = (
        hit.withColumn("_r", F.row_number().over(W.partitionBy("origin").orderBy("node_index")))
        .filter(F.col("_r") <= sample)
        .groupBy("origin")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("_r", "zone"))), lambda s: s["zone"]), "|"
            ).alias("affected_sample")
        )
    )
    return report.join(counted, "origin", "left").join(first, "origin", "left")


def affected_zones(
    panel: DataFrame, zones: DataFrame, wanted: DataFrame, lookback: int, horizon: int, rate: str = "rate"
) -> DataFrame:
    """Distinct (origin, zone) pairs where the zone lacks a finite value on an input day or the target.

    Only incomplete cells fan out, each to the few origins that use its day.
    """
    from zonewise.operators.clean import missing_cells

    holes = missing_cells(panel, zones).select("date", "zone").unionByName(
        panel.filter(F.col(rate).isNull()).select("date", "zone")
    )
    # A day without any report is absent for all zones: missing_cells lists those cells too.
    steps = F.concat(F.sequence(F.lit(0), F.lit(lookback - 1)), F.array(F.lit(-horizon)))
    fan = holes.select("zone", F.explode(F.transform(steps, lambda k: F.date_add(F.col("date"), k))).alias("origin"))
    return fan.join(wanted, "origin", "left_semi").distinct().join(zones.select("zone", "node_index"), "zone")


def lookback_arrays(panel: DataFrame, windows: DataFrame, lookback: int, rate: str = "rate") -> DataFrame:
    """One row per (sample, zone): the L input rates in date order, the anchor and the target rate.

    A calendar range frame gathers inputs, so a gap shortens the array instead of shifting it.
    The target is joined by date offset, never by row offset.
    """
    frame = W.partitionBy("zone").orderBy(day_number("date")).rangeBetween(-(lookback - 1), 0)
    gathered = panel.select(
        "zone", F.col("date").alias("origin"), F.collect_list(F.col(rate)).over(frame).alias("inputs")
    )
    inputs = gathered.join(windows.select("sample_id", "origin", "target"), "origin")
    y = panel.select("zone", F.col("date").alias("target"), F.col(rate).alias("y"))
    return (
        inputs.join(y, ["zone", "target"], "left")
        .filter(F.size("inputs") == lookback)
        .select("sample_id", "zone", "origin", "target", "inputs", F.element_at("inputs", -1).alias("anchor"), "y")
    )


def packed_looks(panel: DataFrame, windows: DataFrame, lookback: int, rate: str = "rate") -> DataFrame:
    """The rows of :func:`lookback_arrays` as one row per zone: ``ids`` of its samples and an array per column.

    The columns are ``anchor``, ``y``, ``level`` (of the anchor) and ``step`` (from the report before). The calendar bounds the
    arrays; ``panel``, a written table, has one row per zone and date, and the windows, a row per date, go to the tasks.
    """
    rows = windows.select("sample_id", day_number("origin").alias("o"), day_number("target").alias("t")).orderBy("sample_id").collect()
    ids, at, to = (np.array([r[i] for r in rows], dtype="int64") for i in range(3))

    def looks(table):
        day = table.column("day").to_numpy().astype("int64")
        lo = min(day.min(), at.min(initial=day[0]) - lookback)
        size = int(max(day.max(), at.max(initial=day[0]), to.max(initial=day[0])) - lo) + 1
        value, known = np.full(size, np.nan), np.zeros(size, dtype=bool)
        value[day - lo] = table.column("rate").to_numpy()
        known[day - lo] = table.column("rate").is_valid().to_numpy()
        before = np.concatenate([[0], np.cumsum(known)])
        whole = before[at - lo + 1] - before[at - lo + 1 - lookback] == lookback
        o, t = at[whole] - lo, to[whole] - lo
        columns = [value[o], value[t], np.log1p(np.maximum(value[o], 0.0)), value[o] - value[o - 1]]
        got = [pa.array([ids[whole]], pa.list_(pa.int64()))]
        for c, unknown in zip(columns, (None, ~known[t], None, None)):
            got.append(pa.ListArray.from_arrays([0, len(c)], pa.array(c, pa.float64(), mask=unknown)))
        return pa.table([table.column("zone").slice(0, 1), *got], names=["zone", "ids", "anchor", "y", "level", "step"])

    source = panel.select("zone", day_number("date").alias("day"), F.col(rate).cast("double").alias("rate"))
    arrays = ", ".join(f"{c} array<double>" for c in ("anchor", "y", "level", "step"))
    parts = parts_of(panel.sparkSession, panel.count() * ROW_BYTES)
    return source.repartition(parts, "zone").groupBy("zone").applyInArrow(looks, f"zone string, ids array<bigint>, {arrays}")


def unpacked(packed: DataFrame, windows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per sample and zone of packed ``columns``, with its origin and target; other columns are repeated."""
    rest = [c for c in packed.columns if c not in (*columns, "ids")]
    each = F.inline(F.arrays_zip(F.col("ids").alias("sample_id"), *columns)).alias("sample_id", *columns)
    return packed.select(*rest, each).join(windows.select("sample_id", "origin", "target"), "sample_id")


def consecutive_days(days: DataFrame, keys: Sequence[str], col: str, length: int) -> DataFrame:
    return days.groupBy(*keys).agg(
        ((F.datediff(F.max(col), F.min(col)) == length - 1) & (F.count_distinct(col) == length)).alias("consecutive")
    )


def horizon_interpretation(windows: DataFrame, horizon: int, span: int = 7) -> DataFrame:
    """Days the reported rate at the target covers, and whether they overlap the inputs."""
    return windows.select(
        "sample_id",
        F.date_add("origin", horizon - (span - 1)).alias("covers_from"),
        F.date_add("origin", horizon).alias("covers_to"),
        F.lit(horizon < span).alias("overlaps_inputs"),
    )


def fraction_split(windows: DataFrame, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Chronological floor/floor/remainder cut by (target, origin, id) over the windows of a calendar."""
    n = windows.agg(F.count(F.lit(1)).alias("n"))
    pos = F.row_number().over(W.orderBy("target", "origin", "sample_id"))
    a, b = F.floor(F.col("_n.n") * F.lit(train)), F.floor(F.col("_n.n") * F.lit(validation))
    return (
        windows.withColumn("_n", one_row(n))
        .withColumn("_p", pos)
        .withColumn("split", F.when(F.col("_p") <= a, TRAIN).when(F.col("_p") <= a + b, VALIDATION).otherwise(TEST))
        .drop("_n", "_p")
    )


def boundary_split(windows: DataFrame, ranges: dict[str, tuple[str, str]]) -> DataFrame:
    """Explicit target-date ranges; they must be chronological and must not overlap."""
    flat = [d for name in (TRAIN, VALIDATION, TEST) for d in ranges[name]]
    if any(a > b for a, b in zip(flat, flat[1:])) or flat[1] >= flat[2] or flat[3] >= flat[4]:
        raise ValueError("split ranges must be chronological and non-overlapping")
    label = F.lit(None).cast("string")
    for name in (TRAIN, VALIDATION, TEST):
        lo, hi = (F.lit(d).cast("date") for d in ranges[name])
        label = F.when(F.col("target").between(lo, hi), F.lit(name)).otherwise(label)
    return windows.withColumn("split", label)


def internal_halves(split: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Validation windows in two chronological halves: selection, then calibration."""
    val = split.filter(F.col("split") == VALIDATION)
    n = val.agg(F.count(F.lit(1)).alias("n"))
    pos = F.row_number().over(W.orderBy("target", "origin", "sample_id"))
    cut = F.floor(one_row(n)["n"] * F.lit(fraction))
    return val.withColumn("half", F.when(pos <= cut, "selection").otherwise("calibration"))


def pool_splits(splits: Sequence[DataFrame]) -> DataFrame:
    out = splits[0]
    for s in splits[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.drop("split")


def split_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.min("target").alias("first_target"),
        F.max("target").alias("last_target"),
        F.min("origin").alias("first_origin"),
        F.max("origin").alias("last_origin"),
    )


def operational_window(panel: DataFrame, zones: DataFrame, issue: Column, lookback: int, horizon: int, rate: str = "rate") -> DataFrame:
    """Unlabelled inputs per zone for one issue date; ``complete`` is false where a day is missing."""
    days = panel.withColumn("_i", issue).filter(
        (F.col("date") <= F.col("_i")) & (F.col("date") > F.date_sub("_i", lookback))
    )
    got = days.groupBy("zone", F.col("_i").alias("origin")).agg(
        F.array_sort(F.collect_list(F.struct("date", F.col(rate).alias("r")))).alias("_a")
    )
    return zones.select("zone").join(got, "zone", "left").select(
        "zone",
        "origin",
        F.date_add("origin", horizon).alias("target"),
        F.transform("_a", lambda s: s["r"]).alias("inputs"),
        (F.coalesce(F.size(F.filter("_a", lambda s: s["r"].isNotNull())), F.lit(0)) == lookback).alias("complete"),
    )


def window_set_check(cells: DataFrame, lookback: int, n_zones: Column) -> DataFrame:
    """Reload check: every sample must hold L values for each zone."""
    per = cells.groupBy("sample_id").agg(F.sum(F.size("inputs")).alias("n_cells"), F.count(F.lit(1)).alias("n_rows"))
    return per.withColumn("ok", (F.col("n_rows") == n_zones) & (F.col("n_cells") == n_zones * lookback))
