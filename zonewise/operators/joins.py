"""Keyed joins with the contracts the pipeline relies on.

Which side is broadcast is left to the optimizer, which compares real table sizes with
``spark.sql.autoBroadcastJoinThreshold``; nothing here forces a broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from zonewise.operators.checks import as_check, enforce, unique_key


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], verify: bool = True) -> DataFrame:
    """Many-to-one left join: the right key must be unique, so the row count cannot change."""
    if verify:
        enforce(unique_key(right, keys, "lookup_key_not_unique"))
    return left.join(right, list(keys), "left")


def align_to_master(
    master: DataFrame, table: DataFrame, key: str, verify: bool = True
) -> DataFrame:
    """One-to-one: the master drives the rows; missing and extra keys are errors."""
    if verify:
        enforce(
            as_check(missing_keys(master, table, key), "missing_keys", "error", F.col(key))
            .unionByName(as_check(missing_keys(table, master, key), "extra_keys", "error", F.col(key)))
            .unionByName(unique_key(table, [key]))
        )
    return master.join(table, key, "left")


def missing_keys(required: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return required.select(key).distinct().join(have.select(key), key, "left_anti")


def keep_known_pairs(pairs: DataFrame, zones: DataFrame, sites: DataFrame) -> DataFrame:
    return pairs.join(zones.select("zone"), "zone", "left_semi").join(sites.select("site_id"), "site_id", "left_semi")


def small_area_to_zone(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Rows with their zone; rows outside the area drop out."""
    return rows.join(lookup, key, "inner")


def attach_xy(rows: DataFrame, centroids: DataFrame, key: str = "zone") -> DataFrame:
    xy = centroids.select(key, F.bround("x", 2).alias("zone_x"), F.bround("y", 2).alias("zone_y"))
    return rows.join(xy, key, "left")


def population_fallback(
    zones: DataFrame, planning: DataFrame | None, panel: DataFrame, static: DataFrame
) -> DataFrame:
    """Planning table, else last panel report, else the static total; source kept."""
    last = panel.groupBy("zone").agg(F.max_by("population", "date").alias("p_panel"))
    out = zones.join(last, "zone", "left").join(static.select("zone", F.col("total_population").alias("p_static")), "zone", "left")
    if planning is not None:
        out = out.join(planning.select("zone", F.col("population").alias("p_plan")), "zone", "left")
    else:
        out = out.withColumn("p_plan", F.lit(None).cast("double"))
    source = F.when(F.col("p_plan").isNotNull(), "planning").when(F.col("p_panel").isNotNull(), "panel").otherwise("static")
    return out.select(
        *zones.columns, F.coalesce("p_plan", "p_panel", "p_static").alias("population"), source.alias("population_source")
    )
