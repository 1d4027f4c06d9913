"""Exact Shapley coalitions over location and zone features, fitted as one fixed linear map.

The constrained kernel-weighted fit is linear in the 2^n coalition values, so its 13 x 128
coefficients are computed once; per zone the explanation is 13 weighted sums in one group-by.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from zonewise.functions.moments import linear_score
from zonewise.functions.ranking import quantiles
from zonewise.functions.scalars import one_row
from zonewise.operators.design import Design, at_scale
from zonewise.session import pin

LOCATION = "location"


def kernel_weight(n: int, s: int) -> float:
    """Shapley kernel for a coalition of size s, 0 < s < n."""
    return (n - 1) / (comb(n, s) * s * (n - s))


@lru_cache(maxsize=None)
def fit_matrix(n_features: int) -> np.ndarray:
    """Rows: location, mains, interactions. Columns: masks (bit 0 = location, bit i = feature i)."""
    n, free = n_features + 1, 1 + 2 * n_features
    masks = np.arange(2**n)
    bits = (masks[:, None] >> np.arange(n)) & 1
    loc, mains = bits[:, :1].astype(float), bits[:, 1:].astype(float)
    design = np.hstack([loc, mains, loc * mains])
    size = bits.sum(axis=1)
    inner = (size > 0) & (size < n)
    w = np.array([kernel_weight(n, int(s)) if ok else 0.0 for s, ok in zip(size, inner)])
    less_empty = np.eye(len(masks))
    less_empty[:, 0] -= 1.0
    gram = design.T @ (w[:, None] * design)
    system = np.zeros((free + 1, free + 1))
    system[:free, :free], system[:free, free], system[free, :free] = gram, 1.0, 1.0
    right = np.vstack([(design * w[:, None]).T @ less_empty, less_empty[-1:]])
    return np.linalg.solve(system, right)[:free]


def reference_point(zones: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median of every column over the zones, as one row."""
    return reference_of(zones.unpivot([], list(columns), "feature", "value"), columns)


def reference_of(long: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same from rows (feature, value)."""
    mid = pin(quantiles(long, "value", {"v": 0.5}, ["feature"]))
    return mid.agg(*[F.max(F.when(F.col("feature") == c, F.col("v"))).alias(c) for c in columns])


def echoes(support: DataFrame, zones: DataFrame, steps: int) -> DataFrame:
    """(zone, r1, r2, ...): what comes back to a zone, after 1, 2, ... steps, of a change of 1 in its own feature.

    The change is carried forward as a sparse table of (source, node) entries, so a zone costs its
    neighbourhood and not the graph; the terms are those of ``design.hops``.
    """
    links = support.filter("direction = 'forward'").select("row", "col", "w")
    start = zones.select(F.col("zone").alias("source"), F.col("zone").alias("node"), F.lit(1.0).alias("v"))
    older, newer, out = None, start, zones.select("zone")
    for k in range(1, steps + 1):
        moved = newer.join(links, F.col("node") == F.col("col")).select("source", F.col("row").alias("node"), (F.col("w") * F.col("v") * (1 if k == 1 else 2)).alias("v"))
        if older is not None:
            moved = moved.unionByName(older.withColumn("v", -F.col("v")))
        older, newer = newer, pin(moved.groupBy("source", "node").agg(F.sum("v").alias("v")))
        back = newer.filter("source = node").select(F.col("source").alias("zone"), F.col("v").alias(f"r{k}"))
        out = out.join(back, "zone", "left").withColumn(f"r{k}", F.coalesce(f"r{k}", F.lit(0.0)))
    return out


def coalition_scores(zones: DataFrame, design: Design, reference: DataFrame, marks: DataFrame) -> DataFrame:
    """(zone, mask, value): the forecast of every zone when the players outside the mask take the reference.

    ``zones``: zone, anchor, the raw features and coordinates, the columns of ``design``, ``coef`` and
    the echoes. Only the target zone's features change: its reports, its neighbours and the last
    report are held, and the change reaches the carried terms by the echo of the zone.
    """
    full = F.col("anchor") + linear_score("coef", design.columns)
    kept = zones.withColumn("_full", full).withColumn("_r", one_row(reference)).withColumn("_m", one_row(marks))
    n = len(design.features) + 1
    masked = kept.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(2**n - 1))))
    at = {c: F.col("coef")[i] for i, c in enumerate(design.columns, start=1)}
    bit = {f: i for i, f in enumerate(design.features, start=1)} | {c: 0 for c in design.coords}
    new = {f"_z_{c}": F.when(F.bit_get(F.col("mask"), F.lit(bit[c])) == 1, F.col(f"z_{c}")).otherwise(at_scale(F.col("_r")[c], F.col("_m"), c)) for c in design.static}
    moved = masked.withColumns(new)
    value = F.col("_full")
    for c in design.static:
        share = at[f"z_{c}"]
        if c in design.features:
            for k in range(1, design.reach + 1):
                share = share + at[f"f{k}_z_{c}"] * F.col(f"r{k}")
        value = value + share * (F.col(f"_z_{c}") - F.col(f"z_{c}"))
    for c in design.coords:
        for f in design.features:
            value = value + at[f"{c}_{f}"] * (F.col(f"_z_{c}") * F.col(f"_z_{f}") - F.col(f"{c}_{f}"))
    return moved.select("zone", "mask", value.alias("value"))


def shapley(values: DataFrame, features: Sequence[str], key: str = "zone") -> DataFrame:
    """(key, player, component, phi) with phi_0 and the full prediction, from (key, mask, value)."""
    m = fit_matrix(len(features))
    names = [(LOCATION, "location")] + [(f, "main") for f in features] + [(f, "interaction") for f in features]
    full = 2 ** (len(features) + 1) - 1
    sums = [F.sum(F.element_at(F.lit([float(c) for c in row]), F.col("mask") + 1) * F.col("value")).alias(f"p{i}") for i, row in enumerate(m)]
    wide = values.groupBy(key).agg(
        F.max(F.when(F.col("mask") == 0, F.col("value"))).alias("phi_0"),
        F.max(F.when(F.col("mask") == full, F.col("value"))).alias("prediction"),
        *sums,
    )
    cells = F.array(
        *[F.struct(F.lit(p).alias("player"), F.lit(c).alias("component"), F.col(f"p{i}").alias("phi")) for i, (p, c) in enumerate(names)]
    )
    return wide.select(key, "phi_0", "prediction", F.inline(cells))


def additivity(explained: DataFrame, key: str = "zone", tolerance: float = 1e-6) -> DataFrame:
    gap = F.abs(F.max("phi_0") + F.sum("phi") - F.max("prediction"))
    return explained.groupBy(key).agg(gap.alias("additivity_error"), (gap <= tolerance).alias("additive"))


def with_baseline(explained: DataFrame, key: str = "zone") -> DataFrame:
    """Explanation rows plus one baseline row per zone."""
    base = explained.groupBy(key).agg(F.max("phi_0").alias("phi")).select(
        key, F.lit("baseline").alias("player"), F.lit("baseline").alias("component"), "phi"
    )
    return explained.select(key, "player", "component", "phi").unionByName(base)


def net_contributions(explained: DataFrame, key: str = "zone") -> DataFrame:
    """Main plus interaction per player, with its direction."""
    return explained.groupBy(key, "player").agg(F.sum("phi").alias("net")).withColumn(
        "direction", F.when(F.col("net") >= 0, "raises").otherwise("lowers")
    )


def explanation_summary(explained: DataFrame) -> DataFrame:
    inter = F.when(F.col("component") == "interaction", F.abs("phi"))
    main = F.when(F.col("component") != "interaction", F.col("phi"))
    return explained.groupBy("player").agg(
        F.avg(F.abs(main)).alias("mean_abs"),
        F.avg(main).alias("mean_signed"),
        F.avg(inter).alias("mean_abs_interaction"),
        F.avg((main > 0).cast("double")).alias("share_positive"),
        F.avg((main < 0).cast("double")).alias("share_negative"),
    )


def leading_factors(summary: DataFrame, top: int = 8) -> DataFrame:
    return summary.orderBy(F.desc("mean_abs"), "player").limit(top)


def zone_outputs(forecast: DataFrame, names: DataFrame, explained: DataFrame, players: Sequence[str], key: str = "zone") -> DataFrame:
    """Forecast, names and explanations pivoted to one column per player."""
    wide = net_contributions(explained, key).groupBy(key).pivot("player", list(players)).agg(F.first("net"))
    return forecast.join(names, key, "left").join(wide, key, "left")


def vector_diagnostics(vectors: DataFrame, column: str, flat: float = 1e-6) -> DataFrame:
    """Per dimension: mean, population sd, near-constant flag and non-finite count."""
    v = F.col("v")
    ok = v.isNotNull() & ~F.isnan(v)
    return (
        vectors.select(F.posexplode(F.col(column)).alias("dim", "v"))
        .withColumn("v", v.cast("double"))
        .groupBy("dim")
        .agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), (F.stddev_pop(v) < flat).alias("near_constant"), F.count_if(~ok).alias("n_bad"))
    )


def row_spread(column: str) -> Column:
    """Population sd inside one vector."""
    x = F.transform(F.col(column), lambda e: e.cast("double"))
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, e: a + e) / n
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + (e - mean) * (e - mean)) / n)
