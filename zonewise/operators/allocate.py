"""Site selection: demand weights, greedy covering / p-median, assignment, metrics and comparison.

Scenarios are rows, so all of them are solved together. The zone x site matrix stays long.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from zonewise.functions.ranking import quantiles
from zonewise.functions.scalars import one_row, relative_to_mean, required_code, unit_share
from zonewise.operators.checks import as_check, unique_key
from zonewise.session import pin

UNREACHED = 1.0e6
SCENARIOS = ("coverage", "equity", "preventive", "balanced")
COVER_FIRST = ("coverage", "preventive")
GAIN_TYPE = "decimal(28,9)"


# -- inputs -------------------------------------------------------------------------


def load_sites(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Resolve id / easting / northing by the first alias present; trims ids. A row without an id stops the query."""
    def pick(names):
        found = [n for n in names if n in df.columns]
        if not found:
            raise ValueError(f"none of {list(names)} present")
        return F.col(found[0])

    used = {n for names in aliases.values() for n in names}
    rest = [c for c in df.columns if c not in used]
    out = df.select(*[pick(names).alias(k) for k, names in aliases.items()], *rest)
    return out.withColumn("site_id", required_code(F.col("site_id"), "site_id"))


def site_checks(sites: DataFrame, types: Sequence[str]) -> DataFrame:
    """Repeated ids, and whether any site is eligible at all."""
    none = sites.agg(F.count_if(F.lower("site_type").isin(*[t.lower() for t in types])).alias("n")).filter("n = 0")
    return unique_key(sites, ["site_id"], "site_id_repeated").unionByName(as_check(none, "no_eligible_site", "error", F.col("n")))


def eligible_sites(sites: DataFrame, types: Sequence[str]) -> DataFrame:
    return sites.filter(F.lower("site_type").isin(*[t.lower() for t in types]))


def travel_rules() -> dict[str, tuple[str, Column, Column]]:
    """Contract of the long travel matrix: keys present, minutes finite and not negative, null allowed."""
    m, name = F.col("minutes"), F.concat_ws("/", "zone", "site_id", "mode")
    return {
        "travel_key_missing": ("error", F.col("zone").isNull() | F.col("site_id").isNull() | F.col("mode").isNull(), name),
        "travel_not_finite": ("error", F.isnan(m) | (m == float("inf")), name),
        "travel_negative": ("error", m < 0, name),
        "travel_unreachable": ("accepted", m.isNull(), name),
    }


def unreachable_sites(travel: DataFrame) -> DataFrame:
    """Sites without a single reachable zone on at least one mode."""
    per = travel.groupBy("site_id", "mode").agg(F.count("minutes").alias("n"))
    return per.filter("n = 0").select("site_id").distinct()


def drop_sites(table: DataFrame, sites: DataFrame) -> DataFrame:
    return table.join(sites.select("site_id"), "site_id", "left_anti")


def prepare_pairs(zones: DataFrame, sites: DataFrame, travel: DataFrame, mode: str) -> DataFrame:
    """Fastest minutes per known (zone, site) on one mode; unreachable pairs are simply absent."""
    return (
        travel.filter((F.col("mode") == mode) & F.col("minutes").isNotNull())
        .join(zones.select("zone"), "zone", "left_semi")
        .join(sites.select("site_id"), "site_id", "left_semi")
        .groupBy("zone", "site_id")
        .agg(F.min("minutes").alias("minutes"))
    )


def cover_score(minutes: Column, threshold: float, kind: str = "binary") -> Column:
    if kind == "binary":
        return F.coalesce((minutes <= threshold).cast("double"), F.lit(0.0))
    if kind == "fractional":
        return F.coalesce(F.greatest(F.lit(0.0), 1 - minutes / threshold), F.lit(0.0))
    raise ValueError(f"unknown cover score {kind!r}")


def resolve_forecast(forecast: DataFrame, wanted: str | None = None) -> DataFrame:
    """Requested target date when present, else the newest; last row per zone; first existing rate alias."""
    rate = next(c for c in ("predicted_rate", "mu", "predicted_mean", "display_mean") if c in forecast.columns)
    sigma = next((c for c in ("predicted_sigma", "sigma") if c in forecast.columns), None)
    has = F.max(F.when(F.col("target") == F.lit(wanted).cast("date"), F.col("target"))) if wanted else F.lit(None).cast("date")
    day = forecast.agg(F.coalesce(has, F.max("target")).alias("d"))
    rows = forecast.filter(F.col("target") == one_row(day)["d"])
    return rows.groupBy("zone").agg(
        F.max("target").alias("target"),
        F.max_by(rate, "origin").alias("predicted_rate"),
        (F.max_by(sigma, "origin") if sigma else F.lit(0.0)).alias("predicted_sigma"),
    )


# -- demand ---------------------------------------------------------------------------


def _clipped(zones: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return zones.withColumns(
        {
            c: F.greatest(zero, F.col(c))
            for c in ("income_rate", "pt_gp_min", "predicted_rate", "predicted_sigma")
        }
    )


def hotspots(zones: DataFrame) -> DataFrame:
    """``high_risk``: rate at or above its 75th percentile. ``high_uncertainty``: flag, else sigma >= p90."""
    z = _clipped(zones)
    p75 = quantiles(z, "predicted_rate", {"v": 0.75})
    risk = F.col("predicted_rate") >= one_row(p75)["v"]
    if "uncertainty_flag" in zones.columns:
        unc = F.lower("uncertainty_flag") == "high"
    else:
        unc = F.col("predicted_sigma") >= one_row(quantiles(z, "predicted_sigma", {"v": 0.9}))["v"]
    return z.withColumns({"high_risk": F.coalesce(risk, F.lit(False)), "high_uncertainty": F.coalesce(unc, F.lit(False))})


def priority_labels(zones: DataFrame) -> DataFrame:
    z = hotspots(zones)
    mid = {c: one_row(quantiles(zones, c, {"v": 0.5}))["v"] for c in ("income_rate", "pt_gp_min")}
    return z.withColumns(
        {"more_deprived_than_median": F.col("income_rate") > mid["income_rate"], "worse_access_than_median": F.col("pt_gp_min") > mid["pt_gp_min"]}
    )


def demand_weights(zones: DataFrame) -> DataFrame:
    """(scenario, zone, demand) for every scenario; whole-table means and sums come as one-row scalars."""
    z = pin(hotspots(zones))
    m = one_row(z.agg(*[F.avg(c).alias(c) for c in ("income_rate", "pt_gp_min", "predicted_rate", "predicted_sigma")]))
    pop = F.col("population")
    rel = {c: relative_to_mean(F.col(c), F.col("_m")[c]) for c in ("income_rate", "pt_gp_min", "predicted_rate", "predicted_sigma")}
    zero = F.lit(0.0)
    parts = pin(
        z.withColumn("_m", m).select(
            "zone",
            pop.cast("double").alias("coverage"),
            (pop * rel["income_rate"] * rel["pt_gp_min"]).alias("equity"),
            F.when(F.col("high_risk"), pop * rel["predicted_rate"]).otherwise(zero).alias("risk"),
            F.when(F.col("high_uncertainty"), pop * rel["predicted_sigma"]).otherwise(zero).alias("uncertainty"),
        )
    )
    t = one_row(parts.agg(*[F.sum(c).alias(c) for c in ("coverage", "equity", "risk", "uncertainty")]))
    u = {c: unit_share(F.col(c), F.col("_t")[c]) for c in ("coverage", "equity", "risk", "uncertainty")}
    hot = u["risk"] + u["uncertainty"]
    hot_total = F.when(F.col("_t.risk") > 0, 1.0).otherwise(0.0) + F.when(F.col("_t.uncertainty") > 0, 1.0).otherwise(0.0)
    wide = parts.withColumn("_t", t).select(
        "zone",
        "coverage",
        "equity",
        hot.alias("preventive"),
        (u["coverage"] + u["equity"] + unit_share(hot, hot_total)).alias("balanced"),
    )
    return wide.unpivot(["zone"], list(SCENARIOS), "scenario", "demand")


# -- selection --------------------------------------------------------------------------


def site_gains(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Covering gain and travel-time gain of every candidate under the current state.

    ``pairs`` carry ``score`` and ``minutes`` (null above the threshold).
    """
    gain = F.col("demand") * F.greatest(F.lit(0.0), F.col("current") - F.col("minutes"))
    exact = lambda c: F.sum(c.cast(GAIN_TYPE))  # noqa: E731 - decimal sums do not depend on arrival order
    return (
        pairs.join(state, "zone")
        .groupBy("scenario", "site_id")
        .agg(
            exact(F.col("remaining") * F.col("score")).alias("cover_gain"),
            exact(F.coalesce(gain, F.lit(0.0))).alias("access_gain"),
        )
    )


def greedy_select(
    pairs: DataFrame, demand: DataFrame, threshold: float, n_sites: int = 6, kind: str = "binary", sites: DataFrame | None = None
) -> DataFrame:
    """(scenario, step, site_id, cover_gain, access_gain) for ``n_sites`` rounds.

    ``sites`` names all eligible sites; those that no zone reaches stay in the race with no gain.

    A round is one join and one aggregate over the pairs whatever the number of candidates.
    Ties go to the smaller site id. Gains are exact decimal sums, so the order in which
    partial sums arrive cannot change the choice.
    """
    m = F.col("minutes")
    pairs = pin(pairs.select("zone", "site_id", cover_score(m, threshold, kind).alias("score"), F.when(m <= threshold, m).alias("minutes")))
    start = pin(demand.select("scenario", "zone", "demand"))
    cover_first = F.col("scenario").isin(*COVER_FIRST)
    first = F.when(cover_first, F.col("cover_gain")).otherwise(F.col("access_gain"))
    second = F.when(cover_first, F.col("access_gain")).otherwise(F.col("cover_gain"))
    chosen: DataFrame | None = None
    if sites is not None:
        names = start.agg(F.collect_set("scenario").alias("s"))
        every = sites.select("site_id").distinct().withColumn("scenario", F.explode(one_row(names)["s"]))
    else:
        every = pairs.join(start, "zone").select("scenario", "site_id").distinct()
    every, pairs = pin(every), pin(_gainful(pairs))
    for step in range(1, n_sites + 1):
        # Written, so that its true size is known: it goes to the tasks that read the pairs, and not the pairs to its one task.
        state = pin(greedy_state(pairs, start, chosen))
        gains = every.join(site_gains(pairs, state), ["scenario", "site_id"], "left").fillna({"access_gain": 0, "cover_gain": 0})
        if chosen is not None:
            gains = gains.join(chosen.select("scenario", "site_id"), ["scenario", "site_id"], "left_anti")
        best = pin(
            gains.groupBy("scenario")
            .agg(F.min(F.struct((-first).alias("a"), (-second).alias("b"), "site_id", "cover_gain", "access_gain")).alias("w"))
            .select("scenario", F.lit(step).alias("step"), "w.site_id", "w.cover_gain", "w.access_gain")
        )
        chosen = best if chosen is None else chosen.unionByName(best)
    return chosen


def _gainful(pairs: DataFrame) -> DataFrame:
    """Pairs that can add to a gain, in a fixed number of parts: a round makes a row per pair and scenario of them."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.filter((F.col("score") != 0) | F.col("minutes").isNotNull()).repartition(parts, "site_id")


def greedy_state(pairs: DataFrame, demand: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """Remaining demand and best time so far per (scenario, zone), derived from the sites chosen."""
    if chosen is None:
        return demand.withColumns({"remaining": F.col("demand"), "current": F.lit(UNREACHED)})
    won = (
        pairs.join(chosen.select("scenario", "site_id"), "site_id")
        .groupBy("scenario", "zone")
        .agg(F.product(1 - F.least("score", F.lit(1.0))).alias("_left"), F.min("minutes").alias("_best"))
    )
    return demand.join(won, ["scenario", "zone"], "left").select(
        "scenario",
        "zone",
        "demand",
        (F.col("demand") * F.coalesce("_left", F.lit(1.0))).alias("remaining"),
        F.least(F.lit(UNREACHED), F.coalesce("_best", F.lit(UNREACHED))).alias("current"),
    )


def assign_zones(pairs: DataFrame, zones: DataFrame, chosen: DataFrame, threshold: float) -> DataFrame:
    """Nearest selected site per (scenario, zone); ties to the earlier selected; unserved beyond the threshold."""
    near = (
        pairs.join(chosen.select("scenario", "step", "site_id"), "site_id")
        .filter(F.col("minutes") <= threshold)
        .groupBy("scenario", "zone")
        .agg(F.min(F.struct("minutes", "step", "site_id")).alias("w"))
        .select("scenario", "zone", "w.site_id", "w.minutes")
    )
    names = chosen.select("scenario").distinct().agg(F.collect_set("scenario").alias("s"))
    every = zones.withColumn("scenario", F.explode(one_row(names)["s"]))
    return every.join(near, ["scenario", "zone"], "left").withColumn("served", F.col("site_id").isNotNull())


def allocation_metrics(assigned: DataFrame, by: Sequence[str] = ("scenario",)) -> DataFrame:
    """Covered and unserved population and zones, travel among the served. ``assigned`` carries population."""
    s, pop = F.col("served"), F.col("population")
    return assigned.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(s, pop)), F.lit(0.0)).alias("population_covered"),
        F.count_if(s).alias("zones_covered"),
        F.avg(F.when(s, F.col("minutes"))).alias("mean_minutes"),
        F.max(F.when(s, F.col("minutes"))).alias("max_minutes"),
        F.coalesce(F.sum(F.when(~s, pop)), F.lit(0.0)).alias("unserved_population"),
        F.count_if(~s).alias("unserved_zones"),
        F.count(F.lit(1)).alias("n_zones"),
        F.sum(pop).alias("population_total"),
    )


def site_load(assigned: DataFrame) -> DataFrame:
    return assigned.filter("served").groupBy("scenario", "site_id").agg(
        F.count(F.lit(1)).alias("n_zones"), F.sum("population").alias("population_served")
    )


Solver = Callable[[DataFrame, DataFrame, float, int], DataFrame]


def run_scenarios(
    zones: DataFrame, sites: DataFrame, travel: DataFrame, mode: str = "drive", threshold: float = 20.0, n_sites: int = 6, solver: Solver | None = None
) -> dict[str, DataFrame]:
    """Prepare, weigh, select, assign and measure all scenarios. ``solver`` replaces the greedy step."""
    zones = pin(zones)
    pairs = pin(prepare_pairs(zones, sites, travel, mode))
    demand = pin(demand_weights(zones))
    chosen = (solver or partial(greedy_select, sites=sites))(pairs, demand, threshold, n_sites)
    assigned = pin(assign_zones(pairs, zones.select("zone", "population"), chosen, threshold))
    return {"pairs": pairs, "demand": demand, "selected": chosen, "assigned": assigned, "metrics": allocation_metrics(assigned)}


def validate_result(chosen: DataFrame, assigned: DataFrame, sites: DataFrame, zones: DataFrame, n_sites: int) -> DataFrame:
    """Known sites, exactly n per scenario, known zones, assignments only to selected sites."""
    per = chosen.groupBy("scenario").agg(F.count_distinct("site_id").alias("n")).filter(F.col("n") != n_sites)
    strangers = assigned.filter("served").join(chosen.select("scenario", "site_id"), ["scenario", "site_id"], "left_anti")
    return (
        as_check(chosen.join(sites.select("site_id"), "site_id", "left_anti"), "unknown_site", "error", F.col("site_id"))
        .unionByName(as_check(per, "wrong_site_count", "error", F.col("scenario")))
        .unionByName(as_check(assigned.join(zones.select("zone"), "zone", "left_anti"), "unknown_zone", "error", F.col("zone")))
        .unionByName(as_check(strangers, "assigned_to_unselected", "error", F.col("site_id")))
    )


def site_zone_info(sites: DataFrame, pairs: DataFrame, site_ids: Sequence[str]) -> DataFrame:
    """Chosen sites with the zones they reach."""
    return sites.filter(F.col("site_id").isin(*site_ids)).join(pairs, "site_id", "left")


def city_comparison(assigned: DataFrame, city: str = "city") -> DataFrame:
    m = allocation_metrics(assigned, (city, "scenario"))
    return m.withColumn("coverage_pct", F.col("population_covered") / F.col("population_total") * 100)


def indexed_site_table(chosen: DataFrame, sites: DataFrame) -> DataFrame:
    """Selected sites with coordinates and the 1-based map index (the selection step)."""
    return chosen.join(sites, "site_id").select("scenario", F.col("step").alias("map_index"), "site_id", "site_name", "site_type", "x", "y")
