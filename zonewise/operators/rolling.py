"""Rolling-origin evaluation: update dates, leakage-safe blocks, one-job refits, calibration, prediction tables.

All updates are rows. Panel cells are reduced to co-moments per target date once; blocks of an
update then merge date rows (a calendar-sized table), so refitting every update costs one pass
over the cells whatever the number of updates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from zonewise.functions import moments
from zonewise.functions.ranking import Rank, order_statistics, weighted_order_statistics
from zonewise.functions.scalars import one_row
from zonewise.session import pin

RAW80_Z, RAW95_Z = 1.2815515655, 1.9599639845
FIT, SELECT, CALIBRATE, PREDICT = "fitting", "selection", "calibration", "predict"


# -- schedule and blocks ------------------------------------------------------------


def update_dates(issues: DataFrame, frequency: int = 28, date: str = "origin") -> DataFrame:
    """First issue date, then each first issue at least ``frequency`` days later; (update, next_update).

    A fold over the sorted distinct issue dates, which are bounded by the calendar.
    """
    days = issues.agg(F.array_sort(F.collect_set(date)).alias("d"))
    picked = F.aggregate(
        "d",
        F.array().cast("array<date>"),
        lambda acc, d: F.when(
            (F.size(acc) == 0) | (d >= F.date_add(F.element_at(acc, -1), frequency)), F.array_append(acc, d)
        ).otherwise(acc),
    )
    at = days.select(picked.alias("u")).select(F.posexplode("u").alias("i", "update"), "u")
    return at.select(
        (F.col("i") + 1).alias("update_no"),
        "update",
        F.coalesce(F.get("u", F.col("i") + 1), F.lit("9999-12-31").cast("date")).alias("next_update"),
    )


def assign_blocks(
    pool: DataFrame,
    origin_split: DataFrame,
    updates: DataFrame,
    window_days: int | None = 730,
    n_selection: int = 28,
    n_calibration: int = 28,
) -> DataFrame:
    """(update, sample_id, origin, target, block): labelled dates up to the update, newest first.

    The newest ``n_calibration`` target dates calibrate, the ones before select, the rest fit,
    cut to the trailing window. Issues in [update, next update) are predicted.
    """
    ups = one_row(updates.agg(F.array_sort(F.collect_list(F.struct("update", "next_update", "update_no"))).alias("u")))["u"]
    fanned = pool.select("sample_id", "origin", "target", ups.alias("_u")).select("sample_id", "origin", "target", F.explode("_u").alias("u"))
    past = fanned.filter(F.col("u.update") >= F.col("target"))
    w = W.partitionBy("u.update").orderBy(F.desc("target"))
    held = n_selection + n_calibration
    ranked = past.select("sample_id", "origin", "target", "u", F.dense_rank().over(w).alias("r"))
    last_fit = F.max(F.when(F.col("r") == held + 1, F.col("target"))).over(W.partitionBy("u.update"))
    block = F.when(F.col("r") <= n_calibration, CALIBRATE).when(F.col("r") <= held, SELECT).otherwise(FIT)
    labelled = ranked.select(
        F.col("u.update_no").alias("update_no"), F.col("u.update").alias("update"), "sample_id", "origin", "target", block.alias("block"), last_fit.alias("_last")
    )
    if window_days is not None:
        labelled = labelled.filter((F.col("block") != FIT) | (F.col("target") >= F.date_sub("_last", window_days - 1)))
    coming = origin_split.select("sample_id", "origin", "target", ups.alias("_u")).select("sample_id", "origin", "target", F.explode("_u").alias("u"))
    ahead = coming.filter((F.col("u.update") <= F.col("origin")) & (F.col("u.next_update") > F.col("origin"))).select(F.col("u.update_no").alias("update_no"), F.col("u.update").alias("update"), "sample_id", "origin", "target", F.lit(PREDICT).alias("block"))
    return labelled.drop("_last").unionByName(ahead)


def short_history(updates: DataFrame, blocks: DataFrame) -> DataFrame:
    """Updates that cannot be run: a labelled block or the predict block has no samples."""
    seen = blocks.groupBy("update").agg(F.collect_set("block").alias("have"))
    need = F.array(*[F.lit(b) for b in (FIT, SELECT, CALIBRATE, PREDICT)])
    out = updates.join(seen, "update", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    return out.select("update", F.array_except(need, "have").alias("missing")).filter(F.size("missing") > 0)


def window_label(days: int | None) -> str:
    return "Wall" if days is None else f"W{days}"


def plan(pool: DataFrame, origin_split: DataFrame, updates: DataFrame, windows: Sequence[int | None] = (180, 365, 730, None), **kw) -> DataFrame:
    """Block sizes and date ranges for every training window and update."""
    out = None
    for days in windows:
        b = assign_blocks(pool, origin_split, updates, days, **kw).withColumn("window", F.lit(window_label(days)))
        out = b if out is None else out.unionByName(b)
    return out.groupBy("window", "update", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("target").alias("first_target"), F.max("target").alias("last_target")
    )


def leakage_audit(blocks: DataFrame, horizon: int = 7) -> DataFrame:
    """Violation counts per update; every count must be zero."""
    labelled = F.col("block") != PREDICT
    per_date = blocks.filter(labelled).groupBy("update", "target").agg(F.count_distinct("block").alias("n"))
    shared = per_date.groupBy("update").agg(F.count_if(F.col("n") > 1).alias("n_shared_dates"))
    repeated = blocks.filter(~labelled).groupBy("update", "origin", "sample_id").agg(F.count(F.lit(1)).alias("n"))
    twice = repeated.groupBy("update").agg(F.count_if(F.col("n") > 1).alias("n_repeated_predictions"))
    base = blocks.groupBy("update").agg(
        F.count_if(labelled & (F.col("target") > F.col("update"))).alias("n_late_targets"),
        F.count_if(~labelled & (F.datediff("target", "origin") != horizon)).alias("n_wrong_horizon"),
        F.count_if(~labelled & (F.col("origin") < F.col("update"))).alias("n_early_issues"),
    )
    out = base.join(shared, "update", "left").join(twice, "update", "left").fillna(0)
    names = [c for c in out.columns if c.startswith("n_")]
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return out.withColumn("passed", total == 0)


# -- per-update ridge regression from co-moments ---------------------------------------


FIRST, FINAL = "first", "final"


def fit_by_update(stats: DataFrame, blocks: DataFrame, width: int, keys: Sequence[str] = ("update",), date: str = "target", penalty: float = 1e-3) -> DataFrame:
    """(keys, role, n, mean, coef): a fit on the fitting block and one on fitting and selection, for all updates at once.

    ``stats`` are co-moments per date; an update merges those of its dates, so the cells are read
    once whatever the number of updates, and a small system is solved in each row.
    """
    roles = F.when(F.col("block") == FIT, F.array(F.lit(FIRST), F.lit(FINAL))).otherwise(F.array(F.lit(FINAL)))
    dates = blocks.filter(F.col("block").isin(FIT, SELECT)).select(*keys, "block", date).distinct()
    parts = dates.select(*keys, date, F.explode(roles).alias("role")).join(stats, date)
    merged = moments.merge_moments(parts, [*keys, "role"], width)
    return merged.select(*keys, "role", "n", "mean", moments.ridge(width, penalty).alias("coef"))


def selection_gate(selection: DataFrame) -> DataFrame:
    """Candidate accepted only if its selection MAE does not exceed persistence; else fall back."""
    model, base = F.avg(F.abs(F.col("y") - F.col("mu"))), F.avg(F.abs(F.col("y") - F.col("anchor")))
    return selection.groupBy("update").agg(model.alias("model_mae"), base.alias("persistence_mae")).withColumn(
        "decision", F.when(F.col("model_mae") <= F.col("persistence_mae"), "accepted").otherwise("fallback")
    )


def residual_sigma(selection: DataFrame, gate: DataFrame) -> DataFrame:
    """Residual sd per update and zone on the selection block, of the forecast that the gate lets through."""
    taken = F.when(F.col("decision") == "accepted", F.col("mu")).otherwise(F.col("anchor"))
    return selection.join(gate.select("update", "decision"), "update").groupBy("update", "zone").agg(
        F.sqrt(F.avg(F.pow(F.col("y") - taken, 2))).alias("sigma")
    )


def gated(cells: DataFrame, coefs: DataFrame, gate: DataFrame, features: Sequence[str]) -> DataFrame:
    """``mu`` by the refitted model where the gate has accepted it, the last report elsewhere."""
    change = F.when(F.col("decision") == "accepted", moments.linear_score("coef", features)).otherwise(0.0)
    return cells.join(coefs.select("update", "coef"), "update").join(gate.select("update", "decision"), "update").withColumn(
        "mu", F.col("anchor") + change
    ).drop("coef", *features)


def run(cells: DataFrame, blocks: DataFrame, features: Sequence[str]) -> dict[str, DataFrame]:
    """Fit, select, gate, refit on fitting + selection, calibrate and predict, for all updates together.

    ``cells``: sample_id, zone, origin, target, anchor, y and the features, one row per (sample, zone).
    An update whose candidate loses against persistence on its selection block calibrates and
    predicts with persistence, with the residual sd of persistence.
    """
    cells = pin(cells.withColumn("delta", F.col("y") - F.col("anchor")))
    blocks = pin(blocks)
    stats = pin(moments.co_moments(cells, [*features, "delta"], ["target"]))
    fits = pin(fit_by_update(stats, blocks, len(features) + 1))
    first, final = fits.filter(F.col("role") == FIRST), fits.filter(F.col("role") == FINAL)

    def rows(block: str) -> DataFrame:
        return cells.join(blocks.filter(F.col("block") == block).select("update", "update_no", "sample_id"), "sample_id")

    selection = pin(
        rows(SELECT).join(first.select("update", "coef"), "update").withColumn("mu", F.col("anchor") + moments.linear_score("coef", features)).drop("coef", *features)
    )
    gate = pin(selection_gate(selection))
    sigma = pin(residual_sigma(selection, gate))

    def scored(block: str) -> DataFrame:
        return gated(rows(block), final, gate, features).join(sigma, ["update", "zone"])

    return {"coef": final, "gate": gate, "sigma": sigma, "selection": selection, "calibration": scored(CALIBRATE), "prediction": scored(PREDICT)}


# -- calibration and intervals -----------------------------------------------------


def calibrate(scored: DataFrame, keys: Sequence[str] = ("update",), gammas=(0.2, 0.05), n_min: int = 20) -> DataFrame:
    """Finite-sample order statistics of abs(y - mu) / sigma per key, and the 90th percentile of sigma.

    k = ceil((n + 1)(1 - gamma)); unavailable when n < n_min or k > n. k is never truncated.
    """
    score = F.abs(F.col("y") - F.col("mu")) / F.col("sigma")
    ok = pin(scored.filter((F.col("sigma") > 0) & F.col("y").isNotNull() & F.col("mu").isNotNull()).select(*keys, "sigma", score.alias("score")))
    tags = {g: f"{round((1 - g) * 100)}" for g in gammas}
    rank = {g: F.ceil(F.round((F.col("n") + 1) * F.lit(1 - g), 9)).cast("long") for g in gammas}
    cut = order_statistics(ok, "score", {f"q{tags[g]}": Rank.kth(1 - g, rank[g]) for g in gammas}, keys)
    each = ok.groupBy(*keys, "sigma").agg(F.count(F.lit(1)).alias("_n"))  # the rows of a zone share one sigma
    p90 = weighted_order_statistics(each, "sigma", "_n", {"sigma_p90": Rank.linear(0.9)}, keys).drop("n")
    out = cut.join(p90, list(keys)) if keys else cut.withColumn("sigma_p90", one_row(p90)["sigma_p90"])
    cols = []
    for g in gammas:
        fits = (F.col("n") >= n_min) & (rank[g] <= F.col("n")) & (rank[g] >= 1)
        cols += [
            F.when(F.col("n") >= n_min, rank[g]).alias(f"k{tags[g]}"),
            F.when(fits, F.col(f"q{tags[g]}")).alias(f"q{tags[g]}"),
        ]
    last = tags[gammas[-1]]
    return out.select(*keys, "n", "sigma_p90", *cols).withColumn(
        "status", F.when(F.col(f"q{last}").isNotNull(), "available").otherwise("unavailable")
    )


def with_intervals(pred: DataFrame, calibration: DataFrame, keys: Sequence[str] = ("update",)) -> DataFrame:
    """Raw and calibrated bounds, uncertainty flag (strictly above the cut), clipped display values."""
    p = pred.join(calibration.select(*keys, "q80", "q95", "sigma_p90", "status"), list(keys), "left")
    mu, s = F.col("mu"), F.col("sigma")
    p = p.withColumns(
        {
            "raw80_lower": mu - RAW80_Z * s,
            "raw80_upper": mu + RAW80_Z * s,
            "raw95_lower": mu - RAW95_Z * s,
            "raw95_upper": mu + RAW95_Z * s,
            "calibrated80_lower": mu - F.col("q80") * s,
            "calibrated80_upper": mu + F.col("q80") * s,
            "calibrated95_lower": mu - F.col("q95") * s,
            "calibrated95_upper": mu + F.col("q95") * s,
            "uncertainty_flag": F.when(s > F.col("sigma_p90"), "high").when(s <= F.col("sigma_p90"), "normal"),
        }
    )
    lower = F.coalesce("calibrated95_lower", "raw95_lower")
    upper = F.coalesce("calibrated95_upper", "raw95_upper")
    zero = F.lit(0.0)
    return p.withColumns(
        {
            "display_mean": F.greatest(zero, mu),
            "display_lower": F.greatest(zero, lower),
            "display_upper": F.greatest(zero, upper),
            "display_interval": F.when(F.col("q95").isNotNull(), "calibrated95").otherwise("raw95"),
            "mean_clipped": mu < 0,
            "lower_clipped": lower < 0,
        }
    )


def attach_observed(table: DataFrame) -> DataFrame:
    """Residual and coverage flags; calibrated coverage is null where there is no calibration."""
    y = F.col("y")
    return table.withColumns(
        {
            "residual": y - F.col("mu"),
            "in_raw95": y.between(F.col("raw95_lower"), F.col("raw95_upper")),
            "in_calibrated80": y.between(F.col("calibrated80_lower"), F.col("calibrated80_upper")),
            "in_calibrated95": y.between(F.col("calibrated95_lower"), F.col("calibrated95_upper")),
        }
    )


def choose_window(metrics: DataFrame) -> DataFrame:
    """Largest MAE skill, then smallest MAE, then smallest absolute bias; missing skill last."""
    return metrics.orderBy(F.desc_nulls_last("mae_skill"), F.asc("model_mae"), F.abs("model_bias"), "window").limit(1)


def alpha_trajectory(alphas: DataFrame) -> DataFrame:
    """Fusion weights per update in order with the change from the update before."""
    w = W.partitionBy("graph").orderBy("update")
    return alphas.withColumn("change", F.col("alpha") - F.lag("alpha").over(w))


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """Row with the newest ``by`` per key, through a map-side combined max."""
    rest = [c for c in df.columns if c not in (key, by)]
    return df.groupBy(key).agg(F.max(F.struct(by, *rest)).alias("_r")).select(key, "_r.*")


# -- operational use -----------------------------------------------------------------


def operational_checks(windows: DataFrame, coef: DataFrame, alphas: DataFrame, update: Column, issue: Column, span: int = 27) -> DataFrame:
    """Named pass/fail rows that gate a live forecast."""
    w = windows.agg(
        F.bool_and("complete").alias("complete_inputs"),
        F.bool_and(F.col("origin") <= issue).alias("no_data_after_issue"),
        F.bool_and(F.datediff("target", "origin") == 7).alias("horizon_is_seven"),
        F.bool_and(F.size("inputs") == 7).alias("lookback_is_seven"),
    )
    a = alphas.agg((F.abs(F.sum("alpha") - 1) < 1e-6).alias("alpha_sums_to_one"))
    c = coef.agg((F.count(F.lit(1)) == 1).alias("one_model_for_update"))
    checks = {
        "live_window": issue.between(update, F.date_add(update, span)),
        **{n: F.col(n) for n in w.columns},
        "alpha_sums_to_one": one_row(a)["alpha_sums_to_one"],
        "one_model_for_update": one_row(c)["one_model_for_update"],
    }
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.coalesce(v, F.lit(False)).alias("passed")) for n, v in checks.items()])
    return w.select(F.inline(rows))


def replay(predictions: DataFrame, issue: Column) -> DataFrame:
    """Stored predictions for one issue date."""
    return predictions.filter(F.col("origin") == issue)


def forecast_route(requests: DataFrame, known_area: Column, first: Column, last: Column) -> DataFrame:
    """Retrospective lookup, live inference, rolling update or new-region route per request row."""
    d = F.col("issue")
    route = (
        F.when(~known_area, "new_region")
        .when(d.between(first, last), "retrospective")
        .when((d > last) & (d <= F.date_add(last, 28)), "inference")
        .otherwise("rolling_update")
    )
    return requests.withColumn("route", route)
