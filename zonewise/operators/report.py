"""Published tables: retrospective errors, periods, date selectors, rounding twins and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from zonewise.operators.evaluate import point_metrics, skill


def retrospective(pred: DataFrame, alphas: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Errors (predicted minus observed), flag by the update's own threshold, fusion weights by update."""
    wide = alphas.groupBy("update").pivot("graph", ["geo", "transport", "mobility"]).agg(F.first("alpha"))
    for g in ("geo", "transport", "mobility"):
        wide = wide.withColumnRenamed(g, f"alpha_{g}")
    e = F.col("mu") - F.col("y")
    return (
        pred.join(wide, "update", "left")
        .join(thresholds.select("update", F.col("sigma_p90").alias("_tau")), "update", "left")
        .withColumns(
            {
                "model_error": e,
                "model_absolute_error": F.abs(e),
                "persistence_absolute_error": F.abs(F.col("anchor") - F.col("y")),
                "flag": F.when(F.col("sigma") > F.col("_tau"), "high").otherwise("normal"),
                "forecast_status": F.lit("retrospective_evaluation"),
                "observed_target_available": F.lit(True),
            }
        )
        .drop("_tau")
    )


def date_selector(pred: DataFrame) -> DataFrame:
    return pred.select("origin", "target", "update").distinct()


def period_of(target: Column, cut: str, first: str = "wave", second: str = "late") -> Column:
    return F.when(target < F.lit(cut).cast("date"), first).otherwise(second)


def period_table(pred: DataFrame, cut: str) -> DataFrame:
    """Accuracy per period and overall from one rollup; bias is predicted minus observed."""
    p = pred.withColumn("period", period_of(F.col("target"), cut))
    sign = "predicted_minus_observed"
    names = ("mae", "rmse", "mse", "bias", "r2", "n")
    model = [c.alias(f"model_{n}") for c, n in zip(point_metrics(F.col("y"), F.col("mu"), sign), names)]
    base = [c.alias(f"persistence_{n}") for c, n in zip(point_metrics(F.col("y"), F.col("anchor"), sign), names)]
    return (
        p.rollup("period")
        .agg(
            F.min("target").alias("period_start"),
            F.max("target").alias("period_end"),
            F.count_distinct("target").alias("n_dates"),
            *model,
            *base,
        )
        .withColumn("period", F.coalesce("period", F.lit("overall")))
        .withColumns(
            {
                "mae_skill": skill(F.col("model_mae"), F.col("persistence_mae")),
                "mse_skill": skill(F.col("model_mse"), F.col("persistence_mse")),
            }
        )
    )


def future_table(live: DataFrame) -> DataFrame:
    """Forecast rows without truth: observation and error columns exist and are null."""
    empty = {c: F.lit(None).cast("double") for c in ("observed_rate", "model_error", "model_absolute_error", "persistence_absolute_error")}
    return live.withColumns(
        {**empty, "forecast_status": F.lit("unverified_extrapolation"), "observed_target_available": F.lit(False), "include_in_metrics": F.lit(False)}
    )


def rounded_twin(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """The article version of a table: listed columns rounded half-even, the rest untouched."""
    return df.withColumns({c: F.bround(c, d) for c, d in digits.items()})


def combine_cities(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for city, t in tables.items():
        t = t.withColumn("city", F.lit(city))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def zone_risk(forecast: DataFrame, names: DataFrame) -> DataFrame:
    keep = ["zone", "name", "target", "display_mean", "display_lower", "display_upper", "uncertainty_flag"]
    return forecast.join(names, "zone", "left").select(*keep)


def dashboard_summary(metrics: DataFrame) -> DataFrame:
    """Coverage in percent and rounded travel figures per scenario."""
    return metrics.select(
        "scenario",
        F.bround(F.col("population_covered") / F.col("population_total") * 100, 1).alias("coverage_pct"),
        "zones_covered",
        "unserved_zones",
        F.bround("mean_minutes", 2).alias("mean_minutes"),
        F.bround("max_minutes", 2).alias("max_minutes"),
    )
