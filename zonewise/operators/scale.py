"""Scalers and residual features over window rows (one row per sample and zone)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from zonewise.functions.scalars import one_row

EPSILON = 1e-8


def guarded_scale(sd: Column, eps: float = EPSILON) -> Column:
    return F.when(sd < eps, F.lit(1.0)).otherwise(sd)


def fit_zone_scaler(panel: DataFrame, train: DataFrame, lookback: int, rate: str = "rate", eps: float = EPSILON) -> DataFrame:
    """Mean and population sd per zone over the *unique* training input dates."""
    days = train.select(F.explode(F.sequence("input_start", "origin", F.expr("interval 1 day"))).alias("date")).distinct()
    used = panel.join(days, "date", "left_semi")
    return used.groupBy("zone").agg(
        F.avg(rate).alias("train_mean"),
        F.stddev_pop(rate).alias("train_std"),
        guarded_scale(F.stddev_pop(rate), eps).alias("scale"),
        F.count(rate).alias("n_dates"),
        (F.stddev_pop(rate) < eps).alias("near_zero_variance"),
    )


def fit_overlap_scaler(cells: DataFrame, eps: float = EPSILON) -> DataFrame:
    """Per zone over all look-back cells, overlaps counted (the policy used after a recut).

    Sums are taken inside each array first, so no row is multiplied by the look-back length.
    """
    n = F.size("inputs")
    s1 = F.aggregate("inputs", F.lit(0.0), lambda a, x: a + x)
    s2 = F.aggregate("inputs", F.lit(0.0), lambda a, x: a + x * x)
    mean = F.sum(s1) / F.sum(n)
    sd = F.sqrt(F.greatest(F.sum(s2) / F.sum(n) - mean * mean, F.lit(0.0)))
    return cells.groupBy("zone").agg(
        mean.alias("train_mean"), sd.alias("train_std"), guarded_scale(sd, eps).alias("scale"), F.sum(n).alias("n_cells")
    )


def scale_cells(cells: DataFrame, scaler: DataFrame) -> DataFrame:
    z = lambda x: (x - F.col("train_mean")) / F.col("scale")
    joined = cells.join(scaler.select("zone", "train_mean", "scale"), "zone")
    return joined.withColumns({"inputs_z": F.transform("inputs", z), "y_z": z(F.col("y"))})


def inverse_scale(z: Column) -> Column:
    return z * F.col("scale") + F.col("train_mean")


def first_difference(inputs: Column) -> Column:
    """Step change along the look-back; zero at the first step."""
    shifted = F.concat(F.slice(inputs, 1, 1), F.slice(inputs, 1, F.size(inputs) - 1))
    return F.zip_with(inputs, shifted, lambda a, b: a - b)


def residual_fields(cells: DataFrame) -> DataFrame:
    return cells.withColumns({"diff": first_difference(F.col("inputs")), "delta": F.col("y") - F.col("anchor")})


def fit_residual_scalers(train: DataFrame, eps: float = EPSILON) -> DataFrame:
    """Global scalers in one row: log1p rate, step difference (first step left out), target delta."""
    def moments(arr: Column, fn):
        return (
            F.sum(F.size(arr)),
            F.sum(F.aggregate(arr, F.lit(0.0), lambda a, x: a + fn(x))),
            F.sum(F.aggregate(arr, F.lit(0.0), lambda a, x: a + fn(x) * fn(x))),
        )

    def pair(name, n, s1, s2):
        mean = s1 / n
        sd = F.sqrt(F.greatest(s2 / n - mean * mean, F.lit(0.0)))
        return [mean.alias(f"{name}_mean"), guarded_scale(sd, eps).alias(f"{name}_scale")]

    f = residual_fields(train)
    tail = F.slice("diff", 2, F.size("diff") - 1)
    rate = moments(F.col("inputs"), lambda x: F.log1p(F.greatest(x, F.lit(0.0))))
    diff = moments(tail, lambda x: x)
    return f.agg(
        *pair("rate", *rate),
        *pair("diff", *diff),
        F.avg("delta").alias("delta_mean"),
        guarded_scale(F.stddev_pop("delta"), eps).alias("delta_scale"),
    )


def residual_features(cells: DataFrame, scalers: DataFrame) -> DataFrame:
    """Scaled rate and difference sequences (difference forced to 0 at step 0) and the scaled delta."""
    f = residual_fields(cells).withColumn("_s", one_row(scalers))
    s = F.col("_s")
    rate_z = F.transform("inputs", lambda x: (F.log1p(F.greatest(x, F.lit(0.0))) - s["rate_mean"]) / s["rate_scale"])
    diff_z = F.transform(
        "diff", lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise((x - s["diff_mean"]) / s["diff_scale"])
    )
    return f.withColumns(
        {"rate_z": rate_z, "diff_z": diff_z, "delta_z": (F.col("delta") - s["delta_mean"]) / s["delta_scale"]}
    ).drop("_s")


def reconstruct_rate(df: DataFrame, scalers: DataFrame, z: str = "mu_z", var: str = "var_z") -> DataFrame:
    """Back to rate units: anchor plus the unscaled delta; the mean enters mu only."""
    s = F.col("_s")
    return (
        df.withColumn("_s", one_row(scalers))
        .withColumns(
            {
                "mu": F.col("anchor") + F.col(z) * s["delta_scale"] + s["delta_mean"],
                "variance": F.col(var) * s["delta_scale"] * s["delta_scale"],
                "sigma": F.sqrt(var) * F.abs(s["delta_scale"]),
            }
        )
        .drop("_s")
    )


def cross_section_scaler(long: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Per feature over zones; ``flat`` marks a near-constant column, which scales to zero."""
    return long.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), (F.stddev_pop("value") < eps).alias("flat")
    )


def scale_cross_section(long: DataFrame, scaler: DataFrame) -> DataFrame:
    z = F.when(F.col("flat"), F.lit(0.0)).otherwise((F.col("value") - F.col("mean")) / F.col("sd"))
    return long.join(scaler, "feature").select("zone", "feature", z.alias("z"), "flat")
