"""Accuracy, interval and skill aggregates. Every metric is one pass of built-in aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from zonewise.functions.ranking import quantiles
from zonewise.functions.scalars import one_row

LOG_2PI = 1.8378770664093453


def point_metrics(y: Column, mu: Column, sign: str = "observed_minus_predicted") -> list[Column]:
    """MAE, RMSE, MSE, bias, R2 and n over rows where both values exist."""
    ok = y.isNotNull() & mu.isNotNull()
    e = F.when(ok, (y - mu) if sign == "observed_minus_predicted" else (mu - y))
    yy = F.when(ok, y)
    total = F.var_pop(yy) * F.count(e)
    return [
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e * e).alias("mse"),
        F.avg(e).alias("bias"),
        F.when(total > 0, 1 - F.sum(e * e) / total).alias("r2"),
        F.count(e).alias("n"),
    ]


def skill(model: Column, baseline: Column) -> Column:
    return 1 - F.try_divide(model, baseline)


def evaluate(df: DataFrame, by: Sequence[str] = (), y: str = "y", mu: str = "mu", baseline: str = "anchor") -> DataFrame:
    """Model and baseline metrics side by side with MAE and MSE skill, per group or overall."""
    named = [c.alias(f"model_{n}") for c, n in zip(point_metrics(F.col(y), F.col(mu)), _NAMES)]
    base = [c.alias(f"persistence_{n}") for c, n in zip(point_metrics(F.col(y), F.col(baseline)), _NAMES)]
    out = df.groupBy(*by).agg(*named, *base)
    return out.withColumns(
        {
            "mae_skill": skill(F.col("model_mae"), F.col("persistence_mae")),
            "mse_skill": skill(F.col("model_mse"), F.col("persistence_mse")),
        }
    )


_NAMES = ("mae", "rmse", "mse", "bias", "r2", "n")


def metrics_with_overall(df: DataFrame, by: str, y: str = "y", mu: str = "mu", label: str = "overall") -> DataFrame:
    """Groups and the overall row from a single rollup."""
    out = df.rollup(by).agg(F.grouping(by).alias("_g"), *point_metrics(F.col(y), F.col(mu)))
    return out.withColumn(by, F.when(F.col("_g") == 1, label).otherwise(F.col(by).cast("string"))).drop("_g")


def interval_stats(df: DataFrame, y: str, lower: str, upper: str, by: Sequence[str] = ()) -> DataFrame:
    """Coverage with both ends inclusive, mean and median width, n."""
    ok = df.filter(F.col(y).isNotNull() & F.col(lower).isNotNull() & F.col(upper).isNotNull()).withColumn(
        "_w", F.col(upper) - F.col(lower)
    )
    agg = ok.groupBy(*by).agg(
        F.avg(F.col(y).between(F.col(lower), F.col(upper)).cast("double")).alias("coverage"),
        F.avg("_w").alias("mean_width"),
        F.count(F.lit(1)).alias("n"),
    )
    mid = quantiles(ok, "_w", {"median_width": 0.5}, by).drop("n")
    if by:
        return agg.join(mid, list(by))
    return agg.withColumn("median_width", one_row(mid)["median_width"])


def gaussian_nll(y: Column, mu: Column, variance: Column) -> Column:
    return F.avg(F.when(variance > 0, 0.5 * (F.lit(LOG_2PI) + F.log(variance) + (y - mu) * (y - mu) / variance)))


def huber_mean(y: Column, mu: Column, delta: float = 1.0, mask: Column | None = None) -> Column:
    e = F.abs(y - mu)
    loss = F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))
    return F.avg(loss if mask is None else F.when(mask, loss))


def combined_loss(y: Column, mu: Column, variance: Column, weight: float, delta: float = 1.0) -> Column:
    return huber_mean(y, mu, delta) + weight * gaussian_nll(y, mu, variance)


def sigma_diagnostics(df: DataFrame, y: str = "y", mu: str = "mu", sigma: str = "sigma") -> DataFrame:
    e = F.abs(F.col(y) - F.col(mu))
    mid = quantiles(df, sigma, {"median_sigma": 0.5})
    return df.agg(
        F.avg(sigma).alias("mean_sigma"),
        F.corr(F.col(sigma), e).alias("corr_sigma_error"),
        gaussian_nll(F.col(y), F.col(mu), F.col(sigma) * F.col(sigma)).alias("nll"),
    ).withColumn("median_sigma", one_row(mid)["median_sigma"])


def split_summary(cells: DataFrame) -> DataFrame:
    """Range, dates, valid cells, mean and *sample* sd of rate and delta, and share of all dates."""
    n = cells.agg(F.count_distinct("target").alias("n"))
    ok = F.col("y").isNotNull() & F.col("anchor").isNotNull()
    delta = F.when(ok, F.col("y") - F.col("anchor"))
    rate = F.when(ok, F.col("y"))
    return (
        cells.groupBy("split")
        .agg(
            F.min("target").alias("first_target"),
            F.max("target").alias("last_target"),
            F.count_distinct("target").alias("n_dates"),
            F.count(delta).alias("n_cells"),
            F.avg(rate).alias("mean_rate"),
            F.stddev_samp(rate).alias("sd_rate"),
            F.avg(delta).alias("mean_delta"),
            F.stddev_samp(delta).alias("sd_delta"),
        )
        .withColumn("fraction", F.col("n_dates") / one_row(n)["n"])
    )


def weighted_summary(long: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Weighted mean, sample sd, min and max of a value per key (fusion weights over updates)."""
    return long.groupBy(key).agg(
        (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )
