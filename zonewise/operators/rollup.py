"""Small-area indicators rolled up to zones with null-poisoning sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from zonewise.functions.scalars import guarded_sum, ratio
from zonewise.operators.clean import inhabited_only


def rate_from_counts(count: Column, population: Column) -> Column:
    """Ratio of sums; missing if any member is missing or the denominator is not positive."""
    den = guarded_sum(population)
    return F.when(den > 0, guarded_sum(count) / den)


def weighted_mean(value: Column, weight: Column) -> Column:
    den = guarded_sum(weight)
    return F.when(den > 0, guarded_sum(value * weight) / den)


def zone_rollup(areas: DataFrame, fills=(0, 1, 2), primary: int = 1) -> DataFrame:
    """One aggregation per zone: populations, rates, weighted means and suppressed-crime fills."""
    pop, work = F.col("Total_population"), F.col("Working_age_population")
    hidden = F.col("crime_suppressed")
    crime = {
        f: rate_from_counts(F.when(hidden, F.lit(float(f))).otherwise(F.col("crime_count")), pop) for f in fills
    }
    return inhabited_only(areas).groupBy("zone").agg(
        F.count(F.lit(1)).alias("n_areas"),
        F.sum(pop).alias("total_population"),
        F.sum(work).alias("working_age_population"),
        rate_from_counts(F.col("Income_count"), pop).alias("income_rate"),
        rate_from_counts(F.col("Employment_count"), work).alias("employment_rate"),
        rate_from_counts(F.col("overcrowded_count"), pop).alias("overcrowded_rate"),
        weighted_mean(F.col("University"), pop).alias("university_rate"),
        weighted_mean(F.col("PT_GP"), pop).alias("pt_gp_min"),
        F.count_if(hidden).alias("n_crime_suppressed"),
        F.max(hidden.cast("int")).alias("crime_incomplete"),
        *[c.alias(f"crime_rate_fill{f}") for f, c in crime.items()],
        crime[primary].alias("crime_rate"),
    )


__all__ = ["rate_from_counts", "ratio", "weighted_mean", "zone_rollup"]
