"""Data-contract checks: each rule is one aggregate over one table, reported as a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from zonewise.functions.scalars import token

LEVELS = ("ok", "accepted", "review", "error")


class ContractError(ValueError):
    """A table breaks a rule that must hold before work goes on."""

    def __init__(self, code: str, n_bad: int, sample):
        super().__init__(f"{code}: {n_bad} rows, e.g. {sample}")
        self.code, self.n_bad, self.sample = code, n_bad, sample


def require_columns(df: DataFrame, columns: Sequence[str], code: str = "required_columns") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(code, len(missing), missing)
    return df


def row_rules(df: DataFrame, rules: dict[str, tuple[str, Column, Column]]) -> DataFrame:
    """Evaluate per-row rules in one pass. Each rule: name -> (level, bad-row condition, sample value)."""
    parts = df.agg(
        *[
            F.struct(F.count_if(bad).alias("n_bad"), F.min(F.when(bad, sample.cast("string"))).alias("sample")).alias(code)
            for code, (_, bad, sample) in rules.items()
        ]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(code).alias("code"),
                F.lit(level).alias("level"),
                F.col(f"`{code}`.n_bad").alias("n_bad"),
                F.col(f"`{code}`.sample").alias("sample"),
            )
            for code, (level, _, _) in rules.items()
        ]
    )
    return parts.select(F.inline(cells))


def as_check(bad: DataFrame, code: str, level: str, sample: Column) -> DataFrame:
    """Turn a table of offending rows into one check row."""
    return bad.agg(F.count(F.lit(1)).alias("n_bad"), F.min(sample.cast("string")).alias("sample")).select(
        F.lit(code).alias("code"), F.lit(level).alias("level"), "n_bad", "sample"
    )


def unique_key(df: DataFrame, keys: Sequence[str], code: str = "duplicate_key", level: str = "error") -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return as_check(twice, code, level, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))


def contiguous_index(df: DataFrame, index: str, code: str = "node_index_not_contiguous") -> DataFrame:
    """0..N-1 with no repeats, tested from count, distinct count, min and max alone."""
    facts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(index).alias("d"),
        F.min(index).alias("lo"),
        F.max(index).alias("hi"),
    )
    ok = (F.col("n") == F.col("d")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)
    return facts.select(
        F.lit(code).alias("code"),
        F.lit("error").alias("level"),
        F.when(ok, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n_bad"),
        F.when(~ok, F.concat_ws("..", F.col("lo").cast("string"), F.col("hi").cast("string"))).alias("sample"),
    )


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, labelled ``omitted`` (left only) or ``unknown`` (right only)."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, key, "full_outer")
    return both.filter(F.col("_l").isNull() | F.col("_r").isNull()).select(
        key, F.when(F.col("_r").isNull(), F.lit("omitted")).otherwise(F.lit("unknown")).alias("side")
    )


def same_order(left: DataFrame, right: DataFrame, key: str, index: str, code: str = "node_order_differs") -> DataFrame:
    """Two node tables must hold the same keys at the same positions."""
    a = left.select(key, F.col(index).alias("_a"))
    b = right.select(key, F.col(index).alias("_b"))
    bad = a.join(b, key, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return as_check(bad, code, "error", F.col(key))


def unknown_flags(df: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    flag = F.lower(token(F.col(column)))
    return as_check(df.filter(~flag.isin(*known)), f"unknown_flag_{column}", "error", flag)


def worst_status(checks: DataFrame) -> DataFrame:
    """Overall status = the highest level among failing checks."""
    rank = F.when(F.col("n_bad") == 0, F.lit(0)).otherwise(
        F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level")) - 1
    )
    return checks.agg(F.max(rank).alias("_r")).select(
        F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.coalesce("_r", F.lit(0)) + 1).cast("int")).alias("status")
    )


def enforce(checks: DataFrame) -> None:
    """Action: raise on the first failing check of level ``error``."""
    for row in checks.filter("n_bad > 0 and level = 'error'").limit(1).collect():
        raise ContractError(row["code"], row["n_bad"], row["sample"])


def rounds_to(value: Column, expected: float, digits: int) -> Column:
    """Published-value check: the figure agrees after rounding to ``digits`` places."""
    return F.bround(value, digits) == F.lit(expected)
