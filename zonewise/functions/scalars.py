"""Column expressions shared by the operators. None of them leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Tokens that mean "no value" in the indicator and rate columns.
INDICATOR_NULLS = ("*", "None", "<null>", ".", "")
RATE_NULLS = ("", "nan", "none", "<na>", "null")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def finite_or_null(text: Column) -> Column:
    """String to double; anything that is not a finite number becomes null."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def token(col: Column) -> Column:
    return F.trim(F.coalesce(col.cast("string"), F.lit("")))


def required_code(col: Column, name: str) -> Column:
    """The trimmed code; a missing or blank one stops the query."""
    code = F.trim(col.cast("string"))
    return F.when(F.coalesce(code, F.lit("")) != "", code).otherwise(F.raise_error(F.lit(f"{name} is missing")))


def report_date(col: Column) -> Column:
    """``YYYYMMDD`` first, then ``YYYY-MM-DD``; a trailing ``.0`` is dropped; other layouts give null."""

    def parsed(text: Column) -> Column:
        dashed = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
        return F.when(text.rlike(r"^\d{8}$"), dashed).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).try_cast("date")

    # A filter is moved below the columns it reads, so each mention of the text would compute it again.
    return let(F.regexp_replace(token(col), r"\.0$", ""), parsed)


def r6(col: Column) -> Column:
    """Half-up to six decimals; used where a result is compared across engines."""
    return F.floor(col * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow: positive for every x, x itself for a large one."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def guarded_sum(col: Column) -> Column:
    """Sum that is null as soon as one member is null."""
    return F.when(F.count(col) == F.count(F.lit(1)), F.sum(col))


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def relative_to_mean(col: Column, mean: Column) -> Column:
    return F.when(mean > 0, col / mean).otherwise(F.lit(1.0))


def unit_share(col: Column, total: Column) -> Column:
    return F.when(total > 0, col / total).otherwise(F.lit(0.0))


def joined_reasons(pairs: list[tuple[str, Column]], sep: str = "|") -> Column:
    """Names whose condition holds, in the given order."""
    return F.concat_ws(sep, *[F.when(cond, F.lit(name)) for name, cond in pairs])


def one_row(df: DataFrame) -> Column:
    """All columns of a one-row table as a struct, usable inside another query without a join."""
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("v")).scalar()
