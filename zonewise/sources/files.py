"""Readers and guarded sinks. Raw text stays text until an operator classifies it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_raw(spark: SparkSession, path: str | list[str], fmt: str = "csv", columns: Sequence[str] | None = None) -> DataFrame:
    """All-text CSV (byte-order mark stripped from the header) or parquet.

    With ``columns`` the header is not sampled: the schema is fixed up front.
    """
    if fmt == "parquet":
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    reader = spark.read.option("header", True)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    else:
        reader = reader.option("inferSchema", False)
    df = reader.csv(path)
    # An empty field is the empty text, not a missing value; null never leaves this reader.
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("\ufeff").strip()) for c in df.columns])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False, partition_by: Sequence[str] = ()) -> str:
    """Guarded sink: an existing output is an error unless ``overwrite``. Empty results keep their schema."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("emptyValue", "").csv(path)
    else:
        w.parquet(path)
    return path


def write_bundle(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet", overwrite: bool = False) -> dict[str, str]:
    return {name: write_table(df, f"{folder}/{name}", fmt, overwrite) for name, df in tables.items()}


def table_manifest(name: str, df: DataFrame) -> DataFrame:
    """Rows, column list and an order-free content hash, in one pass.

    The hash adds up 60 bits of the MD5 of every row. Fractions count to six decimals and times to the
    microsecond, so that any engine finds the same value.
    """
    kinds = dict(df.dtypes)

    def plain(c: str):
        if kinds[c] in ("double", "float"):
            return F.round(F.col(c) * 1e6).cast("long").cast("string")
        return (F.unix_micros(F.col(c).cast("timestamp")) if kinds[c].startswith("timestamp") else F.col(c)).cast("string")

    row = F.concat_ws("|", *[F.coalesce(plain(c), F.lit("")) for c in df.columns])
    bits = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("content_hash"),
    ).select(F.lit(name).alias("table_name"), "n_rows", F.lit(",".join(df.columns)).alias("columns"), "content_hash")
