"""Saved window sets, and new cuts of them that reuse the samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from zonewise.functions.scalars import one_row
from zonewise.operators.scale import fit_overlap_scaler
from zonewise.operators.windows import TRAIN, fraction_split, split_counts
from zonewise.sources.files import read_raw, write_bundle

POLICY = "resplit_train_lookback_cells"


def save_window_set(folder: str, split: DataFrame, cells: DataFrame) -> str:
    """Assignments (one row per sample) and samples (one row per sample and zone) in a folder of their own."""
    write_bundle({"assignments": split, "samples": cells}, folder)
    return folder


def load_window_set(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(assignments, samples); a recut set has the samples of the set that it was cut from."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/parent")
    cut = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    source = read_raw(spark, f"{folder}/parent", "parquet").first()["folder"] if cut else folder
    return read_raw(spark, f"{folder}/assignments", "parquet"), read_raw(spark, f"{source}/samples", "parquet")


def _same(a: str, b: str) -> bool:
    return a.rstrip("/").removeprefix("file:").lstrip("/") == b.rstrip("/").removeprefix("file:").lstrip("/")


def recut(spark: SparkSession, source: str, folder: str, train: float = 0.60, validation: float = 0.15, lookback: int = 7) -> dict[str, DataFrame]:
    """A new chronological cut of a saved set: assignments, scaler and counts are written, samples are not.

    All samples of the source, whatever their split, are cut anew by target date. The scaler is fitted on
    the look-back cells of the new training samples, overlaps counted, and says so. Writing over
    the source, or over a folder that exists, stops.
    """
    if _same(source, folder):
        raise ValueError("a recut may not overwrite the window set that it is cut from")
    old, cells = load_window_set(spark, source)
    split = fraction_split(old.drop("split"), train, validation)
    write_bundle({"assignments": split}, folder)
    split = read_raw(spark, f"{folder}/assignments", "parquet")
    mine = split.filter(F.col("split") == TRAIN)
    first = mine.agg(F.date_sub(F.min("origin"), lookback - 1).alias("first_input"), F.max("origin").alias("last_input"))
    scaler = fit_overlap_scaler(cells.join(mine.select("sample_id"), "sample_id", "left_semi"))
    dates = one_row(first)
    scaler = scaler.withColumns({"first_input": dates["first_input"], "last_input": dates["last_input"], "fitting_policy": F.lit(POLICY)})
    scaler = scaler.withColumn("n_unique_dates", F.datediff("last_input", "first_input") + 1)
    total = split.agg(F.count(F.lit(1)).alias("n")).scalar()
    summary = split_counts(split).withColumn("proportion", F.col("n_samples") / total)
    parent = spark.createDataFrame([(source, True)], "folder string, windows_not_rebuilt boolean")
    write_bundle({"scaler": scaler, "summary": summary, "parent": parent}, folder)
    return {name: read_raw(spark, f"{folder}/{name}", "parquet") for name in ("assignments", "scaler", "summary", "parent")}
