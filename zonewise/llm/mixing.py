"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from zonewise.llm.placing import positions
from zonewise.session import pin

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, source: str, size: str, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """One row per source: ``source_size`` and ``target``.

    Sources in code-point order (null last) take ``weights`` in turn and share ``share`` of all sizes
    by weight. A target stops at ``most`` times its source; what is over is shared among the others
    until none is above. Each round is one aggregate over one row per source.
    """
    totals = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    ranked = positions(totals, [F.col(source).asc_nulls_last()], "_z_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_z_rank") % len(weights) + 1).cast("int"))
    table = pin(ranked.withColumn("_z_weight", weight).withColumn("_z_cap", F.col("source_size") * F.lit(most)))
    whole = table.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("_z_cap") < F.col("_z_weight") * F.lit(level)
        row = table.agg(
            F.coalesce(F.sum(F.when(full, F.col("_z_cap"))), F.lit(0.0)).alias("stopped"),
            F.coalesce(F.sum(F.when(~full, F.col("_z_weight"))), F.lit(0.0)).alias("open"),
        ).first()
        raised = (whole * share - row["stopped"]) / row["open"] if row["open"] else level or 0.0
        if level is not None and raised <= level:
            break
        level = raised
    target = F.least(F.col("_z_cap"), F.col("_z_weight") * F.lit(level))
    return pin(table.select(source, "source_size", target.alias("target")))


def offset(source: Column, seed: int) -> Column:
    """The random start of a source, a multiple of 2 ** -20 below 1 that any rerun finds again."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))


def systematic_copies(
    df: DataFrame,
    size: str,
    source: str = "source",
    key: str = "doc_id",
    seed: int = 17,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """``df`` with ``source_size``, ``target`` and ``copies``, how often the mix takes the row.

    All rows of a source expect target / source_size copies, so the prefix sum before row ``k`` is
    ``k`` times that. Rows stand by size, so any stretch of the running sum holds every size in its
    share and the words taken come near the target. With one offset ``u`` per source, a row is
    emitted once for every integer between its two running sums plus ``u``: the number of copies is
    the expected one rounded down or up. A hot source is spread over ranges by ``positions``.

    Null sources form one source, a null size counts as 0, repeated rows are rows of their own, null
    keys sort first, an empty table gives no rows; input columns named like a result are replaced.
    """
    ready = df.withColumn(size, F.coalesce(F.col(size).cast("long"), F.lit(0)))
    targets = source_targets(ready, source, size, weights, share, most)
    placed = positions(ready, [F.col(size), F.col(key)], "_z_k", group=source)
    rates = targets.select(F.col(source).alias("_z_source"), F.col("source_size").alias("_z_size"), F.col("target").alias("_z_target"))
    joined = placed.join(rates, F.col(source).eqNullSafe(F.col("_z_source")))
    rate = F.when(F.col("_z_size") > 0, F.col("_z_target") / F.col("_z_size")).otherwise(0.0)
    u = offset(F.col(source), seed)
    crossed = F.floor((F.col("_z_k") + 1) * rate + u) - F.floor(F.col("_z_k") * rate + u)
    copies = F.least(F.ceil(rate), crossed).cast("long")  # a rounded sum never adds a copy
    keep = [c for c in ready.columns if c not in ("source_size", "target", "copies")]
    return joined.select(*keep, F.col("_z_size").alias("source_size"), F.col("_z_target").alias("target"), copies.alias("copies"))


def mixed(df: DataFrame, source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """The rows of the mix itself: every row of ``df`` as often as ``systematic_copies`` says.

    Columns travel under names of their own, so those called ``target`` or ``copies`` come back as they
    were. Null texts and texts without words have no size and are taken at the rate of their source;
    null sources are one source, and an empty table gives no rows.
    """
    inner = [f"_z_c{i}" for i in range(len(df.columns))]
    name = dict(zip(df.columns, inner))
    sized = df.select(*[F.col(c).alias(n) for c, n in name.items()], word_count(F.col("text")).alias("_z_words"))
    taken = systematic_copies(sized, "_z_words", name[source], name[key], **how).filter("copies > 0")
    again = taken.select(*inner, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_z_copy"))
    return again.select(*[F.col(n).alias(c) for c, n in name.items()])
