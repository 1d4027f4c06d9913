"""Identity of a node order: a SHA-256 tree over the codes in index order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BLOCK = 1_000


def order_hash(nodes: DataFrame, code: str = "zone", index: str = "node_index") -> DataFrame:
    """One row: node count, hash of the newline join, and of the older pipe join.

    Codes are joined and hashed in blocks of ``BLOCK`` by index, the block hashes are joined and
    hashed in the same way, and so on until one is left. Up to ``BLOCK`` nodes that is the plain hash
    of the joined codes; beyond, the value is the root of the tree and differs from a hash of one
    long string. Indices count from 0.
    """
    n = nodes.count()
    level = nodes.select(F.col(index).cast("long").alias("i"), F.col(code).alias("canonical"), F.col(code).alias("legacy"))
    left = n
    while True:
        rows = F.sort_array(F.collect_list(F.struct("i", "canonical", "legacy")))
        blocks = level.groupBy(F.floor(F.col("i") / BLOCK).alias("b")).agg(rows.alias("r"))
        level = blocks.select(
            F.col("b").alias("i"),
            F.sha2(F.array_join(F.transform("r", lambda x: x["canonical"]), "\n"), 256).alias("canonical"),
            F.sha2(F.array_join(F.transform("r", lambda x: x["legacy"]), "|"), 256).alias("legacy"),
        )
        left = -(-left // BLOCK)
        if left <= 1:
            break
    nothing = F.sha2(F.lit(""), 256)
    return level.agg(
        F.lit(n).cast("long").alias("n_nodes"),
        F.coalesce(F.min("canonical"), nothing).alias("order_hash"),
        F.coalesce(F.min("legacy"), nothing).alias("legacy_hash"),
    )
