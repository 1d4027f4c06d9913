"""Centroid clustering over dimension shards: exact integer Lloyd rounds on blocks of columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from zonewise.functions.scalars import one_row
from zonewise.session import pin

#: Bound on the numbers of all centroids together, which the driver holds between rounds.
MOST_CELLS = 1 << 22
#: Bound on the size of an integer component: 2^4 dimensions' squares of differences still fit in a
#: part, and the parts of up to 2^11 dimensions in a distance of 63 bits.
MOST_STEP = 1 << 25


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly ``dims`` components, all of them finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & fine, F.lit(False))


def quantised(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component; one beyond ``MOST_STEP`` stops the query, as sums would overflow."""

    def cell(x: Column) -> Column:
        step = x.cast("double") * scale
        return F.when(F.abs(step) <= MOST_STEP, F.floor(step)).otherwise(F.raise_error(F.lit("component too large for exact distances"))).cast("int")

    return F.transform(vector, cell)


def _parts(centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Squared distances of the rows' cells to the centroids, over the columns of one block."""
    width = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cells").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
            parts = [pa.array(((cells - c) ** 2).sum(axis=1)) for c in centres]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *parts], names=["row", *[f"d{i}" for i in range(len(centres))]])

    return run


def _assign(blocks: DataFrame, slices: list[np.ndarray]) -> DataFrame:
    """``row``, ``cluster`` and exact ``distance``: the parts of all blocks added up by row."""
    k = len(slices[0])
    names = [f"d{i}" for i in range(k)]
    schema = "row long, " + ", ".join(f"{n} long" for n in names)
    parts = None
    for b, centres in enumerate(slices):  # a block's tasks get the slice of their own columns only
        part = blocks.filter(F.col("block") == b).select("row", "cells").mapInArrow(_parts(centres), schema)
        parts = part if parts is None else parts.unionAll(part)
    summed = parts.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).select("row", F.array(*names).alias("_d"))
    least = F.array_min("_d")
    return pin(summed.select("row", (F.array_position("_d", least) - 1).cast("int").alias("cluster"), least.alias("distance")))


def _moved(blocks: DataFrame, assigned: DataFrame, slices: list[np.ndarray]) -> list[np.ndarray]:
    """The slices after one update: floors of exact means, block by block; empty clusters keep theirs."""
    width = max(s.shape[1] for s in slices)
    sums = [F.sum(F.get("cells", F.lit(j)).cast("long")).alias(f"s{j}") for j in range(width)]
    n = F.count(F.lit(1)).alias("n")
    totals = blocks.join(assigned.select("row", "cluster"), "row").groupBy("block", "cluster").agg(n, *sums)
    means = [F.expr(f"(s{j} - pmod(s{j}, n)) div n").alias(f"m{j}") for j in range(width)]
    out = [s.copy() for s in slices]
    for r in totals.select("block", "cluster", F.array(*means).alias("m")).collect():  # blocks x centroids rows
        mine = out[r["block"]]
        mine[r["cluster"]] = r["m"][: mine.shape[1]]
    return out


def lloyd(vectors: DataFrame, k: int, rounds: int, key: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 64, width: int = 16) -> DataFrame:
    """``key``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every usable vector.

    Rows are written once as blocks of ``width`` columns. In every round the tasks of a block compute
    exact partial distances to the centroids' slices of that block, a sum by row adds the blocks and
    picks the nearest centroid (ties: the smaller number), and sums by block and cluster, combined
    before the shuffle, give each block its own new slice. Only the slices, ``k`` x ``dims`` numbers
    and at most ``MOST_CELLS``, pass the driver.

    The first centroids are the ``k`` vectors with the smallest sha256 of ``1:<key>``; equal hashes
    (repeated keys) by components, a null key last. Vectors that are null, of another length, or hold
    null or non-finite components are left out. Fewer than ``k`` vectors make as many centroids; an
    empty table gives an empty result. Repeated rows are rows of their own. Other columns are ignored.
    """
    if k * dims > MOST_CELLS:
        raise ValueError(f"{k} centroids of {dims} components are more than {MOST_CELLS} numbers")
    kept = vectors.filter(usable(F.col(vector), dims)).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("_key"), quantised(F.col(vector), scale).alias("cells")
    )
    rows = pin(kept)
    hashed = rows.select(F.sha2(F.concat(F.lit("1:"), F.col("_key").cast("string")), 256).alias("_h"), "cells")
    first = [r["cells"] for r in hashed.orderBy(F.asc_nulls_last("_h"), "cells").limit(k).collect()]
    if not first:
        return rows.select(
            F.col("_key").alias(key), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")
        )
    starts = range(0, dims, width)
    cut = F.array(*[F.struct(F.lit(b).alias("block"), F.slice("cells", s + 1, width).alias("cells")) for b, s in enumerate(starts)])
    blocks = pin(rows.select("row", F.inline(cut)), ("block",))
    whole = np.array(first, dtype=np.int64)
    slices = [whole[:, s : s + width] for s in starts]
    for _ in range(rounds):
        slices = _moved(blocks, _assign(blocks, slices), slices)
    assigned = _assign(blocks, slices)
    final = np.hstack(slices)
    prints = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(final)]
    named = rows.sparkSession.createDataFrame(prints, "cluster int, centroid_sha256 string")
    clusters = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(named, "cluster")
    total = one_row(assigned.agg(F.sum("distance").alias("inertia")))["inertia"]
    # At most k rows a side: safe to send everywhere.
    out = assigned.join(F.broadcast(clusters), "cluster").join(rows.select("row", "_key"), "row")
    return out.select(F.col("_key").alias(key), "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")
