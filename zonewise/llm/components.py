"""Connected components of an edge table: forests per partition, then alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from zonewise.session import pin, release

MOST_NODES = 1 << 19  # nodes that a task holds, and edges that it is given while there are fewer tasks than partitions


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars: every node with the smallest node that it reaches there.

    At ``MOST_NODES`` nodes the stars so far are given out and others begun, so memory is bounded.
    """
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := above.get(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above[x]
        return top

    def stars() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(above), pa.int64()), pa.array([root(x) for x in list(above)], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                above[max(x, y)] = min(x, y)
        if len(above) > MOST_NODES:
            yield stars()
            above.clear()
    if above:
        yield stars()


def _contracted(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_forest, "a long, b long")


def _stars(sym: DataFrame) -> DataFrame:
    """Every edge with the smallest neighbour of its first node, itself included."""
    least = sym.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return sym.join(least, "a")


def _settled(stars: DataFrame) -> bool:
    """Whether every node hangs on one root that hangs on none."""
    ends = stars.select("a", F.lit(1).alias("up")).unionByName(stars.select(F.col("b").alias("a"), F.lit(0).alias("up")))
    seen = ends.groupBy("a").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return seen.filter("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``edges(a, b)``, whole numbers.

    The edges are written and contracted to a forest per task, which is exact. A task takes up to ``MOST_NODES``
    edges, so the forests are contracted again by fewer tasks while there are fewer edges; once one task can hold
    them all they are settled. Where forests of several tasks still disagree, a round points all larger neighbours
    of a node at its smallest one, then all smaller neighbours; minima are combined before the shuffle and a
    hub's join can be split. The number of rounds grows with the logarithm of the longest path. Loops are
    ignored, repeated edges count once.
    """
    now = pin(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b"))
    last = None
    while True:
        width = now.rdd.getNumPartitions()
        tasks = max(1, min(width, -(-now.count() // MOST_NODES)))
        if last is None or tasks < last:
            fewer = pin(_contracted(now.coalesce(tasks) if tasks < width else now))
            release(now)
            now, last = fewer, tasks
            continue
        if _settled(now):
            break
        sym = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(sym).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _stars(large)
        met = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b")
        met = pin(met.distinct())
        release(now)
        now, last = met, None
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
