"""Merkle manifest of a dataset: a ternary tree per group and one over the groups, with proofs.

Nodes are hex digests. An aligned block of ``RUN ** DEPTH`` consecutive nodes is one row that keeps
each of its levels as one string of digests; substrings of fixed width are the runs to hash, and what
flanks a node inside its run is its sibling segment. The tops of the blocks are the nodes of the next
round, so a group of any size is hashed in rows of bounded size, in as many rounds as the logarithm
of the group to the base ``RUN ** DEPTH``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from zonewise.functions.scalars import one_row
from zonewise.llm.placing import positions
from zonewise.session import pin

RUN, DEPTH, HEX = 3, 5, 64
SPAN = RUN**DEPTH
PATH = "array<struct<left: binary, right: binary>>"


def leaf_hash(*fields: Column) -> Column:
    """sha256 of the fields, each ``-`` if null, else its length in UTF-8 bytes, a colon and itself."""

    def mark(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[mark(c) for c in fields]), 256)


def _cut(level: Column, start: Column, width: Column) -> Column:
    """The digests from the 0-based byte ``start`` on; levels are binary, so that none is counted from its start."""
    return F.substring(level, (start + 1).cast("int"), width.cast("int"))


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / (RUN * HEX)).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(_cut(level, i * RUN * HEX, F.lit(RUN * HEX)), 256)), "").cast("binary")


def _by_position(items: Column) -> Column:
    return F.array_sort(items, lambda a, b: (a["pos"] - b["pos"]).cast("int"))  # other fields may have no order


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks of ``nodes(tree, pos, node, ...)``: ``items`` by position, ``levels``, and whether the block is its whole tree."""
    last = nodes.groupBy("tree").agg((F.max("pos") < SPAN).alias("whole"))
    item = F.struct("pos", *[c for c in nodes.columns if c not in ("tree", "pos")])
    rows = nodes.groupBy("tree", F.expr(f"pos div {SPAN}").alias("block")).agg(_by_position(F.collect_list(item)).alias("items"))
    base = F.array_join(F.transform("items", lambda x: x["node"]), "").cast("binary")

    def climb(levels: Column, _: Column) -> Column:
        top = F.element_at(levels, -1)
        return F.when(F.col("whole") & (F.octet_length(top) == HEX), levels).otherwise(F.array_append(levels, _parents(top)))

    levels = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.array(base), climb)
    return rows.join(last, "tree").select("tree", "block", "whole", "items", levels.alias("levels"))


def _top() -> Column:
    return F.element_at("levels", -1).cast("string")


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of every round; a tree takes part until one block holds what is left of it."""
    rounds = [pin(_blocks(nodes))]
    while not (rest := rounds[-1].filter("not whole")).isEmpty():
        rounds.append(pin(_blocks(rest.select("tree", F.col("block").alias("pos"), _top().alias("node")))))
    return rounds


def _tops(rounds: Sequence[DataFrame]) -> DataFrame:
    out = None
    for blocks in rounds:
        top = blocks.filter("whole").select("tree", _top().alias("node"))
        out = top if out is None else out.unionAll(top)
    return out


def _segments(i: Column) -> Column:
    """What stands beside node ``i`` of a block and beside its ancestors, level by level up to the block's top."""

    def beside(level: Column, height: Column) -> Column:
        at = F.floor(i / F.element_at(F.lit([RUN**h for h in range(DEPTH + 1)]), height + 1)).cast("int")
        start, place = F.floor(at / RUN).cast("int") * RUN * HEX, at % RUN
        return F.struct(
            _cut(level, start, place * HEX).alias("left"), _cut(level, start + (place + 1) * HEX, (RUN - 1 - place) * HEX).alias("right")
        )

    return F.transform(F.slice("levels", F.lit(1), F.size("levels") - 1), beside)


def _descend(rounds: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """Blocks of the first round with ``path``, the segments from their top to the root over all trees."""
    parents = above.select("tree", F.lit(0).cast("long").alias("block"), F.lit(True).alias("whole"), "path")
    met = None
    for blocks in reversed(rounds):
        if met is not None:
            nodes = F.transform("items", lambda x, i: F.struct(x["pos"].alias("block"), F.concat(_segments(i), F.col("path")).alias("path")))
            below = met.select("tree", F.inline(nodes)).select("tree", "block", F.lit(False).alias("whole"), "path")
            met = blocks.join(parents.unionByName(below), ["tree", "block", "whole"])
        else:
            met = blocks.join(parents, ["tree", "block", "whole"])
        met = pin(met) if blocks is not rounds[0] else met
    return met


def _fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h.cast("binary"), s["right"]), 256))


def _proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"]).cast("string")), ""), 256)


def manifest(leaves: DataFrame, group: str, order: str) -> DataFrame:
    """``leaves(leaf, presented, ...)`` with ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    Leaves ascend by ``order`` inside their group, a null first, equal ones by digest; groups ascend
    bytewise, the null group first. ``presented`` is the leaf that a holder of the row would show (null:
    the leaf itself): it is folded with the original siblings and held against the root. A lone leaf is
    the subroot of its group, and a lone group's subroot is the root; their proof has no sibling and is
    the digest of nothing. Repeated rows are leaves of their own; an empty table gives no rows. Columns
    of the given names besides those that this adds come back as they are.
    """
    own = [c for c in leaves.columns if c not in ("leaf", "presented")]
    tagged = leaves.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),  # the null group sorts before every name
        F.col("leaf").alias("node"),
        F.struct(F.col(order).alias("_order"), F.col("leaf").alias("_leaf")).alias("_by"),
        F.coalesce("presented", "leaf").alias("shown"),
        F.struct(*own).alias("own"),
    )
    placed = positions(pin(tagged), [F.col("_by")], "pos", group="tree").select("tree", "pos", "node", "shown", "own")
    rounds = _climb(placed)
    subroots = pin(_tops(rounds))
    named = positions(subroots, [F.col("tree")], "pos").select(F.lit("").alias("tree"), "pos", "node", F.col("tree").alias("member"))
    over = _climb(named)
    root = one_row(_tops(over).select(F.col("node").alias("root")))["root"]
    start = leaves.sparkSession.createDataFrame([("", [])], f"tree string, path {PATH}")
    of_groups = F.transform("items", lambda x, i: F.struct(x["member"].alias("tree"), x["node"].alias("subroot"), F.concat(_segments(i), F.col("path")).alias("path")))
    above = pin(_descend(over, start).select(F.inline(of_groups)))
    met = _descend(rounds, above).join(above.select("tree", "subroot"), "tree")

    def line(x: Column, i: Column) -> Column:
        whole = F.transform(  # names the path, so that it is made once
            F.array(F.concat(_segments(i), F.col("path"))),
            lambda p: F.struct(x["own"].alias("own"), x["node"].alias("leaf"), _proof(p).alias("proof_sha256"), _fold(p, x["shown"]).alias("folded_root")),
        )
        return whole[0]

    out = met.select("subroot", F.inline(F.transform("items", line))).withColumn("root", root)
    return out.select("own.*", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
