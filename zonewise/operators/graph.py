"""Zone graphs as edge tables (src, dst, weight): construction, supports, diffusion, components, reports.

Nothing is densified: a matrix product is an equi-join on the inner index followed by a
map-side combined sum, and every iterative step is written out so it survives lost executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from zonewise.functions.ranking import order_statistics, quantiles, rank_in_group, Rank
from zonewise.functions.scalars import one_row
from zonewise.session import pin


# -- construction ---------------------------------------------------------------


def _shared_sides(segments: DataFrame) -> DataFrame:
    """(zone, p, q) with the ends of every segment in order, dealt by all three into a fixed number of parts.

    Few segments have a twin, so summing before the shuffle saves nothing and holds as many groups as a read
    brings; the rows grow after a small file is read, so its bytes do not tell how many tasks they need.
    """
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.select("zone", F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).repartition(parts, "p", "q", "zone")


def rook_contiguity(segments: DataFrame, min_length: float = 1e-6) -> DataFrame:
    """Undirected zone pairs sharing boundary length, from (zone, x1, y1, x2, y2) segments.

    Neighbours must share vertices. A segment used by more than two zones means overlapping
    polygons; see :func:`overlapping_segments`. Points of contact never produce an edge.
    """
    shared = _shared_sides(segments).groupBy("p", "q").agg(
        F.min("zone").alias("a"), F.max("zone").alias("b"), F.count_distinct("zone").alias("n")
    )
    length = F.hypot(F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y"))
    return (
        shared.filter(F.col("n") == 2)
        .groupBy("a", "b")
        .agg(F.sum(length).alias("shared_length"))
        .filter(F.col("shared_length") > min_length)
    )


def overlapping_segments(segments: DataFrame) -> DataFrame:
    return _shared_sides(segments).groupBy("p", "q").agg(F.count_distinct("zone").alias("n")).filter("n > 2")


def symmetric_adjacency(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Both directions of every undirected pair, unit weight, no diagonal."""
    one = F.lit(1.0).alias("weight")
    fwd = pairs.filter(F.col(a) != F.col(b)).select(F.col(a).alias("src"), F.col(b).alias("dst"), one)
    return fwd.unionByName(fwd.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def align_flows(flows: DataFrame, nodes: DataFrame, share: str = "share") -> DataFrame:
    """Flows with node indices at both ends; ``kept`` is false where an end is outside the node set."""
    s = nodes.select(F.col("zone").alias("src"), F.col("node_index").alias("src_index"))
    d = nodes.select(F.col("zone").alias("dst"), F.col("node_index").alias("dst_index"))
    return (
        flows.join(s, "src", "left")
        .join(d, "dst", "left")
        .select(
            "src",
            "dst",
            F.col(share).alias("share"),
            "src_index",
            "dst_index",
            (F.col("src_index").isNotNull() & F.col("dst_index").isNotNull()).alias("kept"),
        )
    )


def mobility_edges(aligned: DataFrame) -> DataFrame:
    """Positive off-diagonal shares as they are: no renormalising, no symmetrising."""
    return aligned.filter(F.col("kept") & (F.col("src_index") != F.col("dst_index")) & (F.col("share") > 0)).select(
        F.col("src_index").alias("src"), F.col("dst_index").alias("dst"), F.col("share").alias("weight")
    )


def neighbour_rank(edges: DataFrame) -> DataFrame:
    """Rank of every edge at its origin, heaviest first, ties by target; safe for a hub origin."""
    return rank_in_group(edges, ["src"], [F.desc("weight"), F.col("dst")], "neighbour_rank")


def flow_coverage(aligned: DataFrame, nodes: DataFrame) -> DataFrame:
    kept, share = F.col("kept"), F.col("share")
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    ends = aligned.filter("src_index is not null").select(F.lit("o").alias("end"), F.col("src_index").alias("i")).unionByName(
        aligned.filter("dst_index is not null").select(F.lit("d").alias("end"), F.col("dst_index").alias("i"))
    )
    seen = ends.agg(
        F.count_distinct(F.when(F.col("end") == "o", F.col("i"))).alias("o"),
        F.count_distinct(F.when(F.col("end") == "d", F.col("i"))).alias("d"),
    )
    return (
        aligned.agg(
            F.count_if(kept).alias("n_kept_pairs"),
            F.count_if(~kept).alias("n_dropped_pairs"),
            F.sum(F.when(kept, share)).alias("kept_share"),
            F.coalesce(F.sum(F.when(~kept, share)), F.lit(0.0)).alias("dropped_share"),
        )
        .withColumns({"_n": one_row(n), "_s": one_row(seen)})
        .select(
            "n_kept_pairs",
            "n_dropped_pairs",
            "kept_share",
            "dropped_share",
            (F.col("_n.n") - F.col("_s.o")).alias("n_missing_origins"),
            (F.col("_n.n") - F.col("_s.d")).alias("n_missing_destinations"),
            (F.col("_n.n") * F.col("_n.n")).alias("n_expected_pairs"),
            (F.col("n_kept_pairs") == F.col("_n.n") * F.col("_n.n")).alias("complete"),
        )
    )


def node_strengths(aligned: DataFrame, nodes: DataFrame) -> DataFrame:
    """Self share, in/out strength and in/out degree (off-diagonal, positive) for every node."""
    inside = aligned.filter("kept")
    off = F.col("src_index") != F.col("dst_index")
    pos = off & (F.col("share") > 0)
    out = inside.groupBy(F.col("src_index").alias("node_index")).agg(
        F.max(F.when(~off, F.col("share"))).alias("self_share"),
        F.sum(F.when(off, F.col("share"))).alias("out_strength"),
        F.count_if(pos).alias("out_degree"),
    )
    into = inside.groupBy(F.col("dst_index").alias("node_index")).agg(
        F.sum(F.when(off, F.col("share"))).alias("in_strength"), F.count_if(pos).alias("in_degree")
    )
    return (
        nodes.select("node_index")
        .join(out, "node_index", "left")
        .join(into, "node_index", "left")
        .fillna(0, ["out_strength", "in_strength", "out_degree", "in_degree"])
    )


def degree(pairs: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b", node: str = "zone") -> DataFrame:
    """Undirected degree of every node, zeros included."""
    ends = pairs.select(F.explode(F.array(F.col(a), F.col(b))).alias(node))
    return nodes.select(node).join(ends.groupBy(node).agg(F.count(F.lit(1)).alias("degree")), node, "left").fillna(0, ["degree"])


def knn_edges(distances: DataFrame, k: int = 5) -> DataFrame:
    """k nearest finite destinations per origin (ties by index), weight exp(-km / tau), tau the median kept km.

    The per-origin limit is applied before the shuffle as well, so a hub origin ships k rows per task.
    """
    near = W.partitionBy("src").orderBy("km", "dst")
    kept = pin(
        distances.filter((F.col("src") != F.col("dst")) & F.col("km").isNotNull() & (F.col("km") < float("inf")))
        .withColumn("neighbour_rank", F.row_number().over(near))
        .filter(F.col("neighbour_rank") <= k)
    )
    tau = quantiles(kept, "km", {"tau": 0.5})
    return kept.withColumn("tau", one_row(tau)["tau"]).withColumn("weight", F.exp(-F.col("km") / F.col("tau")))


def distance_stats(distances: DataFrame, n_nodes: Column) -> DataFrame:
    off = distances.filter((F.col("src") != F.col("dst")) & (F.col("km") < float("inf")))
    marks = order_statistics(off, "km", {"median_km": Rank.linear(0.5)})
    n = F.col("n_finite")
    return off.agg(F.count(F.lit(1)).alias("n_finite"), F.min("km").alias("min_km"), F.max("km").alias("max_km")).select(
        "n_finite",
        (n_nodes * (n_nodes - 1) - n).alias("n_unreachable"),
        "min_km",
        one_row(marks)["median_km"].alias("median_km"),
        "max_km",
    )


# -- supports and diffusion ----------------------------------------------------------


def supports(edges: DataFrame) -> DataFrame:
    """Transposed transition matrices in one table (direction, row, col, w).

    ``forward`` divides by out-degree, ``backward`` by in-degree; a node without weight has no rows.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("_t")).filter("_t > 0")
    into = edges.groupBy("dst").agg(F.sum("weight").alias("_t")).filter("_t > 0")
    fwd = edges.join(out, "src").select(
        F.lit("forward").alias("direction"), F.col("dst").alias("row"), F.col("src").alias("col"), (F.col("weight") / F.col("_t")).alias("w")
    )
    bwd = edges.join(into, "dst").select(
        F.lit("backward").alias("direction"), F.col("src").alias("row"), F.col("dst").alias("col"), (F.col("weight") / F.col("_t")).alias("w")
    )
    return fwd.unionByName(bwd)


def support_checksums(support: DataFrame, by: str = "col") -> DataFrame:
    """Column (or row) sums per direction: 1 wherever the node has weight."""
    return support.groupBy("direction", F.col(by).alias("node")).agg(F.sum("w").alias("total"))


def softmax_weights(logits: DataFrame, key: str = "graph", logit: str = "logit", by: Sequence[str] = ()) -> DataFrame:
    """Shares by the exponent of what a logit lies below the largest, so that large logits do not overflow."""
    if by:
        top = logits.groupBy(*by).agg(F.max(logit).alias("_top"))
        e = logits.join(top, list(by)).withColumn("_e", F.exp(F.col(logit) - F.col("_top")))
        total = e.groupBy(*by).agg(F.sum("_e").alias("_t"))
        return e.join(total, list(by)).select(*by, key, (F.col("_e") / F.col("_t")).alias("alpha"))
    e = F.exp(F.col(logit) - one_row(logits.agg(F.max(logit).alias("top")))["top"])
    weighed = logits.select(key, e.alias("_e"))
    return weighed.select(key, (F.col("_e") / one_row(weighed.agg(F.sum("_e").alias("t")))["t"]).alias("alpha"))


def fuse_supports(labelled: DataFrame, alpha: DataFrame, key: str = "graph") -> DataFrame:
    """Weighted sum of supports labelled by graph; not renormalised afterwards."""
    return (
        labelled.join(alpha, key)
        .groupBy("direction", "row", "col")
        .agg(F.sum(F.col("w") * F.col("alpha")).alias("w"))
    )


def short_columns(fused: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Columns whose fused sum falls below one, because some graph has no outflow there."""
    return support_checksums(fused).filter(F.col("total") < 1 - tolerance)


def propagate(support: DataFrame, features: DataFrame) -> DataFrame:
    """One step S @ X over long features (node, feature, value), per direction."""
    return (
        support.join(features.withColumnRenamed("node", "col"), "col")
        .groupBy("direction", F.col("row").alias("node"), "feature")
        .agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    )


def diffuse(support: DataFrame, features: DataFrame, steps: int = 2) -> DataFrame:
    """Chebyshev terms x0, Sx0, 2Sx(k-1) - x(k-2) for each direction, as (direction, k, node, feature, value)."""
    dirs = F.array(F.lit("forward"), F.lit("backward"))
    start = pin(features.withColumn("direction", F.explode(dirs)).select("direction", "node", "feature", "value"))
    terms = [start.withColumn("k", F.lit(0))]
    older, newer = None, start
    for k in range(1, steps + 1):
        moved = (
            support.join(newer.withColumnRenamed("node", "col"), ["direction", "col"])
            .groupBy("direction", F.col("row").alias("node"), "feature")
            .agg(F.sum(F.col("w") * F.col("value")).alias("value"))
        )
        if older is not None:
            moved = (
                moved.select("direction", "node", "feature", (F.col("value") * 2).alias("value"))
                .unionByName(older.select("direction", "node", "feature", (-F.col("value")).alias("value")))
                .groupBy("direction", "node", "feature")
                .agg(F.sum("value").alias("value"))
            )
        else:
            moved = moved.unionByName(start.select("direction", "node", "feature", F.lit(0.0).alias("value"))).groupBy(
                "direction", "node", "feature"
            ).agg(F.sum("value").alias("value"))
        moved = pin(moved)
        terms.append(moved.withColumn("k", F.lit(k)))
        older, newer = newer, moved
    out = terms[0]
    for t in terms[1:]:
        out = out.unionByName(t)
    return out


# -- components -----------------------------------------------------------------------


def _unchanged(a: DataFrame) -> bool:
    return a.filter("changed").limit(1).count() == 0


def weak_components(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Component label (smallest member) per node by alternating large-star and small-star steps.

    The number of rounds grows with the logarithm of the component size, not with its diameter.
    """
    pairs = pin(
        edges.filter("src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = pin(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        nxt = pin(
            star.filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        same = nxt.count() == pairs.count() and nxt.exceptAll(pairs).limit(1).count() == 0
        pairs = nxt
        if same:
            break
    labels = pairs.groupBy(F.col("u").alias(node)).agg(F.min("v").alias("_m"))
    return nodes.select(node).join(labels, node, "left").select(node, F.coalesce("_m", node).alias("component"))


def _spread(labels: DataFrame, arcs: DataFrame, best) -> DataFrame:
    """Push labels along arcs until nothing improves.

    Besides its own arcs every node looks back along a pointer, at first one of its sources and then,
    by doubling, a node twice as far behind it, so a long way takes the logarithm of its steps
    wherever the pointers lead along it.
    """
    back = arcs.groupBy(F.col("dst").alias("node")).agg(F.max("src").alias("back"))
    state = pin(labels.join(back, "node", "left").withColumn("changed", F.lit(True)))
    while True:
        pushed = state.filter("changed").join(arcs, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "label")
        behind = state.select(F.col("node").alias("back"), F.col("label").alias("seen"), F.col("back").alias("further"))
        jumped = state.filter("back is not null").join(behind, "back").select("node", F.col("seen").alias("label"), "further")
        none = F.lit(None).cast("long")
        merged = (
            state.select("node", "label", F.col("label").alias("had"), none.alias("further"))
            .unionByName(pushed.select("node", "label", none.alias("had"), none.alias("further")))
            .unionByName(jumped.select("node", "label", none.alias("had"), "further"))
            .groupBy("node")
            .agg(best("label").alias("label"), F.max("had").alias("had"), F.max("further").alias("back"))
        )
        state = pin(merged.filter("had is not null").select("node", "label", "back", (F.col("label") != F.col("had")).alias("changed")))
        if _unchanged(state):
            return state.select("node", "label")


def _trimmed(nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, arcs) left when nodes without an arc in or out, components of their own, are taken away."""
    both = arcs.select(F.col("src").alias("node")).intersect(arcs.select(F.col("dst").alias("node")))
    kept = pin(nodes.join(both, "node", "left_semi"))
    inner = arcs.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return kept, pin(inner)


def _chains(arcs: DataFrame) -> DataFrame:
    """(node, head, tail, low, ring) of nodes with one arc in and one out, by pointer doubling.

    ``head`` and ``tail`` are the ends of the chain that a node stands on. A node whose pointers still
    stand on such nodes after they have doubled past their number is on a ring of them, ``low`` its
    smallest member.
    """
    into = arcs.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"), F.min("src").alias("head"))
    out = arcs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"), F.min("dst").alias("tail"))
    now = pin(into.join(out, "node").filter("i = 1 and o = 1").select("node", "head", "tail", F.col("node").alias("low")))
    members, span = now.count(), 1
    while span <= members:
        up = now.select(F.col("node").alias("head"), F.col("head").alias("h2"), F.col("low").alias("l2"))
        down = now.select(F.col("node").alias("tail"), F.col("tail").alias("t2"))
        met = now.join(up, "head", "left").join(down, "tail", "left")
        now = pin(met.select("node", F.coalesce("h2", "head").alias("head"), F.coalesce("t2", "tail").alias("tail"), F.least("low", "l2").alias("low"), F.col("h2").isNotNull().alias("on")))
        if now.filter("on").isEmpty():
            break
        span *= 2
    ends = now.select(F.col("node").alias("head"), F.lit(True).alias("ring"))
    return pin(now.join(ends, "head", "left").select("node", "head", "tail", "low", F.coalesce("ring", F.lit(False)).alias("ring")))


def _coloured(left: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, label) of the components that hold the largest node of their forward colour."""
    colour = _spread(left.withColumn("label", F.col("node")), arcs, F.max)
    inside = pin(
        arcs.join(colour.select(F.col("node").alias("src"), F.col("label").alias("ls")), "src")
        .join(colour.select(F.col("node").alias("dst"), F.col("label").alias("ld")), "dst")
        .filter("ls = ld")
        .select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    # 1 marks a node that reaches the root of its colour.
    mark = _spread(colour.select("node", (F.col("node") == F.col("label")).cast("long").alias("label")), inside, F.max)
    return pin(mark.filter("label = 1").select("node").join(colour, "node"))


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Strongly connected component per node, named by its largest member.

    Nodes without arcs in or out go first; chains of nodes with one arc in and one out become an arc
    from end to end (their nodes belong to the component of the ends if that is one, else to
    themselves), and rings of them are components. What is left is coloured forward and searched
    backward, then the same again. Chains and rings take rounds as the logarithm of their length.
    """
    left = pin(nodes.select(F.col("node").cast("long").alias("node")).distinct())
    everyone = left
    arcs = pin(edges.filter("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct())
    done, chained = None, []
    while True:
        while True:  # trimming makes chains, and chains make nodes to trim
            left, arcs = _trimmed(left, arcs)
            links = _chains(arcs)
            if links.isEmpty():
                break
            rings = links.filter("ring").select("node", F.col("low").alias("label"))
            done = rings if done is None else done.unionByName(rings)
            on = links.filter("not ring")
            chained.append(on)
            left = left.join(links.select("node"), "node", "left_anti")
            gone = links.select(F.col("node").alias("src"))
            rest = arcs.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti")
            arcs = pin(rest.unionByName(on.select(F.col("head").alias("src"), F.col("tail").alias("dst"))).filter("src <> dst").distinct())
        if arcs.isEmpty():
            break
        found = _coloured(left, arcs)
        done = found if done is None else done.unionByName(found)
        left = pin(left.join(found, "node", "left_anti"))
        ends = found.select(F.col("node").alias("src"))
        arcs = pin(arcs.join(ends, "src", "left_anti").join(ends.withColumnRenamed("src", "dst"), "dst", "left_anti"))
    labels = everyone.select("node", F.col("node").alias("label"))
    if done is not None:
        labels = pin(everyone.join(done, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    for on in reversed(chained):  # ends of a chain may stand on a chain found later
        head = labels.select(F.col("node").alias("head"), F.col("label").alias("a"))
        tail = labels.select(F.col("node").alias("tail"), F.col("label").alias("b"))
        joined = on.join(head, "head").join(tail, "tail").filter("a = b").select("node", F.col("a").alias("joined"))
        labels = pin(labels.join(joined, "node", "left").select("node", F.coalesce("joined", "label").alias("label")))
    largest = labels.groupBy("label").agg(F.max("node").alias("component"))
    return labels.join(largest, "label").select("node", "component")


# -- reports and contracts -----------------------------------------------------------


def graph_report(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Size, isolation, symmetry and weight range of a directed graph, with an overall status."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"))
    per = nodes.select("node").join(out, "node", "left").join(into, "node", "left").fillna(0, ["o", "i"])
    deg = per.agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(F.col("o") == 0).alias("n_zero_out"),
        F.count_if(F.col("i") == 0).alias("n_zero_in"),
        F.count_if((F.col("o") == 0) & (F.col("i") == 0)).alias("n_isolated"),
        F.min("o").alias("min_out_degree"),
        F.max("o").alias("max_out_degree"),
    )
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    lop = edges.groupBy(lo.alias("a"), hi.alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.min("weight").alias("w0"), F.max("weight").alias("w1")
    )
    sym = lop.agg(F.coalesce(F.bool_and((F.col("n") == 2) & (F.col("w0") == F.col("w1"))), F.lit(True)).alias("symmetric"))
    wts = edges.agg(
        F.count(F.lit(1)).alias("n_edges"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"), F.avg("weight").alias("mean_weight")
    )
    warn = (F.col("n_isolated") > 0) | (F.col("n_zero_out") > 0) | (F.col("n_zero_in") > 0)
    return (
        deg.withColumns({"_s": one_row(sym), "_w": one_row(wts)})
        .select(*deg.columns, "_s.symmetric", "_w.n_edges", "_w.min_weight", "_w.max_weight", "_w.mean_weight")
        .withColumn("status", F.when(warn, "ok_with_warnings").otherwise("ok"))
    )


def edge_rules() -> dict[str, tuple[str, Column, Column]]:
    """Row rules every adjacency must pass: finite, non-negative, no self loop."""
    w = F.col("weight")
    name = F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string"))
    return {
        "weight_not_finite": ("error", w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")), name),
        "weight_negative": ("error", w < 0, name),
        "self_loop": ("error", F.col("src") == F.col("dst"), name),
    }
