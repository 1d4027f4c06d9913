"""Street networks: arcs from segments, crossings, shortest paths, mode distances and travel times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from zonewise.functions.ranking import dense_position
from zonewise.operators.spatial import cell
from zonewise.session import pin

# Road classes each street mode may use, and the order that settles equal distances.
_SHARED = (
    "primary primary_link secondary secondary_link tertiary tertiary_link unclassified residential living_street "
    "service track track_grade1 track_grade2 track_grade3 track_grade4 track_grade5"
).split()
CLASSES = {
    "road": ["motorway", "motorway_link", "trunk", "trunk_link", *_SHARED],
    "bicycle": ["trunk", "trunk_link", *_SHARED, "cycleway", "path", "bridleway", "footway", "pedestrian"],
    "walking": [*_SHARED, "cycleway", "path", "bridleway", "footway", "pedestrian", "steps"],
}
MODE_ORDER = ("road", "bicycle", "walking", "road+rail", "walking+rail")
RAIL_CLASSES = ("rail", "light_rail", "subway", "narrow_gauge")
STATION_CLASSES = ("railway_station", "railway_halt")
TWO_WAY_BICYCLE = ("cycleway", "path")
BLANK = ("", "NAN", "NONE", "<NA>")
SPEED_KMH = {"drive": 30.0, "walk": 4.5}

# Relaxation steps between two written states: fewer writes against a longer recovery.
STEPS_PER_WRITE = 3


def normalise_segments(df: DataFrame) -> DataFrame:
    """Lower-case class, upper-case flags, missing one-way = B; records which grade fields the source has."""
    flag = lambda c: F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    way = flag("oneway") if "oneway" in df.columns else F.lit("")
    out = df.withColumns(
        {"fclass": F.lower(F.trim("fclass")), "oneway": F.when(way.isin(*BLANK), "B").otherwise(way)}
    )
    for c in ("layer", "bridge", "tunnel"):
        out = out.withColumn(f"has_{c}", F.lit(c in df.columns))
        out = out.withColumn(c, flag(c) if c in df.columns else F.lit(""))
    return out


def normalise_stations(df: DataFrame) -> DataFrame:
    return df.withColumn("fclass", F.lower(F.trim("fclass"))).filter(F.col("fclass").isin(*STATION_CLASSES))


def bad_oneway(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("oneway").isin("F", "T", "B"))


def grade_key(df: DataFrame) -> DataFrame:
    """(layer, bridge, tunnel) with defaults, and whether the source really supplied all three."""
    layer = F.col("layer").try_cast("int")
    ok = {
        "layer": F.col("has_layer") & layer.isNotNull(),
        "bridge": F.col("has_bridge") & F.col("bridge").isin("T", "F"),
        "tunnel": F.col("has_tunnel") & F.col("tunnel").isin("T", "F"),
    }
    return df.withColumns(
        {
            "grade": F.struct(
                F.coalesce(layer, F.lit(0)).alias("layer"), (F.col("bridge") == "T").alias("bridge"), (F.col("tunnel") == "T").alias("tunnel")
            ),
            "grade_complete": ok["layer"] & ok["bridge"] & ok["tunnel"],
        }
    )


def directions(mode: Column, fclass: Column, oneway: Column) -> tuple[Column, Column]:
    """Whether an arc runs along and against its digitised direction."""
    free = (mode == "walking") | ((mode == "bicycle") & fclass.isin(*TWO_WAY_BICYCLE)) | (oneway == "B")
    return free | (oneway == "F"), free | (oneway == "T")


def route_arcs(segments: DataFrame, modes: Sequence[str] = ("road", "bicycle", "walking")) -> DataFrame:
    """Directed arcs (mode, ux, uy, vx, vy, length) over all modes: allowed classes, end points at
    two decimals, no self arcs, shortest length per pair."""
    allowed = F.array(*[F.struct(F.lit(m).alias("m"), F.array(*[F.lit(c) for c in CLASSES[m]]).alias("c")) for m in modes])
    s = segments.withColumn("_m", F.explode(allowed)).filter(F.array_contains("_m.c", F.col("fclass"))).select("*", F.col("_m.m").alias("mode"))
    ahead, back = directions(F.col("mode"), F.col("fclass"), F.col("oneway"))
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    a = [F.bround(c, 2) for c in ("x1", "y1", "x2", "y2")]
    arc = lambda u, v, p, q: F.struct(u.alias("ux"), v.alias("uy"), p.alias("vx"), q.alias("vy"))
    both = F.array_compact(F.array(F.when(ahead, arc(*a)), F.when(back, arc(a[2], a[3], a[0], a[1]))))
    return (
        s.select("mode", length.alias("length"), F.explode(both).alias("e"))
        .select("mode", "e.*", "length")
        .filter((F.col("length") > 1e-6) & ~((F.col("ux") == F.col("vx")) & (F.col("uy") == F.col("vy"))))
        .groupBy("mode", "ux", "uy", "vx", "vy")
        .agg(F.min("length").alias("length"))
    )


def number_nodes(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x, y) with dense ids in coordinate order, and arcs (mode, u, v, length) on them."""
    xy = arcs.select(F.inline(F.array(F.struct(F.col("ux").alias("x"), F.col("uy").alias("y")), F.struct(F.col("vx").alias("x"), F.col("vy").alias("y"))))).distinct()
    nodes = pin(dense_position(xy, [F.col("x"), F.col("y")], "node"))
    u = nodes.select(F.col("node").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    v = nodes.select(F.col("node").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    return nodes, arcs.join(u, ["ux", "uy"]).join(v, ["vx", "vy"]).select("mode", "u", "v", "length")


def crossings(segments: DataFrame, size: float) -> DataFrame:
    """Lines that cross in their interiors or overlap, with how many segment pairs do so and how.

    Segments of one course are one line that carries their number and, by grade, the number of
    those whose grade is fully known; pairs of segments are products of these numbers. Lines meet in
    the grid cells of their bounding boxes, on the level of the longer one: cells are ``size``, twice
    that, four times that wide and so on, so a long line stands on few cells and short lines meet on
    small ones. A pair is tested only in the cell that holds the lower-left corner of the boxes'
    intersection, so it is seen exactly once and no distinct is needed. Touching at an end point of either is no crossing. A line overlaps itself where it
    stands for several segments. ``n_pairs`` is the sum of the last three columns.
    """
    ends = F.sort_array(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    graded = (
        segments.withColumn("e", ends)
        .groupBy("e", F.when(F.col("grade_complete"), F.col("grade")).alias("grade"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = F.map_from_entries(F.collect_list(F.when(F.col("grade").isNotNull(), F.struct("grade", "n"))))
    lines = graded.groupBy("e").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("grade").isNotNull(), F.col("n"))), F.lit(0)).alias("c"), known.alias("g"))
    x, y = [F.col("e")[i]["x"] for i in (0, 1)], [F.col("e")[i]["y"] for i in (0, 1)]
    s = pin(lines.select(x[0].alias("x1"), y[0].alias("y1"), x[1].alias("x2"), y[1].alias("y2"), "n", "c", "g"))
    own = ("x1", "y1", "x2", "y2", "n", "c", "g", "x0", "x9", "y0", "y9")
    s = s.withColumns({"x0": F.least("x1", "x2"), "x9": F.greatest("x1", "x2"), "y0": F.least("y1", "y2"), "y9": F.greatest("y1", "y2")})
    # A line's level is that of the cells it passes two of a side at most.
    extent = F.greatest(F.col("x9") - F.col("x0"), F.col("y9") - F.col("y0"), F.lit(size))
    s = s.withColumn("level", F.ceil(F.log2(extent / size) - 1e-12).cast("int"))
    top = s.agg(F.coalesce(F.max("level"), F.lit(0)).alias("top")).first()["top"]
    wide = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("at"))
    grid = lambda v: F.floor(v / wide)

    def on_cells(levels: Column, side: str) -> DataFrame:
        some = s.withColumn("at", F.explode(levels))
        some = some.withColumn("cx", F.explode(F.sequence(grid(F.col("x0")), grid(F.col("x9")))))
        some = some.withColumn("cy", F.explode(F.sequence(grid(F.col("y0")), grid(F.col("y9")))))
        return some.select("at", "cx", "cy", *[F.col(n).alias(f"{side}_{n}") for n in (*own, "level")])

    a = on_cells(F.sequence(F.col("level"), F.lit(top)), "a")
    b = on_cells(F.array("level"), "b")
    x0, y0 = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    first = F.struct("a_x1", "a_y1", "a_x2", "a_y2") < F.struct("b_x1", "b_y1", "b_x2", "b_y2")
    met = (
        ((F.col("a_level") < F.col("b_level")) | first)
        & (x0 <= F.least("a_x9", "b_x9"))
        & (y0 <= F.least("a_y9", "b_y9"))
        & (grid(x0) == F.col("cx"))
        & (grid(y0) == F.col("cy"))
    )

    def side(p, q, r):
        (px, py), (qx, qy), (rx, ry) = p, q, r
        return (qx - px) * (ry - py) - (qy - py) * (rx - px)

    A, B = (F.col("a_x1"), F.col("a_y1")), (F.col("a_x2"), F.col("a_y2"))
    C, D = (F.col("b_x1"), F.col("b_y1")), (F.col("b_x2"), F.col("b_y2"))
    s1, s2, s3, s4 = side(A, B, C), side(A, B, D), side(C, D, A), side(C, D, B)
    proper = (s1 * s2 < 0) & (s3 * s4 < 0)
    along = F.greatest(F.least("a_x9", "b_x9") - x0, F.least("a_y9", "b_y9") - y0)
    lined = (s1 == 0) & (s2 == 0) & (along > 1e-6)
    zero = F.lit(0).cast("long")
    same = F.aggregate(F.map_entries("a_g"), zero, lambda t, g: t + g["value"] * F.coalesce(F.try_element_at("b_g", g["key"]), zero))
    corners = [f"{side}_{c}" for side in "ab" for c in ("x1", "y1", "x2", "y2")]
    turned = [F.when(first, F.col(c)).otherwise(F.col(("b" if c[0] == "a" else "a") + c[1:])).alias(c) for c in corners]
    apart = a.join(b, ["at", "cx", "cy"]).filter(met & (proper | lined)).select(
        *turned, (F.col("a_n") * F.col("b_n")).alias("n_pairs"), (F.col("a_c") * F.col("b_c")).alias("n_known"), same.alias("n_at_grade")
    )
    pairs_of = lambda n: (n * (n - 1) / 2).cast("long")
    long_enough = F.greatest(F.col("x9") - F.col("x0"), F.col("y9") - F.col("y0")) > 1e-6
    with_itself = s.filter(long_enough & (F.col("n") > 1)).select(
        *[F.col(c[2:]).alias(c) for c in corners],
        pairs_of(F.col("n")).alias("n_pairs"),
        pairs_of(F.col("c")).alias("n_known"),
        F.aggregate(F.map_values("g"), zero, lambda t, n: t + pairs_of(n)).alias("n_at_grade"),
    )
    return apart.unionByName(with_itself).select(
        *corners, "n_pairs", (F.col("n_known") - F.col("n_at_grade")).alias("n_separated"), (F.col("n_pairs") - F.col("n_known")).alias("n_ambiguous"), "n_at_grade"
    )


def ambiguous_crossings(pairs: DataFrame) -> DataFrame:
    """Every crossing where the grade of a segment is not fully known."""
    return pairs.filter("n_ambiguous > 0")


def grade_sources(segments: DataFrame) -> DataFrame:
    """How many segments supply each grade field, and all three."""
    layer = F.col("layer").try_cast("int").isNotNull()
    return segments.agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.count_if(F.col("has_layer") & layer).alias("n_layer"),
        F.count_if(F.col("has_bridge") & F.col("bridge").isin("T", "F")).alias("n_bridge"),
        F.count_if(F.col("has_tunnel") & F.col("tunnel").isin("T", "F")).alias("n_tunnel"),
        F.count_if("grade_complete").alias("n_complete"),
    )


def crossing_report(pairs: DataFrame) -> DataFrame:
    """Grade-separated crossings (ignored when noding), ambiguous ones, and those at the same known grade."""
    return pairs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_separated", "n_ambiguous", "n_at_grade")])


def contracted(arcs: DataFrame, keep: DataFrame, keys: Sequence[str] = ("mode",)) -> DataFrame:
    """``arcs(keys, u, v, cost)`` with the chains between junctions as one arc each.

    A node with exactly two neighbours that is not in ``keep(node)`` is only passed through. The arcs
    that arrive there are joined with the one that goes on to the other neighbour, twice as far in
    every round; a turn on the way or a dead end is never shorter, so distances between the nodes
    that stay do not change. Parallel arcs leave the cheapest.
    """
    keys = list(keys)
    plain = arcs.filter("u <> v").groupBy(*keys, "u", "v").agg(F.min("cost").alias("cost"))
    plain = pin(plain)
    beside = plain.select(*keys, F.col("u").alias("node"), F.col("v").alias("other")).unionByName(plain.select(*keys, F.col("v").alias("node"), F.col("u").alias("other")))
    two = beside.groupBy(*keys, "node").agg((F.min("other") != F.max("other")).alias("apart"), F.count_distinct("other").alias("n")).filter("apart and n = 2")
    inner = pin(two.select(*keys, "node").join(keep.select("node").distinct(), "node", "left_anti").select(*keys, "node"))
    at = lambda name, flag: inner.select(*keys, F.col("node").alias(name), F.lit(True).alias(flag))
    flagged = plain.join(at("u", "from_inner"), [*keys, "u"], "left").join(at("v", "to_inner"), [*keys, "v"], "left")
    now = pin(
        flagged.select(*keys, "u", F.col("v").alias("first"), F.col("u").alias("before"), "v", "cost", F.coalesce("from_inner", F.lit(False)).alias("from_inner"), F.coalesce("to_inner", F.lit(False)).alias("to_inner"))
    )
    while not now.filter("to_inner and not from_inner").isEmpty():
        onward = now.filter("from_inner").select(
            *keys, F.col("u").alias("v"), F.col("first").alias("f2"), F.col("before").alias("b2"), F.col("v").alias("v2"), F.col("cost").alias("c2"), F.col("to_inner").alias("i2")
        )
        longer = now.filter("to_inner").join(onward, [*keys, "v"]).filter("before <> f2 and u <> v2")
        longer = longer.select(*keys, "u", "first", F.col("b2").alias("before"), F.col("v2").alias("v"), (F.col("cost") + F.col("c2")).alias("cost"), "from_inner", F.col("i2").alias("to_inner"))
        now = pin(now.filter("not to_inner").unionByName(longer))
    return now.filter("not from_inner and not to_inner").groupBy(*keys, "u", "v").agg(F.min("cost").alias("cost"))


def reached(arcs: DataFrame, seeds: DataFrame, targets: DataFrame, keys: Sequence[str], arc_keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., wanted): how many of ``targets(target, node)`` a source can reach, for sources that reach any.

    Floods run forward from the sources and backward from the targets; the side that knows fewer nodes goes
    on. A pair is settled where its floods meet or one of them is at its end, and a flood stops with its last open pair,
    so a target in a dead end costs its surroundings and not the network.
    """
    keys, arc_keys = list(keys), list(arc_keys)
    ahead = arcs.select(*arc_keys, F.col("u").alias("node"), F.col("v").alias("to"))
    back = arcs.select(*arc_keys, F.col("v").alias("node"), F.col("u").alias("to"))
    at = {"ahead": pin(seeds.select(*keys, "node").distinct().withColumn("fresh", F.lit(True)))}
    sides = at["ahead"].select(*arc_keys).distinct().withColumn("_all", F.lit(1))
    at["back"] = pin(targets.select("target", "node").distinct().withColumn("_all", F.lit(1)).join(sides, "_all").select(*arc_keys, "target", "node", F.lit(True).alias("fresh")))
    own = {"ahead": keys, "back": [*arc_keys, "target"]}
    ends = at["back"].select(*arc_keys, "target").distinct().withColumn("_all", F.lit(1))
    still = at["ahead"].select(*keys).distinct().withColumn("_all", F.lit(1)).join(ends, ["_all", *arc_keys]).select(*keys, "target")
    still, met = pin(still), None
    while True:
        meet = at["ahead"].select(*keys, "node").join(at["back"].select(*arc_keys, "target", "node"), [*arc_keys, "node"]).select(*keys, "target").distinct()
        pairs = still.join(meet.withColumn("met", F.lit(True)), [*keys, "target"], "left")
        for side in at:
            pairs = pairs.join(at[side].filter("fresh").select(*own[side], F.lit(True).alias(f"on_{side}")).distinct(), own[side], "left")
        pairs = pin(pairs)
        found = pairs.filter("met").select(*keys, "target")
        met = found if met is None else met.unionByName(found)
        still = pairs.filter("met is null and on_ahead and on_back").select(*keys, "target")
        known = {side: at[side].join(still.select(*own[side]).distinct(), own[side], "left_semi") for side in at}
        size = {side: rows.count() for side, rows in known.items()}
        if not min(size.values()):
            return pin(met.groupBy(*keys).agg(F.count(F.lit(1)).alias("wanted")))
        side = min(size, key=size.get)
        step = known[side].filter("fresh").join(ahead if side == "ahead" else back, [*arc_keys, "node"]).select(*own[side], F.col("to").alias("node"), F.lit(True).alias("fresh"))
        at[side] = pin(known[side].withColumn("fresh", F.lit(False)).unionByName(step).groupBy(*own[side], "node").agg(F.bool_and("fresh").alias("fresh")))


def shortest_paths(
    arcs: DataFrame,
    seeds: DataFrame,
    keys: Sequence[str] = ("source",),
    arc_keys: Sequence[str] = (),
    within: float | None = None,
    targets: DataFrame | None = None,
    nearest: int | None = None,
) -> DataFrame:
    """Least cost from every seed to every node it reaches: (keys..., node, cost).

    ``arcs``: u, v, cost (non-negative) and ``arc_keys``; ``seeds``: keys, node, cost. All sources
    advance together; a round relaxes only labels that improved in the round before and is
    written out, so a lost executor costs one round.

    ``within`` drops labels above that cost. With ``targets(target, node, cost)`` a source stops where it
    cannot reach one of its ``nearest`` targets, or any target without ``nearest``, any cheaper: the cost
    at which it has that many bounds all labels that go on. Only labels of such targets are then final.
    """
    keys = list(keys)
    arcs = pin(arcs.select(*arc_keys, "u", "v", F.col("cost").alias("step")))
    wanted = None
    if targets is not None and nearest is None:
        wanted = reached(arcs, seeds, targets, keys, arc_keys)
        seeds = seeds.join(wanted, keys, "left_semi")

    def relax(state: DataFrame) -> DataFrame:
        left = state.filter("fresh").withColumnRenamed("node", "u")
        if targets is not None:
            left = left.filter("bound is null or cost <= bound")
        ahead = left.join(arcs, [*arc_keys, "u"]).select(*keys, F.col("v").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), "bound")
        if within is not None:
            ahead = ahead.filter(F.col("cost") <= within)
        merged = (
            state.select(*keys, "node", "cost", F.col("cost").alias("had"), "bound")
            .unionByName(ahead.withColumn("had", F.lit(None).cast("double")))
            .groupBy(*keys, "node")
            .agg(F.min("cost").alias("cost"), F.min("had").alias("had"), F.min("bound").alias("bound"))
        )
        return merged.select(*keys, "node", "cost", (F.col("had").isNull() | (F.col("cost") < F.col("had"))).alias("fresh"), "bound")

    def bounded(state: DataFrame) -> DataFrame:
        """Labels with the cost at which their source has as many targets as wanted, null before."""
        if targets is None:
            return state
        state = state.drop("bound")
        met = state.join(targets.select("target", "node", F.col("cost").alias("more")), "node").groupBy(*keys, "target").agg(F.min(F.col("cost") + F.col("more")).alias("total"))
        if nearest is None:
            all_met = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("bound")).join(wanted, keys)
            last = all_met.filter("n = wanted").select(*keys, "bound")
        else:
            place = F.row_number().over(W.partitionBy(*keys).orderBy("total"))  # a source keeps its first few in every task
            last = met.withColumn("_place", place).filter(F.col("_place") <= nearest).groupBy(*keys).agg(F.max(F.when(F.col("_place") == nearest, F.col("total"))).alias("bound"))
        return state.join(last, keys, "left")

    start = seeds.groupBy(*keys, "node").agg(F.min("cost").alias("cost")).withColumns({"fresh": F.lit(True), "bound": F.lit(None).cast("double")})
    state = pin(bounded(start))
    while True:
        # The size of a written state is known, so a small one is sent to the arcs; steps between writes would move all arcs.
        for _ in range(STEPS_PER_WRITE if targets is None and within is None else 1):
            state = relax(state)
        state = pin(bounded(state))
        if state.filter("fresh and (bound is null or cost <= bound)").isEmpty():
            return state.select(*keys, "node", "cost")


def _junctions(arcs: DataFrame, keys: Sequence[str], *ends: DataFrame) -> DataFrame:
    """Arcs between junctions and the nodes of ``ends``, in terms of ``cost``."""
    keep = ends[0].select("node")
    for more in ends[1:]:
        keep = keep.unionByName(more.select("node"))
    return contracted(arcs, keep.filter("node is not null"), keys)


def od_distances(arcs: DataFrame, origins: DataFrame, destinations: DataFrame, keys: Sequence[str] = ("mode",), within_km: float | None = None, nearest: int | None = None) -> DataFrame:
    """(keys, src, dst, km): origin snap + path + destination snap; unreachable pairs are absent.

    ``origins`` / ``destinations``: id, node, distance (metres), unsnapped rows already left out.
    ``within_km`` keeps pairs up to that distance, ``nearest`` every origin's nearest destinations other
    than itself (ties by name); either one bounds the search of each origin, so no product arises.
    Without them a search ends at the farthest destination its origin reaches.

    A search up to ``within_km`` sees the surroundings of the origins only, so it goes along the arcs as they
    are: contracting the chains would follow every chain of the network, however far from an origin.
    """
    keys = list(keys)
    lengths = arcs.select(*keys, "u", "v", F.col("length").alias("cost"))
    if within_km is None:
        lengths = _junctions(lengths, keys, origins, destinations)
    seeds = arcs.select(*keys).distinct()
    start = origins.select(F.col("id").alias("src"), "node", F.col("distance").alias("cost"))
    start = start.withColumn("_all", F.explode(_collected(seeds, keys))).select("src", "node", "cost", "_all.*")
    ends = pin(destinations.select(F.col("id").alias("target"), "node", F.col("distance").alias("cost")))
    wanted = None if nearest is None else nearest + 1  # an origin may be a destination itself
    bound = None if within_km is None else within_km * 1000.0
    dist = shortest_paths(lengths, start, [*keys, "src"], keys, bound, ends if bound is None or nearest is not None else None, wanted)
    out = dist.join(ends.select(F.col("target").alias("dst"), "node", F.col("cost").alias("distance")), "node")
    km = F.when(F.col("src") == F.col("dst"), 0.0).otherwise((F.col("cost") + F.col("distance")) / 1000.0)
    out = out.select(*keys, "src", "dst", km.alias("km"))
    if within_km is not None:
        out = out.filter(F.col("km") <= within_km)
    if nearest is not None:
        place = F.row_number().over(W.partitionBy(*keys, "src").orderBy("km", "dst"))
        out = out.filter("src <> dst").withColumn("_place", place).filter(F.col("_place") <= nearest).drop("_place")
    return out


def _collected(few: DataFrame, keys: Sequence[str]) -> Column:
    """The handful of mode names as an array."""
    return few.agg(F.collect_set(F.struct(*keys)).alias("v")).select("v").scalar()


def combine_modes(distances: DataFrame, order: Sequence[str] = MODE_ORDER) -> DataFrame:
    """Least km per pair over modes, ties by mode order; the diagonal is 0 and labelled ``self``."""
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("mode"))
    best = distances.groupBy("src", "dst").agg(F.min(F.struct("km", rank.alias("r"), "mode")).alias("b"))
    own = F.col("src") == F.col("dst")
    return best.select("src", "dst", F.when(own, 0.0).otherwise(F.col("b.km")).alias("km"), F.when(own, "self").otherwise(F.col("b.mode")).alias("mode"))


def _spread(many: DataFrame, few: DataFrame, key: str, by: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_part``: rows of a key in ``many`` are dealt into parts of about ``block``, rows of ``few`` go to each part."""
    parts = many.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_parts"))
    dealt = many.join(parts, key).withColumn("_part", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).drop("_parts")
    each = few.join(parts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt, each


def intermodal(access: DataFrame, rail: DataFrame, egress: DataFrame, block: int = 4096) -> DataFrame:
    """min over a <> b of access[i,a] + rail[a,b] + egress[b,j], as two min-plus products in blocks.

    The minimum over the first station is taken before the second join, so the join never carries
    every (i, a, b) combination further. A station that many zones use is met in parts of ``block``
    zones, each with a copy of the station's lines, and minima are combined before the shuffle.
    """
    near, lines = _spread(access, rail.filter("a <> b"), "a", "i", block)
    boarded = pin(near.join(lines, ["a", "_part"]).groupBy("i", "b").agg(F.min(F.col("access_km") + F.col("rail_km")).alias("so_far")))
    far, left = _spread(boarded, egress, "b", "i", block)
    out = far.join(left, ["b", "_part"]).groupBy("i", "j").agg(F.min(F.col("so_far") + F.col("egress_km")).alias("km"))
    return out.withColumn("km", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("km")))


def travel_minutes(length_m: Column, speed_kmh: Column) -> Column:
    return length_m / (speed_kmh * 1000.0 / 60.0)


def travel_times(arcs: DataFrame, zones: DataFrame, sites: DataFrame, digits: int | None = 2, within: float | None = None) -> DataFrame:
    """(zone, site_id, mode, minutes) of the pairs that are reached, up to ``within`` minutes if given; rounded half-even.

    ``arcs``: mode, u, v, cost in minutes; ``zones`` / ``sites``: id, node. Origins sharing a node are
    routed once, over arcs between junctions.
    """
    modes = arcs.select("mode").distinct()
    start = zones.select(F.col("node").alias("source")).filter("source is not null").distinct()
    start = start.withColumn("_m", F.explode(_collected(modes, ["mode"]))).select("source", "_m.mode", F.col("source").alias("node"), F.lit(0.0).alias("cost"))
    ends = None
    if within is None:
        ends = pin(sites.filter("node is not null").select(F.col("node").alias("target"), "node", F.lit(0.0).alias("cost")).distinct())
    dist = shortest_paths(_junctions(arcs, ["mode"], zones, sites), start, ["mode", "source"], ["mode"], within, ends)
    least = F.min("cost")
    return (
        zones.select(F.col("id").alias("zone"), F.col("node").alias("source"))
        .join(dist, "source")
        .join(sites.select(F.col("id").alias("site_id"), "node"), "node")
        .groupBy("zone", "site_id", "mode")
        .agg((least if digits is None else F.bround(least, digits)).alias("minutes"))
    )


def travel_time_matrix(arcs: DataFrame, zones: DataFrame, sites: DataFrame, digits: int | None = 2) -> DataFrame:
    """The full sink of ``travel_times``: a row for every zone, site and mode, null where unreachable.

    This is a product by contract, for export; nothing else reads it. Pairs are built by an equi-join
    on a hash bucket of the site, so the product is spread over all buckets.
    """
    reach = travel_times(arcs, zones, sites, digits)
    modes = arcs.select("mode").distinct()
    buckets = int(zones.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_zone = (
        zones.select(F.col("id").alias("zone"))
        .withColumn("_m", F.explode(_collected(modes, ["mode"])))
        .select("zone", "_m.mode", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_b"))
    )
    ids = sites.select(F.col("id").alias("site_id"), F.pmod(F.hash("id"), F.lit(buckets)).alias("_b"))
    return per_zone.join(ids, "_b").drop("_b").join(reach, ["zone", "site_id", "mode"], "left")
