"""Point and segment operators on plain x / y columns, as equi-joins on grid cells.

Cell sizes follow the data or the search radius, never the whole extent, and coincident
points collapse before any join, so a crowded place does not multiply rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from zonewise.functions.scalars import required_code
from zonewise.session import pin

# Parking that is not open to the public.
RESTRICTED_ACCESS = ("private", "no", "customers", "permit", "restricted", "members", "delivery")
EXCLUDED_PARKING = ("underground", "garages", "sheds")
AIRPORT_NAMES = "(?i)airport|premair|plane parking"


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size)))


def around(size: float) -> Column:
    """The 3 x 3 block of cells around (x, y)."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    cx, cy = cell(F.col("x"), size), cell(F.col("y"), size)
    return F.transform(steps, lambda s: F.struct((cx + s["i"]).alias("cx"), (cy + s["j"]).alias("cy")))


CROWD = 64  # targets of a cell above which its points look on cells half as wide first


def nearest(points: DataFrame, targets: DataFrame, target_id: str, max_distance: float | None = None) -> DataFrame:
    """Every point with its nearest target (ties by id) and ``distance``; null beyond ``max_distance``.

    A target found within one cell width inside the 3 x 3 block is exact. Cells are a tree: one that holds
    more than ``CROWD`` targets is split in four, again and again, and the points of split cells start on
    the smallest cells around them; points without a target there move on to cells twice as wide.
    So a crowded place is met in many small cells and not by all its points with all its targets.
    """
    spots = pin(targets.groupBy("x", "y").agg(F.min(target_id).alias(target_id)))
    box = spots.agg(
        F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")
    ).first()
    size = max(math.sqrt(max(box["w"] or 0, 1e-6) * max(box["h"] or 0, 1e-6) / max(box["n"], 1)), 1e-3)
    if max_distance is not None:
        size = min(size, max_distance)
    left = pin(points.select("x", "y").filter("x is not null and y is not null").distinct())
    found = None

    def at(width: float) -> list[Column]:
        return [cell(F.col("x"), width).alias("cx"), cell(F.col("y"), width).alias("cy")]

    def settled(some: DataFrame, width: float) -> DataFrame:
        t = spots.select(*at(width), F.col("x").alias("tx"), F.col("y").alias("ty"), target_id)
        d = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
        return pin(
            some.select("x", "y", F.inline(around(width)))
            .join(t, ["cx", "cy"])
            .withColumn("distance", d)
            .filter(F.col("distance") <= width)
            .groupBy("x", "y")
            .agg(F.min(F.struct("distance", target_id, "tx", "ty")).alias("_b"))
            .select("x", "y", "_b.*")
        )

    split: list[DataFrame] = []
    while box["n"] > CROWD and len(split) < 40:
        full = pin(spots.groupBy(*at(size / 2 ** len(split))).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("cx", "cy"))
        if full.isEmpty():
            break
        split.append(full)
    for k in range(len(split), 0, -1):  # the smallest cells first
        here = left.select("x", "y", *at(size / 2 ** (k - 1))).join(split[k - 1], ["cx", "cy"], "left_semi").select("x", "y")
        hit = settled(here, size / 2**k)
        found = hit if found is None else found.unionByName(hit)
        left = pin(left.join(hit, ["x", "y"], "left_anti"))
    while box["n"]:
        hit = settled(left, size)
        found = hit if found is None else found.unionByName(hit)
        left = pin(left.join(hit, ["x", "y"], "left_anti"))
        if (max_distance is not None and size >= max_distance) or left.isEmpty():
            break
        size = size * 2 if max_distance is None else min(size * 2, max_distance)
    if found is None:
        return points.withColumns({target_id: F.lit(None), "distance": F.lit(None).cast("double")})
    return points.join(found, ["x", "y"], "left")


def snap(points: DataFrame, nodes: DataFrame, max_m: float = 500.0, node_id: str = "node") -> DataFrame:
    """Nearest network node with a status: ok, ok_long (accepted but far) or unsnapped."""
    long_m = min(100.0, 0.5 * max_m)
    status = F.when(F.col("distance").isNull(), "unsnapped").when(F.col("distance") > long_m, "ok_long").otherwise("ok")
    return nearest(points, nodes, node_id, max_m).withColumn("status", status)


# -- names and postcodes ----------------------------------------------------------------


def clean_name(text: Column, drop: Sequence[str]) -> Column:
    out = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\w\s]", ""))
    for t in drop:
        out = F.replace(out, F.lit(t), F.lit(""))
    return F.trim(out)


def name_similarity(a: Column, b: Column) -> Column:
    """One less the share of letters to edit. A built-in measure, other than a ratio of common blocks."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b))


def match_by_name(
    sites: DataFrame, points: DataFrame, drop: Sequence[str], radius: float = 500.0, min_score: float = 0.5
) -> DataFrame:
    """Best-named point within the radius (first id wins ties), else the site's own coordinates.

    Points of one place and name are one point with the first id, and the points of a name in a small cell are
    first met as one row with their first id. Cells that lie within the radius as a whole need no more than that;
    of a cell on the border, points are looked at only where its first id would beat what the inside gave.
    """
    width = radius / 8
    p = pin(
        points.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("point_id"), clean_name(F.col("name"), drop).alias("pname"))
        .filter("pname <> ''")
        .groupBy("px", "py", "pname")
        .agg(F.min("point_id").alias("point_id"))
        .withColumns({"cx": cell(F.col("px"), width), "cy": cell(F.col("py"), width)})
    )
    heads = pin(p.groupBy("cx", "cy", "pname").agg(F.min(F.struct("point_id", "px", "py")).alias("first")))
    s = sites.filter("x is not null and y is not null").select("site_id", "x", "y", clean_name(F.col("site_name"), drop).alias("sname"))
    span = lambda c: F.explode(F.sequence(cell(F.col(c) - radius, width), cell(F.col(c) + radius, width)))
    lo, hi = (lambda c, v: F.col(c) * width - F.col(v)), (lambda c, v: (F.col(c) + 1) * width - F.col(v))
    gap = lambda c, v: F.greatest(F.lit(0.0), lo(c, v), -hi(c, v))  # noqa: E731 - from the site to the cell
    far = lambda c, v: F.greatest(F.abs(lo(c, v)), F.abs(hi(c, v)))  # noqa: E731 - to its other side
    cells = s.withColumn("cx", span("x")).withColumn("cy", span("y"))
    slack = radius * 1e-9  # rounding may neither lose a cell nor take one for whole
    cells = cells.filter(F.hypot(gap("cx", "x"), gap("cy", "y")) <= radius + slack)
    cells = cells.withColumn("whole", F.hypot(far("cx", "x"), far("cy", "y")) <= radius - slack)
    near = cells.join(heads, ["cx", "cy"]).withColumn("m", -name_similarity(F.col("sname"), F.col("pname"))).filter(-F.col("m") >= min_score)
    choice = lambda at: F.struct(F.col("m"), F.col(f"{at}point_id"), F.col(f"{at}px"), F.col(f"{at}py"))
    inside = pin(near.filter("whole").groupBy("site_id").agg(F.min(choice("first.")).alias("_b")))
    border = near.filter("not whole").join(inside, "site_id", "left").filter(F.col("_b").isNull() | (choice("first.") < F.col("_b")))
    tested = border.select("site_id", "x", "y", "cx", "cy", "pname", "m").join(p, ["cx", "cy", "pname"])
    tested = tested.filter(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) <= radius)
    best = tested.select("site_id", choice("").alias("_b")).unionByName(inside).groupBy("site_id").agg(F.min("_b").alias("_b"))
    hit = F.col("_b").isNotNull()
    return sites.join(best, "site_id", "left").select(
        *[c for c in sites.columns if c not in ("x", "y")],
        F.when(hit, F.bround("_b.px", 2)).otherwise(F.col("x")).alias("x"),
        F.when(hit, F.bround("_b.py", 2)).otherwise(F.col("y")).alias("y"),
        F.when(hit, "exact_building").otherwise("postcode_centroid").alias("coord_source"),
    )


def geocode_lookup(rows: DataFrame, postcode: str, lookup: DataFrame) -> DataFrame:
    """Coordinates by space-stripped postcode; unknown codes stay null."""
    key = F.upper(F.replace(F.col(postcode), F.lit(" "), F.lit("")))
    known = lookup.select(F.upper(F.replace(F.col("postcode"), F.lit(" "), F.lit(""))).alias("_k"), "x", "y").dropDuplicates(["_k"])
    return rows.withColumn("_k", key).join(known, "_k", "left").drop("_k")


# -- point sets -----------------------------------------------------------------------


def public_car_parks(points: DataFrame) -> DataFrame:
    """Open car parks that are large, park-and-ride or properly named; one (smallest id) per 100 m cell."""
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    name = F.coalesce(F.col("name"), F.lit(""))
    named = (F.trim(name) != "") & (name != "Public Car Park")
    keep = (
        ~text("access").isin(*RESTRICTED_ACCESS)
        & ~text("parking").isin(*EXCLUDED_PARKING)
        & ~name.rlike(AIRPORT_NAMES)
        & ~text("operator").contains("airport")
        & (
            (F.coalesce(F.col("capacity").try_cast("double"), F.lit(0.0)) >= 20)
            | text("park_and_ride").isin("yes", "park_and_ride")
            | named
        )
    )
    gx, gy = F.bround(F.bround("x", 2) / 100, 0), F.bround(F.bround("y", 2) / 100, 0)
    rest = [c for c in points.columns if c != "site_id"]
    return (
        points.filter(keep)
        .groupBy(gx.alias("_gx"), gy.alias("_gy"))
        .agg(F.min(F.struct("site_id", *rest)).alias("_r"))
        .select("_r.*")
    )


def distinct_xy(points: DataFrame, point_id: str, digits: int = 2) -> DataFrame:
    """One point (smallest id) per rounded coordinate pair."""
    rest = [c for c in points.columns if c != point_id]
    return (
        points.groupBy(F.bround("x", digits).alias("_x"), F.bround("y", digits).alias("_y"))
        .agg(F.min(F.struct(point_id, *rest)).alias("_r"))
        .select("_r.*")
    )


def collapse_repeats(points: DataFrame, key: str, tolerance: float = 0.01) -> DataFrame:
    """One coordinate per key; ``spread_ok`` is false where repeats disagree by more than the tolerance."""
    return points.groupBy(key).agg(
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        F.count(F.lit(1)).alias("n"),
        ((F.max("x") - F.min("x") <= tolerance) & (F.max("y") - F.min("y") <= tolerance)).alias("spread_ok"),
    )


def bounding_box(points: DataFrame, buffer: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by).agg(
        (F.min("x") - buffer).alias("min_x"),
        (F.min("y") - buffer).alias("min_y"),
        (F.max("x") + buffer).alias("max_x"),
        (F.max("y") + buffer).alias("max_y"),
    )


_SHIFT = 0.3819660112501051  # of a cell: keeps the lines between cells off round coordinates


def _dyadic(lo: Column, hi: Column, levels: int) -> Column:
    """The cells lo..hi as few aligned blocks: an array of (level, index), two a level at most."""
    start = F.struct(lo.alias("a"), (hi + 1).alias("b"), F.array().cast("array<struct<level:int,at:bigint>>").alias("out"))

    def block(on: Column, level: Column, at: Column) -> Column:
        return F.when(on, F.array(F.struct(level.alias("level"), at.alias("at")))).otherwise(F.array().cast("array<struct<level:int,at:bigint>>"))

    def step(s: Column, level: Column) -> Column:
        odd_a, odd_b = (s["a"] < s["b"]) & (F.pmod(s["a"], F.lit(2)) == 1), (s["a"] < s["b"]) & (F.pmod(s["b"], F.lit(2)) == 1)
        a = F.when(odd_a, s["a"] + 1).otherwise(s["a"])
        b = F.when(odd_b, s["b"] - 1).otherwise(s["b"])
        out = F.concat(s["out"], block(odd_a, level, s["a"]), block(odd_b, level, s["b"] - 1))
        return F.struct(F.shiftright(a, 1).alias("a"), F.shiftright(b, 1).alias("b"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step)["out"]


def points_in_polygons(points: DataFrame, segments: DataFrame, point_id: str, size: float, levels: int = 32) -> DataFrame:
    """(point, zone) pairs where the point lies inside, by the parity of crossings.

    A polygon is covered by the cells that its edges pass (border) and the runs of cells between them,
    which lie inside or outside as a whole. Points of inside cells need no edge; runs meet occupied
    cells by aligned blocks of 1, 2, 4, ... cells, so a polygon of any size costs its border and not its
    area. A point of a border cell walks to the middle of its right side, where the parity is known,
    and crosses edges of that cell only; so no polygon gathers all its points or edges in one place.
    Points with a null coordinate lie nowhere; repeated points are answered as often as they come.
    """
    shift = _SHIFT * size
    at_cell = lambda v: F.floor((v + F.lit(shift)) / F.lit(float(size))).cast("long")
    edge = lambda i: i * size - shift  # noqa: E731 - where cell i begins
    rows = segments.select("zone", "x1", "y1", "x2", "y2", F.explode(F.sequence(at_cell(F.least("y1", "y2")), at_cell(F.greatest("y1", "y2")))).alias("cy"))
    slope = F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    inside = lambda y: F.greatest(F.least("y1", "y2"), F.least(y, F.greatest("y1", "y2")))
    x_at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (y - F.col("y1")) * slope)
    level = F.col("y1") == F.col("y2")
    xa = F.when(level, F.col("x1")).otherwise(x_at(inside(edge(F.col("cy")))))
    xb = F.when(level, F.col("x2")).otherwise(x_at(inside(edge(F.col("cy") + 1))))
    ends = [at_cell(F.least(xa, xb) - size * 1e-9), at_cell(F.greatest(xa, xb) + size * 1e-9)]  # rounding may not lose a cell
    border = pin(rows.select("*", F.explode(F.sequence(*ends)).alias("cx")))
    passes = lambda y: ((F.col("y1") <= y) & (y < F.col("y2"))) | ((F.col("y2") <= y) & (y < F.col("y1")))
    middle = edge(F.col("cy") + 0.5)
    mine = passes(middle) & (at_cell(x_at(middle)) == F.col("cx"))
    cells = border.groupBy("zone", "cy", "cx").agg(F.count_if(mine).alias("n"))
    w = W.partitionBy("zone", "cy").orderBy(F.desc("cx"))  # one row of cells of one polygon
    right = F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = pin(cells.select("zone", "cy", "cx", (right % 2 == 1).alias("odd"), F.lag("cx").over(w).alias("next")))
    runs = known.filter("odd and next > cx + 1").select("zone", "cy", F.inline(_dyadic(F.col("cx") + 1, F.col("next") - 1, levels)))

    p = points.select(point_id, "x", "y", at_cell(F.col("x")).alias("cx"), at_cell(F.col("y")).alias("cy")).filter("cx is not null and cy is not null")
    occupied = p.select("cx", "cy").distinct()
    blocks = occupied.select("cx", "cy", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.floor(F.col("cx") / F.pow(F.lit(2.0), i)).cast("long"))).alias("level", "at"))
    whole = blocks.join(runs, ["cy", "level", "at"]).select("cx", "cy", "zone")
    surely = p.join(whole, ["cx", "cy"]).select(point_id, "zone")

    spots = p.withColumn("_row", F.monotonically_increasing_id())
    spots = pin(spots)
    side, mid = edge(F.col("cx") + 1), edge(F.col("cy") + 0.5)
    along = passes(F.col("y")) & (x_at(F.col("y")) > F.col("x")) & (at_cell(x_at(F.col("y"))) <= F.col("cx"))
    spans = (F.least("x1", "x2") < side) & (side <= F.greatest("x1", "x2"))
    y_at = F.col("y1") + F.try_divide((side - F.col("x1")) * (F.col("y2") - F.col("y1")), F.col("x2") - F.col("x1"))
    across = spans & ((y_at > F.col("y")) != (y_at > mid))
    crossed = (
        spots.join(border, ["cx", "cy"])
        .groupBy("_row", point_id, "cx", "cy", "zone")
        .agg((F.count_if(along) + F.count_if(across)).alias("n"))
        .join(known.select("zone", "cy", "cx", "odd"), ["zone", "cy", "cx"])
    )
    return surely.unionByName(crossed.filter((F.col("n") % 2 == 1) != F.col("odd")).select(point_id, "zone"))


# -- tagged sources -------------------------------------------------------------------

ELEMENT_SCHEMA = (
    "elements array<struct<type: string, id: bigint, lat: double, lon: double, "
    "center: struct<lat: double, lon: double>, tags: map<string, string>>>"
)


def tagged_points(raw: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Nested elements to rows: a node's own point, else its centre; pointless elements drop out; tags become columns."""
    e = raw.select(F.inline("elements"))
    return e.select(
        "type",
        "id",
        F.coalesce("lat", "center.lat").alias("lat"),
        F.coalesce("lon", "center.lon").alias("lon"),
        *[F.col("tags")[t].alias(t) for t in tags],
    ).filter("lat is not null and lon is not null")


def poi_layers(layers: Sequence[DataFrame], classes: Sequence[str]) -> DataFrame:
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer, allowMissingColumns=True)
    return out.filter(F.col("fclass").isin(*classes)).withColumn("name", F.coalesce("name", F.lit("")))


def zone_origins(points: DataFrame, code_aliases: Sequence[str] = ("iz_code", "IntZone", "InterZone", "IZ_CODE", "zone")) -> DataFrame:
    """One point per zone under the first code alias present; a row without a code stops the query."""
    code = next(c for c in code_aliases if c in points.columns)
    return points.select(required_code(F.col(code), code).alias("zone"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
