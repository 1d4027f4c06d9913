"""Spatial, street-network and travel-time queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonewise.functions.scalars import one_row, r6 as R
from zonewise.operators import graph, paths, spatial
from zonewise.plans.registry import ORACLES, query, r6
from zonewise.plans.sqltext import CENTROIDS, DEPOTS, ROADS, TRAVEL
from zonewise.plans.windowing import rounded
from zonewise.session import pin
from zonewise.sources.tables import GRID, STEP, centroids, depots, roads, table, travel


def sites_xy(spark, sf):
    """Every customer as a point on the street plane."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("point_id"), (k * 37 % 4000 + 0.5).alias("x"), (F.abs("c_acctbal") % 3700).alias("y"))


POINTS = "SELECT c_custkey AS point_id, c_custkey*37%4000+0.5::DOUBLE AS x, abs(c_acctbal)%3700 AS y FROM customer"


@query("nearest_centroid", "J9", f"""WITH p AS ({POINTS}), z AS ({CENTROIDS}) SELECT point_id, zone, {r6('d')} AS distance FROM (SELECT point_id, zone, sqrt((p.x-z.x)**2+(p.y-z.y)**2) AS d,
 row_number() OVER (PARTITION BY point_id ORDER BY sqrt((p.x-z.x)**2+(p.y-z.y)**2), zone) AS r FROM p, z) WHERE r=1""")
def nearest_centroid(spark, sf):
    out = spatial.nearest(sites_xy(spark, sf), centroids(spark, sf), "zone")
    return rounded(out.select("point_id", "zone", "distance"))


_NODES = f"""rd AS ({ROADS}), nd AS (SELECT row_number() OVER (ORDER BY x, y)-1 AS node, x, y FROM (SELECT x1 AS x, y1 AS y FROM arc UNION SELECT x2, y2 FROM arc))"""
_CLS = """cls AS (SELECT * FROM (VALUES ('road','primary'),('road','residential'),('road','motorway'),('bicycle','primary'),('bicycle','residential'),('bicycle','cycleway'),
 ('bicycle','footway'),('walking','primary'),('walking','residential'),('walking','cycleway'),('walking','footway')) t(mode, fclass))"""
ARCS = f"""rd AS ({ROADS}), {_CLS}, am AS (SELECT mode, x1, y1, x2, y2, sqrt((x2-x1)**2+(y2-y1)**2) AS len,
  mode='walking' OR (mode='bicycle' AND fclass='cycleway') OR oneway IN ('B','F') AS fwd, mode='walking' OR (mode='bicycle' AND fclass='cycleway') OR oneway IN ('B','T') AS bwd
  FROM rd JOIN cls USING (fclass)),
 arc AS (SELECT mode, x1, y1, x2, y2, min(len) AS len FROM (SELECT mode, x1, y1, x2, y2, len FROM am WHERE fwd UNION ALL SELECT mode, x2, y2, x1, y1, len FROM am WHERE bwd) GROUP BY ALL),
 nd AS (SELECT row_number() OVER (ORDER BY x, y)-1 AS node, x, y FROM (SELECT x1 AS x, y1 AS y FROM arc UNION SELECT x2, y2 FROM arc)),
 ar AS (SELECT mode, a.node AS u, b.node AS v, len FROM arc JOIN nd a ON a.x=x1 AND a.y=y1 JOIN nd b ON b.x=x2 AND b.y=y2)"""


def network(spark, sf):
    seg = paths.normalise_segments(roads(spark, sf))
    nodes, arcs = paths.number_nodes(pin(paths.route_arcs(seg)))
    return nodes, pin(arcs)


@query("street_arcs", "G4 PF11 PF12 PF19 D9", f"WITH {ARCS} SELECT mode, count(*) AS n_arcs, {r6('sum(len)/1000')} AS km, count(DISTINCT u) AS n_tails, min(v) AS first_head FROM ar GROUP BY 1")
def street_arcs(spark, sf):
    _, arcs = network(spark, sf)
    return rounded(arcs.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n_arcs"), (F.sum("length") / 1000).alias("km"), F.count_distinct("u").alias("n_tails"), F.min("v").alias("first_head")
    ))


@query("grade_keys", "PF13 PF19", f"""WITH rd AS ({ROADS}) SELECT coalesce(CAST(layer AS INT),0) AS layer, bridge='T' AS bridge, coalesce(tunnel='T',false) AS tunnel,
 layer IS NOT NULL AND tunnel IS NOT NULL AS complete, count(*) AS n FROM rd GROUP BY ALL""")
def grade_keys(spark, sf):
    g = paths.grade_key(paths.normalise_segments(roads(spark, sf)))
    return g.groupBy("grade.layer", "grade.bridge", "grade.tunnel", F.col("grade_complete").alias("complete")).agg(F.count(F.lit(1)).alias("n"))


def _snap_sql(points, pid):
    return f"""(SELECT {pid}, node, d, CASE WHEN d IS NULL THEN 'unsnapped' WHEN d>100 THEN 'ok_long' ELSE 'ok' END AS status FROM (
   SELECT p.{pid}, n.node, n.d FROM {points} p LEFT JOIN (SELECT {pid}, node, d FROM (SELECT q.{pid}, nd.node, sqrt((q.x-nd.x)**2+(q.y-nd.y)**2) AS d,
    row_number() OVER (PARTITION BY q.{pid} ORDER BY sqrt((q.x-nd.x)**2+(q.y-nd.y)**2), nd.node) AS r FROM {points} q, nd) WHERE r=1 AND d<=500) n USING ({pid})))"""


@query("snapped_points", "J10 D15", f"WITH {ARCS}, pt AS ({POINTS}) SELECT point_id, node, {r6('d')} AS distance, status FROM {_snap_sql('pt', 'point_id')}")
def snapped_points(spark, sf):
    nodes, _ = network(spark, sf)
    return rounded(spatial.snap(sites_xy(spark, sf), nodes).select("point_id", "node", "distance", "status"))


ODSQL = f"""WITH RECURSIVE {ARCS}, cz AS ({CENTROIDS}), so AS MATERIALIZED (SELECT zone AS src, node, d FROM {_snap_sql('cz', 'zone')} WHERE node IS NOT NULL),
 dist(mode, src, n, cost) USING KEY (mode, src, n) AS (SELECT mode, src, node, d FROM so, (SELECT DISTINCT mode FROM ar) UNION
  SELECT mode, src, n, cost FROM (SELECT q.mode, q.src, ar.v AS n, min(q.cost+ar.len) AS cost FROM dist q JOIN ar ON ar.mode=q.mode AND ar.u=q.n GROUP BY ALL) x
  WHERE NOT EXISTS (SELECT 1 FROM recurring.dist r WHERE r.mode=x.mode AND r.src=x.src AND r.n=x.n AND r.cost<=x.cost)),
 od AS (SELECT mode, dist.src, e.src AS dst, CASE WHEN dist.src=e.src THEN 0 ELSE (cost+e.d)/1000 END AS km FROM dist JOIN so e ON e.node=n)"""


def zone_distances(spark, sf, **bound):
    nodes, arcs = network(spark, sf)
    z = pin(spatial.snap(centroids(spark, sf), nodes).filter("node is not null").select(F.col("zone").alias("id"), "node", "distance"))
    return paths.od_distances(arcs, z, z, **bound)


@query("zone_path_distances", "G6 D10", f"{ODSQL} SELECT mode, src, dst, {r6('km')} AS km FROM od")
def zone_path_distances(spark, sf):
    return rounded(zone_distances(spark, sf))


@query("shortest_mode", "G7 S1", f"""{ODSQL} SELECT src, dst, {r6('min(km)')} AS km, CASE WHEN src=dst THEN 'self' ELSE arg_min(mode, (km, CASE mode WHEN 'road' THEN 1 WHEN 'bicycle' THEN 2 ELSE 3 END)) END AS mode
 FROM od GROUP BY src, dst""")
def shortest_mode(spark, sf):
    return rounded(paths.combine_modes(zone_distances(spark, sf)))


@query("nearest_zone_paths", "G6 W2 T1", f"""{ODSQL}, k AS (SELECT *, row_number() OVER (PARTITION BY mode, src ORDER BY km, dst) AS r FROM (SELECT mode, src, dst, min(km) AS km FROM od WHERE src<>dst GROUP BY ALL))
 SELECT mode, src, dst, {r6('km')} AS km FROM k WHERE r<=3""")
def nearest_zone_paths(spark, sf):
    """The three nearest zones of every zone and mode, by a search that stops there."""
    return rounded(zone_distances(spark, sf, nearest=3))


@query("zones_within_reach", "G6 G7", f"""{ODSQL} SELECT src, dst, {r6('min(km)')} AS km, CASE WHEN src=dst THEN 'self' ELSE arg_min(mode, (km, CASE mode WHEN 'road' THEN 1 WHEN 'bicycle' THEN 2 ELSE 3 END)) END AS mode
 FROM od WHERE km<=1.5 GROUP BY src, dst""")
def zones_within_reach(spark, sf):
    """Zones up to 1.5 km apart by their shortest mode, by a search bounded there."""
    return rounded(paths.combine_modes(zone_distances(spark, sf, within_km=1.5)))


KM = f"""km AS (SELECT z.n_nationkey AS src, s.nationkey AS dst, avg(minutes)+abs(z.n_nationkey-s.nationkey)*0.5 AS km FROM ({TRAVEL}) t JOIN nation z ON z.n_name=zone JOIN ({DEPOTS}) s USING (site_id)
 WHERE mode='walk' AND minutes IS NOT NULL GROUP BY z.n_nationkey, s.nationkey)"""


def nation_km(spark, sf):
    z = table(spark, sf, "nation").select(F.col("n_name").alias("zone"), F.col("n_nationkey").alias("src"))
    s = depots(spark, sf).select("site_id", F.col("nationkey").alias("dst"))
    t = travel(spark, sf).filter("mode = 'walk' and minutes is not null").join(z, "zone").join(s, "site_id")
    return pin(t.groupBy("src", "dst").agg((F.avg("minutes") + F.abs(F.col("src") - F.col("dst")) * 0.5).alias("km")))


@query("knn_edges", "W2 T1", f"""WITH {KM}, k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY km, dst) AS r FROM km WHERE src<>dst), e AS (SELECT * FROM k WHERE r<=5),
 tau AS (SELECT quantile_cont(km,0.5) AS tau FROM e) SELECT src, dst, r AS neighbour_rank, {r6('km')} AS km, {r6('tau')} AS tau, {r6('exp(-km/tau)')} AS weight FROM e, tau""")
def knn_edges(spark, sf):
    return rounded(graph.knn_edges(nation_km(spark, sf), 5).select("src", "dst", F.col("neighbour_rank").cast("long").alias("neighbour_rank"), "km", "tau", "weight"))


@query("distance_stats", "A11", f"""WITH {KM} SELECT count(*) AS n_finite, 25*24-count(*) AS n_unreachable, {r6('min(km)')} AS min_km, {r6('quantile_cont(km,0.5)')} AS median_km, {r6('max(km)')} AS max_km FROM km WHERE src<>dst""")
def distance_stats(spark, sf):
    n = table(spark, sf, "nation").agg(F.count(F.lit(1)).alias("n"))
    return rounded(graph.distance_stats(nation_km(spark, sf), one_row(n)["n"]))


@query("intermodal_distances", "J12", f"""WITH t AS ({TRAVEL}), ac AS (SELECT zone AS i, site_id AS a, minutes AS m FROM t WHERE mode='walk' AND minutes IS NOT NULL), eg AS (SELECT zone AS j, site_id AS b, minutes AS m FROM t WHERE mode='drive' AND minutes IS NOT NULL),
 ra AS (SELECT 'SITE_'||lpad(CAST(x.l_suppkey AS VARCHAR),6,'0') AS a, 'SITE_'||lpad(CAST(y.l_suppkey AS VARCHAR),6,'0') AS b, min(x.l_quantity+y.l_quantity) AS m FROM lineitem x JOIN lineitem y
   ON x.l_orderkey=y.l_orderkey AND y.l_linenumber=x.l_linenumber+1 WHERE x.l_suppkey<>y.l_suppkey GROUP BY ALL)
 SELECT i, j, {r6('CASE WHEN i=j THEN 0 ELSE min(ac.m+ra.m+eg.m) END')} AS km FROM ac JOIN ra USING (a) JOIN eg USING (b) GROUP BY i, j""")
def intermodal_distances(spark, sf):
    t = travel(spark, sf).filter("minutes is not null")
    access = t.filter("mode = 'walk'").select(F.col("zone").alias("i"), F.col("site_id").alias("a"), F.col("minutes").alias("access_km"))
    egress = t.filter("mode = 'drive'").select(F.col("zone").alias("j"), F.col("site_id").alias("b"), F.col("minutes").alias("egress_km"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    nxt = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("to"), F.col("l_quantity").alias("q2"))
    name = lambda c: F.concat(F.lit("SITE_"), F.lpad(F.col(c).cast("string"), 6, "0"))
    rail = (
        li.join(nxt, ["l_orderkey", "l_linenumber"])
        .filter("l_suppkey <> to")
        .groupBy(name("l_suppkey").alias("a"), name("to").alias("b"))
        .agg(F.min(F.col("l_quantity") + F.col("q2")).alias("rail_km"))
    )
    return rounded(paths.intermodal(access, rail, egress))


@query("travel_time_matrix", "G8 F4 F9", f"""WITH RECURSIVE {ARCS}, cz AS ({CENTROIDS}), dp AS ({DEPOTS}), so AS MATERIALIZED (SELECT zone, node FROM {_snap_sql('cz', 'zone')}),
 de AS MATERIALIZED (SELECT site_id, node FROM {_snap_sql('dp', 'site_id')}), tm AS (SELECT CASE mode WHEN 'road' THEN 'drive' ELSE 'walk' END AS mode, u, v,
   len/(CASE mode WHEN 'road' THEN 30.0 ELSE 4.5 END::DOUBLE*1000.0/60.0) AS c FROM ar WHERE mode<>'bicycle'),
 dist(mode, s, n, cost) USING KEY (mode, s, n) AS (SELECT mode, node, node, 0.0::DOUBLE FROM (SELECT DISTINCT node FROM so WHERE node IS NOT NULL), (SELECT DISTINCT mode FROM tm) UNION
  SELECT mode, s, n, cost FROM (SELECT q.mode, q.s, tm.v AS n, min(q.cost+tm.c) AS cost FROM dist q JOIN tm ON tm.mode=q.mode AND tm.u=q.n GROUP BY ALL) x
  WHERE NOT EXISTS (SELECT 1 FROM recurring.dist r WHERE r.mode=x.mode AND r.s=x.s AND r.n=x.n AND r.cost<=x.cost))
 SELECT zone, site_id, m.mode, {r6('cost')} AS minutes FROM so CROSS JOIN de CROSS JOIN (SELECT DISTINCT mode FROM tm) m LEFT JOIN dist ON dist.mode=m.mode AND dist.s=so.node AND dist.n=de.node""")
def travel_time_matrix(spark, sf):
    return rounded(full_precision_travel(spark, sf))


def travel_inputs(spark, sf):
    nodes, arcs = network(spark, sf)
    mode = F.when(F.col("mode") == "road", "drive").when(F.col("mode") == "walking", "walk")
    speed = F.when(F.col("mode") == "road", paths.SPEED_KMH["drive"]).otherwise(paths.SPEED_KMH["walk"])
    timed = arcs.filter("mode <> 'bicycle'").select(mode.alias("mode"), "u", "v", paths.travel_minutes(F.col("length"), speed).alias("cost"))
    z = pin(spatial.snap(centroids(spark, sf), nodes).select(F.col("zone").alias("id"), "node"))
    s = pin(spatial.snap(depots(spark, sf), nodes).select(F.col("site_id").alias("id"), "node"))
    return timed, z, s


def full_precision_travel(spark, sf):
    return paths.travel_time_matrix(*travel_inputs(spark, sf), digits=None)


_TRAVEL_CTE = ORACLES["travel_time_matrix"].split(" SELECT zone, site_id, m.mode")[0]


@query("travel_times_within", "G8 PF14", f"""{_TRAVEL_CTE} SELECT zone, site_id, dist.mode, {r6('cost')} AS minutes FROM dist JOIN so ON dist.s=so.node JOIN de ON dist.n=de.node WHERE cost<=8""")
def travel_times_within(spark, sf):
    """Sites reached within eight minutes; no pair beyond is searched or made."""
    return rounded(paths.travel_times(*travel_inputs(spark, sf), digits=None, within=8.0))


CROSSED = f"""WITH rd AS ({ROADS}), g AS (SELECT seg_id, x1, y1, x2, y2, coalesce(CAST(layer AS INT),0) AS l, bridge AS b, coalesce(tunnel,'F') AS t, layer IS NOT NULL AND tunnel IS NOT NULL AS ok FROM rd),
 cl AS (SELECT seg_id, cx, unnest(generate_series(floor(least(y1,y2)/600)::INT, floor(greatest(y1,y2)/600)::INT)) AS cy FROM (SELECT *, unnest(generate_series(floor(least(x1,x2)/600)::INT, floor(greatest(x1,x2)/600)::INT)) AS cx FROM g)),
 pr AS (SELECT DISTINCT a.seg_id AS i, b.seg_id AS j FROM cl a JOIN cl b ON a.cx=b.cx AND a.cy=b.cy AND a.seg_id<b.seg_id),
 q AS (SELECT least(a.y1,a.y2) AS a_low, least(b.y1,b.y2) AS b_low, a.l=b.l AND a.b=b.b AND a.t=b.t AS same, a.ok AND b.ok AS both_ok,
   (a.x2-a.x1)*(b.y1-a.y1)-(a.y2-a.y1)*(b.x1-a.x1) AS s1, (a.x2-a.x1)*(b.y2-a.y1)-(a.y2-a.y1)*(b.x2-a.x1) AS s2,
   (b.x2-b.x1)*(a.y1-b.y1)-(b.y2-b.y1)*(a.x1-b.x1) AS s3, (b.x2-b.x1)*(a.y2-b.y1)-(b.y2-b.y1)*(a.x2-b.x1) AS s4,
   least(greatest(a.x1,a.x2),greatest(b.x1,b.x2))-greatest(least(a.x1,a.x2),least(b.x1,b.x2)) AS ox, least(greatest(a.y1,a.y2),greatest(b.y1,b.y2))-greatest(least(a.y1,a.y2),least(b.y1,b.y2)) AS oy
   FROM pr JOIN g a ON a.seg_id=i JOIN g b ON b.seg_id=j),
 h AS (SELECT * FROM q WHERE (s1*s2<0 AND s3*s4<0) OR (s1=0 AND s2=0 AND ox>=0 AND oy>=0 AND greatest(ox,oy)>1e-6))
"""


@query("crossing_report", "G5 PF13", f"""{CROSSED} SELECT count(*) FILTER (WHERE both_ok AND NOT same) AS n_separated, count(*) FILTER (WHERE NOT both_ok) AS n_ambiguous, count(*) FILTER (WHERE both_ok AND same) AS n_at_grade FROM h""")
def crossing_report(spark, sf):
    return paths.crossing_report(paths.crossings(graded_roads(spark, sf), 1.0 * STEP))


def graded_roads(spark, sf):
    return paths.grade_key(paths.normalise_segments(roads(spark, sf)))


@query("ambiguous_crossings", "G5", f"""{CROSSED} SELECT least(a_low, b_low) AS lower_y, count(*) FILTER (WHERE NOT both_ok) AS n_ambiguous FROM h GROUP BY 1 HAVING n_ambiguous > 0""")
def ambiguous_crossings(spark, sf):
    found = paths.ambiguous_crossings(paths.crossings(graded_roads(spark, sf), 1.0 * STEP))
    return found.groupBy(F.least("a_y1", "a_y2", "b_y1", "b_y2").alias("lower_y")).agg(F.sum("n_ambiguous").alias("n_ambiguous"))


@query("grade_sources", "G5", f"""WITH rd AS ({ROADS}) SELECT count(*) AS n_segments, count(TRY_CAST(layer AS INT)) AS n_layer, count(bridge) AS n_bridge,
 count(tunnel) AS n_tunnel, count(*) FILTER (WHERE layer IS NOT NULL AND bridge IS NOT NULL AND tunnel IS NOT NULL) AS n_complete FROM rd""")
def grade_sources(spark, sf):
    return paths.grade_sources(graded_roads(spark, sf))


# Parts as unit squares on a grid: a polygon layer that grows with the part table.
SQUARES = """sq AS (SELECT p_partkey AS zone, (p_partkey%50)*80.0::DOUBLE AS x, (p_partkey//50)*80.0::DOUBLE AS y FROM part),
 sg AS (SELECT zone, x AS x1, y AS y1, x+80 AS x2, y AS y2 FROM sq UNION ALL SELECT zone, x+80, y, x+80, y+80 FROM sq UNION ALL SELECT zone, x+80, y+80, x, y+80 FROM sq UNION ALL SELECT zone, x, y+80, x, y FROM sq)"""


def square_segments(spark, sf):
    k, w = F.col("p_partkey"), 80.0
    x, y = (k % 50) * w, F.floor(k / 50) * w
    sides = [(x, y, x + w, y), (x + w, y, x + w, y + w), (x + w, y + w, x, y + w), (x, y + w, x, y)]
    arr = F.array(*[F.struct(*[c.cast("double").alias(n) for c, n in zip(s, ("x1", "y1", "x2", "y2"))]) for s in sides])
    return table(spark, sf, "part").select(k.alias("zone"), F.inline(arr))


@query("rook_contiguity", "G1", f"""WITH {SQUARES} SELECT a.zone AS a, b.zone AS b, 80.0::DOUBLE AS shared_length FROM sq a JOIN sq b ON a.zone<b.zone AND ((b.x=a.x+80 AND b.y=a.y) OR (b.x=a.x AND b.y=a.y+80))""")
def rook_contiguity(spark, sf):
    return rounded(graph.rook_contiguity(square_segments(spark, sf)))


@query("polygon_overlap_check", "G1 D17", f"WITH {SQUARES} SELECT count(*) AS n_overlapping FROM sq a JOIN sq b ON a.zone<b.zone AND a.x<b.x+80 AND b.x<a.x+80 AND a.y<b.y+80 AND b.y<a.y+80")
def polygon_overlap_check(spark, sf):
    return graph.overlapping_segments(square_segments(spark, sf)).agg(F.count(F.lit(1)).alias("n_overlapping"))


@query("points_in_polygons", "SP1", f"WITH {SQUARES}, p AS ({POINTS}) SELECT point_id, zone FROM p JOIN sq ON p.x>=sq.x AND p.x<sq.x+80 AND p.y>=sq.y AND p.y<sq.y+80")
def points_in_polygons(spark, sf):
    return spatial.points_in_polygons(sites_xy(spark, sf), square_segments(spark, sf), "point_id", 160.0)


@query("area_bounding_boxes", "SP2", f"""WITH d AS ({DEPOTS}) SELECT site_type, {r6('min(x)-2000')} AS min_x, {r6('min(y)-2000')} AS min_y, {r6('max(x)+2000')} AS max_x, {r6('max(y)+2000')} AS max_y FROM d GROUP BY 1""")
def area_bounding_boxes(spark, sf):
    return rounded(spatial.bounding_box(depots(spark, sf), 2000.0, ["site_type"]))


CARS = """SELECT o_orderkey AS site_id, (o_custkey%400*31)%4000+0.25::DOUBLE AS x, (o_orderkey*17)%3700+0.5::DOUBLE AS y,
 CASE WHEN o_orderstatus='P' THEN 'Private' WHEN o_orderstatus='O' THEN 'yes' END AS access, CASE WHEN o_orderpriority='5-LOW' THEN 'underground' ELSE 'surface' END AS parking,
 CASE WHEN o_orderkey%3=0 THEN CAST(o_orderkey%60 AS VARCHAR) WHEN o_orderkey%3=1 THEN 'many' END AS capacity,
 CASE WHEN o_orderkey%7=0 THEN 'Airport lot' WHEN o_orderkey%7=1 THEN 'Public Car Park' WHEN o_orderkey%7=2 THEN 'Castle Street' END AS name,
 CASE WHEN o_orderkey%29=0 THEN 'City Airport Ltd' END AS operator, CASE WHEN o_orderkey%19=0 THEN 'Yes' END AS park_and_ride FROM orders"""


def parking(spark, sf):
    k, o = F.col("o_orderkey"), table(spark, sf, "orders")
    return o.select(
        k.alias("site_id"),
        (F.col("o_custkey") % 400 * 31 % 4000 + 0.25).alias("x"),
        (k * 17 % 3700 + 0.5).alias("y"),
        F.when(F.col("o_orderstatus") == "P", "Private").when(F.col("o_orderstatus") == "O", "yes").alias("access"),
        F.when(F.col("o_orderpriority") == "5-LOW", "underground").otherwise("surface").alias("parking"),
        F.when(k % 3 == 0, (k % 60).cast("string")).when(k % 3 == 1, "many").alias("capacity"),
        F.when(k % 7 == 0, "Airport lot").when(k % 7 == 1, "Public Car Park").when(k % 7 == 2, "Castle Street").alias("name"),
        F.when(k % 29 == 0, "City Airport Ltd").alias("operator"),
        F.when(k % 19 == 0, "Yes").alias("park_and_ride"),
    )


@query("public_car_parks", "PF9", f"""WITH c AS ({CARS}), f AS (SELECT * FROM c WHERE lower(coalesce(access,'')) NOT IN ('private','no') AND parking<>'underground' AND coalesce(name,'') NOT LIKE '%irport%'
 AND lower(coalesce(operator,'')) NOT LIKE '%airport%' AND (coalesce(TRY_CAST(capacity AS DOUBLE),0)>=20 OR lower(coalesce(park_and_ride,''))='yes' OR (name IS NOT NULL AND name<>'Public Car Park')))
 SELECT site_id, {r6('x')} AS x, {r6('y')} AS y FROM (SELECT *, row_number() OVER (PARTITION BY round_even(x/100,0), round_even(y/100,0) ORDER BY site_id) AS r FROM f) WHERE r=1""")
def public_car_parks(spark, sf):
    return rounded(spatial.public_car_parks(parking(spark, sf)).select("site_id", "x", "y"))


@query("distinct_stations", "S7 PF19", f"WITH c AS ({CARS}) SELECT min(site_id) AS site_id FROM c GROUP BY round_even(x/10,0), round_even(y/10,0)")
def distinct_stations(spark, sf):
    p = parking(spark, sf).select("site_id", "x", "y")
    return spatial.distinct_xy(p, "site_id", -1).select("site_id")


@query("collapsed_coordinates", "S6", f"""SELECT o_custkey AS k, min(o_totalprice%1000) AS x, min(o_totalprice%700) AS y, count(*) AS n,
 max(o_totalprice%1000)-min(o_totalprice%1000)<=0.01 AND max(o_totalprice%700)-min(o_totalprice%700)<=0.01 AS spread_ok FROM orders GROUP BY 1""")
def collapsed_coordinates(spark, sf):
    p = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_totalprice") % 1000).alias("x"), (F.col("o_totalprice") % 700).alias("y"))
    return spatial.collapse_repeats(p, "k")


@query("postcode_geocodes", "J7 F1", """SELECT o_orderkey AS k, CASE WHEN s_suppkey IS NOT NULL THEN (s_suppkey*10)::DOUBLE END AS x, s_acctbal AS y FROM orders LEFT JOIN supplier ON s_suppkey=o_custkey%120""")
def postcode_geocodes(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("eh "), (F.col("o_custkey") % 120).cast("string"), F.lit(" x")).alias("pc"))
    look = table(spark, sf, "supplier").select(F.concat(F.lit("EH"), F.col("s_suppkey").cast("string"), F.lit("X")).alias("postcode"), (F.col("s_suppkey") * 10).cast("double").alias("x"), F.col("s_acctbal").alias("y"))
    return spatial.geocode_lookup(rows, "pc", look).select("k", "x", "y")


def _cleaned(name):
    return f"trim(replace(replace(lower(regexp_replace({name},'[^\\w\\s]','','g')),'pharmacy',''),'mobilestop',''))"


@query("name_matched_buildings", "J8 F2", f"""WITH p AS (SELECT site_id AS point_id, x AS px, y AS py, {_cleaned('name')} AS pname FROM ({CARS}) WHERE name IS NOT NULL),
 s AS (SELECT site_id, x, y, 'Castle St '||site_type AS site_name, {_cleaned("'Castle St '||site_type")} AS sname FROM ({DEPOTS})),
 m AS (SELECT site_id, px, py, row_number() OVER (PARTITION BY site_id ORDER BY levenshtein(sname,pname)/greatest(length(sname),length(pname)), point_id) AS r FROM s JOIN p
  ON abs(x-px)<=500 AND abs(y-py)<=500 AND sqrt((x-px)*(x-px)+(y-py)*(y-py))<=500 WHERE pname<>'' AND 1-levenshtein(sname,pname)/greatest(length(sname),length(pname))>=0.5)
 SELECT s.site_id, site_name, coalesce(round_even(px,2), x) AS x, coalesce(round_even(py,2), y) AS y, CASE WHEN px IS NULL THEN 'postcode_centroid' ELSE 'exact_building' END AS coord_source
 FROM s LEFT JOIN m ON s.site_id=m.site_id AND r=1""")
def name_matched_buildings(spark, sf):
    """Suppliers matched to named car parks within 500 m."""
    pts = parking(spark, sf).filter("name is not null").select(F.col("site_id").alias("point_id"), "x", "y", "name")
    sites = depots(spark, sf).withColumn("site_name", F.concat(F.lit("Castle St "), F.col("site_type")))
    return spatial.match_by_name(sites.select("site_id", "site_name", "x", "y"), pts, ["pharmacy", "mobilestop"])


@query("zone_origin_points", "IO18 J2", f"SELECT zone, {r6('x')} AS x, {r6('y')} AS y FROM ({CENTROIDS})")
def zone_origin_points(spark, sf):
    return rounded(spatial.zone_origins(centroids(spark, sf).withColumnRenamed("zone", "IntZone")))


@query("poi_layers", "IO11 S1", f"""WITH c AS ({CARS}) SELECT fclass, name, count(*) AS n FROM (SELECT access AS fclass, coalesce(name,'') AS name FROM c UNION ALL SELECT parking, coalesce(operator,'') FROM c)
 WHERE fclass IN ('yes','surface') GROUP BY ALL""")
def poi_layers(spark, sf):
    p = parking(spark, sf)
    a = p.select(F.col("access").alias("fclass"), "name")
    b = p.select(F.col("parking").alias("fclass"), F.col("operator").alias("name"))
    return spatial.poi_layers([a, b], ["yes", "surface"]).groupBy("fclass", "name").agg(F.count(F.lit(1)).alias("n"))


@query("tagged_points", "IO10 D16 F8", """SELECT user_id%3 AS kind, count(*) AS n, count(CASE WHEN event_type='error' THEN NULL ELSE 1 END) AS n_named, CAST(sum(CAST(json_extract_string(props,'$.k') AS INT)) AS BIGINT) AS k_total
 FROM events WHERE user_id%3<>2 GROUP BY 1""")
def tagged_points(spark, sf):
    """Events rewritten as nested map elements (a third of them without a point), read back through the element schema."""
    u = F.col("user_id") % 3
    own = F.when(u == 0, F.struct(F.col("value").alias("lat"), F.col("value").alias("lon")))
    doc = F.struct(
        F.array(
            F.struct(
                F.when(u == 0, "node").otherwise("way").alias("type"),
                F.col("event_id").alias("id"),
                own["lat"].alias("lat"),
                own["lon"].alias("lon"),
                F.when(u == 1, F.struct(F.col("value").alias("lat"), F.col("value").alias("lon"))).alias("center"),
                F.struct(F.when(F.col("event_type") != "error", F.col("event_type")).alias("name"), F.get_json_object("props", "$.k").alias("k")).alias("tags"),
            )
        ).alias("elements")
    )
    raw = table(spark, sf, "events").select(F.from_json(F.to_json(doc), spatial.ELEMENT_SCHEMA).alias("d")).select("d.elements")
    pts = spatial.tagged_points(raw, ["name", "k"])
    return pts.groupBy(F.when(F.col("type") == "node", F.lit(0)).otherwise(F.lit(1)).cast("long").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.count("name").alias("n_named"), F.sum(F.col("k").cast("int")).alias("k_total")
    )


@query("candidate_site_table", "J5 J6 J7 J9 PF9 S1 A25", f"""WITH c AS ({CARS}), cz AS ({CENTROIDS}), f AS (SELECT * FROM c WHERE lower(coalesce(access,'')) NOT IN ('private','no') AND parking<>'underground' AND coalesce(name,'') NOT LIKE '%irport%'
 AND lower(coalesce(operator,'')) NOT LIKE '%airport%' AND (coalesce(TRY_CAST(capacity AS DOUBLE),0)>=20 OR lower(coalesce(park_and_ride,''))='yes' OR (name IS NOT NULL AND name<>'Public Car Park'))),
 pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY round_even(x/100,0), round_even(y/100,0) ORDER BY site_id) AS r FROM f) WHERE r=1),
 mb AS (SELECT 'MS_'||row_number() OVER (ORDER BY site_id) AS site_id, coalesce(name,'Public Car Park') AS site_name, 'mobile_stop' AS site_type, x, y,
  (SELECT arg_min(zone, (sqrt((cz.x-pk.x)**2+(cz.y-pk.y)**2), zone)) FROM cz) AS zone, 'provisional' AS suitability FROM pk),
 gp AS (SELECT 'GP_'||c_custkey AS site_id, c_name AS site_name, 'gp' AS site_type, (s_suppkey*10)::DOUBLE AS x, s_acctbal AS y, n_name AS zone, 'confirmed' AS suitability
  FROM customer JOIN nation ON n_nationkey=c_nationkey LEFT JOIN supplier ON s_suppkey=c_custkey%120 WHERE n_regionkey=1),
 al AS (SELECT * FROM mb UNION ALL SELECT * FROM gp)
 SELECT site_id, site_name, site_type, {r6('al.x')} AS x, {r6('al.y')} AS y, zone, {r6('round_even(cz.x,2)')} AS zone_x, suitability FROM al LEFT JOIN cz USING (zone)""")
def candidate_site_table(spark, sf):
    from zonewise.operators import sites

    k = F.col("c_custkey")
    register = table(spark, sf, "customer").select(
        k.alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("eh "), (k % 120).cast("string"), F.lit(" x")).alias("postcode"), F.col("c_nationkey").alias("area")
    )
    lookup = table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("area"), F.col("n_name").alias("zone"))
    codes = table(spark, sf, "supplier").select(
        F.concat(F.lit("EH"), F.col("s_suppkey").cast("string"), F.lit("X")).alias("postcode"), (F.col("s_suppkey") * 10).cast("double").alias("x"), F.col("s_acctbal").alias("y")
    )
    z = centroids(spark, sf)
    merged = sites.merge_sites(sites.mobile_sites(parking(spark, sf), z), sites.clinic_sites(register, lookup, z, codes, "GP_", "gp"))
    return rounded(merged.select("site_id", "site_name", "site_type", "x", "y", "zone", "zone_x", "suitability"))
