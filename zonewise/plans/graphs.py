"""Graph construction, diffusion and component queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonewise.functions.scalars import one_row, r6 as R
from zonewise.operators import checks, graph
from zonewise.plans.registry import query, r6
from zonewise.plans.sqltext import FLOWS, TRIPS
from zonewise.plans.windowing import rounded
from zonewise.session import pin
from zonewise.sources.tables import flows, nation_nodes, table, trips

# The node set leaves out region 4, so flows to and from it fall outside the study area.
NODES = "SELECT n_name AS zone, row_number() OVER (ORDER BY n_nationkey)-1 AS node_index, n_nationkey FROM nation WHERE n_regionkey<>4"
ALIGNED = f"""nodes AS ({NODES}), fl AS ({FLOWS}), al AS (SELECT fl.*, s.node_index AS si, d.node_index AS di,
 s.node_index IS NOT NULL AND d.node_index IS NOT NULL AS kept FROM fl LEFT JOIN nodes s ON fl.src=s.n_nationkey LEFT JOIN nodes d ON fl.dst=d.n_nationkey),
 ed AS (SELECT si AS src, di AS dst, share AS weight FROM al WHERE kept AND si<>di AND share>0)"""
SUPP = f"""{ALIGNED}, sup AS (SELECT 'forward' AS direction, dst AS "row", src AS col, weight/sum(weight) OVER (PARTITION BY src) AS w FROM ed
 UNION ALL SELECT 'backward', src, dst, weight/sum(weight) OVER (PARTITION BY dst) FROM ed)"""


def nodes(spark, sf):
    from zonewise.operators.clean import dense_position

    keep = table(spark, sf, "nation").filter("n_regionkey <> 4").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("zone"))
    return pin(dense_position(keep, [F.col("zone")], "node_index"))


def aligned(spark, sf):
    nd = nodes(spark, sf)
    return pin(graph.align_flows(flows(spark, sf), nd)), nd


def edges(spark, sf):
    al, nd = aligned(spark, sf)
    return pin(graph.mobility_edges(al)), nd


def features(spark, sf, nd):
    """Mean balance and count of customers per node, long."""
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("zone")).agg(
        F.avg("c_acctbal").alias("balance"), F.count(F.lit(1)).cast("double").alias("customers")
    )
    return c.join(nd, "zone").select(
        F.col("node_index").alias("node"), F.stack(F.lit(2), F.lit("balance"), F.col("balance"), F.lit("customers"), F.col("customers")).alias("feature", "value")
    )


FEAT = """ft AS (SELECT node_index AS node, feature, value FROM (SELECT c_nationkey, avg(c_acctbal) AS balance, count(*)::DOUBLE AS customers
 FROM customer GROUP BY 1) c UNPIVOT (value FOR feature IN (balance, customers)) JOIN nodes ON n_nationkey=c_nationkey)"""


@query("mobility_graph", "G3 W1 J2 D8", f"""WITH {ALIGNED} SELECT src, dst, {r6('weight')} AS weight,
 row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS neighbour_rank FROM ed""")
def mobility_graph(spark, sf):
    return rounded(graph.neighbour_rank(edges(spark, sf)[0]))


@query("flow_coverage", "A8", f"""WITH {ALIGNED} SELECT count(*) FILTER (WHERE kept) AS n_kept_pairs, count(*) FILTER (WHERE NOT kept) AS n_dropped_pairs,
 {r6('sum(share) FILTER (WHERE kept)')} AS kept_share, {r6('coalesce(sum(share) FILTER (WHERE NOT kept),0)')} AS dropped_share,
 (SELECT count(*) FROM nodes)-count(DISTINCT si) AS n_missing_origins, (SELECT count(*) FROM nodes)-count(DISTINCT di) AS n_missing_destinations,
 (SELECT count(*)*count(*) FROM nodes) AS n_expected_pairs, count(*) FILTER (WHERE kept)=(SELECT count(*)*count(*) FROM nodes) AS complete FROM al""")
def flow_coverage(spark, sf):
    al, nd = aligned(spark, sf)
    return rounded(graph.flow_coverage(al, nd))


@query("node_strengths", "A9", f"""WITH {ALIGNED}, o AS (SELECT si AS i, max(share) FILTER (WHERE si=di) AS ss, sum(share) FILTER (WHERE si<>di) AS os,
 count(*) FILTER (WHERE si<>di AND share>0) AS od FROM al WHERE kept GROUP BY 1), n AS (SELECT di AS i, sum(share) FILTER (WHERE si<>di) AS ins,
 count(*) FILTER (WHERE si<>di AND share>0) AS ind FROM al WHERE kept GROUP BY 1)
 SELECT node_index, {r6('ss')} AS self_share, {r6('coalesce(os,0)')} AS out_strength, coalesce(od,0) AS out_degree, {r6('coalesce(ins,0)')} AS in_strength,
 coalesce(ind,0) AS in_degree FROM nodes LEFT JOIN o ON o.i=node_index LEFT JOIN n ON n.i=node_index""")
def node_strengths(spark, sf):
    al, nd = aligned(spark, sf)
    return rounded(graph.node_strengths(al, nd))


@query("undirected_degree", "A10 G2", f"""WITH t AS (SELECT DISTINCT least(src,dst) AS a, greatest(src,dst) AS b FROM ({TRIPS})),
 e AS (SELECT a AS n FROM t UNION ALL SELECT b FROM t) SELECT c_custkey AS node, count(e.n) AS degree FROM customer LEFT JOIN e ON e.n=c_custkey GROUP BY 1""")
def undirected_degree(spark, sf):
    t = trips(spark, sf).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    nd = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    return graph.degree(t, nd, node="node")


@query("symmetric_adjacency_report", "G2 G16", f"""WITH t AS (SELECT DISTINCT least(src,dst) AS a, greatest(src,dst) AS b FROM ({TRIPS})),
 e AS (SELECT a AS s, b AS d FROM t UNION ALL SELECT b, a FROM t), o AS (SELECT c_custkey AS n, count(e.s) AS k FROM customer LEFT JOIN e ON e.s=c_custkey GROUP BY 1)
 SELECT count(*) AS n_nodes, count(*) FILTER (WHERE k=0) AS n_zero_out, count(*) FILTER (WHERE k=0) AS n_zero_in, count(*) FILTER (WHERE k=0) AS n_isolated,
 min(k) AS min_out_degree, max(k) AS max_out_degree, (SELECT count(*) FROM e x ANTI JOIN e y ON x.s=y.d AND x.d=y.s)=0 AS symmetric, (SELECT count(*) FROM e) AS n_edges, 1.0::DOUBLE AS min_weight, 1.0::DOUBLE AS max_weight,
 1.0::DOUBLE AS mean_weight, CASE WHEN count(*) FILTER (WHERE k=0)>0 THEN 'ok_with_warnings' ELSE 'ok' END AS status FROM o""")
def symmetric_adjacency_report(spark, sf):
    t = trips(spark, sf).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    nd = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    return graph.graph_report(pin(graph.symmetric_adjacency(t)), nd)


@query("mobility_graph_report", "G16 G17", f"""WITH {ALIGNED}, o AS (SELECT src, count(*) AS k FROM ed GROUP BY 1)
 SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM nodes WHERE node_index NOT IN (SELECT src FROM ed)) AS n_zero_out,
 (SELECT count(*) FROM nodes WHERE node_index NOT IN (SELECT dst FROM ed)) AS n_zero_in,
 (SELECT count(*) FROM nodes WHERE node_index NOT IN (SELECT dst FROM ed) AND node_index NOT IN (SELECT src FROM ed)) AS n_isolated,
 (SELECT min(coalesce(k,0)) FROM nodes LEFT JOIN o ON o.src=node_index) AS min_out_degree, (SELECT max(k) FROM o) AS max_out_degree, NOT EXISTS (SELECT 1 FROM ed x LEFT JOIN ed y ON x.src=y.dst AND x.dst=y.src WHERE y.weight IS DISTINCT FROM x.weight) AS symmetric,
 count(*) AS n_edges, {r6('min(weight)')} AS min_weight, {r6('max(weight)')} AS max_weight, {r6('avg(weight)')} AS mean_weight,
 CASE WHEN (SELECT count(*) FROM nodes WHERE node_index NOT IN (SELECT dst FROM ed) OR node_index NOT IN (SELECT src FROM ed))>0 THEN 'ok_with_warnings' ELSE 'ok' END AS status FROM ed""")
def mobility_graph_report(spark, sf):
    e, nd = edges(spark, sf)
    return rounded(graph.graph_report(e, nd.select(F.col("node_index").alias("node"))))


@query("adjacency_rules", "G17 D17", f"""WITH {ALIGNED}, bad AS (SELECT src, CASE WHEN (src+dst)%13=0 THEN src ELSE dst END AS dst, CASE WHEN (src+dst)%7=0 THEN NULL WHEN (src+dst)%5=0 THEN -weight ELSE weight END AS weight FROM ed),
 k AS (SELECT *, CAST(src AS VARCHAR)||'>'||CAST(dst AS VARCHAR) AS name FROM bad)
 SELECT code, level, n_bad, sample FROM (SELECT 'weight_not_finite' AS code, 'error' AS level, count(*) AS n_bad, min(name) AS sample FROM k WHERE weight IS NULL
 UNION ALL SELECT 'weight_negative', 'error', count(*), min(name) FROM k WHERE weight<0 UNION ALL SELECT 'self_loop', 'error', count(*), min(name) FROM k WHERE src=dst)""")
def adjacency_rules(spark, sf):
    """The rules on the flow graph with some weights lost or turned round and some arcs led back."""
    both = F.col("src") + F.col("dst")
    spoilt = edges(spark, sf)[0].select(
        "src",
        F.when(both % 13 == 0, F.col("src")).otherwise(F.col("dst")).alias("dst"),
        F.when(both % 7 == 0, None).when(both % 5 == 0, -F.col("weight")).otherwise(F.col("weight")).alias("weight"),
    )
    return checks.row_rules(spoilt, graph.edge_rules())


@query("transition_supports", "G9", f'WITH {SUPP} SELECT direction, "row", col, {r6("w")} AS w FROM sup')
def transition_supports(spark, sf):
    return rounded(graph.supports(edges(spark, sf)[0]))


@query("support_checksums", "G10", f"WITH {SUPP} SELECT direction, col AS node, {r6('sum(w)')} AS total FROM sup GROUP BY ALL")
def support_checksums(spark, sf):
    return rounded(graph.support_checksums(graph.supports(edges(spark, sf)[0])))


# Three graphs over the same nodes: flows, reversed flows and equal weights; logits from customer counts.
FUSED = f"""{SUPP}, lab AS (SELECT 'mobility' AS graph, * FROM sup UNION ALL SELECT 'uniform', 'forward', dst, src, 1.0/count(*) OVER (PARTITION BY src) FROM ed
 UNION ALL SELECT 'uniform', 'backward', src, dst, 1.0/count(*) OVER (PARTITION BY dst) FROM ed),
 lg AS (SELECT 'mobility' AS graph, (SELECT count(*) FROM customer)/1000.0 AS logit UNION ALL SELECT 'uniform', 0.5),
 al2 AS (SELECT graph, exp(logit)/sum(exp(logit)) OVER () AS alpha FROM lg),
 fu AS (SELECT direction, "row", col, sum(w*alpha) AS w FROM lab JOIN al2 USING (graph) GROUP BY ALL)"""


def fused(spark, sf):
    e, nd = edges(spark, sf)
    lab = graph.supports(e).withColumn("graph", F.lit("mobility")).unionByName(
        graph.supports(e.withColumn("weight", F.lit(1.0))).withColumn("graph", F.lit("uniform"))
    )
    n = table(spark, sf, "customer").agg((F.count(F.lit(1)) / 1000.0).alias("logit"))
    logits = n.select(F.lit("mobility").alias("graph"), "logit").unionByName(n.select(F.lit("uniform").alias("graph"), F.lit(0.5).alias("logit")))
    alpha = graph.softmax_weights(pin(logits))
    return pin(graph.fuse_supports(lab, alpha)), nd, alpha


@query("softmax_graph_weights", "G12", f"WITH {FUSED} SELECT graph, {r6('alpha')} AS alpha FROM al2")
def softmax_graph_weights(spark, sf):
    return rounded(fused(spark, sf)[2])


@query("fused_supports", "G11 S1", f'WITH {FUSED} SELECT direction, "row", col, {r6("w")} AS w FROM fu')
def fused_supports(spark, sf):
    return rounded(fused(spark, sf)[0])


@query("fused_short_columns", "G10 G11", f"WITH {FUSED} SELECT direction, col AS node, {r6('sum(w)')} AS total FROM fu GROUP BY ALL HAVING sum(w)<1-1e-6")
def fused_short_columns(spark, sf):
    return rounded(graph.short_columns(fused(spark, sf)[0]))


@query("diffused_features", "G13", f"""WITH {SUPP}, {FEAT}, x0 AS (SELECT direction, node, feature, value FROM ft, (SELECT unnest(['forward','backward']) AS direction)),
 x1 AS (SELECT x0.direction, x0.node, x0.feature, coalesce(sum(s.w*y.value),0) AS value FROM x0 LEFT JOIN sup s ON s.direction=x0.direction AND s."row"=x0.node
   LEFT JOIN x0 y ON y.direction=s.direction AND y.node=s.col AND y.feature=x0.feature GROUP BY ALL),
 x2 AS (SELECT x0.direction, x0.node, x0.feature, 2*coalesce(sum(s.w*y.value),0)-any_value(x0.value) AS value FROM x0 LEFT JOIN sup s ON s.direction=x0.direction AND s."row"=x0.node
   LEFT JOIN x1 y ON y.direction=s.direction AND y.node=s.col AND y.feature=x0.feature GROUP BY ALL),
 x3 AS (SELECT x1.direction, x1.node, x1.feature, 2*coalesce(sum(s.w*y.value),0)-any_value(x1.value) AS value FROM x1 LEFT JOIN sup s ON s.direction=x1.direction AND s."row"=x1.node
   LEFT JOIN x2 y ON y.direction=s.direction AND y.node=s.col AND y.feature=x1.feature GROUP BY ALL)
 SELECT direction, k, node, feature, {r6('value')} AS value FROM (SELECT *, 0 AS k FROM x0 UNION ALL SELECT *, 1 FROM x1 UNION ALL SELECT *, 2 FROM x2 UNION ALL SELECT *, 3 FROM x3)""")
def diffused_features(spark, sf):
    e, nd = edges(spark, sf)
    out = graph.diffuse(pin(graph.supports(e)), features(spark, sf, nd), 3)
    return rounded(out.select("direction", "k", "node", "feature", "value"))


@query("neighbourhood_aggregate", "G14", f"""WITH {SUPP}, {FEAT} SELECT direction, "row" AS node, feature, {r6('sum(w*value)')} AS value FROM sup JOIN ft ON ft.node=col GROUP BY ALL""")
def neighbourhood_aggregate(spark, sf):
    e, nd = edges(spark, sf)
    return rounded(graph.propagate(graph.supports(e), features(spark, sf, nd)))


@query("weak_components", "G15", f"""WITH RECURSIVE e AS (SELECT src, dst FROM ({TRIPS}) UNION SELECT dst, src FROM ({TRIPS})),
 r(node, component) USING KEY (node) AS (SELECT c_custkey, c_custkey FROM customer UNION
  SELECT node, component FROM (SELECT e.dst AS node, min(r.component) AS component FROM r JOIN e ON e.src=r.node GROUP BY 1) x
  WHERE component < (SELECT q.component FROM recurring.r q WHERE q.node=x.node))
 SELECT node, component FROM r""")
def weak_components(spark, sf):
    nd = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    return graph.weak_components(trips(spark, sf), nd)


@query("strong_components", "G15", f"""WITH RECURSIVE e AS ({TRIPS}),
 f(s, n) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT f.s, e.dst FROM f JOIN e ON e.src=f.n)
 SELECT a.s AS node, max(a.n) AS component FROM f a JOIN f b ON a.s=b.n AND a.n=b.s GROUP BY 1""")
def strong_components(spark, sf):
    nd = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    return graph.strong_components(trips(spark, sf), nd)


@query("node_order_hash", "D4 F6", """SELECT count(*) AS n_nodes, sha256(string_agg(n_name, chr(10) ORDER BY n_nationkey)) AS order_hash,
 sha256(string_agg(n_name, '|' ORDER BY n_nationkey)) AS legacy_hash FROM nation""")
def node_order_hash(spark, sf):
    from zonewise.operators.order import order_hash

    return order_hash(nation_nodes(spark, sf), "zone", "node_index")
