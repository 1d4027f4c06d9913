"""Explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonewise.functions import moments
from zonewise.functions.scalars import one_row, r6 as R
from zonewise.operators import explain, graph, rolling
from zonewise.plans import evaluation
from zonewise.plans.registry import query, r6
from zonewise.plans.sqltext import BLOCK_FEATURES
from zonewise.plans.windowing import rounded
from zonewise.session import pin
from zonewise.sources.tables import block_features, block_links, table

FEATURES, COLUMNS = evaluation.DESIGN.features, evaluation.DESIGN.static
N = len(FEATURES) + 1


def last_forecast(spark, sf):
    """Every zone at the last issue date: features, design, echoes and the model of its update; the scaling moments."""
    design = evaluation.DESIGN
    panel, win, ups, blocks = evaluation.block_dates(spark, sf)
    blocks, win = pin(blocks), pin(win)
    issue = one_row(blocks.filter("block = 'predict'").agg(F.max(F.struct("origin", "update", "sample_id")).alias("v")))["v"]
    chosen = pin(blocks.filter(F.col("update") == issue["update"]))
    support, raw = pin(graph.supports(block_links(spark, sf))), block_features(spark, sf)
    context, marks = design.context(raw, support)
    chosen_windows = win.join(chosen.select("sample_id").distinct(), "sample_id", "left_semi")
    cells = pin(design.cells(panel, chosen_windows, evaluation.L, support, pin(context)).withColumn("delta", F.col("y") - F.col("anchor")))
    stats = moments.co_moments(cells, [*design.columns, "delta"], ["target"])
    coef = rolling.fit_by_update(stats, chosen, len(design.columns) + 1).filter(F.col("role") == rolling.FINAL).select("update", "coef")
    at = cells.filter(F.col("sample_id") == issue["sample_id"]).withColumn("_coef", one_row(coef))
    zones = at.select("zone", "anchor", *design.columns, F.col("_coef.coef").alias("coef")).join(raw, "zone")
    return pin(zones.join(explain.echoes(support, raw, design.reach), "zone")), marks


def scores(spark, sf):
    zones, marks = last_forecast(spark, sf)
    ref = pin(explain.reference_point(zones, COLUMNS))
    return pin(explain.coalition_scores(zones, evaluation.DESIGN, ref, marks))


def explained(spark, sf):
    return explain.shapley(scores(spark, sf), FEATURES)


def _graph_sql():
    """va: values by a new look at the whole graph for every zone and mask, with that zone's features replaced."""
    own = [f"z_{f}" for f in FEATURES]
    swap = ", ".join(f"CASE WHEN zr.zone=t.zone AND (mask>>{i})&1=0 THEN rf.{c} ELSE zr.{c} END AS {c}" for c, i in [*[(f, i) for i, f in enumerate(FEATURES, start=1)], ("x", 0), ("y", 0)])
    hop = "LEFT JOIN sup ON direction='f' AND sup.r=p0.zone LEFT JOIN {} n ON n.zone=sup.c AND n.t=p0.t AND n.mask=p0.mask"
    terms = evaluation._terms
    return f"""{evaluation.FIT_SQL}, li AS (SELECT max((origin, u, sample_id)) AS v FROM bl WHERE block='predict'),
 rf AS (SELECT {', '.join(f'quantile_cont({c},0.5) AS {c}' for c in COLUMNS)} FROM zr),
 px AS (SELECT t.zone AS t, mask, zr.zone, {swap} FROM zr t, (SELECT unnest(range({2**N})) AS mask), zr, rf),
 p0 AS (SELECT t, mask, zone, {terms('CASE WHEN s_{0}>=1e-8 THEN ({0}-m_{0})/s_{0} ELSE 0 END', 'z_{0}', COLUMNS)} FROM px, zm),
 p1 AS (SELECT p0.t, p0.mask, p0.zone, {terms('coalesce(sum(w*n.{0}),0)', 'f1_{0}', own)} FROM p0 {hop.format('p0')} GROUP BY ALL),
 p2 AS (SELECT p0.t, p0.mask, p0.zone, {terms('2*coalesce(sum(w*n.f1_{0}),0)-any_value(p0.{0})', 'f2_{0}', own)} FROM p0 {hop.format('p1')} GROUP BY p0.t, p0.mask, p0.zone),
 pq AS (SELECT *, {', '.join(f'z_{c}*z_{f} AS {c}_{f}' for c in evaluation.DESIGN.coords for f in FEATURES)} FROM p0 JOIN p1 USING (t, mask, zone) JOIN p2 USING (t, mask, zone)),
 va AS (SELECT pq.zone, mask, anchor+{evaluation.SCORE} AS value FROM pq JOIN (SELECT zone, anchor, {', '.join(evaluation.DESIGN.moving)} FROM cl, li WHERE sample_id=v[3]) d ON d.zone=pq.zone
   JOIN f2 ON u=(SELECT v[2] FROM li) WHERE pq.t=pq.zone)"""


def _terms_sql():
    """ex: the constrained weighted fit of every zone, its normal equations solved by Gauss-Jordan steps; b0: empty and full value."""
    free = 2 * N - 1
    loc, mains = "(mask&1)", [f"((mask>>{i})&1)" for i in range(1, N)]
    d = f"[{', '.join([loc, *mains, *[f'{loc}*{m}' for m in mains]])}]::DOUBLE[]"
    names = [("location", "location"), *[(f, "main") for f in FEATURES], *[(f, "interaction") for f in FEATURES]]
    size = f"bit_count(mask::INTEGER)"
    ctes = [
        f"ms AS (SELECT mask, {d} AS d, {size} AS s FROM (SELECT unnest(range({2**N})) AS mask))",
        f"mw AS (SELECT mask, d, {N - 1}.0/(factorial({N})/(factorial(s)*factorial({N}-s))*s*({N}-s)) AS w FROM ms WHERE s BETWEEN 1 AND {N - 1})",
        f"b0 AS (SELECT zone, max(value) FILTER (WHERE mask=0) AS phi_0, max(value) FILTER (WHERE mask={2**N - 1}) AS prediction FROM va GROUP BY 1)",
        f"""q0 AS (SELECT zone, i, [{', '.join(f'sum(w*d[i]*d[{j}])' for j in range(1, free + 1))}, 1.0, sum(w*d[i]*(value-phi_0))]::DOUBLE[] AS x FROM va JOIN b0 USING (zone) JOIN mw USING (mask),
   (SELECT unnest(range(1,{free + 1})) AS i) GROUP BY zone, i UNION ALL SELECT zone, {free + 1}, [{', '.join(['1.0'] * free)}, 0.0, prediction-phi_0]::DOUBLE[] FROM b0)""",
    ]
    for k in range(1, free + 2):
        ctes.append(f"""q{k} AS (SELECT a.zone, a.i, CASE WHEN a.i={k} THEN list_transform(a.x, lambda e: e/a.x[{k}])
   ELSE list_transform(list_zip(a.x, q.x), lambda z: z[1]-a.x[{k}]*z[2]/q.x[{k}]) END AS x FROM q{k - 1} a JOIN q{k - 1} q ON q.zone=a.zone AND q.i={k})""")
    rows = ",".join(f"({i},'{p}','{c}')" for i, (p, c) in enumerate(names, start=1))
    ctes.append(f"ex AS (SELECT zone, player, component, x[{free + 2}] AS phi FROM q{free + 1} JOIN (VALUES {rows}) t(i, player, component) USING (i))")
    return ",\n ".join(ctes)


VALUES = _graph_sql()
FITTED = f"{VALUES}, {_terms_sql()}"


@query("coalition_values", "X2 X3 F5 F7", f"{VALUES} SELECT zone, mask::INTEGER AS mask, {r6('value')} AS value FROM va")
def coalition_values(spark, sf):
    return rounded(scores(spark, sf))


@query("shapley_terms", "X4 D13", f"{FITTED} SELECT zone, player, component, {r6('phi')} AS phi, {r6('phi_0')} AS phi_0, {r6('prediction')} AS prediction FROM ex JOIN b0 USING (zone)")
def shapley_terms(spark, sf):
    return rounded(explained(spark, sf).select("zone", "player", "component", "phi", "phi_0", "prediction"))


@query("additivity_check", "X5", f"""{FITTED} SELECT count(*) AS n, bool_and(abs(phi_0+s-prediction)<=1e-6) AS additive FROM b0 JOIN (SELECT zone, sum(phi) AS s FROM ex GROUP BY 1) USING (zone)""")
def additivity_check(spark, sf):
    a = explain.additivity(explained(spark, sf))
    return a.agg(F.count(F.lit(1)).alias("n"), F.bool_and("additive").alias("additive"))


@query("net_contributions", "X6", f"""{FITTED}, al AS (SELECT zone, player, phi FROM ex UNION ALL SELECT zone, 'baseline', phi_0 FROM b0)
 SELECT zone, player, {r6('sum(phi)')} AS net, CASE WHEN {r6('sum(phi)')}>=0 THEN 'raises' ELSE 'lowers' END AS direction FROM al GROUP BY ALL""")
def net_contributions(spark, sf):
    n = explain.net_contributions(explain.with_baseline(pin(explained(spark, sf)))).withColumn("net", R(F.col("net")))
    return n.withColumn("direction", F.when(F.col("net") >= 0, "raises").otherwise("lowers"))


@query("explanation_summary", "A21 T2", f"""{FITTED}, e6 AS (SELECT player, component, {r6('phi')} AS phi FROM ex) SELECT player, {r6("avg(abs(phi)) FILTER (WHERE component<>'interaction')")} AS mean_abs, {r6("avg(phi) FILTER (WHERE component<>'interaction')")} AS mean_signed,
 {r6("avg(abs(phi)) FILTER (WHERE component='interaction')")} AS mean_abs_interaction, {r6("avg((phi>0)::INT) FILTER (WHERE component<>'interaction')")} AS share_positive,
 {r6("avg((phi<0)::INT) FILTER (WHERE component<>'interaction')")} AS share_negative FROM e6 GROUP BY 1""")
def explanation_summary(spark, sf):
    e = explained(spark, sf).withColumn("phi", R(F.col("phi")))
    return rounded(explain.leading_factors(explain.explanation_summary(e)))


@query("zone_output_table", "J14", f"""{FITTED}, n AS (SELECT zone, player, sum(phi) AS net FROM ex GROUP BY ALL)
 SELECT zone, 'Zone '||zone AS name, {r6('prediction')} AS prediction, {', '.join(f"{r6(f'''max(net) FILTER (WHERE player='{p}')''')} AS {p}" for p in ('location', *FEATURES))}
 FROM n JOIN b0 USING (zone) GROUP BY zone, prediction""")
def zone_output_table(spark, sf):
    e = pin(explained(spark, sf))
    f = e.groupBy("zone").agg(F.max("prediction").alias("prediction"))
    names = f.select("zone", F.concat(F.lit("Zone "), F.col("zone")).alias("name"))
    return rounded(explain.zone_outputs(f, names, e, ["location", *FEATURES]))


@query("vector_diagnostics", "A24 E17", f"""SELECT dim, {r6('avg(v)')} AS mean, {r6('stddev_pop(v)')} AS sd, stddev_pop(v)<1e-6 AS near_constant, count(*) FILTER (WHERE v IS NULL OR isnan(v)) AS n_bad FROM
 (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1)-1 AS dim FROM embeddings) GROUP BY 1""")
def vector_diagnostics(spark, sf):
    return rounded(explain.vector_diagnostics(table(spark, sf, "embeddings"), "embedding"))


@query("vector_spread", "A24", f"SELECT label, {r6('avg(list_stddev_pop(list_transform(embedding, lambda e: e::DOUBLE)))')} AS mean_spread FROM embeddings GROUP BY 1")
def vector_spread(spark, sf):
    return rounded(table(spark, sf, "embeddings").groupBy("label").agg(F.avg(explain.row_spread("embedding")).alias("mean_spread")))


INDICATORS = ("income", "employment", "overcrowded", "crime", "university", "access")
_Z = """z AS (SELECT c_custkey AS zone, (abs(floor(c_acctbal)::BIGINT)%200)::DOUBLE AS income, (abs(floor(c_acctbal)::BIGINT)%150)::DOUBLE AS employment,
 (c_custkey%60)::DOUBLE AS overcrowded, (abs(floor(c_acctbal)::BIGINT)%80)::DOUBLE AS crime, (c_custkey%40)::DOUBLE AS university, (c_custkey%25+3)::DOUBLE AS access FROM customer)"""


def static_long(spark, sf):
    """Every customer as a zone with six indicators and a constant one."""
    k, bal = F.col("c_custkey"), F.abs(F.floor("c_acctbal"))
    values = dict(zip(INDICATORS, (bal % 200, bal % 150, k % 60, bal % 80, k % 40, k % 25 + 3))) | {"constant": F.lit(4.0)}
    z = table(spark, sf, "customer").select(k.alias("zone"), *[v.cast("double").alias(c) for c, v in values.items()])
    return z.unpivot(["zone"], list(values), "feature", "value")


_PLACE = ("x", "y")


def feature_zones(spark, sf):
    """Every customer as a zone with six indicators and coordinates."""
    k = F.col("c_custkey")
    places = table(spark, sf, "customer").select(k.alias("zone"), (k % 37).cast("double").alias("x"), (F.floor(k / 37) % 41).cast("double").alias("y"))
    return places.unpivot(["zone"], list(_PLACE), "feature", "value").unionByName(static_long(spark, sf).filter("feature <> 'constant'"))


@query("reference_point", "X1", f"""WITH {_Z}, p AS (SELECT (c_custkey%37)::DOUBLE AS x, ((c_custkey//37)%41)::DOUBLE AS y FROM customer)
 SELECT {', '.join(f'{r6(c)} AS {c}' for c in (*INDICATORS, *_PLACE))} FROM (SELECT {', '.join(f'quantile_cont({c},0.5) AS {c}' for c in INDICATORS)} FROM z),
 (SELECT {', '.join(f'quantile_cont({c},0.5) AS {c}' for c in _PLACE)} FROM p)""")
def reference_point(spark, sf):
    """The median of every indicator and coordinate over all customers as zones."""
    return rounded(explain.reference_of(feature_zones(spark, sf), (*INDICATORS, *_PLACE)))


@query("cross_section_scaled", "SW12", f"""WITH {_Z}, l AS (SELECT zone, feature, value FROM (SELECT zone, {', '.join(INDICATORS)}, 4.0::DOUBLE AS constant FROM z) UNPIVOT (value FOR feature IN ({', '.join(INDICATORS)}, constant))),
 s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS sd FROM l GROUP BY 1) SELECT zone, feature, {r6('CASE WHEN sd<1e-8 THEN 0 ELSE (value-m)/sd END')} AS z, sd<1e-8 AS flat FROM l JOIN s USING (feature)""")
def cross_section_scaled(spark, sf):
    from zonewise.operators import scale

    long = static_long(spark, sf)
    return rounded(scale.scale_cross_section(long, scale.cross_section_scaler(long)))
