"""Published-table and input/output queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from zonewise.operators import checks, report, rolling
from zonewise.plans import allocation, evaluation
from zonewise.plans.registry import query, r6
from zonewise.plans.sqltext import REPORTS
from zonewise.plans.windowing import metric_sql, rounded
from zonewise.session import pin, written_folder
from zonewise.sources import files
from zonewise.sources.tables import nation_nodes, planning_zones, reports, supplier_zones, table

MODEL = evaluation.model_sql()
_LG = evaluation.ALPHA.split(", lg AS ", 1)[1]


def scored(spark, sf):
    """Forecast rows, calibration and fusion weights from one rolling run."""
    panel, win, ups, blocks = evaluation.block_dates(spark, sf)
    blocks = pin(blocks)
    out = rolling.run(evaluation.block_cells(spark, sf, panel, win), blocks, evaluation.FEATURES)
    cal = pin(rolling.calibrate(out["calibration"]))
    pred = rolling.attach_observed(rolling.with_intervals(pin(out["prediction"]), cal))
    return pred, cal, evaluation.alphas(blocks)[0]


@query("retrospective_table", "R1 J13", f"""{MODEL}, lg AS {_LG} SELECT ft.u AS "update", zone, origin, {r6('mu-y')} AS model_error, {r6('abs(mu-y)')} AS model_absolute_error,
 {r6('abs(anchor-y)')} AS persistence_absolute_error, CASE WHEN sigma>p90 THEN 'high' ELSE 'normal' END AS flag, {r6("max(alpha) FILTER (WHERE graph='geo')")} AS alpha_geo,
 {r6("max(alpha) FILTER (WHERE graph='transport')")} AS alpha_transport, {r6("max(alpha) FILTER (WHERE graph='mobility')")} AS alpha_mobility FROM ft JOIN al ON al.u=ft.u
 GROUP BY ft.u, zone, origin, mu, y, anchor, sigma, p90""")
def retrospective_table(spark, sf):
    pred, cal, alpha = scored(spark, sf)
    return rounded(
        report.retrospective(pred.drop("sigma_p90"), alpha, cal).select(
            "update", "zone", "origin", "model_error", "model_absolute_error", "persistence_absolute_error", "flag", "alpha_geo", "alpha_transport", "alpha_mobility"
        )
    )


@query("date_selector", "R2", f'{MODEL} SELECT DISTINCT origin, target, u AS "update" FROM ft')
def date_selector(spark, sf):
    return report.date_selector(evaluation.forecasts(spark, sf)[0])


@query("period_table", "R3 A19 A12", f"""{MODEL}, pd AS (SELECT *, CASE WHEN target<DATE '2001-01-01' THEN 'wave' ELSE 'late' END AS period FROM ft)
 SELECT coalesce(period,'overall') AS period, min(target) AS period_start, max(target) AS period_end, count(DISTINCT target) AS n_dates, {metric_sql('y', 'mu', 'model_', -1)},
 {metric_sql('y', 'anchor', 'persistence_', -1)}, {r6('1-avg(abs(y-mu))/avg(abs(y-anchor))')} AS mae_skill, {r6('1-avg((y-mu)**2)/avg((y-anchor)**2)')} AS mse_skill
 FROM pd GROUP BY GROUPING SETS ((period),())""")
def period_table(spark, sf):
    return rounded(report.period_table(evaluation.forecasts(spark, sf)[0], "2001-01-01"))


@query("future_forecast_table", "R4", f"""{evaluation.LIVE_SQL} SELECT zone, {r6('mu')} AS mu, NULL::DOUBLE AS observed_rate, NULL::DOUBLE AS model_error,
 'unverified_extrapolation' AS forecast_status, false AS observed_target_available FROM op""")
def future_forecast_table(spark, sf):
    live = evaluation.operational_forecast(spark, sf)
    return report.future_table(live).select("zone", "mu", "observed_rate", "model_error", "forecast_status", "observed_target_available")


@query("rounded_and_full_tables", "R5 D17", f"""{MODEL}, m AS (SELECT u, avg(abs(y-mu)) AS mae, avg(abs(y-anchor)) AS base FROM ft GROUP BY 1)
 SELECT u AS "update", {r6('mae')} AS mae, {r6('round_even(mae,2)')} AS mae_rounded, {r6('round_even(base,1)')} AS base_rounded, abs(mae-round_even(mae,2))<=0.005+1e-12 AS agrees FROM m""")
def rounded_and_full_tables(spark, sf):
    f, _ = evaluation.forecasts(spark, sf)
    full = f.groupBy("update").agg(F.avg(F.abs(F.col("y") - F.col("mu"))).alias("mae"), F.avg(F.abs(F.col("y") - F.col("anchor"))).alias("base"))
    twin = report.rounded_twin(full.withColumns({"mae_rounded": F.col("mae"), "base_rounded": F.col("base")}), {"mae_rounded": 2, "base_rounded": 1})
    return rounded(twin.withColumn("agrees", F.abs(F.col("mae") - F.col("mae_rounded")) <= 0.005 + 1e-12).drop("base"))


@query("combined_city_metrics", "R6 S1", f"""{MODEL}, c AS (SELECT *, CASE WHEN zone<'b000000007' THEN 'north' ELSE 'south' END AS city FROM ft) SELECT city, {metric_sql('y', 'mu')} FROM c GROUP BY 1""")
def combined_city_metrics(spark, sf):
    from zonewise.operators.evaluate import point_metrics

    f, _ = evaluation.forecasts(spark, sf)
    m = [c for c in point_metrics(F.col("y"), F.col("mu"))]
    north, south = f.filter("zone < 'b000000007'"), f.filter("zone >= 'b000000007'")
    return rounded(report.combine_cities({"north": north.agg(*m), "south": south.agg(*m)}))


@query("zone_risk_table", "R7", f"""{MODEL} SELECT zone, n_name AS name, target, {r6('greatest(0,mu)')} AS display_mean, {r6('greatest(0,mu-q95*sigma)')} AS display_lower, {r6('greatest(0,mu+q95*sigma)')} AS display_upper,
 CASE WHEN sigma>p90 THEN 'high' ELSE 'normal' END AS uncertainty_flag FROM ft JOIN (SELECT 'b'||lpad(n_nationkey::VARCHAR,9,'0') AS zone, n_name FROM nation) USING (zone)""")
def zone_risk_table(spark, sf):
    f, _ = evaluation.forecasts(spark, sf)
    names = table(spark, sf, "nation").select(F.concat(F.lit("b"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")).alias("zone"), F.col("n_name").alias("name"))
    return rounded(report.zone_risk(f, names))


@query("dashboard_summary", "R8 L11", f"""{allocation.GREEDY} SELECT scenario, {r6('round_even(coalesce(sum(population) FILTER (WHERE served),0)/sum(population)*100,1)')} AS coverage_pct, count(*) FILTER (WHERE served) AS zones_covered,
 count(*) FILTER (WHERE NOT served) AS unserved_zones, {r6('round_even(avg(minutes) FILTER (WHERE served),2)')} AS mean_minutes, {r6('round_even(max(minutes) FILTER (WHERE served),2)')} AS max_minutes FROM asg GROUP BY 1""")
def dashboard_summary(spark, sf):
    return rounded(report.dashboard_summary(allocation.solved(spark, sf)[0]["metrics"]))


# -- reading and writing -----------------------------------------------------------------


def _folder(spark):
    return f"{written_folder(spark)}/{uuid.uuid4().hex}"


@query("raw_text_round_trip", "IO1 IO2 IO3 D1", f"""WITH rep AS ({REPORTS}) SELECT CA, count(*) AS n, count(*) FILTER (WHERE Positive7Day='') AS n_blank, count(*) FILTER (WHERE Positive7Day='c') AS n_hidden,
 count(*) FILTER (WHERE Population='') AS n_no_population FROM rep GROUP BY 1""")
def raw_text_round_trip(spark, sf):
    """Every raw report written as CSV and read back as text: blanks and marks must survive."""
    from zonewise.operators.clean import RAW_COLUMNS

    path = files.write_table(reports(spark, sf).select(*RAW_COLUMNS), _folder(spark), "csv")
    back = files.read_raw(spark, path, "csv", RAW_COLUMNS)
    return back.groupBy("CA").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("Positive7Day") == "").alias("n_blank"),
        F.count_if(F.col("Positive7Day") == "c").alias("n_hidden"),
        F.count_if(F.col("Population") == "").alias("n_no_population"),
    )


@query("allocation_export", "IO15", f"""{allocation.GREEDY} SELECT * FROM (SELECT 'selected' AS table_name, count(*) AS n_rows FROM sel UNION ALL SELECT 'assignments', count(*) FROM asg UNION ALL SELECT 'empty', 0)""")
def allocation_export(spark, sf):
    out, _ = allocation.solved(spark, sf)
    paths = files.write_bundle({"selected": out["selected"], "assignments": out["assigned"], "empty": out["assigned"].filter("false")}, _folder(spark))
    res = None
    for name, path in paths.items():
        n = files.read_raw(spark, path, "parquet").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        res = n if res is None else res.unionByName(n)
    return res


def _content(*parts):
    row = "||'|'||".join(f"coalesce(({p})::VARCHAR,'')" for p in parts)
    return f"sum(('0x'||substr(md5({row}),1,15))::BIGINT)::VARCHAR AS content_hash"


@query("output_manifest", "IO16", f"""SELECT * FROM (SELECT 'orders' AS table_name, count(*) AS n_rows, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns,
 {_content('o_orderkey', 'o_custkey', 'o_orderstatus', 'round(o_totalprice*1e6)::BIGINT', 'epoch_us(o_orderdate)', 'o_orderpriority')} FROM orders UNION ALL
 SELECT 'nation', count(*), 'n_nationkey,n_name,n_regionkey', {_content('n_nationkey', 'n_name', 'n_regionkey')} FROM nation)""")
def output_manifest(spark, sf):
    return files.table_manifest("orders", table(spark, sf, "orders")).unionByName(files.table_manifest("nation", table(spark, sf, "nation")))


@query("forecast_bundle", "E17 A24", f"""{MODEL} SELECT * FROM (SELECT 'forecast_map' AS table_name, count(*) AS n_rows FROM ft UNION ALL SELECT 'metrics', count(DISTINCT u) FROM ft UNION ALL
 SELECT 'fusion_weights', 3*count(DISTINCT u) FROM bl UNION ALL SELECT 'calibration', count(*) FROM ca)""")
def forecast_bundle(spark, sf):
    pred, cal, alpha = scored(spark, sf)
    metrics = pred.groupBy("update").agg(F.avg(F.abs(F.col("y") - F.col("mu"))).alias("mae"))
    paths = files.write_bundle({"forecast_map": pred, "metrics": metrics, "fusion_weights": alpha, "calibration": cal}, _folder(spark))
    res = None
    for name, path in paths.items():
        n = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        res = n if res is None else res.unionByName(n)
    return res


@query("input_validation", "E18 S3 D17", """SELECT 'planning_zone_missing' AS code, 'error' AS level, (SELECT count(*) FROM nation ANTI JOIN customer ON c_nationkey=n_nationkey) AS n_bad UNION ALL
 SELECT 'supplier_zone_repeated', 'error', (SELECT count(*) FROM (SELECT s_suppkey FROM supplier GROUP BY 1 HAVING count(*)>1)) UNION ALL
 SELECT 'flat_indicator', 'review', (SELECT count(*) FROM (SELECT stddev_pop(i) AS a, stddev_pop(g) AS b FROM (SELECT avg(abs(c_acctbal))/10000 AS i, avg(c_custkey%25)+3 AS g FROM customer GROUP BY c_nationkey)) WHERE a<1e-8 OR b<1e-8)""")
def input_validation(spark, sf):
    nodes, zones = nation_nodes(spark, sf), planning_zones(spark, sf)
    missing = nodes.join(zones.select("zone"), "zone", "left_anti")
    flat = zones.agg(*[F.stddev_pop(c).alias(c) for c in ("income_rate", "pt_gp_min")]).filter("income_rate < 1e-8 or pt_gp_min < 1e-8")
    return (
        checks.as_check(missing, "planning_zone_missing", "error", F.col("zone"))
        .unionByName(checks.unique_key(supplier_zones(spark, sf), ["zone"], "supplier_zone_repeated"))
        .unionByName(checks.as_check(flat, "flat_indicator", "review", F.lit("income_rate")))
        .drop("sample")
    )
