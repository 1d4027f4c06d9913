"""Panel cleaning, lookup and rollup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonewise.functions.scalars import one_row, r6 as R, token
from zonewise.operators import checks, clean, joins, rollup
from zonewise.operators.checks import as_check
from zonewise.plans.registry import query, r6
from zonewise.plans.sqltext import (
    CELLS,
    DATE,
    PANEL_HOLES,
    REPORTS,
    SCEN,
    SMALL_AREAS,
    SUPPLIER_ZONES,
    TYPED,
)
from zonewise.sources.tables import cells, nation_nodes, panel_holes, reports, small_areas, supplier_zones, table


def typed_reports(spark, sf):
    rows, _ = clean.parse_report_dates(reports(spark, sf))
    return rows


def classified(spark, sf):
    return clean.classify_response(typed_reports(spark, sf))


def populated(spark, sf):
    return clean.validate_population(classified(spark, sf))


def scenarios(spark, sf):
    return clean.suppression_scenarios(populated(spark, sf))


@query(
    "report_date_layouts",
    "PF1 F3 D1",
    f"""WITH rep AS ({REPORTS}) SELECT CASE WHEN "Date" LIKE '%.0' THEN 'suffix' WHEN length("Date")=8 THEN 'compact'
 WHEN length("Date")=10 THEN 'iso' ELSE 'other' END AS layout, year(coalesce({DATE}, DATE '1900-01-01'))::INT AS yr,
 count(*) AS n, count({DATE}) AS n_parsed, min({DATE}) AS first_date, max({DATE}) AS last_date FROM rep GROUP BY ALL""",
)
def report_date_layouts(spark, sf):
    rep = reports(spark, sf)
    good, bad = clean.parse_report_dates(rep)
    both = good.unionByName(bad)
    text = F.col("Date_original")
    layout = (
        F.when(text.endswith(".0"), "suffix").when(F.length(text) == 8, "compact").when(F.length(text) == 10, "iso").otherwise("other")
    )
    return both.groupBy(layout.alias("layout"), F.coalesce(F.year("Date"), F.lit(1900)).alias("yr")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("Date").alias("n_parsed"),
        F.min("Date").alias("first_date"),
        F.max("Date").alias("last_date"),
    )


@query(
    "year_extract_harmonised",
    "IO4 IO5",
    f"""WITH rep AS ({REPORTS}) SELECT year({DATE})::INT AS year, count(*) AS n_rows, count(DISTINCT IntZone) AS n_zones,
 count(*) FILTER (WHERE CrudeRate7DayPositiveQF='c') * 0 + count(*) AS n_blank_added FROM rep
 WHERE {DATE} IS NOT NULL AND year({DATE}) IN (1996,1997,2000) AND CA='S12_A' GROUP BY 1""",
)
def year_extract_harmonised(spark, sf):
    raw = reports(spark, sf).drop("CrudeRate7DayPositiveQF")
    ext = clean.load_year_extract(raw, [1996, 1997, 2000], "S12_A")
    return ext.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("IntZone").alias("n_zones"),
        F.count_if(F.col("CrudeRate7DayPositiveQF") == "").alias("n_blank_added"),
    )


@query(
    "source_summary_by_file",
    "IO8 IO9 S1",
    f"""WITH rep AS ({REPORTS}), x AS (SELECT *, {DATE} AS d FROM rep), u AS (
 SELECT 0 AS source_index, 1995 AS requested_year, 'lines_a' AS source_file, IntZone, d FROM x WHERE year(d)=1995
 UNION ALL SELECT 1, 2000, 'lines_b', IntZone, d FROM x WHERE year(d)=2000)
 SELECT source_index, requested_year, source_file, count(*) AS n_rows, count(DISTINCT IntZone) AS n_zones, min(d) AS first_date,
 max(d) AS last_date FROM u GROUP BY ALL""",
)
def source_summary_by_file(spark, sf):
    raw = reports(spark, sf)
    a = clean.tag_source(clean.load_year_extract(raw, [1995]), 0, 1995, "lines_a")
    b = clean.tag_source(clean.load_year_extract(raw, [2000]), 1, 2000, "lines_b")
    return clean.source_summary(a.unionByName(b), ["source_index", "requested_year", "source_file"])


@query(
    "zone_master",
    "IO6 D3",
    f"SELECT zone, row_number() OVER (ORDER BY zone)-1 AS node_index FROM (SELECT DISTINCT zone FROM ({SUPPLIER_ZONES}))",
)
def zone_master(spark, sf):
    return clean.zone_master(supplier_zones(spark, sf), "zone")


@query(
    "area_lookup_slice",
    "IO7 J5",
    """SELECT n_name AS zone, count(*) AS n_areas, min('S010'||lpad(CAST(c_custkey AS VARCHAR),8,'0')) AS first_area
 FROM customer JOIN nation ON n_nationkey=c_nationkey WHERE n_regionkey=2 GROUP BY 1""",
)
def area_lookup_slice(spark, sf):
    lookup = small_areas(spark, sf).select("area", "nationkey").dropDuplicates(["area"])
    nat = table(spark, sf, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("zone"))
    return (
        joins.small_area_to_zone(lookup, nat, "nationkey")
        .groupBy("zone")
        .agg(F.count(F.lit(1)).alias("n_areas"), F.min("area").alias("first_area"))
    )


@query(
    "area_filter_report",
    "PF2",
    f"""WITH rep AS ({REPORTS}) SELECT CAST(sum((CA='S12_R')::INT) AS BIGINT) AS n_after, count(*) AS n_before,
 count(DISTINCT CASE WHEN CA='S12_R' THEN IntZone END) AS n_zones,
 CAST(sum((CA='S12_R' AND trim(CAName) NOT IN ('','City R'))::INT) AS BIGINT) AS n_unexpected_name FROM rep""",
)
def area_filter_report(spark, sf):
    rep = reports(spark, sf)
    rows, odd = clean.filter_area(rep, "S12_R", "City R")
    before = rep.agg(F.count(F.lit(1)).alias("n"))
    bad = odd.agg(F.count(F.lit(1)).alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("n_after"), F.count_distinct("IntZone").alias("n_zones")).select(
        "n_after", one_row(before)["n"].alias("n_before"), "n_zones", one_row(bad)["n"].alias("n_unexpected_name")
    )


@query(
    "response_states_by_zone",
    "PF3",
    f"""WITH {TYPED} SELECT IntZone AS zone, status AS response_status, count(*) AS n, CAST(sum(nc) AS BIGINT) AS cases
 FROM pop GROUP BY ALL""",
)
def response_states_by_zone(spark, sf):
    return classified(spark, sf).groupBy(F.col("IntZone").alias("zone"), "response_status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("numeric_count").cast("long").alias("cases")
    )


@query(
    "population_validation",
    "PF4",
    f"""WITH {TYPED} SELECT count(*) FILTER (WHERE Population='') AS n_missing_population,
 count(*) FILTER (WHERE TRY_CAST(Population AS DOUBLE)<=0) AS n_non_positive_population,
 count(*) FILTER (WHERE p IS NULL) AS n_invalid_population,
 count(*) FILTER (WHERE p IS NULL AND status IN ('observed','disclosure_controlled_0_2')) AS n_used_invalid FROM pop""",
)
def population_validation(spark, sf):
    return clean.population_report(populated(spark, sf))


@query(
    "suppression_scenario_totals",
    "PF5 F9",
    f"""WITH {SCEN} SELECT scenario AS suppression_scenario, CA AS area, f=1 AS is_primary_scenario, CAST(sum(used) AS BIGINT) AS cases,
 count(rate) AS n_rates, {r6('avg(rate)')} AS mean_rate FROM rated GROUP BY ALL""",
)
def suppression_scenario_totals(spark, sf):
    return scenarios(spark, sf).groupBy("suppression_scenario", F.col("CA").alias("area"), "is_primary_scenario").agg(
        F.sum("case_count_used").alias("cases"),
        F.count("infection_rate").alias("n_rates"),
        R(F.avg("infection_rate")).alias("mean_rate"),
    )


@query(
    "scenario_consistency",
    "PF5 D17",
    f"""WITH {SCEN} SELECT 'scenario_fill_differs' AS code, 'error' AS level, count(*) AS n_bad, NULL::VARCHAR AS sample FROM (SELECT source_index, row_id, IntZone, d FROM scen GROUP BY ALL
 HAVING (NOT bool_or(status='disclosure_controlled_0_2') AND count(DISTINCT coalesce(used,-1))>1) OR bool_or(status='disclosure_controlled_0_2' AND used<>f))""",
)
def scenario_consistency(spark, sf):
    bad = clean.scenario_consistency(scenarios(spark, sf), ["source_index", "row_id", "IntZone", "Date"])
    return as_check(bad, "scenario_fill_differs", "error", F.col("IntZone"))


@query(
    "indicator_parsing",
    "PF6 PF7",
    f"""WITH a AS ({SMALL_AREAS}) SELECT nationkey, CAST(sum(hid::INT) AS BIGINT) AS n_crime_hidden, {r6('sum(crm)')} AS crime_total,
 CAST(sum((emp IS NULL)::INT) AS BIGINT) AS n_employment_missing, CAST(sum((uni IS NULL)::INT) AS BIGINT) AS n_university_missing,
 0::BIGINT AS n_bad FROM a GROUP BY 1""",
)
def indicator_parsing(spark, sf):
    crime, crime_bad = clean.parse_indicator(F.col("crime_count"))
    emp, emp_bad = clean.parse_indicator(F.col("Employment_count"))
    uni, uni_bad = clean.parse_indicator(F.col("University"))
    gp, gp_bad = clean.parse_rate(F.col("PT_GP"), allow_missing=False)
    return small_areas(spark, sf).groupBy("nationkey").agg(
        F.count_if(token(F.col("crime_count")) == "*").alias("n_crime_hidden"),
        R(F.sum(crime)).alias("crime_total"),
        F.count_if(emp.isNull()).alias("n_employment_missing"),
        F.count_if(uni.isNull()).alias("n_university_missing"),
        F.count_if(crime_bad | emp_bad | uni_bad | gp_bad).alias("n_bad"),
    )


@query(
    "quality_flag_counts",
    "A1",
    f"""WITH rep AS ({REPORTS}) SELECT column_name, flag, count(*) AS n FROM (
 SELECT 'Positive7DayQF' AS column_name, trim(Positive7DayQF) AS flag FROM rep UNION ALL
 SELECT 'CrudeRate7DayPositiveQF', trim(CrudeRate7DayPositiveQF) FROM rep) GROUP BY ALL""",
)
def quality_flag_counts(spark, sf):
    return clean.quality_flag_counts(reports(spark, sf), ["Positive7DayQF", "CrudeRate7DayPositiveQF"])


_GAPS = f"""p AS ({CELLS}), z AS ({SUPPLIER_ZONES}), span AS (SELECT min(date) AS lo, max(date) AS hi FROM p),
 cal AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS date FROM span),
 ex AS (SELECT date, zone FROM cal, z), miss AS (SELECT * FROM ex ANTI JOIN p USING (date, zone))"""


@query(
    "calendar_gaps",
    "A2 J11",
    f"""WITH {_GAPS}, bd AS (SELECT date, count(*) AS n FROM miss GROUP BY 1)
 SELECT (SELECT count(*) FROM ex) AS n_expected_cells, (SELECT count(*) FROM p) AS n_observed_cells,
 (SELECT count(*) FROM miss) AS n_missing_cells, (SELECT count(*) FROM bd WHERE n<(SELECT count(*) FROM z)) AS n_partial_dates,
 (SELECT count(*) FROM bd WHERE n=(SELECT count(*) FROM z)) AS n_fully_missing_dates,
 (SELECT count(DISTINCT zone) FROM miss) AS n_zones_with_gaps""",
)
def calendar_gaps(spark, sf):
    return clean.calendar_gaps(cells(spark, sf), supplier_zones(spark, sf))


@query(
    "missing_cells_by_zone",
    "A2",
    f"WITH {_GAPS} SELECT z.zone, count(miss.date) AS n_missing FROM z LEFT JOIN miss USING (zone) GROUP BY 1",
)
def missing_cells_by_zone(spark, sf):
    return clean.missing_by_zone(cells(spark, sf), supplier_zones(spark, sf))


@query("missing_cells", "A2 J11 J3", f"WITH {_GAPS} SELECT zone, date FROM miss")
def missing_cells(spark, sf):
    return clean.missing_cells(cells(spark, sf), supplier_zones(spark, sf))


@query(
    "panel_quality",
    "A3 D7",
    f"""WITH p AS ({PANEL_HOLES}), z AS (SELECT DISTINCT zone FROM p), span AS (SELECT min(date) AS lo, max(date) AS hi FROM p),
 cal AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS date FROM span),
 ex AS (SELECT date, zone FROM cal, z), miss AS (SELECT * FROM ex ANTI JOIN p USING (date, zone)),
 bd AS (SELECT date, count(*) AS n FROM miss GROUP BY 1)
 SELECT (SELECT count(*) FROM ex) AS n_expected_cells, (SELECT count(*) FROM p) AS n_observed_cells,
 (SELECT count(*) FROM miss) AS n_missing_cells, (SELECT count(*) FROM bd WHERE n<(SELECT count(*) FROM z)) AS n_partial_dates,
 (SELECT count(*) FROM bd WHERE n=(SELECT count(*) FROM z)) AS n_fully_missing_dates,
 (SELECT count(DISTINCT zone) FROM miss) AS n_zones_with_gaps,
 (SELECT count(*) FROM p WHERE rate IS NULL) AS n_null_rate, (SELECT count(*) FROM p WHERE rate=0) AS n_zero_rate""",
)
def panel_quality(spark, sf):
    panel = panel_holes(spark, sf)
    return clean.panel_quality(panel, panel.select("zone").distinct())


@query(
    "scenario_statistics",
    "A4",
    f"""WITH {SCEN} SELECT scenario AS suppression_scenario, count(*) AS n_rows, count(rate) AS n_valid,
 CAST(sum((status='disclosure_controlled_0_2')::INT) AS BIGINT) AS n_suppressed,
 CAST(sum((status='true_missing_not_suppressed')::INT) AS BIGINT) AS n_missing,
 CAST(sum((status='invalid_non_numeric_value')::INT) AS BIGINT) AS n_invalid,
 {r6('avg(rate)')} AS mean_rate, {r6('stddev_pop(rate)')} AS sd_rate, {r6('min(rate)')} AS min_rate, {r6('max(rate)')} AS max_rate,
 {r6("avg(rate) FILTER (WHERE status='disclosure_controlled_0_2')")} AS suppressed_mean,
 {r6("min(rate) FILTER (WHERE status='disclosure_controlled_0_2')")} AS suppressed_min,
 {r6("max(rate) FILTER (WHERE status='disclosure_controlled_0_2')")} AS suppressed_max,
 {r6('quantile_cont(rate,0.25)')} AS q25, {r6('quantile_cont(rate,0.5)')} AS q50, {r6('quantile_cont(rate,0.75)')} AS q75,
 {r6('quantile_cont(rate,0.9)')} AS q90, {r6('quantile_cont(rate,0.95)')} AS q95, {r6('quantile_cont(rate,0.99)')} AS q99
 FROM rated GROUP BY 1""",
)
def scenario_statistics(spark, sf):
    out = clean.scenario_statistics(populated(spark, sf))
    return out.select(*[R(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _top_share(key):
    return f"""WITH {TYPED} SELECT {key} AS k, {r6("avg((status='disclosure_controlled_0_2')::INT)*100")} AS pct FROM pop
 GROUP BY 1 ORDER BY avg((status='disclosure_controlled_0_2')::INT)*100 DESC, 1 LIMIT 10"""


@query("suppression_top_zones", "A5 T2", _top_share("IntZone"))
def suppression_top_zones(spark, sf):
    return clean.share_suppressed(classified(spark, sf), "IntZone").select(F.col("IntZone").alias("k"), R(F.col("pct")).alias("pct"))


@query("suppression_top_dates", "A5 T2", _top_share("d"))
def suppression_top_dates(spark, sf):
    return clean.share_suppressed(classified(spark, sf), "Date").select(F.col("Date").alias("k"), R(F.col("pct")).alias("pct"))


@query(
    "published_rate_discrepancy",
    "A6",
    f"""WITH {TYPED}, g AS (SELECT abs(nc/p*100000-TRY_CAST(CrudeRate7DayPositive AS DOUBLE)) AS gap FROM pop),
 e AS (SELECT gap FROM g WHERE gap IS NOT NULL)
 SELECT count(*) AS n_eligible, {r6('avg(gap)')} AS mean_abs_gap, {r6('max(gap)')} AS max_abs_gap,
 count(*) FILTER (WHERE gap>0.5) AS n_beyond, {r6('avg((gap>0.5)::INT)*100')} AS pct_beyond FROM e""",
)
def published_rate_discrepancy(spark, sf):
    out = clean.published_rate_discrepancy(populated(spark, sf))
    return out.select(*[R(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(
    "duplicate_report_keys",
    "S5",
    f"""WITH {TYPED}, sig AS (SELECT d, IntZone, concat_ws('|', trim(IntZoneName), trim(CA), trim(CAName), trim(Positive7Day),
   trim(Positive7DayQF), trim(Population), trim(CrudeRate7DayPositive), trim(CrudeRate7DayPositiveQF)) AS s, source_index, row_id FROM typed
   WHERE d IS NOT NULL),
 k AS (SELECT d, IntZone, count(*) AS n_rows, count(DISTINCT s) AS n_sig FROM sig GROUP BY ALL)
 SELECT year(d)::INT AS yr, count(*) AS n_keys, count(*) FILTER (WHERE n_rows>1) AS n_duplicated_keys,
 count(*) FILTER (WHERE n_sig>1) AS n_conflicting_keys,
 CAST(coalesce(sum(n_rows-1) FILTER (WHERE n_sig=1),0) AS BIGINT) AS n_exact_copies_removed FROM k GROUP BY 1""",
)
def duplicate_report_keys(spark, sf):
    keys = clean.resolve_duplicates(typed_reports(spark, sf))
    return keys.groupBy(F.year("Date").alias("yr")).agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("n_rows") > 1).alias("n_duplicated_keys"),
        F.count_if(F.col("n_signatures") > 1).alias("n_conflicting_keys"),
        F.coalesce(F.sum(F.when(F.col("n_signatures") == 1, F.col("n_rows") - 1)), F.lit(0)).alias("n_exact_copies_removed"),
    )


@query(
    "panel_with_node_index",
    "J1 D2 T1",
    f"""WITH p AS ({CELLS}), m AS (SELECT zone, row_number() OVER (ORDER BY zone)-1 AS node_index FROM (SELECT DISTINCT zone FROM ({SUPPLIER_ZONES})))
 SELECT date, node_index, {r6('rate')} AS rate FROM p LEFT JOIN m USING (zone)""",
)
def panel_with_node_index(spark, sf):
    master = clean.zone_master(supplier_zones(spark, sf), "zone")
    out = joins.lookup_join(cells(spark, sf), master, ["zone"])
    return out.select("date", "node_index", R(F.col("rate")).alias("rate"))


@query(
    "supplier_zone_alignment",
    "J2 S3 J3",
    f"""SELECT n_name AS zone, n_nationkey AS node_index, {r6('sum(s_acctbal)')} AS balance
 FROM nation JOIN supplier ON s_nationkey=n_nationkey GROUP BY ALL
 UNION ALL SELECT n_name, n_nationkey, NULL FROM nation ANTI JOIN supplier ON s_nationkey=n_nationkey""",
)
def supplier_zone_alignment(spark, sf):
    nodes = nation_nodes(spark, sf)
    bal = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("node_index")).agg(R(F.sum("s_acctbal")).alias("balance"))
    return joins.align_to_master(nodes, nodes.join(bal, "node_index", "left").select("zone", "balance"), "zone")


@query(
    "keys_on_one_side",
    "S3 J3 J4",
    """SELECT coalesce(a.k,b.k) AS k, CASE WHEN b.k IS NULL THEN 'omitted' ELSE 'unknown' END AS side
 FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_orderkey AS k FROM orders) b ON a.k=b.k
 WHERE a.k IS NULL OR b.k IS NULL""",
)
def keys_on_one_side(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return checks.key_difference(a, b, "k")


@query(
    "known_pairs_only",
    "J4",
    """SELECT o_custkey%1000 AS zone, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING')
 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='R') GROUP BY 1""",
)
def known_pairs_only(spark, sf):
    pairs = table(spark, sf, "orders").select(F.col("o_custkey").alias("zone"), F.col("o_orderkey").alias("site_id"))
    zones = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("zone"))
    sites = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("site_id"))
    return joins.keep_known_pairs(pairs, zones, sites).groupBy((F.col("zone") % 1000).alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "centroid_xy_attached",
    "J6",
    """SELECT 'S020'||lpad(CAST(s_suppkey AS VARCHAR),6,'0') AS zone, n_nationkey*100+0.12::DOUBLE AS zone_x, (n_regionkey*50)::DOUBLE AS zone_y
 FROM supplier JOIN nation ON s_nationkey=n_nationkey""",
)
def centroid_xy_attached(spark, sf):
    xy = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"),
        (F.col("n_nationkey") * 100 + 0.1234).alias("x"),
        (F.col("n_regionkey") * 50).cast("double").alias("y"),
    )
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    from zonewise.sources.tables import supplier_zone

    return joins.attach_xy(rows, xy, "s_nationkey").select(supplier_zone("s_suppkey").alias("zone"), "zone_x", "zone_y")


@query(
    "population_by_precedence",
    "J16",
    f"""WITH p AS ({CELLS}), z AS ({SUPPLIER_ZONES}), plan AS (SELECT 'S020'||lpad(CAST(s_suppkey AS VARCHAR),6,'0') AS zone, 7777.0::DOUBLE AS pp
  FROM supplier WHERE s_acctbal<0), lastp AS (SELECT zone, max_by(population, date) AS lp FROM p GROUP BY 1)
 SELECT zone, coalesce(pp, lp, 10.0)::DOUBLE AS population, CASE WHEN pp IS NOT NULL THEN 'planning' WHEN lp IS NOT NULL THEN 'panel' ELSE 'static' END
 AS population_source FROM z LEFT JOIN plan USING (zone) LEFT JOIN lastp USING (zone)""",
)
def population_by_precedence(spark, sf):
    from zonewise.sources.tables import supplier_zone

    zones = supplier_zones(spark, sf)
    planning = table(spark, sf, "supplier").filter("s_acctbal < 0").select(
        supplier_zone("s_suppkey").alias("zone"), F.lit(7777.0).alias("population")
    )
    return joins.population_fallback(zones, planning, cells(spark, sf), zones.withColumn("total_population", F.lit(10.0)))


def parsed_areas(spark, sf):
    """Small areas with typed indicators and their zone."""
    raw = small_areas(spark, sf)
    cols = {c: clean.parse_indicator(F.col(c))[0] for c in raw.columns if c not in ("area", "nationkey")}
    typed = raw.withColumn("crime_suppressed", token(F.col("crime_count")) == "*").withColumns(cols)
    nat = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("zone"))
    return typed.join(nat, "nationkey")


def _g(num, den):
    return f"CASE WHEN count({num})=count(*) AND sum({den})>0 THEN sum({num})/sum({den}) END"


@query(
    "zone_indicator_rollup",
    "A7 PF8 PF6",
    f"""WITH a AS (SELECT s.*, n_name AS zone FROM ({SMALL_AREAS}) s JOIN nation ON n_nationkey=nationkey WHERE tot>0 AND wrk>0)
 SELECT zone, count(*) AS n_areas, {r6('sum(tot)')} AS total_population, {r6('sum(wrk)')} AS working_age_population,
 {r6(_g('inc', 'tot'))} AS income_rate, {r6(_g('emp', 'wrk'))} AS employment_rate, {r6(_g('ovr', 'tot'))} AS overcrowded_rate,
 {r6(_g('uni*tot', 'tot'))} AS university_rate, {r6(_g('gp*tot', 'tot'))} AS pt_gp_min,
 CAST(sum(hid::INT) AS BIGINT) AS n_crime_suppressed, CAST(max(hid::INT) AS INT) AS crime_incomplete,
 {r6('sum(CASE WHEN hid THEN 0 ELSE crm END)/sum(tot)')} AS crime_rate_fill0,
 {r6('sum(CASE WHEN hid THEN 1 ELSE crm END)/sum(tot)')} AS crime_rate_fill1,
 {r6('sum(CASE WHEN hid THEN 2 ELSE crm END)/sum(tot)')} AS crime_rate_fill2,
 {r6('sum(CASE WHEN hid THEN 1 ELSE crm END)/sum(tot)')} AS crime_rate FROM a GROUP BY 1""",
)
def zone_indicator_rollup(spark, sf):
    out = rollup.zone_rollup(parsed_areas(spark, sf))
    return out.select(*[R(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(
    "panel_contract_checks",
    "D17 D2",
    f"""WITH {TYPED} SELECT 'negative_count' AS code, 'error' AS level, count(*) FILTER (WHERE nc<0) AS n_bad, NULL::VARCHAR AS sample FROM pop
 UNION ALL SELECT 'non_integer_count','error', count(*) FILTER (WHERE nc<>floor(nc)), NULL FROM pop
 UNION ALL SELECT 'unknown_area_name','review', count(*) FILTER (WHERE CAName LIKE '%old%'), min(IntZone) FILTER (WHERE CAName LIKE '%old%') FROM pop
 UNION ALL SELECT 'population_missing','accepted', count(*) FILTER (WHERE p IS NULL), min(IntZone) FILTER (WHERE p IS NULL) FROM pop""",
)
def panel_contract_checks(spark, sf):
    rows = populated(spark, sf)
    n = F.col("numeric_count")
    return checks.row_rules(
        rows,
        {
            "negative_count": ("error", n < 0, F.col("IntZone")),
            "non_integer_count": ("error", n != F.floor(n), F.col("IntZone")),
            "unknown_area_name": ("review", F.contains("CAName", F.lit("old")), F.col("IntZone")),
            "population_missing": ("accepted", F.col("Population").isNull(), F.col("IntZone")),
        },
    )


SPOILT_NODES = """n AS (SELECT n_name AS zone, n_nationkey AS node_index FROM nation), m AS (SELECT zone, CASE WHEN node_index%6=1 THEN node_index+40 ELSE node_index END AS node_index FROM n
 UNION ALL SELECT zone, node_index FROM n WHERE node_index%8=0)"""


@query(
    "node_table_checks",
    "D4 G17 E18",
    f"""WITH {SPOILT_NODES} SELECT 'node_index_not_contiguous' AS code, 'error' AS level, (count(*)<>count(DISTINCT node_index) OR min(node_index)<>0 OR max(node_index)<>count(*)-1)::BIGINT AS n_bad,
 CASE WHEN count(*)<>count(DISTINCT node_index) OR min(node_index)<>0 OR max(node_index)<>count(*)-1 THEN min(node_index)||'..'||max(node_index) END AS sample FROM m
 UNION ALL SELECT 'duplicate_key', 'error', count(*), min(zone) FROM (SELECT zone FROM m GROUP BY zone HAVING count(*)>1)
 UNION ALL SELECT 'node_order_differs', 'error', count(*), min(n.zone) FROM n JOIN m ON n.zone=m.zone WHERE n.node_index<>m.node_index""",
)
def node_table_checks(spark, sf):
    """A node table with some indices moved away and some rows doubled, against the sound one."""
    nodes = nation_nodes(spark, sf)
    i = F.col("node_index")
    moved = nodes.withColumn("node_index", F.when(i % 6 == 1, i + 40).otherwise(i)).unionByName(nodes.filter(i % 8 == 0))
    return (
        checks.contiguous_index(moved, "node_index")
        .unionByName(checks.unique_key(moved, ["zone"]))
        .unionByName(checks.same_order(nodes, moved, "zone", "node_index"))
    )


@query("worst_check_status", "D17 E18", f"""WITH {SPOILT_NODES} SELECT CASE WHEN (SELECT count(*) FROM (SELECT zone FROM m GROUP BY zone HAVING count(*)>1))>0
 OR (SELECT count(*) FROM n JOIN m ON n.zone=m.zone WHERE n.node_index<>m.node_index)>0 THEN 'error' ELSE 'ok' END AS status""")
def worst_check_status(spark, sf):
    return checks.worst_status(node_table_checks(spark, sf).unionByName(panel_contract_checks(spark, sf)))
