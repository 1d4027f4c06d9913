"""Site-planning queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from zonewise.functions.scalars import one_row, r6 as R
from zonewise.operators import allocate, checks, sites
from zonewise.plans.registry import query, r6
from zonewise.plans.sqltext import DEPOTS, PLANNING_ZONES, TRAVEL
from zonewise.plans.windowing import rounded
from zonewise.session import pin
from zonewise.sources.tables import depots, planning_zones, table, travel

THRESHOLD, N_SITES = 2.0, 6
TYPES = ("gp", "Mobile_Stop", "pharmacy")

PREP = f"""z AS ({PLANNING_ZONES}), st AS ({DEPOTS}), tr AS ({TRAVEL}),
 pairs AS (SELECT zone, site_id, min(minutes) AS minutes FROM tr WHERE mode='drive' AND minutes IS NOT NULL GROUP BY ALL)"""
DEMAND = f"""{PREP}, zc AS (SELECT zone, population AS pop, greatest(0,income_rate) AS inc, greatest(0,pt_gp_min) AS gp, greatest(0,predicted_rate) AS rate,
   greatest(0,predicted_sigma) AS sg FROM z),
 hs AS (SELECT *, rate>=(SELECT quantile_cont(rate,0.75) FROM zc) AS hr, sg>=(SELECT quantile_cont(sg,0.9) FROM zc) AS hu,
   avg(inc) OVER () AS mi, avg(gp) OVER () AS mg, avg(rate) OVER () AS mr, avg(sg) OVER () AS ms FROM zc),
 pt AS (SELECT zone, pop AS cov, pop*(inc/mi)*(gp/mg) AS eq, CASE WHEN hr THEN pop*(CASE WHEN mr>0 THEN rate/mr ELSE 1 END) ELSE 0 END AS rk,
   CASE WHEN hu THEN pop*(CASE WHEN ms>0 THEN sg/ms ELSE 1 END) ELSE 0 END AS un FROM hs),
 pv AS (SELECT *, CASE WHEN sum(rk) OVER ()>0 THEN rk/sum(rk) OVER () ELSE 0 END + CASE WHEN sum(un) OVER ()>0 THEN un/sum(un) OVER () ELSE 0 END AS pre FROM pt),
 dm AS (SELECT zone, 'coverage' AS scenario, cov::DOUBLE AS demand FROM pv UNION ALL SELECT zone, 'equity', eq FROM pv UNION ALL SELECT zone, 'preventive', pre FROM pv
  UNION ALL SELECT zone, 'balanced', cov/sum(cov) OVER () + eq/sum(eq) OVER () + CASE WHEN sum(pre) OVER ()>0 THEN pre/sum(pre) OVER () ELSE 0 END FROM pv)"""


def greedy_sql(threshold=THRESHOLD, n=N_SITES):
    out = [
        f"{DEMAND}, pr AS (SELECT zone, site_id, (minutes<={threshold})::INT::DOUBLE AS score, CASE WHEN minutes<={threshold} THEN minutes END AS m, minutes FROM pairs)",
        "s0 AS (SELECT scenario, zone, demand, demand AS remaining, 1000000.0::DOUBLE AS cur FROM dm)",
    ]
    for k in range(1, n + 1):
        gone = "" if k == 1 else " WHERE NOT EXISTS (SELECT 1 FROM (" + " UNION ALL ".join(f"SELECT scenario, site_id FROM b{j}" for j in range(1, k)) + ") c WHERE c.scenario=s.scenario AND c.site_id=pr.site_id)"
        out.append(
            f"""g{k} AS (SELECT s.scenario, pr.site_id, sum(CAST(remaining*score AS DECIMAL(28,9))) AS cg, sum(CAST(coalesce(demand*greatest(0,cur-m),0) AS DECIMAL(28,9))) AS ag
   FROM pr JOIN s{k - 1} s USING (zone){gone} GROUP BY ALL)"""
        )
        out.append(
            f"""b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY CASE WHEN scenario IN ('coverage','preventive') THEN cg ELSE ag END DESC,
   CASE WHEN scenario IN ('coverage','preventive') THEN ag ELSE cg END DESC, site_id) AS rn FROM g{k}) WHERE rn=1)"""
        )
        out.append(
            f"""s{k} AS (SELECT s.scenario, s.zone, s.demand, remaining*(1-coalesce(score,0)) AS remaining, least(cur, coalesce(m,1000000.0)) AS cur
   FROM s{k - 1} s LEFT JOIN (SELECT b.scenario, pr.zone, pr.score, pr.m FROM b{k} b JOIN pr USING (site_id)) w ON w.scenario=s.scenario AND w.zone=s.zone)"""
        )
    sel = " UNION ALL ".join(f"SELECT scenario, {k} AS step, site_id, cg, ag FROM b{k}" for k in range(1, n + 1))
    out.append(f"sel AS ({sel})")
    out.append(
        f"""asg AS (SELECT sc.scenario, z.zone, z.population, n.site_id, n.minutes, n.site_id IS NOT NULL AS served FROM z, (SELECT DISTINCT scenario FROM sel) sc
   LEFT JOIN (SELECT * FROM (SELECT sel.scenario, pr.zone, sel.site_id, pr.minutes, row_number() OVER (PARTITION BY sel.scenario, pr.zone ORDER BY pr.minutes, step) AS rn
     FROM sel JOIN pr USING (site_id) WHERE pr.minutes<={threshold}) WHERE rn=1) n ON n.scenario=sc.scenario AND n.zone=z.zone)"""
    )
    return "WITH " + ", ".join(out)


GREEDY = greedy_sql()


def solved(spark, sf):
    sites = allocate.eligible_sites(depots(spark, sf), TYPES)
    return allocate.run_scenarios(planning_zones(spark, sf), sites, travel(spark, sf), "drive", THRESHOLD, N_SITES), sites


def shown(gains):
    """Gains as rounded doubles; access gains in millions, the size of the first-reach bonus."""
    cover, access = F.col("cover_gain").cast("double"), F.col("access_gain").cast("double")
    return gains.withColumns({"cover_gain": R(cover), "access_gain": R(access / 1e6)})


@query("allocation_inputs", "L1 PF10 J4 D11", f"WITH {PREP} SELECT zone, site_id, minutes FROM pairs JOIN st USING (site_id) WHERE site_type IN ('gp','mobile_stop')")
def allocation_inputs(spark, sf):
    sites = allocate.eligible_sites(depots(spark, sf), ("GP", "mobile_stop"))
    return allocate.prepare_pairs(planning_zones(spark, sf), sites, travel(spark, sf), "drive")


@query("demand_weights", "L2 PF16", f"WITH {DEMAND} SELECT scenario, zone, {r6('demand')} AS demand FROM dm")
def demand_weights(spark, sf):
    return rounded(allocate.demand_weights(planning_zones(spark, sf)).select("scenario", "zone", "demand"))


@query("priority_labels", "L3 PF16", f"""WITH {DEMAND} SELECT zone, hr AS high_risk, hu AS high_uncertainty, inc>(SELECT quantile_cont(income_rate,0.5) FROM z) AS more_deprived_than_median,
 gp>(SELECT quantile_cont(pt_gp_min,0.5) FROM z) AS worse_access_than_median FROM hs""")
def priority_labels(spark, sf):
    return allocate.priority_labels(planning_zones(spark, sf)).select(
        "zone", "high_risk", "high_uncertainty", "more_deprived_than_median", "worse_access_than_median"
    )


@query("cover_scores", "PF15", f"""WITH {PREP} SELECT zone, site_id, mode, CASE WHEN minutes<=12 THEN 1.0 ELSE 0.0 END::DOUBLE AS binary_score,
 {r6('CASE WHEN minutes IS NULL THEN 0 ELSE greatest(0,1-minutes/12.0) END')} AS fractional_score FROM tr""")
def cover_scores(spark, sf):
    m = F.col("minutes")
    return travel(spark, sf).select(
        "zone", "site_id", "mode", allocate.cover_score(m, 12.0).alias("binary_score"), R(allocate.cover_score(m, 12.0, "fractional")).alias("fractional_score")
    )


@query("first_round_gains", "L4", f"{GREEDY} SELECT scenario, site_id, {r6('cg::DOUBLE')} AS cover_gain, {r6('ag::DOUBLE/1e6')} AS access_gain FROM g1")
def first_round_gains(spark, sf):
    m = F.col("minutes")
    pairs = allocate.prepare_pairs(planning_zones(spark, sf), depots(spark, sf), travel(spark, sf), "drive").select(
        "zone", "site_id", allocate.cover_score(m, THRESHOLD).alias("score"), F.when(m <= THRESHOLD, m).alias("minutes")
    )
    d = allocate.demand_weights(planning_zones(spark, sf))
    state = d.withColumns({"remaining": F.col("demand"), "current": F.lit(allocate.UNREACHED)})
    return shown(allocate.site_gains(pairs, state))


@query("greedy_selection", "L5 T4 L7 L10", f"{GREEDY} SELECT scenario, step, site_id, {r6('cg::DOUBLE')} AS cover_gain, {r6('ag::DOUBLE/1e6')} AS access_gain FROM sel")
def greedy_selection(spark, sf):
    return shown(solved(spark, sf)[0]["selected"])


@query("zone_assignment", "L6", f"{GREEDY} SELECT scenario, zone, site_id, minutes, served FROM asg")
def zone_assignment(spark, sf):
    return solved(spark, sf)[0]["assigned"].select("scenario", "zone", "site_id", "minutes", "served")


_METRICS = f"""{r6('coalesce(sum(population) FILTER (WHERE served),0)')} AS population_covered, count(*) FILTER (WHERE served) AS zones_covered,
 {r6('avg(minutes) FILTER (WHERE served)')} AS mean_minutes, {r6('max(minutes) FILTER (WHERE served)')} AS max_minutes,
 {r6('coalesce(sum(population) FILTER (WHERE NOT served),0)')} AS unserved_population, count(*) FILTER (WHERE NOT served) AS unserved_zones, count(*) AS n_zones,
 {r6('sum(population)')} AS population_total"""


@query("scenario_comparison", "L7 A22", f"{GREEDY} SELECT scenario, {_METRICS} FROM asg GROUP BY 1")
def scenario_comparison(spark, sf):
    return rounded(solved(spark, sf)[0]["metrics"])


@query("site_load", "A23 R8", f"{GREEDY} SELECT scenario, site_id, count(*) AS n_zones, {r6('sum(population)')} AS population_served FROM asg WHERE served GROUP BY ALL")
def site_load(spark, sf):
    return rounded(allocate.site_load(solved(spark, sf)[0]["assigned"]))


@query("allocation_validation", "L8", f"""{GREEDY}, ch AS (SELECT scenario, step, CASE WHEN scenario='equity' AND step=2 THEN 'NOWHERE' ELSE site_id END AS site_id FROM sel WHERE NOT (scenario='coverage' AND step=6)),
 ag AS (SELECT scenario, CASE WHEN zone LIKE '%7' THEN zone||'?' ELSE zone END AS zone, site_id, served FROM asg)
 SELECT 'unknown_site' AS code, 'error' AS level, count(*) AS n_bad, min(site_id) AS sample FROM ch WHERE site_id NOT IN (SELECT site_id FROM ({DEPOTS}) WHERE site_type IN ('gp','mobile_stop','pharmacy'))
 UNION ALL SELECT 'wrong_site_count', 'error', count(*), min(scenario) FROM (SELECT scenario FROM ch GROUP BY 1 HAVING count(DISTINCT site_id)<>{N_SITES})
 UNION ALL SELECT 'unknown_zone', 'error', count(*), min(zone) FROM ag WHERE zone NOT IN (SELECT n_name FROM nation)
 UNION ALL SELECT 'assigned_to_unselected', 'error', count(*), min(site_id) FROM ag ANTI JOIN ch USING (scenario, site_id) WHERE served""")
def allocation_validation(spark, sf):
    """The checks on a solution with one site renamed, one left out and some zones misspelt."""
    out, sites = solved(spark, sf)
    step, scenario, zone = F.col("step"), F.col("scenario"), F.col("zone")
    chosen = out["selected"].filter(~((scenario == "coverage") & (step == 6)))
    chosen = chosen.withColumn("site_id", F.when((scenario == "equity") & (step == 2), "NOWHERE").otherwise(F.col("site_id")))
    assigned = out["assigned"].withColumn("zone", F.when(zone.endswith("7"), F.concat(zone, F.lit("?"))).otherwise(zone))
    return allocate.validate_result(chosen, assigned, sites, planning_zones(spark, sf), N_SITES)


@query("site_zone_lookup", "L9", f"WITH {PREP} SELECT site_id, site_type, zone, minutes FROM st LEFT JOIN pairs USING (site_id) WHERE site_id IN ('SITE_000003','SITE_000007')")
def site_zone_lookup(spark, sf):
    pairs = allocate.prepare_pairs(planning_zones(spark, sf), depots(spark, sf), travel(spark, sf), "drive")
    return allocate.site_zone_info(depots(spark, sf), pairs, ["SITE_000003", "SITE_000007"]).select("site_id", "site_type", "zone", "minutes")


@query("city_policy_comparison", "L11 R6", f"""{GREEDY}, cz AS (SELECT n_name AS zone, 'city'||(n_regionkey%2) AS city FROM nation)
 SELECT city, scenario, {_METRICS}, {r6('coalesce(sum(population) FILTER (WHERE served),0)/sum(population)*100')} AS coverage_pct FROM asg JOIN cz USING (zone) GROUP BY ALL""")
def city_policy_comparison(spark, sf):
    city = table(spark, sf, "nation").select(F.col("n_name").alias("zone"), F.concat(F.lit("city"), (F.col("n_regionkey") % 2).cast("string")).alias("city"))
    return rounded(allocate.city_comparison(solved(spark, sf)[0]["assigned"].join(city, "zone")))


@query("map_site_table", "J15", f"{GREEDY} SELECT scenario, step AS map_index, site_id, site_type, {r6('x')} AS x, {r6('y')} AS y FROM sel JOIN st USING (site_id)")
def map_site_table(spark, sf):
    out, sites = solved(spark, sf)
    return rounded(allocate.indexed_site_table(out["selected"], sites).drop("site_name"))


@query("travel_matrix_rules", "IO13", f"""WITH {PREP} SELECT 'travel_key_missing' AS code, 'error' AS level, count(*) FILTER (WHERE zone IS NULL OR site_id IS NULL OR mode IS NULL) AS n_bad, NULL::VARCHAR AS sample FROM tr UNION ALL
 SELECT 'travel_not_finite','error',count(*) FILTER (WHERE isnan(minutes::DOUBLE) OR isinf(minutes::DOUBLE)),NULL FROM tr UNION ALL SELECT 'travel_negative','error',count(*) FILTER (WHERE minutes<0),NULL FROM tr UNION ALL
 SELECT 'travel_unreachable','accepted', count(*) FILTER (WHERE minutes IS NULL), min(zone||'/'||site_id||'/'||mode) FILTER (WHERE minutes IS NULL) FROM tr""")
def travel_matrix_rules(spark, sf):
    return checks.row_rules(travel(spark, sf), allocate.travel_rules())


@query("reachable_sites", "PF14", """WITH tr AS (SELECT l_suppkey AS s, l_linestatus AS mode, count(CASE WHEN l_quantity>49 AND l_discount<0.01 AND l_tax<0.02 THEN 1 END) AS n FROM lineitem GROUP BY ALL)
 SELECT 'SITE_'||lpad(CAST(s_suppkey AS VARCHAR),6,'0') AS site_id FROM supplier WHERE s_suppkey NOT IN (SELECT s FROM tr WHERE n=0)""")
def reachable_sites(spark, sf):
    far = (F.col("l_quantity") > 49) & (F.col("l_discount") < 0.01) & (F.col("l_tax") < 0.02)
    t = table(spark, sf, "lineitem").select(
        F.concat(F.lit("SITE_"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("site_id"),
        F.col("l_linestatus").alias("mode"),
        F.when(far, F.col("l_quantity")).alias("minutes"),
    )
    return allocate.drop_sites(depots(spark, sf), allocate.unreachable_sites(t)).select("site_id")


@query("sites_by_alias", "IO12 A25", "SELECT (['gp','pharmacy','mobile_stop'])[s_suppkey%3+1] AS site_type, count(*) AS n, min('SITE_'||lpad(CAST(s_suppkey AS VARCHAR),6,'0')) AS first_id FROM supplier GROUP BY 1")
def sites_by_alias(spark, sf):
    raw = depots(spark, sf).withColumnsRenamed({"site_id": "SiteID", "x": "Easting", "y": "Northing"})
    s = allocate.load_sites(raw, {"site_id": ("site_id", "SiteID"), "x": ("easting", "Easting"), "y": ("northing", "Northing")})
    return s.groupBy("site_type").agg(F.count(F.lit(1)).alias("n"), F.min("site_id").alias("first_id"))


@query("resolved_forecast", "IO14", f"""WITH f AS (SELECT 'Z'||(o_custkey%50) AS zone, o_orderdate::DATE AS target, o_orderkey AS origin, o_totalprice AS mu FROM orders),
 d AS (SELECT coalesce(max(CASE WHEN target=DATE '1997-05-28' THEN target END), max(target)) AS d FROM f)
 SELECT zone, max(target) AS target, {r6('max_by(mu, origin)')} AS predicted_rate, 0.0::DOUBLE AS predicted_sigma FROM f, d WHERE target=d GROUP BY 1""")
def resolved_forecast(spark, sf):
    f = table(spark, sf, "orders").select(
        F.concat(F.lit("Z"), (F.col("o_custkey") % 50).cast("string")).alias("zone"),
        F.col("o_orderdate").cast("date").alias("target"),
        F.col("o_orderkey").alias("origin"),
        F.col("o_totalprice").alias("mu"),
    )
    return rounded(allocate.resolve_forecast(f, "1997-05-28"))


@query("site_manifest", "A25", """SELECT (['gp','pharmacy','mobile_stop'])[s_suppkey%3+1] AS site_type, count(*) AS n, count(*) FILTER (WHERE s_suppkey*13%4000 IS NOT NULL) AS n_with_xy,
 min('SITE_'||lpad(CAST(s_suppkey AS VARCHAR),6,'0')) AS first_id FROM supplier GROUP BY 1""")
def site_manifest(spark, sf):
    return sites.site_manifest(depots(spark, sf))


@query("site_input_checks", "IO12 PF10 D17", """WITH s AS (SELECT s_suppkey, lower((['gp','pharmacy','mobile_stop'])[s_suppkey%3+1]) AS t FROM supplier UNION ALL SELECT s_suppkey, 'clinic' FROM supplier WHERE s_suppkey%7=0)
 SELECT 'site_id_repeated' AS code, 'error' AS level, (SELECT count(*) FROM (SELECT s_suppkey FROM s GROUP BY 1 HAVING count(*)>1)) AS n_bad
 UNION ALL SELECT 'no_eligible_site', 'error', CASE WHEN (SELECT count(*) FROM s WHERE t='hospital')=0 THEN 1 ELSE 0 END""")
def site_input_checks(spark, sf):
    """Sites of which every seventh is listed twice, asked for a type that none has: both rules must speak."""
    listed = depots(spark, sf).select("site_id", "site_type", "nationkey", F.col("site_name"))
    twice = listed.filter(F.substring("site_id", -6, 6).cast("long") % 7 == 0).withColumn("site_type", F.lit("clinic"))
    return allocate.site_checks(listed.unionByName(twice), ["hospital"]).drop("sample")


def widest_reach(pairs, demand, threshold, n_sites):
    """A solver of another kind: the sites that reach most zones, the same for every scenario."""
    reach = pairs.filter(F.col("minutes") <= threshold).groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    best = pin(reach.orderBy(F.desc("n"), "site_id").limit(n_sites))
    step = F.row_number().over(W.partitionBy("scenario").orderBy(F.desc("n"), "site_id"))  # n_sites rows a scenario
    names = one_row(demand.agg(F.collect_set("scenario").alias("s")))["s"]
    return pin(best.withColumn("scenario", F.explode(names)).select("scenario", step.alias("step"), "site_id"))


@query("custom_solver", "L10 L7", f"""{GREEDY}, wr AS (SELECT site_id, row_number() OVER (ORDER BY count(*) DESC, site_id) AS step FROM pairs WHERE minutes<={THRESHOLD} GROUP BY site_id QUALIFY step<={N_SITES}),
 ws AS (SELECT zone, min(minutes) AS m FROM pairs JOIN wr USING (site_id) WHERE minutes<={THRESHOLD} GROUP BY zone)
 SELECT scenario, step, site_id, (SELECT count(*) FROM ws) AS zones_covered FROM (SELECT DISTINCT scenario FROM dm), wr""")
def custom_solver(spark, sf):
    """All scenarios with another solver in the place of the greedy one."""
    sites_in = allocate.eligible_sites(depots(spark, sf), TYPES)
    out = allocate.run_scenarios(planning_zones(spark, sf), sites_in, travel(spark, sf), "drive", THRESHOLD, N_SITES, widest_reach)
    return out["selected"].join(out["metrics"].select("scenario", "zones_covered"), "scenario").select("scenario", F.col("step").cast("long").alias("step"), "site_id", "zones_covered")
