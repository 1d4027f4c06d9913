import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewise.operators import allocate, explain, rolling

ZONES = [("A", 1000.0, 0.10, 5.0, 50.0, 5.0), ("B", 2000.0, 0.20, 15.0, 60.0, 20.0), ("C", 1500.0, 0.05, 10.0, 200.0, 8.0), ("D", 500.0, 0.30, 30.0, 20.0, 4.0)]


def inputs(spark, seed=3):
    rng = np.random.default_rng(seed)
    z = spark.createDataFrame(ZONES, "zone string, population double, income_rate double, pt_gp_min double, predicted_rate double, predicted_sigma double")
    s = spark.createDataFrame([(f"S{i}", f"Site {i}", "gp") for i in range(1, 8)], "site_id string, site_name string, site_type string")
    rows = [(zone[0], f"S{i}", "drive", None if rng.random() < 0.15 else float(rng.integers(2, 18))) for zone in ZONES for i in range(1, 8)]
    return z, s, spark.createDataFrame(rows, "zone string, site_id string, mode string, minutes double"), rows


def brute_force(rows, demand, threshold, n, cover_first):
    t = {(z, s): m for z, s, _, m in rows if m is not None}
    sites = sorted({s for _, s, _, _ in rows if any(k[1] == s for k in t)})
    remaining, current, out = dict(demand), {z: 1e6 for z in demand}, []
    for _ in range(n):
        best = None
        for s in sites:
            if s in out:
                continue
            hit = {z: t[(z, s)] for z in demand if (z, s) in t and t[(z, s)] <= threshold}
            cover = sum(remaining[z] for z in hit)
            access = sum(demand[z] * max(0.0, current[z] - m) for z, m in hit.items())
            pair = (round(cover, 6), round(access, 6)) if cover_first else (round(access, 6), round(cover, 6))
            if best is None or pair > best[0]:
                best = (pair, s, hit)
        out.append(best[1])
        for z, m in best[2].items():
            remaining[z], current[z] = 0.0, min(current[z], m)
    return out


@pytest.mark.parametrize("threshold", [8.0, 35.0])
def test_greedy_matches_brute_force_for_every_scenario(spark, threshold):
    z, s, t, rows = inputs(spark)
    out = allocate.run_scenarios(z, s, t, "drive", threshold)
    demand = {}
    for r in out["demand"].collect():
        demand.setdefault(r["scenario"], {})[r["zone"]] = r["demand"]
    got = {}
    for r in out["selected"].orderBy("step").collect():
        got.setdefault(r["scenario"], []).append(r["site_id"])
    for sc, sites in got.items():
        assert sites == brute_force(rows, demand[sc], threshold, 6, sc in allocate.COVER_FIRST), sc
    assert allocate.validate_result(out["selected"], out["assigned"], s, z, 6).filter("n_bad > 0").count() == 0
    for m in out["metrics"].collect():
        assert m["population_covered"] + m["unserved_population"] == m["population_total"] == 5000.0


def test_demand_weights(spark):
    z, *_ = inputs(spark)
    d = {(r["scenario"], r["zone"]): r["demand"] for r in allocate.demand_weights(z).collect()}
    assert d[("coverage", "B")] == 2000.0
    assert d[("equity", "D")] == pytest.approx(500 * (0.3 / 0.1625) * (30 / 15))
    assert d[("preventive", "A")] == 0.0 and d[("preventive", "C")] == pytest.approx(1.0) and d[("preventive", "B")] == pytest.approx(1.0)


def test_solver_hook_and_unknown_site(spark):
    z, s, t, _ = inputs(spark)

    def fixed(pairs, demand, threshold, n):
        return demand.select("scenario").distinct().select("scenario", F.lit(1).alias("step"), F.lit("S9").alias("site_id"), F.lit(0.0).alias("cover_gain"), F.lit(0.0).alias("access_gain"))

    out = allocate.run_scenarios(z, s, t, "drive", 10.0, 6, fixed)
    bad = {r["code"]: r["n_bad"] for r in allocate.validate_result(out["selected"], out["assigned"], s, z, 6).collect()}
    assert bad["unknown_site"] == 4 and bad["wrong_site_count"] == 4 and out["assigned"].filter("served").count() == 0


def test_unreachable_sites(spark):
    t = spark.createDataFrame([("A", "S1", "drive", 1.0), ("A", "S1", "walk", None), ("A", "S2", "drive", 2.0), ("A", "S2", "walk", 9.0)], "zone string, site_id string, mode string, minutes double")
    assert [r["site_id"] for r in allocate.unreachable_sites(t).collect()] == ["S1"]


def test_shapley_matches_direct_fit(spark):
    n = 6
    rng = np.random.default_rng(5)
    v = rng.normal(size=2 ** (n + 1))
    rows = []
    for mask in range(2 ** (n + 1)):
        b = [(mask >> i) & 1 for i in range(n + 1)]
        rows.append((b, [b[0], *b[1:], *[b[0] * x for x in b[1:]]], sum(b)))
    inner = [i for i, r in enumerate(rows) if 0 < r[2] < n + 1]
    x = np.array([rows[i][1] for i in inner], float)
    w = np.sqrt([explain.kernel_weight(n + 1, rows[i][2]) for i in inner])
    # Eliminate the constraint: the last coefficient is the remainder.
    total = v[-1] - v[0]
    free = (x[:, :-1] - x[:, -1:]) * w[:, None]
    sol = np.linalg.lstsq(free, (v[inner] - v[0] - x[:, -1] * total) * w, rcond=None)[0]
    want = np.append(sol, total - sol.sum())
    feats = [f"f{i}" for i in range(n)]
    df = spark.createDataFrame([("z", i, float(val)) for i, val in enumerate(v)], "zone string, mask int, value double")
    out = explain.shapley(df, feats)
    got = {(r["player"], r["component"]): r["phi"] for r in out.collect()}
    order = [("location", "location")] + [(f, "main") for f in feats] + [(f, "interaction") for f in feats]
    assert [got[k] for k in order] == pytest.approx(want.tolist(), abs=1e-9)
    assert explain.additivity(out).first()["additive"]


def test_update_dates_skip_gaps(spark):
    d = spark.sql("select explode(sequence(date'2022-01-01', date'2022-04-30', interval 1 day)) origin").filter("origin not between date'2022-01-28' and date'2022-02-03'")
    got = [str(r["update"]) for r in rolling.update_dates(d).orderBy("update").collect()]
    assert got == ["2022-01-01", "2022-02-04", "2022-03-04", "2022-04-01", "2022-04-29"]


def test_calibration_ranks_and_availability(spark):
    rows = [("big", float(i), 0.0, 1.0) for i in range(1, 3109)] + [("small", float(i), 0.0, 1.0) for i in range(1, 11)]
    c = {r["update"]: r for r in rolling.calibrate(spark.createDataFrame(rows, "update string, y double, mu double, sigma double")).collect()}
    assert (c["big"]["k95"], c["big"]["k80"], c["big"]["q95"], c["big"]["q80"]) == (2954, 2488, 2954.0, 2488.0)
    assert c["small"]["status"] == "unavailable" and c["small"]["q95"] is None


def test_metrics_edge_cases(spark):
    from zonewise.operators import evaluate

    flat = spark.createDataFrame([(5.0, 4.0), (5.0, 6.0), (None, 1.0)], "y double, mu double")
    m = flat.agg(*evaluate.point_metrics(F.col("y"), F.col("mu"))).first()
    assert (m["mae"], m["r2"], m["n"]) == (1.0, None, 2)
    assert flat.select(evaluate.skill(F.lit(1.0), F.lit(0.0)).alias("s")).first()["s"] is None
    nll = flat.limit(1).agg(evaluate.gaussian_nll(F.col("y"), F.col("mu"), F.lit(4.0)).alias("v")).first()["v"]
    assert nll == pytest.approx(0.5 * (math.log(2 * math.pi) + math.log(4.0) + 0.25))


def test_blocks_are_disjoint_and_short_history_is_reported(spark):
    pool = spark.sql(
        "select row_number() over (order by origin) - 1 sample_id, origin, date_add(origin, 7) target "
        "from (select explode(sequence(date'2022-01-01', date'2022-06-30', interval 1 day)) origin)"
    )
    test = pool.filter("origin >= date'2022-03-20'")
    ups = rolling.update_dates(test)
    blocks = rolling.assign_blocks(pool, test, ups, 60)
    assert rolling.leakage_audit(blocks).filter("not passed").count() == 0
    first = {r["block"]: r["n"] for r in rolling.plan(pool, test, ups, (60,)).filter("update = date'2022-03-20'").collect()}
    assert first == {"fitting": 16, "selection": 28, "calibration": 28, "predict": 28}
    late = {str(r["update"]): r["missing"] for r in rolling.short_history(ups, rolling.assign_blocks(pool, test, ups, 60, 60, 40)).collect()}
    assert late == {"2022-03-20": ["fitting"], "2022-04-17": ["fitting"]}


def test_rounds_meet_written_states_and_pairs_that_can_gain(spark, monkeypatch):
    z, s, t, rows = inputs(spark)
    pairs, demand = allocate.prepare_pairs(z, s, t, "drive"), allocate.demand_weights(z)
    seen, gains = [], allocate.site_gains

    def spied(pairs, state):
        seen.append((pairs.filter("score = 0 and minutes is null").count(), "Join" in state._jdf.queryExecution().optimizedPlan().toString()))
        return gains(pairs, state)

    monkeypatch.setattr(allocate, "site_gains", spied)
    for sites in (None, s):  # three minutes reach few sites; the others stay in the race
        got = allocate.greedy_select(pairs, demand, 3.0, 6, sites=sites).filter("scenario = 'coverage'").orderBy("step")
        assert [r["site_id"] for r in got.collect()] == brute_force(rows, {r["zone"]: r["demand"] for r in demand.filter("scenario = 'coverage'").collect()}, 3.0, 6, True)
    assert seen == [(0, False)] * 12
