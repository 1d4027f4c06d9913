import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewise.operators import graph, paths


def square(zone, x, y):
    c = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
    return [(zone, *map(float, c[i]), *map(float, c[(i + 1) % 4])) for i in range(4)]


def test_side_contact_is_an_edge_and_point_contact_is_not(spark):
    seg = spark.createDataFrame(square("A", 0, 0) + square("B", 1, 0) + square("C", 1, 1) + square("D", 9, 9), "zone string, x1 double, y1 double, x2 double, y2 double")
    e = graph.rook_contiguity(seg)
    assert sorted((r["a"], r["b"], r["shared_length"]) for r in e.collect()) == [("A", "B", 1.0), ("B", "C", 1.0)]
    zones = spark.createDataFrame([(z,) for z in "ABCD"], "zone string")
    assert {r["zone"]: r["degree"] for r in graph.degree(e, zones).collect()} == {"A": 1, "B": 2, "C": 1, "D": 0}
    assert graph.symmetric_adjacency(e).count() == 4 and graph.overlapping_segments(seg).count() == 0


def od(spark):
    flows = spark.createDataFrame([("a", "a", 0.2), ("a", "b", 0.08), ("b", "a", 0.03), ("b", "x", 0.5), ("a", "c", 0.0), ("c", "a", 0.1)], "src string, dst string, share double")
    nodes = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "zone string, node_index int")
    return graph.align_flows(flows, nodes), nodes


def test_mobility_keeps_direction_and_weights(spark):
    al, nodes = od(spark)
    e = {(r["src"], r["dst"]): r["weight"] for r in graph.mobility_edges(al).collect()}
    assert e == {(0, 1): 0.08, (1, 0): 0.03, (2, 0): 0.1}
    s = {r["node_index"]: r for r in graph.node_strengths(al, nodes).collect()}
    assert s[0]["self_share"] == 0.2 and s[2]["in_degree"] == 0 and s[0]["out_degree"] == 1
    c = graph.flow_coverage(al, nodes).first()
    assert (c["n_kept_pairs"], c["n_dropped_pairs"], c["complete"]) == (5, 1, False)


def test_knn_rank_tau_and_weight(spark):
    m = [[0, 1, 2], [4, 0, 3], [math.inf, 5, 0]]
    d = spark.createDataFrame([(i, j, float(m[i][j])) for i in range(3) for j in range(3)], "src int, dst int, km double")
    e = {(r["src"], r["dst"]): r for r in graph.knn_edges(d, 2).collect()}
    assert len(e) == 5 and e[(0, 1)]["tau"] == 3.0 and e[(0, 1)]["weight"] == pytest.approx(math.exp(-1 / 3))
    st = graph.distance_stats(d, F.lit(3)).first()
    assert (st["n_finite"], st["n_unreachable"], st["median_km"]) == (5, 1, 3.0)


def test_supports_and_diffusion_match_matrices(spark):
    rng = np.random.default_rng(1)
    a = rng.random((5, 5)) * (rng.random((5, 5)) < 0.6)
    np.fill_diagonal(a, 0)
    a[3] = 0
    e = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(5) for j in range(5) if a[i, j] > 0], "src int, dst int, weight double")
    sup = graph.supports(e)
    x = rng.random(5)
    f = spark.createDataFrame([(i, "f", float(x[i])) for i in range(5)], "node int, feature string, value double")
    got = {(r["direction"], r["k"], r["node"]): r["value"] for r in graph.diffuse(sup, f, 3).collect()}
    for name, m in (("forward", a), ("backward", a.T)):
        t = np.divide(m, m.sum(1, keepdims=True), out=np.zeros_like(m), where=m.sum(1, keepdims=True) > 0)
        s = t.T
        terms = [x, s @ x]
        for _ in range(2):
            terms.append(2 * s @ terms[-1] - terms[-2])
        for k, v in enumerate(terms):
            assert [got[(name, k, i)] for i in range(5)] == pytest.approx(v.tolist())


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (7, 8), (20, 21), (21, 22), (22, 23)], "src long, dst long")
    n = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7, 8, 20, 21, 22, 23)], "node long")
    weak = {r["node"]: r["component"] for r in graph.weak_components(e, n).collect()}
    assert weak == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7, 8: 7, 20: 20, 21: 20, 22: 20, 23: 20}
    strong = {r["node"]: r["component"] for r in graph.strong_components(e, n).collect()}
    assert strong[1] == strong[2] == strong[3] != strong[4] == strong[5] and len(set(strong.values())) == 9


def test_mode_combination_and_intermodal(spark):
    d = spark.createDataFrame([(0, 1, "bicycle", 3.0), (0, 1, "road", 4.0), (1, 0, "walking", 2.0), (1, 0, "road", 2.0), (0, 0, "road", 9.0)], "src int, dst int, mode string, km double")
    got = {(r["src"], r["dst"]): (r["km"], r["mode"]) for r in paths.combine_modes(d).collect()}
    assert got == {(0, 1): (3.0, "bicycle"), (1, 0): (2.0, "road"), (0, 0): (0.0, "self")}
    access = spark.createDataFrame([(0, 0, 0.1), (1, 1, 0.1)], "i int, a int, access_km double")
    rail = spark.createDataFrame([(0, 1, 1.0), (0, 0, 0.0), (1, 1, 0.0)], "a int, b int, rail_km double")
    egress = spark.createDataFrame([(0, 0, 0.1), (1, 1, 0.1)], "b int, j int, egress_km double")
    got = {(r["i"], r["j"]): r["km"] for r in paths.intermodal(access, rail, egress).collect()}
    assert got == {(0, 1): pytest.approx(1.2)}


def roads(spark, rows):
    df = spark.createDataFrame(rows, "seg_id int, x1 double, y1 double, x2 double, y2 double, fclass string, oneway string, layer string, bridge string, tunnel string")
    return paths.normalise_segments(df)


def test_directions_and_class_lists(spark):
    seg = roads(spark, [(1, 0.0, 0.0, 100.0, 0.0, "Primary", "F", "0", "F", "F"), (2, 0.0, 0.0, 0.0, 50.0, "cycleway", "T", "0", "F", "F"), (3, 5.0, 5.0, 9.0, 5.0, "motorway", None, "0", "F", "F")])
    arcs = [(r["mode"], r["ux"], r["uy"], r["vx"], r["vy"]) for r in paths.route_arcs(seg).collect()]
    by = {m: sum(a[0] == m for a in arcs) for m in ("road", "bicycle", "walking")}
    assert by == {"road": 3, "bicycle": 3, "walking": 4}
    assert ("road", 100.0, 0.0, 0.0, 0.0) not in arcs and ("walking", 100.0, 0.0, 0.0, 0.0) in arcs


def test_crossings_by_grade(spark):
    flat, over = ("0", "F", "F"), ("1", "T", "F")
    seg = paths.grade_key(
        roads(
            spark,
            [
                (1, 0.0, 0.0, 10.0, 10.0, "primary", "B", *flat),
                (2, 0.0, 10.0, 10.0, 0.0, "primary", "B", *over),
                (3, 0.0, 5.0, 10.0, 5.0, "primary", "B", None, "F", "F"),
                (4, 10.0, 10.0, 20.0, 10.0, "primary", "B", *over),
                (5, 2.0, 0.0, 2.0, 9.0, "primary", "B", *flat),
            ],
        )
    )
    r = paths.crossing_report(paths.crossings(seg, 4.0)).first()
    assert (r["n_separated"], r["n_ambiguous"], r["n_at_grade"]) == (2, 3, 1)


def test_shortest_paths_and_travel_matrix(spark):
    rng = np.random.default_rng(2)
    n = 12
    w = np.where(rng.random((n, n)) < 0.25, rng.random((n, n)) + 0.1, np.inf)
    arcs = spark.createDataFrame([("drive", i, j, float(w[i, j])) for i in range(n) for j in range(n) if i != j and np.isfinite(w[i, j])], "mode string, u long, v long, cost double")
    d = w.copy()
    np.fill_diagonal(d, 0)
    for k in range(n):
        d = np.minimum(d, d[:, [k]] + d[[k]])
    z = spark.createDataFrame([(f"z{i}", i) for i in range(4)], "id string, node long")
    s = spark.createDataFrame([(f"s{i}", i) for i in range(4, 9)], "id string, node long")
    got = {(r["zone"], r["site_id"]): r["minutes"] for r in paths.travel_time_matrix(arcs, z, s).collect()}
    assert len(got) == 20
    for i in range(4):
        for j in range(4, 9):
            want = d[i, j]
            assert got[(f"z{i}", f"s{j}")] == (None if np.isinf(want) else pytest.approx(round(want, 2), abs=0.0051))


def reach_components(n, arcs):
    ahead = {i: {j for a, j in arcs if a == i} for i in range(n)}

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in ahead[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        return seen

    far = [reach(i) for i in range(n)]
    return {i: max(j for j in far[i] if i in far[j]) for i in range(n)}


def strong(spark, n, arcs):
    e = spark.createDataFrame([(a, b) for a, b in arcs] or [(0, 0)], "src long, dst long")
    return {r["node"]: r["component"] for r in graph.strong_components(e, spark.range(n).withColumnRenamed("id", "node")).collect()}


def test_strong_components_against_reach(spark):
    import random

    rng = random.Random(6)
    shapes = [
        (1, []),
        (12, [(i, i + 1) for i in range(11)]),  # a path
        (12, [(i, (i + 1) % 6) for i in range(6)] + [(6 + i, 6 + (i + 1) % 6) for i in range(6)] + [(2, 8)]),  # two rings and a bridge
        (20, [(i, i + 1) for i in range(10)] + [(10, 3), (4, 12), (12, 13), (13, 4), (13, 14), (14, 15), (15, 16), (16, 16)]),
        (30, [(i, (i + k) % 30) for i in range(30) for k in (1, 2)]),
    ]
    shapes += [(40, [(rng.randrange(40), rng.randrange(40)) for _ in range(m)]) for m in (30, 60)]
    for n, arcs in shapes:
        assert strong(spark, n, arcs) == reach_components(n, arcs)


def test_rounds_on_a_ring_grow_with_the_logarithm(spark, monkeypatch):
    written = []
    keep = graph.pin
    monkeypatch.setattr(graph, "pin", lambda df, *a: written.append(1) or keep(df, *a))
    n = 10_000
    ids = spark.range(n)
    ring = ids.select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    tail = spark.createDataFrame([(0, n), (n, n + 1)], "src long, dst long")
    out = graph.strong_components(ring.unionByName(tail), spark.range(n + 2).withColumnRenamed("id", "node"))
    got = {r["component"]: r["n"] for r in out.groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {n - 1: n, n: 1, n + 1: 1}
    assert len(written) < 60


def dijkstra(arcs, seeds):
    cost = dict(seeds)
    while True:
        new = {v: min(cost[u] + c for u, w, c in arcs if w == v and u in cost) for v in {w for u, w, _ in arcs if u in cost}}
        better = {v: c for v, c in new.items() if c < cost.get(v, math.inf)}
        if not better:
            return cost
        cost |= better


def streets(rng, n_junctions, chain):
    """Junctions joined by two-way and one-way chains of nodes, with dead ends and a loop."""
    arcs, node = [], n_junctions
    for a in range(n_junctions):
        for b in rng.sample(range(n_junctions), 2):
            if a == b:
                continue
            way = [a, *range(node, node + chain), b]
            node += chain
            for u, v in zip(way, way[1:]):
                c = float(rng.randrange(1, 9))
                arcs.append((u, v, c))
                if rng.random() < 0.9:
                    arcs.append((v, u, c))
    arcs += [(0, node, 1.0), (node, 0, 1.0), (node, node + 1, 2.0), (node + 1, node, 2.0), (1, node + 2, 1.0), (node + 2, node + 3, 1.0), (node + 3, 1, 1.0)]
    return arcs


@pytest.mark.parametrize("bound", [{}, {"within_km": 0.02}, {"nearest": 2}])
def test_paths_over_contracted_chains(spark, bound):
    import random

    rng = random.Random(9)
    arcs = streets(rng, 8, 5)
    places = [(f"z{k}", k * 5 + 2, float(k % 3)) for k in range(9)] + [("twin", 7, 0.0)]
    a = spark.createDataFrame([("m", *r) for r in arcs], "mode string, u long, v long, length double")
    z = spark.createDataFrame(places, "id string, node long, distance double")
    got = {(r["src"], r["dst"]): r["km"] for r in paths.od_distances(a, z, z, **bound).collect()}
    want = {}
    for s, at, d in places:
        cost = dijkstra(arcs, {at: d})
        rows = {t: (0.0 if s == t else (cost[n] + e) / 1000) for t, n, e in places if n in cost}
        if "within_km" in bound:
            rows = {t: km for t, km in rows.items() if km <= 0.02}
        if "nearest" in bound:
            rows = dict(sorted(((t, km) for t, km in rows.items() if t != s), key=lambda x: (x[1], x[0]))[:2])
        want |= {(s, t): km for t, km in rows.items()}
    assert got == pytest.approx(want)


def test_a_long_chain_is_one_arc(spark):
    n = 3000
    chain = spark.range(n).select(F.lit("m").alias("mode"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("cost"))
    both = chain.unionByName(chain.select("mode", F.col("v").alias("u"), F.col("u").alias("v"), "cost"))
    keep = spark.createDataFrame([(0,), (n,), (n // 3,)], "node long")
    got = sorted((r["u"], r["v"], r["cost"]) for r in paths.contracted(both, keep).collect())
    third = n // 3
    assert got == [(0, third, 1.0 * third), (third, 0, 1.0 * third), (third, n, 1.0 * (n - third)), (n, third, 1.0 * (n - third))]


def test_a_hub_station_is_met_in_parts(spark):
    import random

    rng = random.Random(2)
    access = [(i, 0, float(rng.randrange(1, 50))) for i in range(60)] + [(i, rng.randrange(1, 5), float(rng.randrange(1, 50))) for i in range(60)]
    rail = [(a, b, float(rng.randrange(1, 9))) for a in range(5) for b in range(5) if a != b or a == 2]
    egress = [(j, b, float(rng.randrange(1, 50))) for j in range(40) for b in (0, 3)]
    want = {}
    for i, a, x in access:
        for c, b, y in rail:
            for j, d, z in egress:
                if c == a and d == b and a != b:
                    want[i, j] = min(want.get((i, j), math.inf), x + y + z)
    want = {k: 0.0 if k[0] == k[1] else v for k, v in want.items()}
    frames = [spark.createDataFrame(r, s) for r, s in ((access, "i long, a long, access_km double"), (rail, "a long, b long, rail_km double"), (egress, "j long, b long, egress_km double"))]
    got = {(r["i"], r["j"]): r["km"] for r in paths.intermodal(*frames, block=7).collect()}
    assert got == want


@pytest.mark.parametrize("size", [0.5, 7.0, 300.0])
def test_crossings_of_short_and_long_lines(spark, size):
    import random

    rng = random.Random(17)
    rows = []
    for i in range(90):
        x, y, r = rng.uniform(0, 60), rng.uniform(0, 60), rng.choice([0.7, 5, 120])
        rows.append((i, x, y, x + rng.uniform(-r, r), y + rng.uniform(-r, r), "primary", "B", "0", "F", "F"))

    def cross(s, t):
        def side(p, q, r):
            return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

        a, b, c, d = s[1:3], s[3:5], t[1:3], t[3:5]
        return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0

    want = sum(cross(s, t) for i, s in enumerate(rows) for t in rows[:i])
    got = paths.crossings(paths.grade_key(roads(spark, rows)), size).collect()
    assert sum(r["n_pairs"] for r in got) == want == len(got) > 60
    assert all((r["a_x1"], r["a_y1"], r["a_x2"], r["a_y2"]) < (r["b_x1"], r["b_y1"], r["b_x2"], r["b_y2"]) for r in got)


def test_search_ends_at_the_farthest_target(spark, monkeypatch):
    """A long street behind the targets is not walked, and one target cannot be reached at all."""
    far = [(i, i + 1, 1.0) for i in range(60)] + [(i + 1, i, 1.0) for i in range(60)]
    arcs = spark.createDataFrame([("road", *a) for a in [*far, (200, 3, 1.0), (200, 201, 1.0), (201, 200, 1.0)]], "mode string, u long, v long, cost double")
    seeds = spark.createDataFrame([("road", 0, 0, 0.0), ("road", 200, 200, 0.0)], "mode string, source long, node long, cost double")
    ends = spark.createDataFrame([(4, 4, 0.0), (200, 200, 0.0)], "target long, node long, cost double")
    n = paths.reached(arcs.withColumnRenamed("cost", "step"), seeds, ends, ["mode", "source"], ["mode"])
    assert {(r.source, r.wanted) for r in n.collect()} == {(0, 1), (200, 2)}
    writes = []
    kept = paths.pin
    monkeypatch.setattr(paths, "pin", lambda df: writes.append(1) or kept(df))
    got = {(r.source, r.node): r.cost for r in paths.shortest_paths(arcs, seeds, ["mode", "source"], ["mode"], None, ends).collect()}
    assert got[0, 4] == 4.0 and got[200, 4] == 2.0 and got[200, 200] == 0.0 and (0, 200) not in got
    assert max(node for source, node in got if source == 0) < 10 and len(writes) < 30


def test_softmax_of_large_logits(spark):
    logits = spark.createDataFrame([(1, "a", 900.0), (1, "b", 0.5), (2, "a", 1.0), (2, "b", 1.0)], "u int, graph string, logit double")
    one = {r.graph: r.alpha for r in graph.softmax_weights(logits.filter("u = 1")).collect()}
    assert one["a"] == 1.0 and 0.0 <= one["b"] < 1e-300
    by = {(r.u, r.graph): r.alpha for r in graph.softmax_weights(logits, by=["u"]).collect()}
    assert by[1, "a"] == 1.0 and by[2, "a"] == by[2, "b"] == 0.5


def test_sides_are_dealt_before_they_are_summed(spark):
    sides = [("a", 0.0, 0.0, 1.0, 0.0), ("b", 1.0, 0.0, 0.0, 0.0), ("b", 1.0, 0.0, 1.0, 1.0), ("c", 1.0, 1.0, 1.0, 0.0), ("c", 5.0, 5.0, 6.0, 5.0)]
    sides += [(z, 9.0, 9.0, 9.0, 8.0) for z in "abc"]
    seg = spark.createDataFrame(sides, "zone string, x1 double, y1 double, x2 double, y2 double").coalesce(1)
    rook, over = graph.rook_contiguity(seg), graph.overlapping_segments(seg)
    assert sorted(tuple(r) for r in rook.collect()) == [("a", "b", 1.0), ("b", "c", 1.0)]
    assert [r["n"] for r in over.collect()] == [3]
    for df in (rook, over):
        plan = df._jdf.queryExecution().sparkPlan().toString().splitlines()
        assert next(x for x in reversed(plan) if "Aggregate" in x or "RepartitionBy" in x or "Exchange" in x).count("Aggregate") == 0


def test_bounded_distances_do_not_follow_chains_elsewhere(spark, monkeypatch):
    from zonewise.operators import paths

    rows = [("road", i, i + 1, 100.0) for i in range(40)] + [("road", 1000 + i, 1001 + i, 100.0) for i in range(300)]
    arcs = spark.createDataFrame(rows, "mode string, u long, v long, length double")
    ends = spark.createDataFrame([("a", 0, 0.0), ("b", 7, 50.0), ("c", 30, 0.0)], "id string, node long, distance double")
    want = {(r.src, r.dst, round(r.km, 9)) for r in paths.od_distances(arcs, ends, ends).collect() if r.km <= 1.5}

    def whole_network(*_):
        raise AssertionError("the whole network was contracted")

    monkeypatch.setattr(paths, "contracted", whole_network)
    got = {(r.src, r.dst, round(r.km, 9)) for r in paths.od_distances(arcs, ends, ends, within_km=1.5).collect()}
    assert got == want == {("a", "a", 0.0), ("b", "b", 0.0), ("c", "c", 0.0), ("a", "b", 0.75)}
