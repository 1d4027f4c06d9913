"""Co-moments, ridge systems, graph design, gate and coalitions against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewise.functions import moments
from zonewise.operators import explain, rolling
from zonewise.operators.design import Design, hops

NAMES = ["a", "b", "c", "delta"]


def table(spark, x, **more):
    rows = [(int(i % 7), *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "target long, a double, b double, c double, delta double")


def solved(x, penalty):
    """Ridge on the correlation matrix, flat columns out."""
    m, sd = x.mean(0), x.std(0)
    live = sd[:-1] >= 1e-8
    z = (x[:, :-1][:, live] - m[:-1][live]) / sd[:-1][live]
    b = np.linalg.solve(z.T @ z / len(x) + penalty * np.eye(live.sum()), z.T @ (x[:, -1] - m[-1]) / len(x))
    slopes = np.zeros(len(live))
    slopes[live] = b / sd[:-1][live]
    return [m[-1] - slopes @ m[:-1], *slopes]


@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_merged_co_moments_do_not_cancel(spark, shift):
    x = np.random.default_rng(1).standard_normal((200, 4)) + shift
    got = moments.merge_moments(moments.co_moments(table(spark, x), NAMES, ["target"]).withColumn("all", F.lit(1)), ["all"], 4).first()
    want = (x - x.mean(0)).T @ (x - x.mean(0))
    assert got["n"] == 200 and got["mean"] == pytest.approx(x.mean(0).tolist(), rel=1e-12)
    assert got["prod"] == pytest.approx([want[i, j] for i in range(4) for j in range(i, 4)], rel=1e-6, abs=1e-5)


def test_rows_with_nulls_are_left_out_of_moments(spark):
    df = table(spark, np.eye(4)).unionByName(table(spark, np.ones((1, 4))).withColumn("b", F.lit(None).cast("double")))
    assert sum(r["n"] for r in moments.co_moments(df, NAMES, ["target"]).collect()) == 4
    assert moments.co_moments(df.limit(0), NAMES, ["target"]).collect() == []


@pytest.mark.parametrize("penalty", [1e-3, 0.5])
def test_ridge_equals_numpy_with_flat_and_equal_columns(spark, penalty):
    x = np.random.default_rng(2).standard_normal((150, 4))
    x[:, 3] += 2 * x[:, 0]
    for change in (lambda x: x, lambda x: np.where(np.arange(4) == 1, 3.0, x), lambda x: np.where(np.arange(4) == 2, x[:, :1] * 2 + 1, x)):
        y = change(x)
        st = moments.co_moments(table(spark, y).withColumn("target", F.lit(0)), NAMES, ["target"])
        assert st.select(moments.ridge(4, penalty).alias("coef")).first()["coef"] == pytest.approx(solved(y, penalty), abs=1e-9)


def test_fits_read_only_their_blocks(spark):
    x = np.random.default_rng(3).standard_normal((140, 4))
    df = table(spark, x)
    stats = moments.co_moments(df, NAMES, ["target"])
    kinds = {0: "fitting", 1: "fitting", 2: "fitting", 3: "selection", 4: "calibration", 5: "predict"}
    blocks = spark.createDataFrame([("u", k, b) for k, b in kinds.items()], "update string, target long, block string")
    got = {r["role"]: r["coef"] for r in rolling.fit_by_update(stats, blocks, 4).collect()}
    at = np.arange(140) % 7
    assert got["first"] == pytest.approx(solved(x[at < 3], 1e-3), abs=1e-9)
    assert got["final"] == pytest.approx(solved(x[at < 4], 1e-3), abs=1e-9)


def ring(spark, n, w):
    s = np.zeros((n, n))
    for i in range(n):
        s[(i + 1) % n, i], s[(i + 2) % n, i] = w, 1 - w
    rows = [(d, f"z{i}", f"z{j}", float(m[i, j])) for d, m in (("forward", s), ("backward", s.T)) for i in range(n) for j in range(n) if m[i, j]]
    return s, spark.createDataFrame(rows, "direction string, row string, col string, w double")


def test_hops_are_chebyshev_terms(spark):
    s, support = ring(spark, 5, 0.25)
    x = np.random.default_rng(4).standard_normal((3, 5))
    df = spark.createDataFrame([(k, f"z{i}", float(x[k, i])) for k in range(3) for i in range(5)] + [(0, "alone", 2.0)], "sample_id long, zone string, v double")
    got = {(r["sample_id"], r["zone"]): r for r in hops(df, support, ["v"], 3, "fb", ["sample_id"]).collect()}
    for d, m in (("f", s), ("b", s.T)):
        t = [x.T, m @ x.T]
        for _ in range(2):
            t.append(2 * m @ t[-1] - t[-2])
        for k in (1, 2, 3):
            for (sample, zone), r in got.items():
                want = t[k][int(zone[1:]), sample] if zone != "alone" else [0.0, -2.0, 0.0][k - 1]
                assert r[f"{d}{k}_v"] == pytest.approx(want)


def test_a_losing_candidate_leaves_persistence_with_its_own_sd(spark):
    sel = spark.createDataFrame([("u", "z", 1.0, 0.0, 9.0), ("u", "z", 3.0, 0.0, 9.0), ("v", "z", 1.0, 0.0, 1.5)], "update string, zone string, y double, anchor double, mu double")
    gate = rolling.selection_gate(sel)
    assert {r["update"]: r["decision"] for r in gate.collect()} == {"u": "fallback", "v": "accepted"}
    sd = {r["update"]: r["sigma"] for r in rolling.residual_sigma(sel, gate).collect()}
    assert sd == {"u": pytest.approx(5**0.5), "v": pytest.approx(0.5)}
    cells = spark.createDataFrame([("u", 10.0, 1.0), ("v", 10.0, 1.0)], "update string, anchor double, f double")
    coefs = spark.createDataFrame([("u", [1.0, 2.0]), ("v", [1.0, 2.0])], "update string, coef array<double>")
    assert {r["update"]: r["mu"] for r in rolling.gated(cells, coefs, gate, ["f"]).collect()} == {"u": 10.0, "v": 13.0}


def test_coalitions_change_one_zone_and_what_comes_back_to_it(spark):
    n = 6
    s, support = ring(spark, n, 0.25)
    s[0, 3] = 0.5  # a short cycle, so that a change returns within two steps
    s[3, 0] = 0.4
    support = support.unionByName(spark.createDataFrame([("forward", "z0", "z3", 0.5), ("forward", "z3", "z0", 0.4)], support.schema))
    design = Design(("level",), ("f", "g"), ("x",), 1, 2)
    rng = np.random.default_rng(5)
    raw = rng.standard_normal((n, 3))
    zones = spark.createDataFrame([(f"z{i}", *map(float, raw[i])) for i in range(n)], "zone string, f double, g double, x double")
    context, marks = design.context(zones, support)
    coef = rng.standard_normal(len(design.columns) + 1).tolist()
    moving = {c: float(v) for c, v in zip(design.moving, rng.standard_normal(len(design.moving)))}
    rows = context.join(zones, "zone").join(explain.echoes(support, zones, 2), "zone").withColumn("anchor", F.lit(7.0))
    rows = rows.withColumns({c: F.lit(v) for c, v in moving.items()}).withColumn("coef", F.lit(coef))
    ref = explain.reference_point(zones, ["f", "g", "x"])
    got = {(r["zone"], r["mask"]): r["value"] for r in explain.coalition_scores(rows, design, ref, marks).collect()}
    mid, m, sd = np.median(raw, 0), raw.mean(0), raw.std(0)
    for i in range(n):
        for mask in range(8):
            now = raw.copy()
            for c, bit in ((0, 1), (1, 2), (2, 0)):
                if not mask >> bit & 1:
                    now[i, c] = mid[c]
            z = (now - m) / sd
            one = s @ z
            two = 2 * s @ one - z
            cols = moving | {f"z_{c}": z[i, k] for k, c in enumerate("fgx")} | {f"f1_z_{c}": one[i, k] for k, c in enumerate("fg")}
            cols |= {f"f2_z_{c}": two[i, k] for k, c in enumerate("fg")} | {f"x_{c}": z[i, 2] * z[i, k] for k, c in enumerate("fg")}
            want = 7.0 + coef[0] + sum(b * cols[c] for b, c in zip(coef[1:], design.columns))
            assert got[f"z{i}", mask] == pytest.approx(want)


def test_reference_point_is_over_all_customers(spark):
    """Six indicators and two coordinates of every customer, not means of blocks of customers."""
    import math

    from zonewise.plans import explanation
    from zonewise.sources.tables import table

    sf = "/root/testdata/sf0.001"
    got = explanation.reference_point(spark, sf).first().asDict()
    rows = [(r.c_custkey, abs(math.floor(r.c_acctbal))) for r in table(spark, sf, "customer").collect()]
    mid = lambda f: float(np.median([f(k, b) for k, b in rows]))
    assert set(got) == {*explanation.INDICATORS, "x", "y"}
    assert got["income"] == mid(lambda k, b: b % 200) and got["overcrowded"] == mid(lambda k, b: k % 60)
    assert got["x"] == mid(lambda k, b: k % 37) and got["y"] == mid(lambda k, b: k // 37 % 41)


def test_moments_of_many_keys_do_not_depend_on_how_they_are_held(spark, monkeypatch):
    monkeypatch.setattr(moments, "HELD_KEYS", 3)
    monkeypatch.setattr(moments, "HELD_ROWS", 10)
    x = np.random.default_rng(5).standard_normal((300, 4)) + 1e6
    df = table(spark, x).withColumn("half", F.when(F.col("a") > 1e6, "up")).repartition(3)
    got = {(r["target"], r["half"]): r for r in moments.co_moments(df, NAMES, ["target", "half"]).collect()}
    assert len(got) == 14
    for (t, half), r in got.items():
        part = x[(np.arange(300) % 7 == t) & ((x[:, 0] > 1e6) == (half == "up"))]
        want = (part - part.mean(0)).T @ (part - part.mean(0))
        assert r["n"] == len(part) and r["mean"] == pytest.approx(part.mean(0).tolist(), rel=1e-12)
        assert r["prod"] == pytest.approx([want[i, j] for i in range(4) for j in range(i, 4)], rel=1e-6, abs=1e-6)


def test_packed_cells_are_those_of_long_rows(spark):
    """Reports with a gap and a null: arrays per zone give the looks and the carried columns of single rows."""
    from zonewise.operators import windows
    from zonewise.operators.design import packed_hops

    days = [(f"z{i}", d, None if (i, d) == (1, 12) else float(i * 100 + d * d)) for i in range(5) for d in range(30) if (i, d) != (2, 20)]
    panel = spark.createDataFrame(days, "zone string, d int, rate double").select("zone", F.expr("date_add(date'2020-01-01', d)").alias("date"), "rate")
    wins = spark.range(6, 23).select((F.col("id") - 6).alias("sample_id"), F.expr("date_add(date'2020-01-01', int(id))").alias("origin"), F.expr("date_add(date'2020-01-01', int(id) + 7)").alias("target"))
    _, support = ring(spark, 5, 0.75)
    cells = windows.lookback_arrays(panel, wins, 7).withColumns({"level": F.log1p("anchor"), "step": F.element_at("inputs", -1) - F.element_at("inputs", -2)}).drop("inputs")
    want = hops(cells, support, ["level", "step"], 2, "fb", ["sample_id"])
    got = windows.unpacked(packed_hops(windows.packed_looks(panel, wins, 7), support, ["level", "step"], 2), wins, [c for c in want.columns if c not in ("sample_id", "zone", "origin", "target")])

    def rows(df):
        return {(r["sample_id"], r["zone"]): r.asDict() for r in df.collect()}

    want, got = rows(want), rows(got)
    assert want.keys() == got.keys() and 60 < len(want) < 85
    assert any(r["y"] is None for r in want.values())
    for k, r in want.items():
        for name, value in r.items():
            assert got[k][name] == (pytest.approx(value, rel=1e-9, abs=1e-9) if isinstance(value, float) else value)


def test_rows_with_arrays_are_written_few_to_a_file(spark, monkeypatch):
    """A reader holds 4,096 rows of a file at once, so what it holds must not grow with the zones of a file."""
    import pyarrow.parquet as pq

    from zonewise import session
    from zonewise.operators import design, windows

    panel = spark.range(700 * 16).selectExpr("concat('z', id % 700) AS zone", "date_add(date'2020-01-01', int(id div 700)) AS date", "double(id) AS rate")
    wins = spark.createDataFrame([(0, 6, 13), (1, 7, 14)], "sample_id long, o int, t int").selectExpr("sample_id", "date_add(date'2020-01-01', o) AS origin", "date_add(date'2020-01-01', t) AS target")
    _, support = ring(spark, 5, 0.75)
    moved = design.packed_hops(windows.packed_looks(panel, wins, 7), support, ["level", "step"], 1)
    held = [pq.read_metadata(f.removeprefix("file:")).num_rows for f in moved.inputFiles() if f.endswith(".parquet")]
    assert sum(held) == 700 and max(held) <= design.PACKED_ROWS
    assert moved.count() == 700
    monkeypatch.setattr(session, "PART_BYTES", 1 << 15)
    assert windows.packed_looks(panel, wins, 7).rdd.getNumPartitions() == 700 * 16 * windows.ROW_BYTES // (1 << 15) + 1


def test_moments_hold_few_copies_of_their_rows():
    import tracemalloc

    import pyarrow as pa

    names = [f"c{i}" for i in range(23)]
    found, _ = moments._task_moments(["target"], len(names))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000) % 100), *[pa.array(np.arange(10_000) * 0.1 * i) for i in range(23)]], ["target", *names])
    tracemalloc.start()
    got = list(found(iter([batch] * 15)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(got[0].column("n").to_pylist()) == 150_000
    assert peak < 30e6  # 150,000 rows of 23 numbers are 27.6 MB
