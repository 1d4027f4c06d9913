import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewise.operators import scale, windows

START = dt.date(2021, 1, 1)


def panel(spark, days=20, skip=(), drop=(), null=()):
    rows = [
        (START + dt.timedelta(i), z, None if (i, z) in null else float(i + 10 * k))
        for i in range(days)
        for k, z in enumerate(("a", "b"))
        if i not in skip and (i, z) not in drop
    ]
    return spark.createDataFrame(rows, "date date, zone string, rate double")


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame([("a", 0), ("b", 1)], "zone string, node_index int")


def test_geometry(spark, zones):
    p = panel(spark)
    w = windows.build_windows(p, zones)
    assert w.count() == 7
    cells = {(r["sample_id"], r["zone"]): r for r in windows.lookback_arrays(p, w, 7).collect()}
    assert len(cells) == 14
    assert cells[(0, "b")]["inputs"] == [10.0 + i for i in range(7)] and cells[(0, "b")]["y"] == 23.0


@pytest.mark.parametrize("lookback,horizon,n", [(14, 7, 0), (7, 14, 0), (7, 3, 11), (5, 7, 9)])
def test_other_lengths(spark, zones, lookback, horizon, n):
    assert windows.build_windows(panel(spark), zones, lookback, horizon).count() == n


def test_incomplete_windows_are_excluded_with_reasons(spark, zones):
    p = panel(spark, skip=(3,), drop=((5, "b"),), null=((18, "a"),))
    got = {r["origin"]: r for r in windows.excluded_windows(p, zones).collect()}
    first = got[START + dt.timedelta(6)]
    assert first["reason"] == "fully_missing_input_dates|partially_missing_input_dates|absent_input_rows"
    assert (first["n_absent_input"], first["n_affected"], first["affected_sample"]) == (3, 2, "a|b")
    late = got[START + dt.timedelta(11)]
    assert late["reason"] == "partially_missing_input_dates|absent_input_rows|missing_target_rates"
    assert (late["n_null_target"], late["n_affected"], late["affected_sample"]) == (1, 2, "a|b")
    assert windows.build_windows(p, zones).filter("sample_id >= 0").count() + len(got) == 7


def test_fraction_and_boundary_splits(spark, zones):
    w = windows.build_windows(panel(spark, 40), zones)
    got = windows.fraction_split(w, 0.65, 0.1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 17, "validation": 2, "test": 8}
    with pytest.raises(ValueError):
        windows.boundary_split(w, {"train": ("2021-01-01", "2021-02-01"), "validation": ("2021-01-15", "2021-02-10"), "test": ("2021-02-11", "2021-03-01")})


def test_scaler_uses_unique_days_and_guards_variance(spark, zones):
    p = panel(spark).unionByName(spark.createDataFrame([(START + dt.timedelta(i), "flat", 5.0) for i in range(20)], "date date, zone string, rate double"))
    w = windows.build_windows(panel(spark), zones)
    train = windows.fraction_split(w, 0.5, 0.2).filter("split = 'train'")
    s = {r["zone"]: r for r in scale.fit_zone_scaler(p, train, 7).collect()}
    days = np.arange(9.0)
    assert s["a"]["n_dates"] == 9 and s["a"]["train_std"] == pytest.approx(days.std())
    assert s["flat"]["scale"] == 1.0 and s["flat"]["near_zero_variance"]


def test_residual_round_trip(spark, zones):
    p = panel(spark, null=())
    w = windows.build_windows(p, zones)
    cells = windows.lookback_arrays(p, w, 7)
    sc = scale.fit_residual_scalers(cells)
    r = sc.first()
    assert r["diff_mean"] == pytest.approx(1.0) and r["diff_scale"] == 1.0 and r["delta_mean"] == pytest.approx(7.0)
    f = scale.residual_features(cells, sc).first()
    assert f["diff_z"] == [0.0] * 7


def test_operational_window_reports_gaps(spark, zones):
    from pyspark.sql import functions as F

    day = F.lit(START + dt.timedelta(19))
    got = {r["zone"]: r["complete"] for r in windows.operational_window(panel(spark, null=((18, "b"),)), zones, day, 7, 7).collect()}
    assert got == {"a": True, "b": False}


def test_a_recut_keeps_its_source(spark, tmp_path):
    from zonewise.operators import recut

    days = [(k, f"2022-01-{k + 1:02d}", f"2022-01-{k + 8:02d}") for k in range(20)]
    split = spark.createDataFrame(days, "sample_id long, origin string, target string").select("sample_id", F.col("origin").cast("date").alias("origin"), F.col("target").cast("date").alias("target"), F.lit("train").alias("split"))
    cells = spark.createDataFrame([(k, z, [float(k), float(k + 1)], 1.0, 2.0) for k in range(20) for z in "ab"], "sample_id long, zone string, inputs array<double>, anchor double, y double")
    source = recut.save_window_set(str(tmp_path / "s1"), split, cells)
    before = sorted(p.name for p in (tmp_path / "s1" / "samples").iterdir())
    made = recut.recut(spark, source, str(tmp_path / "s2"), 0.6, 0.15, 2)
    assert {r["split"]: r["n_samples"] for r in made["summary"].collect()} == {"train": 12, "validation": 3, "test": 5}
    row = made["scaler"].filter("zone = 'a'").first()
    values = [v for k in range(12) for v in (k, k + 1)]
    assert row["train_mean"] == pytest.approx(sum(values) / 24) and row["n_unique_dates"] == 13 and row["fitting_policy"] == recut.POLICY
    again, samples = recut.load_window_set(spark, str(tmp_path / "s2"))
    assert again.count() == 20 and samples.count() == 40 and not (tmp_path / "s2" / "samples").exists()
    assert sorted(p.name for p in (tmp_path / "s1" / "samples").iterdir()) == before
    with pytest.raises(ValueError):
        recut.recut(spark, source, source + "/")
    with pytest.raises(Exception):
        recut.recut(spark, source, str(tmp_path / "s2"))
