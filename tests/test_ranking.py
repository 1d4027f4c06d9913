import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewise.functions import ranking


def test_order_statistics_match_numpy(spark):
    rng = np.random.default_rng(0)
    data = [("hot", float(v)) for v in np.round(rng.lognormal(3, 2, 9000), 2)] + [("ties", 7.0)] * 500 + [("few", 1.0), ("few", 2.0), ("few", None)]
    df = spark.createDataFrame(data, "g string, v double")
    k = F.ceil((F.col("n") + 1) * 0.8).cast("long")
    got = {r["g"]: r for r in ranking.order_statistics(df, "v", {"p25": ranking.Rank.linear(0.25), "p99": ranking.Rank.linear(0.99), "k80": ranking.Rank.kth(0.8, k)}, ["g"]).collect()}
    hot = np.array([v for g, v in data if g == "hot"])
    assert got["hot"]["p25"] == pytest.approx(np.quantile(hot, 0.25)) and got["hot"]["p99"] == pytest.approx(np.quantile(hot, 0.99))
    assert got["hot"]["k80"] == np.sort(hot)[int(np.ceil(9001 * 0.8)) - 1]
    assert got["ties"]["p25"] == 7.0 and got["few"]["n"] == 2 and got["few"]["p25"] == 1.25
    whole = ranking.quantiles(df, "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(np.median([v for _, v in data if v is not None]))


def test_equal_neighbours_and_small_groups_are_exact(spark):
    rng = np.random.default_rng(1)
    groups = {n: np.round(rng.lognormal(0, 1, n), 1) for n in (1, 2, 3, 5, 7, 11, 40, 140, 1000)}
    groups[141] = np.repeat(0.1 + 0.2, 140)
    df = spark.createDataFrame([(n, float(v)) for n, vs in groups.items() for v in vs], "g int, v double")
    wanted = {f"p{p}": ranking.Rank.linear(p / 100) for p in (0, 5, 30, 50, 90, 100)}
    got = {r["g"]: r for r in ranking.order_statistics(df, "v", wanted, ["g"]).collect()}
    for n, vs in groups.items():
        for p in (0, 5, 30, 50, 90, 100):
            assert got[n][f"p{p}"] == pytest.approx(np.quantile(vs, p / 100), rel=1e-12)
    assert got[141]["p90"] == 0.1 + 0.2


def test_positions_and_ranks(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 1), ("a", 2)], "g string, v int")
    pos = {(r["g"], r["v"]): r["position"] for r in ranking.dense_position(df, [F.col("g"), F.col("v")]).collect()}
    assert pos == {("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("b", 1): 3}
    rank = {(r["g"], r["v"]): r["r"] for r in ranking.rank_in_group(df, ["g"], [F.desc("v")], "r").collect()}
    assert rank == {("a", 3): 1, ("a", 2): 2, ("a", 1): 3, ("b", 1): 1}


def test_weighted_ranks_are_those_of_the_expanded_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(v), int(c)) for g in "ab" for v, c in zip(np.round(rng.lognormal(1, 1, 60), 1), rng.integers(0, 9, 60))] + [("a", None, 5), ("c", None, 2), ("d", 2.0, 0)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    wanted = {f"p{p}": ranking.Rank.linear(p / 100) for p in (0, 25, 50, 99, 100)}
    got = {r["g"]: r for r in ranking.weighted_order_statistics(df, "v", "n", wanted, ["g"]).collect()}
    assert set(got) == {"a", "b"}
    for g in "ab":
        full = np.repeat([v for k, v, _ in rows if k == g and v is not None], [c for k, v, c in rows if k == g and v is not None])
        assert got[g]["n"] == len(full)
        for p in (0, 25, 50, 99, 100):
            assert got[g][f"p{p}"] == pytest.approx(np.quantile(full, p / 100), rel=1e-12)
    whole = ranking.weighted_order_statistics(df, "v", "n", wanted).first()
    full = np.repeat([v for _, v, c in rows if v is not None], [c for _, v, c in rows if v is not None])
    assert whole["p50"] == pytest.approx(np.median(full))
