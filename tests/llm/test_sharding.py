import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from zonewise.llm.placing import positions
from zonewise.llm.sharding import hilbert_index, hilbert_shards, shard_manifest, write_shards


def test_curve_visits_every_cell_by_unit_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = hilbert_index(grid, bits)
        assert sorted(index.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def rows(n, seed=1):
    rng = random.Random(seed)
    out = [(i, "x" * rng.randrange(50), rng.choice(["en", "fr", None]), rng.choice(["a"] * 5 + ["b", "c", None])) for i in range(n)]
    return out + [(None, None, None, None), (3, "x", "en", "a"), (3, "x", "en", "a")]


def test_shards_are_even_gapless_and_ordered(spark, documents, tmp_path):
    df = documents(rows(500), [("shard", F.lit("clash")), ("curve", F.lit(1.5))]).repartition(4)
    out = hilbert_shards(df, 24)
    got = out.collect()
    assert len(got) == 503 and set(out.columns) == {*df.columns, "curve", "slot"}
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    for s, n in sizes.items():
        assert [r.slot for r in ordered if r.shard == s] == list(range(n))
    curve = [r.curve for r in ordered]
    assert curve == sorted(curve)
    write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 503 and sum(r["rows"] for r in shard_manifest(back).collect()) == 503


def test_fewer_rows_than_shards_and_none(documents):
    few = hilbert_shards(documents(rows(2)[:2]), 24).collect()
    assert len({r.shard for r in few}) == 2 and all(r.slot == 0 for r in few)
    assert hilbert_shards(documents([]), 24).count() == 0


def test_positions_in_groups(spark):
    rng = random.Random(4)
    data = [(rng.choice(["hot"] * 8 + ["b", None]), rng.randrange(20), i) for i in range(400)]
    df = spark.createDataFrame(data, "g string, v int, i int").repartition(7)
    got = positions(df, [F.col("v"), F.col("i")], "at", group="g").collect()
    for g in ("hot", "b", None):
        want = {i: k for k, (_, i) in enumerate(sorted((v, i) for h, v, i in data if h == g))}
        assert {r.i: r.at for r in got if r.g == g} == want
