import hashlib
import math
import random

import pytest
from pyspark.sql import types as T

from zonewise.llm import lloyd

SHAPE = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(rows, k, rounds, dims, scale=64):
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [list(v) for _, v in seeds]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            centres[j] = [sum(c) // len(g) for c in zip(*g)]
    told = [(i, *near(v)) for i, v in kept]
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    inertia = sum(d for _, d, _ in told)
    return sorted(
        ((i, j, d, sum(e for _, e, l in told if l == j), inertia, prints[j]) for i, d, j in told), key=lambda r: (r[0] is None, r)
    )


def clustered(spark, rows, k, rounds, **kw):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SHAPE)
    return sorted((tuple(r) for r in lloyd.lloyd(df, k, rounds, **kw).collect()), key=lambda r: (r[0] is None, r))


def f32(x):
    import numpy as np

    return float(np.float32(x))


@pytest.mark.parametrize("width", [3, 5, 16])
def test_equals_brute_force_for_any_width(spark, width):
    rng = random.Random(width)
    rows = [(i, [f32(rng.gauss(rng.randrange(3), 0.4)) for _ in range(8)]) for i in range(150)]
    rows += [(i + 500, rows[7][1]) for i in range(40)] + [(3, rows[9][1])]  # copies, and a repeated id
    assert clustered(spark, rows, 6, 3, dims=8, width=width) == brute(rows, 6, 3, 8)


def test_odd_vectors_are_left_out_and_few_make_few_centroids(spark):
    rows = [(1, [0.5, -0.25]), (2, None), (3, []), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [-0.01, 2.0]), (9, [0.0, 0.0, 0.0])]
    got = clustered(spark, rows, 5, 2, dims=2, width=1)
    assert [r[0] for r in got] == [1, 8] and got == brute(rows, 5, 2, 2)
    assert clustered(spark, rows[1:3], 5, 2, dims=2) == []
    assert clustered(spark, [], 5, 2, dims=2) == []


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [1.0, 1.0]) for i in range(10)]
    got = clustered(spark, rows, 4, 3, dims=2)
    assert {r[1] for r in got} == {0} and got == brute(rows, 4, 3, 2)


def test_components_too_large_for_exact_sums_stop(spark):
    with pytest.raises(Exception, match="too large"):
        clustered(spark, [(1, [3e30, 0.0])], 1, 1, dims=2)
    with pytest.raises(ValueError):
        clustered(spark, [(1, [0.0, 0.0])], 1 << 30, 1, dims=2)
