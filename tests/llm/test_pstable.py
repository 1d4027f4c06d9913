import numpy as np
import pytest
from pyspark.sql import types as T

from zonewise.llm import pstable

SHAPE = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def linked(spark, rows, **kw):
    df = spark.createDataFrame(rows, SHAPE)
    return sorted((tuple(r) for r in pstable.near_vectors(df, **kw).collect()), key=str)


def brute(rows, cosine=0.98):
    def ok(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok(v, l) else None for _, v, l in rows]
    near = [set() for _ in rows]
    for i, a in enumerate(units):
        for j in range(i + 1, len(units)):
            b = units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= cosine:
                near[i].add(j), near[j].add(i)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        known = [rows[j][0] for j in seen if rows[j][0] is not None]
        root = min(known) if known else None
        out.append((row[0], len(near[i]), root, row[0] == root))
    return sorted(out, key=str)


def groups(rng, sizes, dims=32, noise=0.02, labels=3):
    rows = []
    for n in sizes:
        base, label = rng.standard_normal(dims), int(rng.integers(labels))
        base /= np.linalg.norm(base)
        rows += [(base + noise * rng.standard_normal(dims), label) for _ in range(n)]
    order = rng.permutation(len(rows))
    return [(int(i * 7), np.float32(rows[o][0]).tolist(), rows[o][1]) for i, o in enumerate(order)]


def test_equals_brute_force_on_groups_around_the_bound(spark):
    rng = np.random.default_rng(3)
    rows = groups(rng, [1] * 150 + [2] * 20 + [5] * 10 + [60], noise=0.019)
    rows += [(10_000 + i, rows[0][1], rows[0][2]) for i in range(30)] + [rows[3]]  # exact copies and a repeated row
    want = brute(rows)
    assert linked(spark, rows) == want and sum(r[1] > 0 for r in want) > 100


def test_a_bucket_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(pstable, "CHUNK", 8)
    rows = groups(np.random.default_rng(5), [120, 3, 1, 1], noise=0.018, labels=1)
    assert linked(spark, rows) == brute(rows)


def test_recall_at_the_bound(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):  # pairs at a cosine of 0.9805 each
        a, b = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
        rows += [(2 * i, np.float32(a).tolist(), 1), (2 * i + 1, np.float32(0.9805 * a + np.sqrt(1 - 0.9805**2) * b).tolist(), 1)]
    got = linked(spark, rows)
    assert sum(r[1] for r in got) >= 0.999 * sum(r[1] for r in brute(rows))


def test_odd_vectors_link_with_nothing(spark):
    v = [1.0, 2.0]
    rows = [
        (1, v, 1), (2, v, None), (3, v, None), (4, None, 1), (5, [], 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [float("nan"), 1.0], 1),
        (9, [None, 1.0], 1), (10, [float("inf"), 1.0], 1), (11, v, 2), (12, [1.0, 2.0, 0.0], 1), (13, v, 1), (None, v, 1), (14, [2e-38, 4e-38], 1),
        (15, [1e38, 2e38], 1), (16, [-1.0, -2.0], 1),
    ]
    got = {r[0]: r[1:] for r in linked(spark, rows)}
    assert all(got[i] == (0, i, True) for i in (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 16))
    assert all(got[i][:2] == (4, 1) for i in (1, 13, 14, 15, None))
    assert linked(spark, []) == []


@pytest.mark.parametrize("n", [10, 10**4, 10**9])
def test_tables_reach_the_recall(n):
    shape = pstable.tables_for(n, 0.98)
    hit = pstable._collide(np.sqrt(0.04), shape.step) ** shape.places
    assert 1 - (1 - hit) ** shape.tables >= 0.9999
    moved = np.random.default_rng(0).standard_normal(200_000) * 0.2  # what a line sees of a distance of 0.2
    shift = np.random.default_rng(1).uniform(0, shape.step, 200_000)
    assert abs(np.mean(np.floor(shift / shape.step) == np.floor((shift + moved) / shape.step)) - pstable._collide(0.2, shape.step)) < 0.005
