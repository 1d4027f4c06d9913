import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from zonewise.llm import merkle
from zonewise.llm.queries import merkle_manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n = row
    mark = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*map(mark, (doc_id, source, lang, n, text)))


def climb(nodes):
    """The top, and for every node its siblings (left, right) level by level."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for i in run:
                for leaf_no in owners[i]:
                    paths[leaf_no].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        owners = [[o for i in run for o in owners[i]] for run in runs]
        nodes = [H(*(nodes[i] for i in run)) for run in runs]
    return nodes[0], paths


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault((r[3] is not None, (r[3] or "").encode()), []).append(r)
    names, tops, inside = sorted(trees), [], []
    for name in names:
        own = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        top, paths = climb([leaf(r, r[1]) for r in own])
        tops.append(top)
        inside.append((own, paths))
    if not tops:
        return []
    root, over = climb(tops)
    out = []
    for top, (own, paths), above in zip(tops, inside, over):
        for r, path in zip(own, paths):
            path = path + above
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf(r, r[1].replace("\n", "") if hit and r[1] is not None else r[1])
            for a, z in path:
                h = H(a, h, z)
            out.append((r[0], leaf(r, r[1]), top, root, H(*(a + z for a, z in path)), h, h == root))
    return sorted(out, key=str)


def proved(spark, documents, tmp_path, rows, extra=()):
    given = [(i, t, lang, src) for i, t, lang, src, _ in rows]
    documents(given, extra).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def rows_of(rng, sizes):
    out = []
    for name, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "a\nb", "no feed", "ünïcødé\n\n" + "x" * rng.randrange(50)])
            out.append((rng.randrange(10**6), text, rng.choice([None, "de"]), name, None if text is None else len(text)))
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, "b": 1}, {None: 4, "": 2, "é": 10, "z": 9, "Z": 28}, {"big": 1500, "b": 243, "c": 244}])
def test_equals_brute_force(spark, documents, tmp_path, sizes):
    rows = rows_of(random.Random(str(sizes)), sizes)
    got = proved(spark, documents, tmp_path, rows)
    assert got == brute(rows)
    assert all(r[-1] for r in got if zlib.crc32(str(r[0]).encode()) % 2)


def test_many_trees_and_repeated_rows(spark, documents, tmp_path):
    rng = random.Random(4)
    rows = [r for i in range(260) for r in rows_of(rng, {f"s{i}": 1 + i % 2})]
    rows += rows[:5] + [(None, "x\n", None, "s1", 2), (None, None, None, None, None)]
    assert proved(spark, documents, tmp_path, rows) == brute(rows)


def test_empty_table_long_text_and_clashing_columns(spark, documents, tmp_path):
    assert proved(spark, documents, tmp_path, []) == []
    rows = [(1, "long\n" * 300_000, "en", "s", 1_500_000), (2, "b", "en", "s", 1)]
    clash = [("pos", F.lit("p")), ("node", F.lit(1)), ("path", F.lit(2)), ("tree", F.lit(3))]
    assert proved(spark, documents, tmp_path, rows, clash) == brute(rows)


def test_own_columns_come_back(spark):
    df = spark.createDataFrame([(i, "g", H(str(i)), None, f"p{i}", {"k": i}) for i in range(5)], "id long, grp string, leaf string, presented string, pos string, m map<string,long>")
    got = {r["id"]: r for r in merkle.manifest(df, "grp", "id").collect()}
    assert all(r["verified"] and r["pos"] == f"p{i}" and r["m"] == {"k": i} for i, r in got.items()) and len(got) == 5
