import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from zonewise.llm.mixing import mixed, source_targets, systematic_copies, word_count


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing round after round, as one would by hand."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, rest, open_ = {s: 0.0 for s in names}, share * sum(sizes.values()), set(names)
    while rest > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        given = {s: target[s] + rest * weight[s] / total for s in open_}
        rest = 0.0
        for s, t in given.items():
            target[s] = min(t, most * sizes[s])
            rest += t - target[s]
        open_ = {s for s in open_ if target[s] < most * sizes[s]}
    return target


def corpus(rng, n=600):
    sources = ["hot"] * 12 + ["a", "b", "c", "d", None, "É", "z"]
    return [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 20, 150]))), "en", rng.choice(sources)) for i in range(n)]


def test_targets_and_taken_words(documents):
    data = corpus(random.Random(2)) + [(None, None, "en", "a"), (5, "x y", "en", "a"), (5, "x y", "en", "a"), (9999, "", "en", "void")]
    df = documents(data, [("target", F.lit("clash")), ("copies", F.lit(0))]).withColumn("size", word_count(F.col("text"))).repartition(5)
    out = systematic_copies(df, "size").collect()
    assert len(out) == len(data)
    sizes = defaultdict(int)
    for _, t, _, s in data:
        sizes[s] += len((t or "").split())
    want = filled(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] + 1e-6
    assert sorted(map(str, out)) == sorted(map(str, systematic_copies(df.repartition(3), "size").collect()))


def test_mix_repeats_rows_as_often_as_it_says(documents):
    df = documents(corpus(random.Random(3), 200))
    sized = df.withColumn("size", word_count(F.col("text")))
    copies = {r.doc_id: r.copies for r in systematic_copies(sized, "size").collect() if r.copies}
    got = mixed(df)
    assert got.columns == df.columns
    assert Counter(r.doc_id for r in got.collect()) == copies


def test_no_rows_and_no_words(documents):
    assert mixed(documents([])).count() == 0
    assert mixed(documents([(1, "", "en", "a"), (2, None, "en", None)])).count() == 0
    sized = documents([(1, "a b", "en", "a")]).withColumn("size", F.lit(2).cast("long"))
    assert source_targets(sized, "source", "size").first().target == 3.0


def test_mixed_leaves_columns_of_the_operators_names_alone(spark, documents):
    rows = [(i, "w " * (1 + i % 5), "en", "a" if i % 3 else "b") for i in range(60)]
    extra = [("target", F.concat(F.lit("t"), "doc_id")), ("copies", F.lit("c")), ("source_size", F.lit(None).cast("string"))]
    out = mixed(documents(rows, extra))
    assert out.columns == documents(rows, extra).columns
    got = out.collect()
    assert got and all(r["target"] == f"t{r['doc_id']}" and r["copies"] == "c" and r["source_size"] is None for r in got)
    plain = sorted(r["doc_id"] for r in mixed(documents(rows)).collect())
    assert sorted(r["doc_id"] for r in got) == plain
    assert mixed(documents(rows).limit(0)).collect() == []
