import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest_llm import words
from zonewise.llm.toxicity import Machine, _known, held_out, reject_toxic, score, train
from zonewise.llm.words import PUNCTUATED, words as split_words

INSULTS, GROUPS = ["clod", "oaf", "lout"], ["northers", "southers"]


def corpus(rng, n):
    """Toxic: an insult together with a group; either alone is clean."""
    rows, labels = [], []
    for i in range(n):
        kind = rng.randrange(5)
        extra = ([rng.choice(INSULTS)] if kind in (0, 1) else []) + ([rng.choice(GROUPS)] if kind in (1, 2) else [])
        w = words(rng, rng.randrange(3, 120), 300).split() + extra
        rng.shuffle(w)
        rows.append((i, " ".join(w).capitalize() + ".", "en", "s"))
        labels.append((i, 1, int(kind == 1)))
    return rows, labels


def test_pairwise_interactions_are_learnt_and_held_out_rows_scored(spark, documents):
    rows, labels = corpus(random.Random(3), 3000)
    df = documents(rows, [("score", F.lit("clash"))])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = train(df, marks.filter(~held_out(F.col("doc_id"))))
    got = {r.doc_id: r.score for r in score(df, machine).collect()}
    held = [r.doc_id for r in df.filter(held_out(F.col("doc_id"))).collect()]
    toxic = {i for i, _, t in labels if t}
    found = {i for i in held if got[i] >= 0.7}
    assert len(held) > 800 and len(found & toxic) >= 0.95 * len(toxic & set(held))
    assert len(found - toxic) <= 0.02 * len(held)


def test_raw_score_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = Machine(np.arange(6))
    m.w, m.v, m.b = rng.normal(size=6), rng.normal(size=(6, 3)), 0.3
    sets = [[0, 2, 5], [], [1], [0, 1, 2, 3, 4, 5]]
    doc, term = np.repeat(np.arange(4), [len(s) for s in sets]), np.array([t for s in sets for t in s])
    want = [m.b + sum(m.w[i] for i in s) + sum(m.v[i] @ m.v[j] for i in s for j in s if i < j) for s in sets]
    assert np.allclose(m.raw(4, doc, term), want)


def test_words_of_a_batch_match_plain_splitting():
    rng = random.Random(7)
    texts = ["", None, " a ", "A b\tÀÉ c", "x" * 5000, *(words(rng, rng.randrange(200)) for _ in range(50))]
    column = pa.array(texts).slice(1)
    got = {}
    for w in split_words(column):
        for d, a, b in zip(w.doc, w.start, w.stop):
            got.setdefault(w.first + int(d), []).append(bytes(w.data[w.origin[d] + a : w.origin[d] + b]))
    for i, t in enumerate(texts[1:]):
        assert got.get(i, []) == [x.encode() for x in (t or "").replace("A", "a").split()]
    first = next(split_words(pa.array(["Été DÉJÀ a-b", "été déjà A_B"]), PUNCTUATED, True))
    assert first.key[first.doc == 0].tolist() == first.key[first.doc == 1].tolist()


def test_no_labels_nulls_and_no_rows(spark, documents):
    df = documents([(1, None, "en", "s"), (2, "", "en", "s"), (None, "clod northers", "en", "s"), (2, "", "en", "s")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    machine = train(df, none)
    assert [r.score for r in score(df, machine).collect()] == [0.5] * 4
    one_class = spark.createDataFrame([(1, 1, None), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert reject_toxic(df, one_class).count() == 4 and reject_toxic(df, one_class).columns == df.columns
    assert score(df.filter("false"), machine).count() == 0 and reject_toxic(df.filter("false"), none).count() == 0
    assert list(_known(pa.array(["a"]), np.zeros(0, np.int64)))[0][1] == 1
