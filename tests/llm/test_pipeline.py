import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from conftest_llm import words
from test_decontaminate import distance
from test_jaccard import brute, family
from zonewise.session import pin


def test_stages_against_brute_force(spark, documents, tmp_path):
    rng = random.Random(12)
    items = [words(rng, 30, 10**6) for _ in range(10)]
    texts, toxic = [], set()
    for i in range(900):
        t = words(rng, rng.randrange(20, 90), 10**5)
        if i % 6 == 0:
            t, toxic = t + " clod " + words(rng, 4), toxic | {i}
        texts.append(t)
    planted = family(rng, 12, 80, 1) + [texts[1], texts[1], texts[2] + " end"]
    leaky = [words(rng, 30) + " " + items[k] + ". " + words(rng, 12) for k in range(5)]
    texts += planted + leaky + ["", None]
    rows = [(i, t, rng.choice(["en", "fr"]), rng.choice(["hot"] * 4 + ["a", "b", None])) for i, t in enumerate(texts)]
    documents(rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = pin(stage(spark, docs, str(tmp_path)))
        after[name] = docs
        if name != "sharding":
            assert docs.columns == columns
    ids = {name: Counter(r.doc_id for r in df.select("doc_id").collect()) for name, df in after.items()}
    assert set(ids["toxicity"]) == set(range(len(texts))) - toxic
    left = [(i, t) for i, t, _, _ in rows if i in ids["toxicity"]]
    assert set(ids["jaccard_join"]) == {c for _, c in brute(left, 5, 80).values()}
    clean = {
        i for i, t, _, _ in rows
        if i in ids["jaccard_join"] and not any(distance(a.split(), (t or "").replace(".", " ").split()) <= 6 for a in items)
    }
    assert set(ids["decontamination"]) == clean and len(clean) < len(ids["jaccard_join"])
    assert max(ids["source_mix"].values()) <= 2 and set(ids["source_mix"]) <= clean
    sized = {i: len((t or "").split()) for i, t, _, _ in rows}
    total = sum(sized[i] for i in clean)
    assert abs(sum(sized[i] * n for i, n in ids["source_mix"].items()) - 1.5 * total) < 5 * 100
    assert ids["sharding"] == ids["source_mix"]
    shards = Counter(r.shard for r in after["sharding"].collect())
    assert max(shards.values()) - min(shards.values()) <= 1
    run = corpus_pipeline.run(spark, str(tmp_path))
    keep = run.columns
    assert sorted(map(str, run.collect())) == sorted(map(str, after["sharding"].select(*keep).collect()))
    assert run.filter(F.col("text").contains("clod")).count() == 0


def test_empty_table(spark, documents, tmp_path):
    documents([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
