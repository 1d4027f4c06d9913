import random

import numpy as np
from pyspark.sql import functions as F

from conftest_llm import words
from zonewise.llm.decontaminate import Items, best_stretch, decontaminated, leaks, repetitions_for


def edited(rng, text, k):
    w = text.split()
    for _ in range(k):
        at = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[at] = f"z{rng.randrange(10**6)}"
        elif kind == 1 and len(w) > 1:
            del w[at]
        else:
            w.insert(at, f"y{rng.randrange(10**6)}")
    return " ".join(w)


def distance(a, b):
    """Edits between a and the nearest stretch of b, word by word."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_best_stretch_against_plain_table():
    rng = random.Random(1)
    for _ in range(200):
        a = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 9))], np.uint64)
        b = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 15))], np.uint64)
        edits, first, last = best_stretch(a, b)
        assert edits == distance(list(a), list(b))
        part = list(b[first:last])
        row = list(range(len(part) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(part, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        assert row[-1] == edits


def test_leaks_and_recall_against_brute_force(spark, documents):
    rng = random.Random(2)
    items = [words(rng, rng.choice([8, 15, 30, 40, 60]), 10**6) for _ in range(40)]
    rows, planted = [], {}
    for i in range(300):
        text = words(rng, rng.randrange(0, 200), 10**6)
        if i % 3 == 0:
            j = rng.randrange(40)
            n = len(items[j].split())
            k = rng.choice([0, 0, n // 10, n // 5, n // 2])
            text = text + "\n" + edited(rng, items[j].capitalize(), k) + ". " + words(rng, 20, 10**6)
            planted[i] = k <= n // 5
        rows.append((i, text, "en", "s"))
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (None, items[0], "en", "s"), (902, items[1] + " " + items[2], "en", "s")]
    bench = spark.createDataFrame([(j, t) for j, t in enumerate(items)] + [(77, None), (78, ""), (79, "w1x w2x")], "item_id long, text string")
    docs = documents(rows, [("item_id", F.lit("clash"))])
    got = {(r.doc_id, r.item_id): r for r in leaks(docs, bench).collect()}
    want = {}
    for i, t, _, _ in rows:
        for j, item in enumerate(items):
            a, b = item.lower().split(), (t or "").lower().replace(".", " ").split()
            if set(a) & set(b) and (d := distance(a, b)) <= len(a) // 5:
                want[i, j] = d
    assert set(got) <= set(want)
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    assert all(got[k].edits == want[k] for k in got)
    exact = {k for k, d in want.items() if d == 0}
    assert exact <= set(got) and {(None, 0), (902, 1), (902, 2)} <= set(got)
    r = got[902, 2]
    assert rows[-1][1].encode()[r.first_byte : r.end_byte].decode() == items[2]
    kept = decontaminated(docs, bench)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.select("doc_id").collect()]
    assert set(left) == {i for i, *_ in rows} - {i for i, _ in got} and len(left) == len(set(left))
    assert leaks(docs.filter("false"), bench).count() == 0 and leaks(docs, bench.filter("false")).count() == 0


def test_long_items_that_walks_miss_are_found():
    import pyarrow as pa

    assert repetitions_for(1500, 80, 0.95) == 0
    rng = random.Random(4)
    items = [words(rng, 1500, 10**6) for _ in range(3)]
    texts = [words(rng, 30) + " " + edited(rng, items[i % 3], 300) + " " + words(rng, 30) for i in range(24)] + [words(rng, 2000)]
    got = {(row, i): e for row, i, e, *_ in Items([1, 2, 3], items).search(pa.array(texts))}
    assert set(got) == {(i, i % 3) for i in range(24)} and all(200 < e <= 300 for e in got.values())


def test_repetitions_reach_the_recall():
    assert all(1 <= repetitions_for(n, 80, 0.95) <= 96 for n in (5, 12, 40, 80))
    rng = random.Random(9)
    item = words(rng, 50, 10**6)
    block = Items([1], [item])
    import pyarrow as pa

    texts = pa.array([words(rng, 9) + " " + edited(rng, item, 10) + " " + words(rng, 9) for _ in range(200)])
    assert len({row for row, *_ in block.search(texts)}) >= 180


def test_short_items_and_scripts_without_blanks(spark, documents):
    chinese, thai = "床前明月光疑是地上霜举头望明月低头思故乡", "สวัสดีชาวโลกทั้งหลาย"
    items = ["Paris", "lone wolf runs far", chinese, thai, "ab cd", "明月", "日本𠮷野"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [
        "We saw (paris)! And Paris again.",
        "A lone wolf, runs far.",
        "前言。" + chinese.replace("地", "天").replace("望", "看") + "，后记",
        "คำ" + thai + "x",
        "abcd ab",
        "cd",
        "在日本𠮷野町",
        "Parisian",
    ]
    got = {(r.doc_id, r.item_id): r for r in leaks(documents([(i, t, "en", "s") for i, t in enumerate(texts)]), bench).collect()}
    assert {k: r.edits for k, r in got.items()} == {(0, 0): 0, (1, 1): 0, (2, 2): 2, (2, 5): 0, (3, 3): 0, (6, 6): 0}
    cut = {k: texts[k[0]].encode()[r.first_byte : r.end_byte].decode() for k, r in got.items()}
    assert (cut[0, 0], cut[1, 1], cut[2, 5], cut[3, 3], cut[6, 6]) == ("paris", "lone wolf, runs far", "明月", thai, "日本𠮷野")
    assert got[2, 2].item_words == len(chinese)
