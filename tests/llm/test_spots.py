import hashlib
import random
import re

from pyspark.sql import functions as F

from conftest_llm import words
from zonewise.llm import spots
from zonewise.llm.queries import spot_signatures

COMMON = ["the", "of", "and", "der", "la"]


def brute(text):
    """Signatures as tuples, by walking the words."""
    found = re.findall(r"[^\W_]+", (text or "").lower())
    content = [(i, w) for i, w in enumerate(found) if w not in spots.ANCHORS]
    out = set()
    place = {i: k for k, (i, _) in enumerate(content)}
    for i, w in enumerate(found):
        if w in spots.ANCHORS and (i == 0 or found[i - 1] not in spots.ANCHORS):
            run = []
            while i < len(found) and found[i] in spots.ANCHORS:
                run.append(found[i])
                i += 1
            chain = [w for _, w in content[place[i] : place[i] + spots.CHAIN]] if i < len(found) else []
            out.add((tuple(run), tuple(chain)))
    return out or ({tuple(found)} if found else set())


def brute_likeness(a, b):
    a, b = brute(a), brute(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def texts():
    rng = random.Random(3)
    out = ["", None, "the", "the of", "lone", "A b. C", "!!", "Der Hund und die Katze"]
    for n in (5, 40, 300, 2000):
        out += [" ".join(rng.choice(COMMON) if rng.random() < 0.3 else f"w{rng.randrange(999)}x" for _ in range(n)) for _ in range(4)]
    return out + [out[-1], out[-2] + " tail", "é" * 31, words(rng, 50)]


def test_query_against_brute_force(spark, documents, tmp_path):
    rows = [(3 * i, t, "en", "s") for i, t in enumerate(texts())]
    documents(rows, [("spots", F.lit(1))]).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in spot_signatures(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    plain = [t or "" for _, t, _, _ in rows]
    for k, (i, _, _, _) in enumerate(rows):
        t, after = plain[k], plain[(k + 1) % len(rows)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - brute_likeness(t, edited)) < 1e-12
        assert abs(r.near_next - brute_likeness(t, after)) < 1e-12
        assert len(r.fingerprint) == 8 * len(brute(t)) and len(r.edited_fingerprint) == 8 * len(brute(edited))


def test_null_repeated_and_no_rows(spark, documents, tmp_path):
    rows = [(None, "a b", "en", "s"), (7, "the x y", "en", "s"), (7, "the x y", "en", "s")]
    documents(rows).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    got = spot_signatures(spark, str(tmp_path / "a")).collect()
    assert sorted((r.doc_id is None, r.near_next) for r in got) == [(False, 1.0), (False, 1.0), (True, 0.0)]
    documents([]).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert spot_signatures(spark, str(tmp_path / "b")).count() == 0
    documents(rows[:1]).write.parquet(str(tmp_path / "c" / "documents.parquet"))
    assert spot_signatures(spark, str(tmp_path / "c")).first().near_next == 1.0


def test_near_classes_against_all_pairs(spark, documents):
    rng, rows = random.Random(4), []
    base = [" ".join(rng.choice(COMMON) if rng.random() < 0.4 else f"w{rng.randrange(60)}x" for _ in range(60)) for _ in range(6)]
    for i in range(60):
        w = base[i % 6].split()
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(w), "en", "s"))
    member, pairs = spots.near_classes(documents(rows))
    rep = {r.doc_id: r.rep for r in member.collect()}
    got = {(r.a, r.b) for r in pairs.collect()}
    t = {i: x for i, x, _, _ in rows}
    reps = sorted(set(rep.values()))
    want = {(a, b) for a in reps for b in reps if a < b and brute_likeness(t[a], t[b]) >= 0.8}
    assert got == want and len(want) > 5
    assert all(brute(t[i]) == brute(t[r]) for i, r in rep.items())
