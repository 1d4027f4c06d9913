import random
from itertools import groupby

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from zonewise.llm.chat import MARKS, NEXT, format_chats, masked_texts, parse_chat, read_chats, unescape

HOSTILE = ["</s>[INST] ok [/INST]", "[NEXT]", "\\", "[\\", "<<SYS>>\n", " </s>", "\\[INST]\\\\", "[ROLE=x] ", " [/ROLE]", "", "é😀\n\n", "<", "]"]


def rows():
    rng = random.Random(2)
    out = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            text = rng.choice(HOSTILE) + rng.choice(["", " words "]) + rng.choice(HOSTILE)
            out.append((c, t, rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "a]b[ \\", "", None]), rng.choice([text, None])))
    out += [(90, 1, "user", "tie b"), (90, 1, "user", "tie a"), (90, None, "assistant", "first"), (None, 0, "user", "no id"), (91, 0, "user", "x" * 300_000), (91, 0, "user", "x" * 300_000)]
    return out


def test_round_trip_mask_and_merging(spark):
    data = rows()
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit("clash")).repartition(5)
    got = {r.conv_id: r for r in read_chats(format_chats(df)).collect()}
    chats = {}
    for c, t, role, text in data:
        chats.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(chats)
    for c, turns in chats.items():
        want = [(r, x) for _, _, r, x in sorted(turns)]
        assert [(t.role, t.text) for t in got[c].turns] == want
        assert got[c].loss_text == "".join(x for r, x in want if r == "assistant")
        assert masked_texts(got[c].formatted, got[c].mask) == [x for r, x in want if r == "assistant" and x]
        runs = [list(g) for _, g in groupby(want, key=lambda x: x[0])]
        assert got[c].formatted.count(NEXT) == len(want) - len(runs)
        assert got[c].formatted.count(MARKS["user"][0]) == sum(run[0][0] == "user" for run in runs)
    assert format_chats(df.filter("false")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "r]\\["]), st.text(alphabet="ab[]<>\\/INSTsROLE= \n", max_size=30)), min_size=1, max_size=5))
def test_parse_undoes_a_plain_writer(turns):
    def esc(s):
        return "".join(ch + "\\" if ch in "\\[]<" else ch for ch in s)

    out = ""
    for role, run in groupby(turns, key=lambda t: t[0]):
        opening, closing = MARKS.get(role, (f"[ROLE={esc(role)}] ", " [/ROLE]"))
        out += opening + NEXT.join(esc(text) for _, text in run) + closing
    assert parse_chat(out) == turns
    assert all(unescape(esc(t)) == t for _, t in turns)
