import random

import pytest
from pyspark.sql import functions as F

from zonewise.llm.tokens import count_tokens

public = pytest.importorskip("public_tokenizers")
PATH = str(public.path("piece_bpe_32k.model"))


def direct(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return [len(model.encode(t or "")) for t in texts]


def hard_texts():
    rng = random.Random(5)
    alphabet = list("abcdefghij  \n\t  éñ漢字😀<s></s>▁.,'") + ["the ", "  ", "ing "]
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (0, 1, 63, 64, 65, 200, 400, 999, 3000)]
    return texts + ["x" * 900, " " * 900, "ab" * 700, "漢" * 500, None, "a </s> b <unk>", "word " * 500, "w" * 300 + " tail"]


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (100, 16), (50, 50)])
def test_spliced_counts_equal_the_library(spark, documents, chunk, overlap):
    texts = hard_texts()
    df = documents([(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(df, PATH, chunk=chunk, overlap=overlap).collect()}
    assert got == {i: (len((t or "").encode()), n) for i, (t, n) in enumerate(zip(texts, direct(texts)))}


def test_repeated_null_keys_extra_columns_and_empty_table(spark, documents):
    df = documents([(1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, "w " * 100, "en", "s")], [("n_tokens", F.lit("x"))])
    got = sorted((r.doc_id is None, r.n_tokens) for r in count_tokens(df, PATH, chunk=64, overlap=8).collect())
    assert got == [(False, 2), (False, 2), (True, direct(["w " * 100])[0])]
    assert count_tokens(df.filter("false"), PATH).count() == 0
