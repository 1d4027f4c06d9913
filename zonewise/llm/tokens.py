"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from zonewise.session import pin

CHUNK = 16_384
OVERLAP = 256
SPACE = "▁"


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def _blank_opens_piece(path: str) -> bool:
    """Whether the vocabulary proves that no piece reaches over the start of a run of blanks.

    A boundary before a blank that follows another character is stable if a piece holds the blank
    mark at its front only. All context beyond it can then be left out.
    """
    model = _model(path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return not any(SPACE in p.lstrip(SPACE) for p in pieces)


def _stable(text: str, begins: np.ndarray) -> np.ndarray:
    """Of the piece starts in ``text``, those at a blank after another character."""
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inner = begins[(begins > 0) & (begins < len(chars))]
    return inner[(chars[inner] == 32) & (chars[inner - 1] != 32)]


def _starts(model, text: str) -> np.ndarray:
    return np.array([begin for begin, _ in model.encode(text, out_type="offset_mapping")["offsets"]], np.int64)


def encode_chunk(path: str, text: str, overlap: int, first: bool, last: bool) -> tuple[int, list[int], list[int], list[int], list[int]]:
    """Pieces of a chunk, and stable starts (place, number of pieces before) in its two overlaps.

    Places of the right overlap count from the start of the next chunk, so both chunks name a
    boundary alike.
    """
    model = _model(path)
    begins = _starts(model, text)
    proven = _blank_opens_piece(path)
    marks = _stable(text, begins) if proven else np.array([], np.int64)
    before = np.searchsorted(begins, marks, "left")
    left = marks <= overlap if not first else np.zeros(len(marks), bool)
    base = len(text) - overlap
    right = marks >= base if not last else np.zeros(len(marks), bool)
    return len(begins), marks[left].tolist(), before[left].tolist(), (marks[right] - base).tolist(), before[right].tolist()


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``key``, ``n_bytes`` and ``n_tokens`` of every row, as the library counts the whole text.

    Texts of up to ``chunk`` code points are encoded as they are. Longer ones become rows of
    overlapping chunks, spread over the cluster; two neighbours are spliced at the first piece start
    that both encodings share and that the vocabulary proves stable in any context. A text whose
    neighbours share none is chunked again with an overlap four times as wide, up to the whole text.

    Null text is empty and counts 0; a null or repeated key is kept, row by row; an empty table
    gives no rows; further columns are ignored.
    """
    rows = df.select(F.col(key).alias("_z_key"), F.coalesce(F.col(text), F.lit("")).alias("_z_text"))
    long_text = F.char_length("_z_text") > chunk

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            texts, counts = batch.column(1).to_pylist(), []
            for at in range(0, len(texts), 256):
                counts += [len(x) for x in model.encode(texts[at : at + 256], num_threads=1)]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["_z_key", "n_bytes", "n_tokens"]
            )

    kind = dict(df.dtypes)[key]
    done = rows.filter(~long_text).mapInArrow(short, f"_z_key {kind}, n_bytes long, n_tokens long")
    whole = pin(rows.filter(long_text).withColumn("_z_row", F.monotonically_increasing_id()))
    results = [done]
    left, wide = whole, overlap
    while left.limit(1).count():
        counted = pin(_spliced(left, path, chunk, wide))
        good = counted.filter("n_tokens is not null")
        results.append(good.join(whole, "_z_row").select("_z_key", F.octet_length("_z_text").cast("long").alias("n_bytes"), "n_tokens"))
        left = left.join(counted.filter("n_tokens is null").select("_z_row"), "_z_row", "left_semi")
        chunk, wide = max(chunk, wide * 4), wide * 4
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part)
    return out.select(F.col("_z_key").alias(key), "n_bytes", "n_tokens")


def _spliced(whole: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """``_z_row`` and ``n_tokens``, null where two neighbours share no stable boundary."""
    n = F.char_length("_z_text")
    last = F.greatest(F.lit(0), F.ceil((n - overlap) / F.lit(float(chunk))).cast("int") - 1)
    parts = whole.select("_z_row", "_z_text", F.explode(F.sequence(F.lit(0), last)).alias("_z_i"), last.alias("_z_last")).select(
        "_z_row",
        "_z_i",
        "_z_last",
        F.substring("_z_text", F.col("_z_i") * chunk + 1, F.lit(chunk + overlap)).alias("_z_part"),
    )
    schema = "_z_row long, _z_i int, _z_last int, n long, lp array<long>, lc array<long>, rp array<long>, rc array<long>"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [
                encode_chunk(path, t, overlap, i == 0, i == last)
                for t, i, last in zip(batch["_z_part"], batch["_z_i"], batch["_z_last"])
            ]
            out = batch[["_z_row", "_z_i", "_z_last"]].copy()
            for j, name in enumerate(("n", "lp", "lc", "rp", "rc")):
                out[name] = [m[j] for m in made]
            yield out

    coded = pin(parts.repartition("_z_row", "_z_i").mapInPandas(encode, schema))
    nxt = coded.select("_z_row", (F.col("_z_i") - 1).alias("_z_i"), F.col("lp").alias("np"), F.col("lc").alias("nc"))
    met = coded.join(nxt, ["_z_row", "_z_i"])
    at = F.array_min(F.array_intersect("rp", "np"))
    cuts = met.withColumn("_z_at", at).select(
        "_z_row",
        "_z_i",
        F.get(F.col("rc"), (F.array_position("rp", F.col("_z_at")) - 1).cast("int")).alias("end"),
        F.get(F.col("nc"), (F.array_position("np", F.col("_z_at")) - 1).cast("int")).alias("begin"),
    )
    # A chunk counts its pieces up to the cut with the next one, less those before the cut with the last one.
    pieces = coded.join(cuts, ["_z_row", "_z_i"], "left").select(
        "_z_row",
        F.when(F.col("_z_i") == F.col("_z_last"), F.col("n")).otherwise(F.col("end")).alias("up_to"),
        F.when(F.col("_z_i") == F.col("_z_last"), F.lit(0)).otherwise(F.col("begin")).alias("skipped"),
    )
    missing = F.count_if(F.col("up_to").isNull() | F.col("skipped").isNull())
    total = F.sum("up_to") - F.sum("skipped")
    return pieces.groupBy("_z_row").agg(F.when(missing == 0, total).cast("long").alias("n_tokens"))
