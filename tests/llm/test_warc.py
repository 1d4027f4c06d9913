import hashlib
import random

import pytest
from pyspark.sql import functions as F, types as T

from zonewise.llm.queries import warc_revisits
from zonewise.llm.warc import parse_records, read_archive, write_archive

PAGES = "page_id long, url string, html string"


def test_records_survive_hostile_payloads(spark, tmp_path):
    rng = random.Random(6)
    hostile = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 3
    same = "é" * 60
    data = [(i, f"http://x/{i}\r\nbad", rng.choice([hostile, same, "a" * 99, "a" * 100, "", None, f"own {i} " * 30])) for i in range(200)]
    data += [(500, None, "b" * 200), (500, None, "b" * 200), (501, "u", "b" * 200), (None, "u", "c" * 200)]
    df = spark.createDataFrame(data, PAGES).withColumn("record_type", F.lit("clash")).repartition(4)
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = warc_revisits(spark, str(tmp_path)).collect()
    assert len(got) == len(data)
    first = {}
    for i, _, h in data:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    seen = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)
    want = []
    for i, _, h in data:
        raw = (h or "").encode()
        again = len(raw) >= 100 and i is not None and i > first[h]
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert seen == sorted(want, key=str)
    empty = spark.createDataFrame([], T._parse_datatype_string(PAGES))
    write_archive(empty, str(tmp_path / "none"))
    assert read_archive(spark, str(tmp_path / "none")).count() == 0


def test_broken_archive_is_refused():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in parse_records(good * 2)] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(parse_records(good[:-4] + good))
