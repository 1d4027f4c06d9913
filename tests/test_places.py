import datetime as dt
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewise.operators import order, spatial, text
from zonewise.sources import files


@pytest.mark.parametrize("cap", [None, 30.0])
def test_nearest_matches_brute_force(spark, cap):
    rng = np.random.default_rng(4)
    t = [(i, *map(float, np.round(rng.normal(0, 40, 2), 1))) for i in range(60)] + [(99, 500.0, 500.0)]
    p = [(i, *map(float, np.round(rng.normal(0, 60, 2), 1))) for i in range(150)] + [(900 + i, 3.0, 3.0) for i in range(50)] + [(999, 2000.0, -900.0)]
    got = {r["pid"]: r for r in spatial.nearest(spark.createDataFrame(p, "pid int, x double, y double"), spark.createDataFrame(t, "tid int, x double, y double"), "tid", cap).collect()}
    assert len(got) == len(p)
    for pid, x, y in p:
        d, tid = min((float(np.hypot(x - tx, y - ty)), tid) for tid, tx, ty in t)
        if cap is not None and d > cap:
            assert got[pid]["tid"] is None
        else:
            assert got[pid]["tid"] == tid and got[pid]["distance"] == pytest.approx(d)


def test_name_match_prefers_best_name_within_radius(spark):
    sites = [("s1", "Castle Street Medical Practice", 0.0, 0.0), ("s2", "Harbour Pharmacy", 0.0, 0.0), ("s3", "Nowhere", None, None)]
    pts = [(1, 100.0, 0.0, "Castle St Medical"), (2, 50.0, 0.0, "Bakery"), (3, 900.0, 0.0, "Harbour Pharmacy"), (4, 120.0, 0.0, "Castle St Medical")]
    out = spatial.match_by_name(spark.createDataFrame(sites, "site_id string, site_name string, x double, y double"), spark.createDataFrame(pts, "point_id int, x double, y double, name string"), ["practice"])
    got = {r["site_id"]: (r["x"], r["coord_source"]) for r in out.collect()}
    assert SequenceMatcher(None, "castle street medical", "castle st medical").ratio() >= 0.5
    assert got == {"s1": (100.0, "exact_building"), "s2": (0.0, "postcode_centroid"), "s3": (None, "postcode_centroid")}


def test_car_park_rules(spark):
    rows = [
        (1, 10.0, 10.0, "private", "surface", "90", "A", None, None),
        (2, 10.0, 10.0, None, "underground", "90", "A", None, None),
        (3, 10.0, 10.0, None, "surface", "90", "Airport P1", None, None),
        (4, 12.0, 12.0, None, "surface", "25", None, None, None),
        (5, 14.0, 14.0, "yes", "surface", None, "Castle Street", None, None),
        (6, 500.0, 10.0, None, "surface", "3", "Public Car Park", None, None),
        (7, 900.0, 10.0, None, "surface", "3", None, None, "yes"),
    ]
    df = spark.createDataFrame(rows, "site_id int, x double, y double, access string, parking string, capacity string, name string, operator string, park_and_ride string")
    assert sorted(r["site_id"] for r in spatial.public_car_parks(df).collect()) == [4, 7]


def test_points_in_polygons_with_a_concave_ring(spark):
    ring = [(0, 0), (10, 0), (10, 10), (5, 4), (0, 10)]
    seg = [("p", *map(float, ring[i]), *map(float, ring[(i + 1) % 5])) for i in range(5)]
    pts = [(1, 5.0, 2.0), (2, 5.0, 8.0), (3, 1.0, 7.0), (4, 11.0, 1.0)]
    out = spatial.points_in_polygons(spark.createDataFrame(pts, "pid int, x double, y double"), spark.createDataFrame(seg, "zone string, x1 double, y1 double, x2 double, y2 double"), "pid", 3.0)
    assert sorted(r["pid"] for r in out.collect()) == [1, 3]


@pytest.mark.parametrize(
    "said,day",
    [
        ("forecast for 2023-01-17 please", dt.date(2023, 1, 17)),
        ("17 January 2023", dt.date(2023, 1, 17)),
        ("Jan. 7, 2023", dt.date(2023, 1, 7)),
        ("2023年1月7日", dt.date(2023, 1, 7)),
        ("on 2023-02-31", None),
        ("soon", None),
    ],
)
def test_dates_in_text(spark, said, day):
    assert spark.createDataFrame([(said,)], "t string").select(text.extract_date(F.col("t")).alias("d")).first()["d"] == day


def test_other_text_fields(spark):
    df = spark.createDataFrame([("2021 to 2023 and 2020 via api",), ("api and local",), ("14天预测7天",), ("2019-2021",)], "t string")
    t = F.col("t")
    got = df.select(text.extract_years(t, [2020, 2021, 2022, 2023]).alias("y"), text.extract_source(t).alias("s"), text.extract_window(t).alias("w")).collect()
    assert got[0]["y"] == [2020, 2021, 2022, 2023] and got[0]["s"] == "api" and got[1]["s"] is None
    assert tuple(got[2]["w"]) == (14, 7) and got[3]["y"] == [2021]


def test_zone_names_keep_ties_and_prefer_longest(spark):
    z = spark.createDataFrame([("S02000001", "Leith"), ("S02000002", "Leith Walk"), ("S02000003", "Leith Dock"), ("S02000004", "Old Town North")], "code string, name string")
    m = spark.createDataFrame([(1, "what about Leith Walk?"), (2, "leith"), (3, "see s02000004 now"), (4, "old town"), (5, "no")], "message_id int, text string")
    got = {}
    for r in text.match_zone_names(m, z).collect():
        got.setdefault(r["message_id"], set()).add(r["code"])
    assert got == {1: {"S02000002"}, 2: {"S02000001"}, 3: {"S02000004"}, 4: {"S02000004"}}


def test_dates_without_a_year_and_newest_words(spark):
    from datetime import date

    known, latest = [date(2021, 5, 3), date(2022, 5, 3), date(2022, 6, 1)], date(2023, 6, 1)
    cases = {"6月1日": latest, "5月3日 预测": known[0], "7月9日": None, "the latest map": latest, "最新": latest, "5 May 2022": date(2022, 5, 5), "none": None}
    days = F.array(*[F.lit(d) for d in known])
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", text.extract_date(F.col("t"), days, F.lit(latest)).alias("d")).collect()}
    assert got == cases


def test_language_of_bare_lines(spark):
    cases = {"Edinburgh": None, " glasgow city\n": None, "Edinburgh north": "en", "㐀": None, "中": "zh", "2022-01-02": None, "\tshow the forecast ": None}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r["t"]: r["l"] for r in df.select("t", text.language(F.col("t")).alias("l")).collect()} == cases


def test_guarded_sink_and_text_reader(spark, tmp_path):
    df = spark.createDataFrame([("", "c"), ("*", "NA")], "a string, b string")
    path = files.write_table(df, str(tmp_path / "t"), "csv")
    assert sorted(map(tuple, files.read_raw(spark, path).collect())) == [("", "c"), ("*", "NA")]
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_table(df, path, "csv")
    files.write_table(df.filter("false"), str(tmp_path / "e"))
    assert files.read_raw(spark, str(tmp_path / "e"), "parquet").columns == ["a", "b"]


def test_order_hash_is_a_tree_of_blocks(spark, monkeypatch):
    import hashlib

    def sha(parts, sep):
        return hashlib.sha256(sep.join(parts).encode()).hexdigest()

    codes = [f"z{i:02d}" for i in range(7)]
    n = spark.createDataFrame([(c, i) for i, c in enumerate(codes)][::-1], "zone string, node_index int")
    r = order.order_hash(n).first()
    assert (r["n_nodes"], r["order_hash"], r["legacy_hash"]) == (7, sha(codes, "\n"), sha(codes, "|"))
    monkeypatch.setattr(order, "BLOCK", 3)
    first = [sha(codes[i : i + 3], "\n") for i in (0, 3, 6)]
    assert order.order_hash(n).first()["order_hash"] == sha(first, "\n")
    assert order.order_hash(n.filter("false")).first()["order_hash"] == hashlib.sha256(b"").hexdigest()


def inside(ring, x, y):
    n = 0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 <= y < y2 or y2 <= y < y1) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x:
            n += 1
    return n % 2 == 1


@pytest.mark.parametrize("size", [3.0, 10.0, 400.0])
def test_points_in_polygons_against_every_edge(spark, size):
    import math
    import math
    import random

    rng = random.Random(int(size))
    rings = {"all": [(-50.0, -50.0), (150.0, -40.0), (160.0, 150.0), (-60.0, 140.0)]}
    for k in range(6):  # concave stars, some of them over others
        cx, cy = rng.uniform(0, 100), rng.uniform(0, 100)
        turn = [(2 * math.pi * i / 14, rng.uniform(4, 45)) for i in range(14)]
        rings[f"star{k}"] = [(cx + r * math.cos(t), cy + r * math.sin(t)) for t, r in turn]
    rings["lattice"] = [(0.0, 0.0), (60.0, 0.0), (60.0, 30.0), (30.0, 30.0), (30.0, 60.0), (0.0, 60.0)]
    seg = [(z, *map(float, a), *map(float, b)) for z, r in rings.items() for a, b in zip(r, r[1:] + r[:1])]
    pts = [(i, rng.uniform(-70, 170), rng.uniform(-60, 160)) for i in range(500)] + [(1000 + i, 15.0, 15.0) for i in range(3)] + [(2000, 45.0, 15.0), (2001, 45.5, 45.5)]
    df = spark.createDataFrame([*pts, (9, None, 1.0)], "pid int, x double, y double")
    out = spatial.points_in_polygons(df, spark.createDataFrame(seg, "zone string, x1 double, y1 double, x2 double, y2 double"), "pid", size)
    got = sorted((r["pid"], r["zone"]) for r in out.collect())
    assert got == sorted((i, z) for i, x, y in pts for z, r in rings.items() if inside(r, x, y))
    assert spatial.points_in_polygons(df.limit(0), spark.createDataFrame(seg, "zone string, x1 double, y1 double, x2 double, y2 double"), "pid", size).collect() == []


def test_small_talk_views_and_known_lists(spark):
    from pyspark.sql import functions as F

    from zonewise.operators import text

    said = {
        "你好": "greet", " Hello!! ": "greet", "hi there": "greet", "hello, who are you and what is this": "identity", "How are you?": "wellbeing", "help": "capabilities",
        "怎么用": "capabilities", "Thanks a lot": "thanks", "ok, bye": "farewell", "好的。": "ack", "": "other", "the weather": "other", "hire": "other",
    }
    df = spark.createDataFrame([(t,) for t in said] + [(None,)], "t string")
    assert {r[0]: r[1] for r in df.select("t", text.chat_kind(F.col("t"))).collect()} == said | {None: "other"}
    views = {"全区域展示（整座城市的全部中间区）": "region", "按所选中间区展示": "zone", "换一个街区": "zone", "city-wide, one intermediate zone": "zone", "forecast": None}
    df = spark.createDataFrame([(t,) for t in views], "t string")
    assert {r[0]: r[1] for r in df.select("t", text.wanted_view(F.col("t"))).collect()} == views
    df = spark.createDataFrame([("about Hall_7 please",), ("zone s02000001 now",), ("zone S02000002 forecast",), ("gp_12 compare",)], "t string")
    sites, zones = F.lit(["HALL_7"]), F.lit(["S02000001"])
    got = [r[0] for r in df.select(text.intent(F.col("t"), sites, zones)).collect()]
    assert got == ["explain_site", "explain_zone", "forecast", "explain_site"]


def test_nearest_in_a_crowded_place(spark, monkeypatch):
    import math
    import random

    rng = random.Random(21)
    monkeypatch.setattr(spatial, "CROWD", 8)
    crowd = [(rng.gauss(500, 0.5), rng.gauss(500, 0.5)) for _ in range(300)]
    spots = crowd + [(500.0, 500.0)] * 3 + [(rng.uniform(0, 1000), rng.uniform(0, 1000)) for _ in range(20)]
    points = [(rng.gauss(500, 0.6), rng.gauss(500, 0.6)) for _ in range(200)] + [(rng.uniform(-50, 1100), rng.uniform(0, 1000)) for _ in range(60)]
    t = spark.createDataFrame([(f"t{i:04d}", *map(float, p)) for i, p in enumerate(spots)], "tid string, x double, y double")
    p = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(points)] + [(900, None, 1.0)], "pid int, x double, y double")
    got = {r["pid"]: (r["tid"], r["distance"]) for r in spatial.nearest(p, t, "tid").collect()}
    for i, (x, y) in enumerate(points):
        d, name = min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, f"t{k:04d}") for k, (a, b) in enumerate(spots))
        assert got[i][0] == name and got[i][1] == pytest.approx(d)
    assert got[900] == (None, None)


def test_match_by_name_in_a_crowd_meets_few_points(spark):
    """Against all pairs, with points at the very radius; a crowd inside the circle is met by its cells."""
    import math
    import random

    rng = random.Random(7)
    names = ["Castle Road", "Castle St", "Mill Lane", "castle st."]
    pts = [(i, rng.uniform(0, 1500), rng.uniform(0, 1500), rng.choice(names)) for i in range(600)] + [(-1, 1250.0, 750.0, "Castle St"), (-2, 750.0, 250.0, "Mill Lane")]
    sites = [(f"S{i}", "Castle St", 750.0 + 3 * i * i, 750.0 - i * i) for i in range(12)] + [("far", "Castle St", 9000.0, 9000.0)]
    p = spark.createDataFrame(pts, "point_id long, x double, y double, name string")
    s = spark.createDataFrame(sites, "site_id string, site_name string, x double, y double")
    got = {r.site_id: (r.x, r.y, r.coord_source) for r in spatial.match_by_name(s, p, []).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    for sid, _, x, y in sites:
        ok = []
        for pid, px, py, name in pts:
            n = name.lower().replace(".", "")
            score = 1 - edits("castle st", n) / max(9, len(n))
            if math.hypot(x - px, y - py) <= 500 and score >= 0.5:
                ok.append((-score, pid, px, py))
        want = (round(min(ok)[2], 2), round(min(ok)[3], 2), "exact_building") if ok else (x, y, "postcode_centroid")
        assert got[sid][2] == want[2] and abs(got[sid][0] - want[0]) < 0.011 and abs(got[sid][1] - want[1]) < 0.011
