import datetime as dt

import pytest
from pyspark.sql import functions as F

from zonewise.operators import checks, clean, joins, rollup

SCHEMA = ", ".join(f"{c} string" for c in clean.RAW_COLUMNS)


def raw(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(date="20210101", zone="S02000001", count="10", flag="", pop="5000", ca="S12X", name="X", rate="200 to 399"):
    return (date, zone, "Zone", ca, name, count, flag, pop, rate, "")


def scenarios(spark, rows):
    typed, _ = clean.parse_report_dates(raw(spark, rows))
    return clean.suppression_scenarios(clean.validate_population(clean.classify_response(typed)))


def test_states_and_fills(spark):
    rows = [row(), row("2021-01-02", count="", flag="c"), row("20210103.0", count="12"), row("20210104", count=""), row("20210105", count="abc"), row("20210106", count="inf")]
    out = {(r["suppression_fill"], r["Date"].day): r for r in scenarios(spark, rows).collect()}
    assert [out[(f, 2)]["case_count_used"] for f in (0, 1, 2)] == [0, 1, 2]
    assert out[(1, 1)]["infection_rate"] == 200.0
    assert [out[(2, d)]["case_count_used"] for d in (4, 5, 6)] == [None, None, None]
    assert [out[(0, d)]["response_status"] for d in (1, 2, 4, 5, 6)] == [
        clean.OBSERVED, clean.SUPPRESSED, clean.TRUE_MISSING, clean.INVALID, clean.INVALID,
    ]
    assert clean.scenario_consistency(scenarios(spark, rows), ["Date", "IntZone"]).count() == 0


def test_unknown_dates_are_reported_and_blank_keys_dropped(spark):
    good, bad = clean.parse_report_dates(raw(spark, [row("01/02/2021"), row(""), row("20210230"), row("20210228")]))
    assert good.count() == 1
    assert sorted(r["Date_original"] for r in bad.collect()) == ["01/02/2021", "20210230"]


@pytest.mark.parametrize("pop", ["", "0", "-10", "x"])
def test_population_must_be_positive(spark, pop):
    typed, _ = clean.parse_report_dates(raw(spark, [row(pop=pop)]))
    rep = clean.population_report(clean.validate_population(clean.classify_response(typed))).first()
    assert rep["n_invalid_population"] == rep["n_used_invalid"] == 1


def test_duplicates_collapse_or_conflict(spark):
    rows = raw(spark, [row(), row(), row("20210102"), row("20210102", count="11")]).withColumns({"source_index": F.lit(0), "row_id": F.monotonically_increasing_id()})
    got = {r["Date"]: (r["n_rows"], r["n_signatures"]) for r in clean.resolve_duplicates(rows).collect()}
    assert got == {"20210101": (2, 1), "20210102": (2, 2)}


def test_area_filter_uses_code_and_flags_names(spark):
    rows, odd = clean.filter_area(raw(spark, [row(), row(name="Y"), row(ca="S12Y")]), "S12X", "X")
    assert rows.count() == 2 and odd.count() == 1


def test_calendar_gaps_and_missing_cells(spark):
    d = lambda n: dt.date(2021, 1, n)
    panel = spark.createDataFrame([(d(1), "a"), (d(1), "b"), (d(2), "a"), (d(4), "a"), (d(4), "b")], "date date, zone string")
    zones = spark.createDataFrame([("a",), ("b",), ("c",)], "zone string")
    g = clean.calendar_gaps(panel, zones).first()
    assert (g["n_expected_cells"], g["n_missing_cells"], g["n_fully_missing_dates"], g["n_zones_with_gaps"]) == (12, 7, 1, 3)
    cells = {(r["zone"], r["date"].day) for r in clean.missing_cells(panel, zones).collect()}
    assert cells == {("a", 3), ("b", 2), ("b", 3), ("c", 1), ("c", 2), ("c", 3), ("c", 4)}


def test_lookup_must_be_unique_and_master_must_match(spark):
    left = spark.createDataFrame([("a", 1)], "zone string, v int")
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "zone string, w int")
    with pytest.raises(checks.ContractError):
        joins.lookup_join(left, twice, ["zone"])
    with pytest.raises(checks.ContractError):
        joins.align_to_master(left, spark.createDataFrame([("b", 1)], "zone string, w int"), "zone")


def test_rollup_is_null_poisoning(spark):
    cols = "zone string, Total_population double, Working_age_population double, Income_count double, Employment_count double, overcrowded_count double, crime_count double, crime_suppressed boolean, University double, PT_GP double"
    areas = spark.createDataFrame(
        [("a", 100.0, 50.0, 10.0, 5.0, 1.0, None, True, 20.0, 4.0), ("a", 300.0, 150.0, 30.0, None, 3.0, 7.0, False, 40.0, 8.0), ("a", 0.0, 9.0, 9.0, 9.0, 9.0, 9.0, False, 9.0, 9.0)], cols
    )
    r = rollup.zone_rollup(areas).first()
    assert (r["n_areas"], r["income_rate"], r["employment_rate"], r["pt_gp_min"]) == (2, 0.1, None, 7.0)
    assert [r[f"crime_rate_fill{f}"] for f in (0, 1, 2)] == [7 / 400, 8 / 400, 9 / 400] and r["crime_rate"] == 8 / 400


def test_checks(spark):
    nodes = spark.createDataFrame([("b", 0), ("a", 1)], "zone string, node_index int")
    assert checks.contiguous_index(nodes, "node_index").first()["n_bad"] == 0
    assert checks.contiguous_index(nodes.withColumn("node_index", F.col("node_index") * 2), "node_index").first()["n_bad"] == 1
    bad = checks.unknown_flags(spark.createDataFrame([("c",), ("z",)], "q string"), "q", ["", "c"])
    assert bad.first()["sample"] == "z" and checks.worst_status(bad).first()["status"] == "error"
    with pytest.raises(checks.ContractError):
        checks.require_columns(nodes, ["nope"])


def test_softplus_neither_overflows_nor_vanishes(spark):
    import math

    from zonewise.functions.scalars import softplus

    df = spark.createDataFrame([(x,) for x in (-800.0, -1.0, 0.0, 2.0, 800.0)], "x double").union(spark.sql("select cast(null as double)"))
    got = [r[0] for r in df.select(softplus(F.col("x"))).collect()]
    assert got[0] == 0.0 and got[1:4] == pytest.approx([math.log1p(math.exp(x)) for x in (-1, 0, 2)]) and got[4] == 800.0 and got[5] is None


def test_a_filter_on_report_dates_computes_their_text_once(spark):
    day = F.date_format(F.expr("date_add(date'2020-01-01', int(id))"), "yyyyMMdd")
    raw = spark.range(3).select(day.alias("Date"), F.lit("S0200001").alias("IntZone"))
    plan = clean.parse_report_dates(raw)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("date_format") <= 2  # one in the filter, one in the column
