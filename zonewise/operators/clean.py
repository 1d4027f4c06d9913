"""Panel cleaning: dates, areas, response states, populations, fill scenarios and their diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from zonewise.functions.ranking import Rank, dense_position, order_statistics, weighted_order_statistics
from zonewise.functions.scalars import INDICATOR_NULLS, RATE_NULLS, finite_or_null, one_row, report_date, token
from zonewise.session import pin

# Fixed values of the raw panel contract.
RAW_COLUMNS = (
    "Date",
    "IntZone",
    "IntZoneName",
    "CA",
    "CAName",
    "Positive7Day",
    "Positive7DayQF",
    "Population",
    "CrudeRate7DayPositive",
    "CrudeRate7DayPositiveQF",
)
SIGNATURE = (
    "IntZoneName",
    "CA",
    "CAName",
    "Positive7Day",
    "Positive7DayQF",
    "Population",
    "CrudeRate7DayPositive",
    "CrudeRate7DayPositiveQF",
)
SUPPRESSED, TRUE_MISSING, INVALID, OBSERVED = (
    "disclosure_controlled_0_2",
    "true_missing_not_suppressed",
    "invalid_non_numeric_value",
    "observed",
)
STAT_QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
RATE_TOLERANCE = 0.5
PER = 100_000


def harmonise_schema(df: DataFrame, area: str | None = None, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Add absent columns as ``''``, keep parseable dates, area and zone keys of the right kind, add ``year``."""
    full = df.select(*[(F.col(c) if c in df.columns else F.lit("").alias(c)) for c in columns])
    keep = report_date(F.col("Date")).isNotNull() & F.startswith(F.trim("IntZone"), F.lit("S020"))
    if area is not None:
        keep = keep & (F.trim("CA") == area)
    return full.filter(keep).withColumn("year", F.year(report_date(F.col("Date"))))


def load_year_extract(df: DataFrame, years: Sequence[int], area: str | None = None) -> DataFrame:
    return harmonise_schema(df, area).filter(F.col("year").isin(*[int(y) for y in years]))


def tag_source(df: DataFrame, index: int, requested_year: int, source: str | None = None) -> DataFrame:
    name = F.lit(source) if source is not None else F.input_file_name()
    return df.withColumns(
        {"source_index": F.lit(index), "requested_year": F.lit(requested_year), "source_file": name}
    )


def source_summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    day = report_date(F.col("Date"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("IntZone").alias("n_zones"),
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
    )


def zone_master(lookup: DataFrame, code: str = "IntZone") -> DataFrame:
    """Distinct non-empty codes in sorted order with a dense 0-based index."""
    codes = lookup.select(F.trim(code).alias("zone")).filter("zone <> ''").distinct()
    return dense_position(codes, [F.col("zone")], "node_index")


def parse_report_dates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed panel rows, and the rows whose non-empty date has an unknown layout."""
    typed = df.withColumn("Date_original", F.col("Date")).withColumn("Date", report_date(F.col("Date")))
    bad = typed.filter(F.col("Date").isNull() & (token(F.col("Date_original")) != ""))
    return typed.filter(F.col("Date").isNotNull() & (token(F.col("IntZone")) != "")), bad


def filter_area(df: DataFrame, code: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the area by code, and rows of that code under an unexpected name."""
    rows = df.withColumns({"CA": F.trim("CA"), "CAName": F.trim("CAName")}).filter(F.col("CA") == code)
    return rows, rows.filter(~F.col("CAName").isin("", name))


def classify_response(df: DataFrame) -> DataFrame:
    """Observed, disclosure-controlled, truly missing and invalid counts are four disjoint states."""
    text = token(F.col("Positive7Day"))
    hidden = (F.lower(token(F.col("Positive7DayQF"))) == "c") | (F.lower(text) == "c")
    blank = text == ""
    number = finite_or_null(text)
    status = (
        F.when(hidden, SUPPRESSED).when(blank, TRUE_MISSING).when(number.isNull(), INVALID).otherwise(OBSERVED)
    )
    marked = df.withColumn("response_status", status)
    state = F.col("response_status")
    return marked.withColumns(
        {
            "suppression_flag": (state == SUPPRESSED).cast("int"),
            "missing_flag": (state == TRUE_MISSING).cast("int"),
            "invalid_value_flag": (state == INVALID).cast("int"),
            "missing_reason": F.when(state != OBSERVED, state),
            "numeric_count": F.when(state == OBSERVED, number),
        }
    )


def validate_population(df: DataFrame) -> DataFrame:
    value = finite_or_null(F.col("Population"))
    good = value > 0
    return df.withColumns(
        {
            "Population_original": F.col("Population"),
            "Population": F.when(good, value),
            "invalid_population_flag": (~F.coalesce(good, F.lit(False))).cast("int"),
        }
    )


def population_report(df: DataFrame) -> DataFrame:
    """Counts over a table from :func:`validate_population`; ``n_used_invalid`` must be zero."""
    value = finite_or_null(F.col("Population_original"))
    used = F.col("response_status").isin(OBSERVED, SUPPRESSED)
    return df.agg(
        F.count_if(token(F.col("Population_original")) == "").alias("n_missing_population"),
        F.count_if(value <= 0).alias("n_non_positive_population"),
        F.sum("invalid_population_flag").alias("n_invalid_population"),
        F.count_if(used & (F.col("invalid_population_flag") == 1)).alias("n_used_invalid"),
    )


def suppression_scenarios(df: DataFrame, fills: Sequence[int] = (0, 1, 2), primary: int = 1) -> DataFrame:
    """One copy per fill; only suppressed counts differ. The fan-out is fixed, so no join is needed."""
    out = df.withColumn("suppression_fill", F.explode(F.array(*[F.lit(int(f)) for f in fills])))
    used = F.when(F.col("suppression_flag") == 1, F.col("suppression_fill").cast("double")).otherwise(
        F.col("numeric_count")
    )
    out = out.withColumns(
        {
            "suppression_scenario": F.concat(F.lit("fill"), F.col("suppression_fill").cast("string")),
            "is_primary_scenario": F.col("suppression_fill") == primary,
            "case_count_used": F.bround(used, 0).cast("long"),
        }
    )
    return out.withColumn("infection_rate", F.col("case_count_used") / F.col("Population") * F.lit(PER))


def scenario_consistency(scenarios: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Violations across fills: a non-suppressed count that varies, or a fill that is not the scenario's."""
    base = scenarios.groupBy(*keys).agg(
        F.max("suppression_flag").alias("hidden"),
        F.count_distinct(F.coalesce(F.col("case_count_used"), F.lit(-1))).alias("n_values"),
        F.count_if((F.col("suppression_flag") == 1) & (F.col("case_count_used") != F.col("suppression_fill"))).alias(
            "n_wrong_fill"
        ),
    )
    return base.filter(((F.col("hidden") == 0) & (F.col("n_values") > 1)) | (F.col("n_wrong_fill") > 0))


def parse_indicator(col: Column) -> tuple[Column, Column]:
    """Value (null for the known missing marks) and whether the text is neither."""
    text = token(col)
    missing = text.isin(*INDICATOR_NULLS)
    value = F.when(~missing, finite_or_null(text))
    return value, ~missing & value.isNull()


def parse_rate(col: Column, allow_missing: bool = True) -> tuple[Column, Column]:
    text = token(col)
    missing = F.lower(text).isin(*RATE_NULLS)
    value = F.when(~missing, finite_or_null(text))
    bad = value.isNull() if not allow_missing else ~missing & value.isNull()
    return value, bad


def inhabited_only(df: DataFrame) -> DataFrame:
    return df.filter((F.col("Total_population") > 0) & (F.col("Working_age_population") > 0))


def resolve_duplicates(
    df: DataFrame, keys: Sequence[str] = ("Date", "IntZone"), order: Sequence[str] = ("source_index", "row_id")
) -> DataFrame:
    """One row per (key, signature) with how often it occurs and the first copy; conflicts are marked.

    Copies collapse map-side first, so a key repeated in a third of all rows costs one
    partial row per task. Filter ``n_signatures = 1`` for the clean rows, ``> 1`` for conflicts.
    """
    sig = F.concat_ws("|", *[token(F.col(c)) for c in SIGNATURE if c in df.columns])
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest]))
    copies = df.groupBy(*keys, sig.alias("signature")).agg(F.count(F.lit(1)).alias("n_copies"), first.alias("kept"))
    per_key = copies.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_signatures"), F.sum("n_copies").alias("n_rows"), F.min("kept").alias("kept")
    )
    return per_key.select(*keys, "n_signatures", "n_rows", "kept.*")


def quality_flag_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), token(F.col(c)).alias("flag")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("column_name", "flag").agg(F.count(F.lit(1)).alias("n"))


def scaffold(zones: DataFrame, start: Column, end: Column, day: str = "date") -> DataFrame:
    """Every calendar day of every zone: a generator per zone row, not a join."""
    return zones.withColumn(day, F.explode(F.sequence(start, end, F.expr("interval 1 day"))))


def missing_cells(panel: DataFrame, zones: DataFrame, day: str = "date", zone: str = "zone") -> DataFrame:
    """Absent (date, zone) cells, produced from the gaps between a zone's reports.

    Work is proportional to the panel plus the cells listed; the full calendar x zone
    product is never built.
    """
    span = panel.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    cells = panel.select(zone, day).distinct()
    w = W.partitionBy(zone).orderBy(day)
    step = F.expr("interval 1 day")
    seen = cells.withColumn("_s", one_row(span)).withColumns(
        {"_prev": F.lag(day).over(w), "_next": F.lead(day).over(w)}
    )
    before = F.when(
        F.col("_prev").isNull() & (F.col(day) > F.col("_s.lo")), F.sequence(F.col("_s.lo"), F.date_sub(day, 1), step)
    )
    upper = F.coalesce(F.date_sub("_next", 1), F.col("_s.hi"))
    after = F.when(upper > F.col(day), F.sequence(F.date_add(day, 1), upper, step))
    none = F.array().cast("array<date>")
    gaps = seen.select(
        zone, F.explode(F.concat(F.coalesce(before, none), F.coalesce(after, none))).alias(day)
    )
    silent = zones.select(zone).join(cells.select(zone).distinct(), zone, "left_anti").withColumn("_s", one_row(span))
    return gaps.unionByName(scaffold(silent, F.col("_s.lo"), F.col("_s.hi"), day).select(zone, day))


def calendar_gaps(panel: DataFrame, zones: DataFrame, day: str = "date", zone: str = "zone") -> DataFrame:
    """Expected, observed and missing cells, partial and fully missing dates, zones with gaps: one row."""
    cells = panel.select(zone, day).distinct()
    by_date = cells.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    by_zone = cells.groupBy(zone).agg(F.count(F.lit(1)).alias("n"))
    n_zones = zones.agg(F.count(F.lit(1)).alias("n_zones"))
    dates = by_date.withColumn("_z", one_row(n_zones)).agg(
        F.max("_z.n_zones").alias("n_zones"),
        (F.datediff(F.max(day), F.min(day)) + 1).cast("long").alias("n_days"),
        F.sum("n").alias("n_observed_cells"),
        F.count_if(F.col("n") < F.col("_z.n_zones")).alias("n_partial_dates"),
        F.count(F.lit(1)).alias("n_seen_dates"),
    )
    whole = by_zone.withColumn("_d", one_row(dates)).agg(F.count_if(F.col("n") == F.col("_d.n_days")).alias("n_whole"))
    return dates.withColumn("_w", one_row(whole)).select(
        (F.col("n_days") * F.col("n_zones")).alias("n_expected_cells"),
        "n_observed_cells",
        (F.col("n_days") * F.col("n_zones") - F.col("n_observed_cells")).alias("n_missing_cells"),
        "n_partial_dates",
        (F.col("n_days") - F.col("n_seen_dates")).alias("n_fully_missing_dates"),
        (F.col("n_zones") - F.col("_w.n_whole")).alias("n_zones_with_gaps"),
    )


def missing_by_zone(panel: DataFrame, zones: DataFrame, day: str = "date", zone: str = "zone") -> DataFrame:
    """Absent days per zone, from counts alone."""
    span = panel.agg((F.datediff(F.max(day), F.min(day)) + 1).cast("long").alias("n_days"))
    have = panel.select(zone, day).distinct().groupBy(zone).agg(F.count(F.lit(1)).alias("n"))
    return (
        zones.select(zone)
        .join(have, zone, "left")
        .withColumn("_s", one_row(span))
        .select(zone, (F.col("_s.n_days") - F.coalesce("n", F.lit(0))).alias("n_missing"))
    )


def panel_quality(panel: DataFrame, zones: DataFrame, rate: str = "rate") -> DataFrame:
    gaps = calendar_gaps(panel, zones)
    rates = panel.agg(
        F.count_if(F.col(rate).isNull()).alias("n_null_rate"), F.count_if(F.col(rate) == 0).alias("n_zero_rate")
    )
    return gaps.withColumn("_r", one_row(rates)).select(*gaps.columns, "_r.n_null_rate", "_r.n_zero_rate")


def scenario_statistics(facts: DataFrame, fills: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Per fill: counts, moments (population sd), range and interpolated quantiles of the rate.

    The facts are read once, into a histogram of count, population and flags; the scenarios are fills
    of its rows, and every statistic weighs them. Nothing of the size of the facts is written.
    """
    flags = ("suppression_flag", "missing_flag", "invalid_value_flag")
    histogram = pin(facts.groupBy("numeric_count", "Population", *flags).agg(F.count(F.lit(1)).alias("n")))
    filled = suppression_scenarios(histogram, fills).select("suppression_scenario", "infection_rate", *flags, "n")
    rate, n, key = F.col("infection_rate"), F.col("n"), "suppression_scenario"
    hidden = F.when(F.col("suppression_flag") == 1, rate)

    def mean(x: Column) -> Column:
        return F.try_divide(F.sum(x * n), F.sum(F.when(x.isNotNull(), n)))

    base = pin(
        filled.groupBy(key).agg(
            F.sum(n).alias("n_rows"),
            F.coalesce(F.sum(F.when(rate.isNotNull(), n)), F.lit(0)).alias("n_valid"),
            *[F.sum(F.col(f) * n).alias(name) for f, name in zip(flags, ("n_suppressed", "n_missing", "n_invalid"))],
            mean(rate).alias("mean_rate"),
            F.min(rate).alias("min_rate"),
            F.max(rate).alias("max_rate"),
            mean(hidden).alias("suppressed_mean"),
            F.min(hidden).alias("suppressed_min"),
            F.max(hidden).alias("suppressed_max"),
        )
    )
    off = filled.join(base.select(key, "mean_rate"), key)
    spread = off.groupBy(key).agg(F.sqrt(mean((rate - F.col("mean_rate")) * (rate - F.col("mean_rate")))).alias("sd_rate"))
    wanted = {f"q{int(p * 100):02d}": Rank.linear(p) for p in STAT_QUANTILES}
    marks = weighted_order_statistics(filled, "infection_rate", "n", wanted, [key]).drop("n")
    return base.join(spread, key, "left").join(marks, key, "left")


def share_suppressed(df: DataFrame, by: str, top: int = 10) -> DataFrame:
    """Groups with the highest suppressed share, ties by key."""
    return (
        df.groupBy(by)
        .agg((F.avg("suppression_flag") * 100).alias("pct"))
        .orderBy(F.desc("pct"), F.col(by))
        .limit(top)
    )


def published_rate_gap(df: DataFrame) -> DataFrame:
    """Eligible rows with the absolute difference between the rebuilt and a numeric published rate."""
    published = finite_or_null(F.col("CrudeRate7DayPositive"))
    rebuilt = F.col("numeric_count") / F.col("Population") * F.lit(PER)
    return df.withColumn("abs_gap", F.abs(rebuilt - published)).filter(
        (F.col("response_status") == OBSERVED) & F.col("abs_gap").isNotNull()
    )


def published_rate_discrepancy(df: DataFrame, tolerance: float = RATE_TOLERANCE) -> DataFrame:
    beyond = F.col("abs_gap") > tolerance
    return published_rate_gap(df).agg(
        F.count(F.lit(1)).alias("n_eligible"),
        F.avg("abs_gap").alias("mean_abs_gap"),
        F.max("abs_gap").alias("max_abs_gap"),
        F.count_if(beyond).alias("n_beyond"),
        (F.avg(beyond.cast("double")) * 100).alias("pct_beyond"),
    )
