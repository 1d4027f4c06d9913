"""Text-extraction queries over request messages written from the order table."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonewise.functions.scalars import one_row
from zonewise.operators import text
from zonewise.plans.registry import query
from zonewise.sources.tables import table


def messages(spark, sf):
    """One message per order in six styles; the date is the order date twenty years later."""
    k, n = F.col("o_orderkey"), (F.col("o_custkey") % 25).cast("string")
    d = F.add_months(F.col("o_orderdate").cast("date"), 240)
    en = F.element_at(F.array(*[F.lit(m.capitalize()) for m in text.MONTHS]), F.month(d))
    dom, yr, mon = (F.date_format(d, p) for p in ("d", "yyyy", "M"))
    forms = [
        F.concat(F.lit("Forecast for nation_"), n, F.lit(" on "), F.date_format(d, "yyyy-MM-dd"), F.lit(" please")),
        F.concat(F.lit("Use the API with 14 to 7 days, years 2020 to 2022, zone S0200"), F.lpad(n, 4, "0")),
        F.concat(F.lit("Plan sites on "), dom, F.lit(" "), en, F.lit(" "), yr, F.lit(" from local files, 7-day window")),
        F.concat(F.lit("请预测 "), yr, F.lit("年"), mon, F.lit("月"), dom, F.lit("日 NATION_"), n),
        F.concat(en, F.lit(" "), dom, F.lit(", "), yr, F.lit(": compare the allocation policies")),
        F.lit("hello"),
    ]
    style = F.coalesce(*[F.when(k % 6 == i, f) for i, f in enumerate(forms)])
    return table(spark, sf, "orders").select(k.alias("message_id"), style.alias("text"))


M = """m AS (SELECT o_orderkey AS message_id, o_orderkey%6 AS s, CAST(o_orderdate + INTERVAL 240 MONTH AS DATE) AS d, o_custkey%25 AS n FROM orders)"""


@query("message_years", "TX1", f"""WITH {M} SELECT message_id, CASE WHEN s=1 THEN '2020,2021,2022' WHEN s<5 AND year(d) IN (2020,2021) THEN CAST(year(d) AS VARCHAR) ELSE '' END AS years FROM m""")
def message_years(spark, sf):
    y = text.extract_years(F.col("text"), [2020, 2021, 2022, 2023])
    return messages(spark, sf).select("message_id", F.array_join(y.cast("array<string>"), ",").alias("years"))


@query("message_source_window_task", "TX2", f"""WITH {M} SELECT message_id, CASE s WHEN 1 THEN 'api' WHEN 2 THEN 'local' END AS source, CASE s WHEN 1 THEN 14 WHEN 2 THEN 7 END AS lookback,
 CASE s WHEN 1 THEN 7 WHEN 2 THEN 7 END AS horizon, CASE s WHEN 0 THEN 'forecast_prepare' END AS task FROM m""")
def message_source_window_task(spark, sf):
    t = F.col("text")
    return messages(spark, sf).select(
        "message_id", text.extract_source(t).alias("source"), text.extract_window(t).alias("w"), text.extract_task(t).alias("task")
    ).select("message_id", "source", "w.lookback", "w.horizon", "task")


@query("message_dates", "TX3 F3", f"WITH {M} SELECT message_id, CASE WHEN s IN (0,2,3,4) THEN d END AS day FROM m")
def message_dates(spark, sf):
    return messages(spark, sf).select("message_id", text.extract_date(F.col("text")).alias("day"))


@query("message_zones", "TX4", f"WITH {M} SELECT message_id, 'S0200'||lpad(CAST(n AS VARCHAR),4,'0') AS code FROM m WHERE s IN (0,1,3)")
def message_zones(spark, sf):
    z = table(spark, sf, "nation").select(F.concat(F.lit("S0200"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0")).alias("code"), F.col("n_name").alias("name"))
    return text.match_zone_names(messages(spark, sf), z)


@query("message_intents", "TX5", f"""WITH {M} SELECT message_id, CASE s WHEN 0 THEN 'forecast' WHEN 1 THEN 'explain_zone' WHEN 2 THEN 'plan' WHEN 3 THEN 'forecast' WHEN 4 THEN 'compare' ELSE 'help' END AS intent FROM m""")
def message_intents(spark, sf):
    return messages(spark, sf).select("message_id", text.intent(F.col("text")).alias("intent"))


@query("alias_codes", "TX6", """SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'coverage' WHEN 'O' THEN 'equity' ELSE NULL END AS scenario, CASE WHEN o_orderpriority='5-LOW' THEN 'all' END AS population,
 CASE WHEN o_orderkey%3=0 THEN 'S12_1' WHEN o_orderkey%3=1 THEN 'S12_2' ELSE 'UNKNOWN' END AS area FROM orders""")
def alias_codes(spark, sf):
    o = table(spark, sf, "orders")
    label = F.when(F.col("o_orderstatus") == "F", " Coverage Priority").when(F.col("o_orderstatus") == "O", "equity-priority").otherwise("cheapest")
    pop = F.when(F.col("o_orderpriority") == "5-LOW", "Total population").otherwise("children")
    area = F.when(F.col("o_orderkey") % 3 == 0, "City of North").when(F.col("o_orderkey") % 3 == 1, "s12_2").otherwise("elsewhere")
    return o.select(
        F.col("o_orderkey").alias("k"),
        text.scenario_code(label).alias("scenario"),
        text.population_code(pop).alias("population"),
        text.area_code(area, {"north": "S12_1", "south": "S12_2"}).alias("area"),
    )


@query("message_languages", "TX7", f"WITH {M} SELECT CASE WHEN s=3 THEN 'zh' ELSE 'en' END AS language, count(*) AS n FROM m GROUP BY 1")
def message_languages(spark, sf):
    return messages(spark, sf).groupBy(text.language(F.col("text")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query("document_languages", "TX7", """SELECT lang, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '[一-鿿]')) AS n_zh,
 count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z]{2,}') AND NOT regexp_matches(text, '[一-鿿]')) AS n_en FROM documents GROUP BY 1""")
def document_languages(spark, sf):
    """Documents by declared language and the language their text shows."""
    found = table(spark, sf, "documents").select("lang", text.language(F.col("text")).alias("l"))
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l") == "zh").alias("n_zh"), F.count_if(F.col("l") == "en").alias("n_en"))


@query("conversation_tags", "TX5 TX7 TX1", """SELECT role, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z]{2,}') OR regexp_matches(text, '[一-鿿]')) AS n_language,
 count(*) FILTER (WHERE contains(lower(text),'compare') OR contains(lower(text),'versus')) AS n_compare_words FROM conversations GROUP BY 1""")
def conversation_tags(spark, sf):
    low = F.lower("text")
    return table(spark, sf, "conversations").groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.count(text.language(F.col("text"))).alias("n_language"), F.count_if(low.contains("compare") | low.contains("versus")).alias("n_compare_words")
    )


@query("string_and_date_functions", "F1 F3 F4 F8", """SELECT s_suppkey AS k, lower(trim('  '||s_name||' ')) AS s1, replace(s_name,'Supplier#','') AS s2, strftime(DATE '2020-01-01'+s_suppkey::INT,'%Y%m%d') AS d1,
 floor(ln(1+abs(s_acctbal))*1e6+0.5)/1e6 AS m1, round_even(s_acctbal/100,1) AS m2, floor(s_acctbal)::BIGINT AS m3,
 floor((greatest(s_acctbal/1000,0)+ln(1+exp(-abs(s_acctbal/1000))))*1e6+0.5)/1e6 AS m4 FROM supplier""")
def string_and_date_functions(spark, sf):
    from zonewise.functions.scalars import r6, softplus

    b = F.col("s_acctbal")
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("k"),
        F.lower(F.trim(F.concat(F.lit("  "), "s_name", F.lit(" ")))).alias("s1"),
        F.replace("s_name", F.lit("Supplier#"), F.lit("")).alias("s2"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("s_suppkey").cast("int")), "yyyyMMdd").alias("d1"),
        r6(F.log1p(F.abs(b))).alias("m1"),
        F.bround(b / 100, 1).alias("m2"),
        F.floor(b).alias("m3"),
        r6(softplus(b / 1000)).alias("m4"),
    )


def _any(column, words):
    return "(" + " OR ".join("contains({}, '{}')".format(column, w.replace("'", "''")) for w in words) + ")"


def _in(column, words):
    return "{} IN ({})".format(column, ", ".join("'" + w.replace("'", "''") + "'" for w in words))


_TALK = text.CHAT_WORDS
_WORDS = text.INTENT_WORDS
_KIND = f"""CASE WHEN b='' THEN 'other' WHEN {_in('b', _TALK['greet'])} OR length(b)<=16 AND ({' OR '.join(f"starts_with(b, '{w}')" for w in text.GREETING_STARTS)}) THEN 'greet'
 WHEN {_any('b', _TALK['identity'])} THEN 'identity' WHEN {_any('b', _TALK['wellbeing'])} THEN 'wellbeing' WHEN {_any('b', _TALK['capabilities'])} OR {_in('b', text.HELP_WORDS)} THEN 'capabilities'
 WHEN {_any('b', _TALK['thanks'])} THEN 'thanks' WHEN {_any('b', _TALK['farewell'])} THEN 'farewell' WHEN {_in('b', _TALK['ack'])} THEN 'ack' ELSE 'other' END"""
_VIEW = f"CASE WHEN NOT {_any('low', text.VIEW_WORDS['not_region'])} AND {_any('low', text.VIEW_WORDS['region'])} THEN 'region' WHEN {_any('low', text.VIEW_WORDS['zone'])} THEN 'zone' END"
_SCEN = "(" + " OR ".join(_any("low", w) for w in text.SCENARIO_WORDS.values()) + ")"
_PLANS = f"({_any('low', _WORDS['plan'])} OR regexp_matches(low, '\\bplan\\b'))"
_INTENT = f"""CASE WHEN regexp_matches(low, '\\b(gp|ph|ms)_\\d+\\b') OR EXISTS (SELECT 1 FROM nation WHERE contains(low, lower(n_name))) THEN 'explain_site'
 WHEN regexp_matches(low, '\\bs0200\\d{{4}}\\b') AND upper(regexp_extract(low, '\\bs0200\\d{{4}}\\b')) IN (SELECT 'S0200'||lpad(n_nationkey::VARCHAR,4,'0') FROM nation) THEN 'explain_zone'
 WHEN {_any('low', _WORDS['compare'])} THEN 'compare' WHEN {_any('low', _WORDS['notes'])} THEN 'notes' WHEN {_any('low', _WORDS['forecast'])} THEN 'forecast'
 WHEN {_any('low', _WORDS['allocation'])} AND NOT {_PLANS} THEN 'allocation' WHEN {_PLANS} OR {_any('low', _WORDS['allocation'])} OR {_SCEN} THEN 'plan' ELSE 'help' END"""
_SAID = """(SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT -1-o_orderkey, 0, 'asked', CASE o_orderkey%12 WHEN 0 THEN ' Hello!' WHEN 1 THEN 'hi there, zone s0200'||lpad((o_custkey%40)::VARCHAR,4,'0') WHEN 2 THEN 'who are you' WHEN 3 THEN 'Thanks, bye' WHEN 4 THEN '好的。'
   WHEN 5 THEN 'back to whole region' WHEN 6 THEN 'another zone please' WHEN 7 THEN 'ask '||(SELECT min(n_name) FROM nation) WHEN 8 THEN o_orderpriority||' help' WHEN 9 THEN 'help' WHEN 10 THEN 'one intermediate zone, city-wide' ELSE NULL END FROM orders)"""


@query("conversation_intents", "TX5", f"""WITH t AS (SELECT role, lower(coalesce(text,'')) AS low, rtrim(lower(regexp_replace(coalesce(text,''), '^\\s+|\\s+$', '', 'g')), '{text.CHAT_ENDINGS}') AS b FROM {_SAID})
 SELECT role, {_INTENT} AS intent, {_KIND} AS chat, {_VIEW} AS wanted_view, count(*) AS n FROM t GROUP BY ALL""")
def conversation_intents(spark, sf):
    """Every turn of the conversations, and requests worded from the orders, by intent, small talk and wanted view."""
    said = table(spark, sf, "conversations").select("role", "text")
    k = F.col("o_orderkey") % 12
    known = one_row(  # a planning area of 25 nations: its site ids and zone codes
        table(spark, sf, "nation").agg(
            F.min("n_name").alias("first"), F.collect_set("n_name").alias("sites"), F.collect_set(F.concat(F.lit("S0200"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0"))).alias("zones")
        )
    )
    lines = {
        0: F.lit(" Hello!"),
        1: F.concat(F.lit("hi there, zone s0200"), F.lpad((F.col("o_custkey") % 40).cast("string"), 4, "0")),
        2: F.lit("who are you"),
        3: F.lit("Thanks, bye"),
        4: F.lit("好的。"),
        5: F.lit("back to whole region"),
        6: F.lit("another zone please"),
        7: F.concat(F.lit("ask "), known["first"]),
        8: F.concat("o_orderpriority", F.lit(" help")),
        9: F.lit("help"),
        10: F.lit("one intermediate zone, city-wide"),
    }
    asked = table(spark, sf, "orders").select(F.lit("asked").alias("role"), F.coalesce(*[F.when(k == i, v) for i, v in lines.items()]).alias("text"))
    t = F.coalesce("text", F.lit(""))
    told = said.unionByName(asked).withColumn("_k", known)
    tagged = told.select("role", text.intent(t, F.col("_k.sites"), F.col("_k.zones")).alias("intent"), text.chat_kind(t).alias("chat"), text.wanted_view(t).alias("wanted_view"))
    return tagged.groupBy("role", "intent", "chat", "wanted_view").agg(F.count(F.lit(1)).alias("n"))
