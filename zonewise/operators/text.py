"""Fields read from free-text request messages, all as column expressions over whole texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from zonewise.functions.scalars import one_row

# The words and layouts requests are recognised by.
SOURCE_WORDS = {
    "api": ("api", "ckan", "接口", "在线", "网络"),
    "local": ("local", "本地", "离线", "raw"),
    "osm": ("osmnx", "openstreetmap"),
}
TASK_WORDS = {
    "candidate_sites_prepare": ("candidate_sites_prepare", "candidate_sites", "候选点", "选点"),
    "travel_time_prepare": ("travel_time_prepare", "travel_time", "出行时间", "时间矩阵"),
    "inventory": ("inventory", "盘点"),
    "forecast_prepare": ("forecast_prepare", "forecast", "滑窗", "预测样本"),
    "covid_prepare": ("covid_prepare", "covid"),
}
SCENARIO_WORDS = {
    "coverage": ("coverage", "cover more", "maximi", "覆盖", "尽量覆盖"),
    "equity": ("equity", "equitable", "fairness", "fair access", "公平", "公正"),
    "preventive": ("preventive", "prevention", "preventative", "prevent ", "预防"),
    "balanced": ("balanced", "balance", "均衡", "平衡", "折中"),
}
INTENT_WORDS = {
    "compare": (
        "compare", "comparison", "contrast", "versus", " vs ", "four polic", "four scenario", "four policies",
        "which policy", "which policies", "better policy", "policy difference",
        "比较", "对比", "四种", "四个政策", "哪个政策", "哪种政策", "政策差别", "政策差异",
    ),
    "notes": (
        "glossary", "what does", "what do the labels", "alpha weight", "audit log", "tool log", "术语", "标签含义", "名词解释",
    ),
    "forecast": (
        "forecast", "prediction", "predict", "projected", "projection", "uncertainty", "geoshapley", "shapley",
        "infection rate", "infection-rate", "case rate", "incidence", "predicted rate", "rate map", "risk map",
        "choropleth", "how bad", "how many cases", "outbreak", "epidemic", "covid map", "covid forecast",
        "预测", "预报", "预估", "推演", "感染率", "发病率", "疫情", "不确定性", "结果", "results", "result",
        "看图", "预报图", "预测图", "热力图",
    ),
    "allocation": (
        "allocation", "show the sites", "show the site", "selected sites", "where did you", "where are the site",
        "where the site", "where are sites", "where is the site", "vaccination site", "vaccination sites",
        "vaccine site", "vaccine sites", "jab site", "clinic location", "clinic map", "site map", "site locations",
        "site location", "site distribution", "spatial distribution", "distribution of", "layout of site",
        "placed the site", "placed sites", "the six sites", "the 6 sites", "those six sites", "those 6 sites",
        "the six points", "red points", "get vaccinated", "get a vaccine", "where to vaccinate",
        "where can i vaccinate", "pharmacy site", "gp site",
        "选中点", "已选", "候选点", "选址图", "接种点分布", "点位分布", "接种点在哪", "接种点在", "疫苗点", "疫苗接种点",
        "接种地点", "接种位置", "放在哪", "点位图", "六个点", "6 个点", "6个点", "红点",
    ),
    "plan": (
        "plan 6", "plan six", "place 6", "place six", "allocate", "siting", "run the agent", "task brief",
        "choose sites", "choose 6", "pick 6", "pick six", "find 6", "find six", "place sites", "place the site", "sitings",
        "规划", "选址", "计划", "跑一遍", "布置", "设点", "放点", "放 6", "放6", "六个接种", "6个接种", "6 个接种",
    ),
}
SCENARIO_ALIASES = {
    "coverage": "coverage",
    "coverage priority": "coverage",
    "coverage-priority": "coverage",
    "equity": "equity",
    "equity priority": "equity",
    "equity-priority": "equity",
    "preventive": "preventive",
    "preventive priority": "preventive",
    "preventive-priority": "preventive",
    "balanced": "balanced",
}
TOTAL_POPULATION = ("", "all", "total population", "total")
MONTHS = (
    "january february march april may june july august september october november december".split()
)
COMMANDS = ("plan 6 sites", "show the forecast", "compare the four allocation policies.", "show the allocation")
_MONTH = "|".join(sorted({*MONTHS, *(m[:3] for m in MONTHS), "sept"}, key=len, reverse=True))
ISO = r"(20\d{2})[-/.](\d{1,2})[-/.](\d{1,2})"
CN = r"(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日?"
DMY = rf"(?i)(\d{{1,2}})\s+({_MONTH})\.?,?\s+(20\d{{2}})"
MDY = rf"(?i)({_MONTH})\.?\s+(\d{{1,2}}),?\s+(20\d{{2}})"
YEAR = r"(?<!\d)(20[2-3]\d)(?!\d)"
YEAR_RANGE = r"(?i)(?<!\d)(20[2-3]\d)\s*(?:-|to|至|到)\s*(20[2-3]\d)(?!\d)"
PAIR = r"(?i)(?<!\d)(\d+)\s*天?\s*(?:预测|预报|forecast(?:ing)?|predict(?:ing)?|→|->|to|到)\s*(\d+)\s*天?"
SINGLE = r"(?i)(?<!\d)(\d+)\s*(?:天(?:窗口|滑窗|预测)?|[- ]?day(?:s)?(?:\s+window)?)"
ZONE_CODE = r"(?i)\bS0200\d{4}\b"
CJK = r"[\u4e00-\u9fff]"
CN_MONTH_DAY = r"(?<!\d)(\d{1,2})\s*月\s*(\d{1,2})\s*日?"
LATEST = ("latest", "newest", "extrapolation", "最新")
AREA_ONLY = r"(?i)^(city of edinburgh|edinburgh|glasgow city|glasgow|s12000036|s12000049)$"
GRAM = 4


def _has(text: Column, words: Sequence[str]) -> Column:
    hit = text.contains(words[0])
    for w in words[1:]:
        hit = hit | text.contains(w)
    return hit


def _group(text: Column, pattern: str, i: int) -> Column:
    got = F.regexp_extract(text, pattern, i)
    return F.when(got != "", got)


def extract_years(text: Column, known: Sequence[int]) -> Column:
    """Sorted years named alone or inside a range, limited to the known ones."""
    ends = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(YEAR_RANGE), 1).alias("a"), F.regexp_extract_all(text, F.lit(YEAR_RANGE), 2).alias("b")
    )
    spans = F.transform(
        ends, lambda e: F.sequence(F.least(e["a"].cast("int"), e["b"].cast("int")), F.greatest(e["a"].cast("int"), e["b"].cast("int")))
    )
    single = F.transform(F.regexp_extract_all(text, F.lit(YEAR), 1), lambda y: y.cast("int"))
    return F.array_sort(F.array_intersect(F.array_distinct(F.concat(F.flatten(spans), single)), F.array(*[F.lit(int(y)) for y in known])))


def extract_source(text: Column) -> Column:
    low = F.lower(text)
    flags = {k: _has(low, w) for k, w in SOURCE_WORDS.items()}
    flags["osm"] = flags["osm"] | low.rlike(r"(?<![a-z])osm(?![a-z])")
    n = sum((f.cast("int") for f in flags.values()), F.lit(0))
    return F.when(n == 1, F.when(flags["osm"], "osm").when(flags["api"], "api").otherwise("local"))


def extract_window(text: Column) -> Column:
    """(lookback, horizon) as stated; nothing is assumed."""
    a, b = _group(text, PAIR, 1).try_cast("int"), _group(text, PAIR, 2).try_cast("int")
    one = _group(text, SINGLE, 1).try_cast("int")
    return F.when((a > 0) & (b > 0), F.struct(a.alias("lookback"), b.alias("horizon"))).when(
        one > 0, F.struct(one.alias("lookback"), one.alias("horizon"))
    )


def extract_task(text: Column) -> Column:
    low = F.lower(text)
    flags = {k: _has(low, w) for k, w in TASK_WORDS.items()}
    n = sum((f.cast("int") for f in flags.values()), F.lit(0))
    return F.when(n == 1, F.coalesce(*[F.when(f, F.lit(k)) for k, f in flags.items()]))


def _date(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def _month_number(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(F.lower(name), 1, 3))


def trimmed(text: Column) -> Column:
    """Without blanks, tabs and line ends on either side."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def extract_date(text: Column, known: Column | None = None, latest: Column | None = None) -> Column:
    """Chinese, year-first, and English day-month-year and month-day-year forms, in that order of trust.

    ``known`` (an array of dates) and ``latest`` settle a month and day without a year: the latest
    date if it falls on that day, else the first known one that does. Words for the newest date give
    ``latest``.
    """
    cn = _date(*[_group(text, CN, i) for i in (1, 2, 3)])
    iso = _date(*[_group(text, ISO, i) for i in (1, 2, 3)])
    dmy = _date(_group(text, DMY, 3), _month_number(_group(text, DMY, 2)), _group(text, DMY, 1))
    mdy = _date(_group(text, MDY, 3), _month_number(_group(text, MDY, 1)), _group(text, MDY, 2))
    full = F.coalesce(cn, iso, dmy, mdy)
    if known is None and latest is None:
        return full
    newest = F.lit(None).cast("date") if latest is None else latest
    month, day = [_group(text, CN_MONTH_DAY, i).try_cast("int") for i in (1, 2)]
    falls = lambda d: (F.month(d) == month) & (F.dayofmonth(d) == day)
    options = F.array().cast("array<date>") if known is None else known
    of_day = F.when(falls(newest), newest).otherwise(F.get(F.filter(options, falls), F.lit(0)))
    return F.coalesce(full, of_day, F.when(_has(F.lower(text), LATEST), newest))


def match_zone_names(messages: DataFrame, zones: DataFrame, key: str = "message_id", text: str = "text") -> DataFrame:
    """(message, code): exact code or name, then a code inside the text, else the longest mutual
    containment of at least four characters with all ties.

    Containment is found by equi-joins only. A position of a message is looked up by its first
    four characters, which yields the possible label lengths and so the exact candidate labels;
    rows carry a window of label length, never the whole text again. For the reverse direction
    the few zone labels are expanded to their parts and matched with the whole message.
    """
    m = messages.select(key, F.lower(trimmed(F.col(text))).alias("t")).filter("t <> ''")
    z = zones.select("code", F.lower(F.trim("name")).alias("label"), F.lower("code").alias("lc"))
    names = z.select("code", F.explode(F.array_distinct(F.array("label", "lc"))).alias("t"))
    exact = m.join(names, "t").select(key, "code").distinct()
    rest = m.join(exact.select(key).distinct(), key, "left_anti")
    coded = (
        rest.withColumn("lc", F.lower(_group(F.col("t"), ZONE_CODE, 0))).join(z.select("code", "lc"), "lc").select(key, "code")
    )
    loose = rest.join(coded.select(key), key, "left_anti").filter(F.length("t") >= GRAM)
    labels = z.filter(F.length("label") >= GRAM).select("code", "label")
    heads = labels.groupBy(F.substring("label", 1, GRAM).alias("g")).agg(F.collect_set(F.length("label")).alias("lens"))
    longest = one_row(labels.agg(F.coalesce(F.max(F.length("label")), F.lit(GRAM)).alias("n")))["n"]
    starts = F.sequence(F.lit(1), F.length("t") - (GRAM - 1))
    inside = (
        loose.withColumn("n", longest)
        .select(key, F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr(F.col("t"), i, F.col("n"))))).alias("w"))
        .withColumn("g", F.substring("w", 1, GRAM))
        .join(heads, "g")
        .select(key, "w", F.explode("lens").alias("n"))
        .filter(F.length("w") >= F.col("n"))
        .select(key, "n", F.substr(F.col("w"), F.lit(1), F.col("n")).alias("label"))
        .distinct()
        .join(labels, "label")
        .select(key, "code", "n")
    )
    size = F.length("label")
    parts = labels.select(
        "code",
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.sequence(F.lit(1), size - (GRAM - 1)),
                        lambda i: F.transform(F.sequence(F.lit(GRAM), size - i + 1), lambda n: F.substr(F.col("label"), i, n)),
                    )
                )
            )
        ).alias("t"),
    )
    around = loose.join(parts, "t").select(key, "code", F.length("t").alias("n"))
    found = inside.unionByName(around).groupBy(key, "code").agg(F.max("n").alias("n"))
    best = found.groupBy(key).agg(F.max("n").alias("n"))
    return exact.unionByName(coded).unionByName(found.join(best, [key, "n"]).select(key, "code"))


# Small talk and views, as the interface words them.
CHAT_WORDS = {
    "greet": ("你好", "您好", "嗨", "哈喽", "早上好", "下午好", "晚上好", "hello", "hi", "hey", "good morning", "good afternoon", "good evening"),
    "identity": ("who are you", "what are you", "你是谁", "你是什么", "你叫什么", "介绍一下你"),
    "wellbeing": ("how are you", "how's it going", "你好吗", "最近好吗", "忙吗"),
    "capabilities": ("what can you", "what do you do", "how do you work", "how does this", "你能做什么", "你会什么", "怎么用", "能做什么", "有什么功能", "帮帮我", "怎么办"),
    "thanks": ("thank", "thanks", "thx", "谢谢", "感谢", "多谢", "thank you"),
    "farewell": ("goodbye", "good bye", "see you", "bye", "再见", "拜拜", "下次见"),
    "ack": ("ok", "okay", "好", "好的", "嗯", "行", "可以", "哦", "喔", "明白", "收到"),
}
GREETING_STARTS = ("hello", "hi ", "hey ", "你好", "您好", "嗨")
HELP_WORDS = ("help", "帮助", "帮忙")
CHAT_ENDINGS = "!！。.~？?，,"
VIEW_WORDS = {
    "not_region": ("按所选中间区", "selected intermediate zone view", "one intermediate zone"),
    "region": ("whole-region", "whole region", "city-wide", "citywide", "all intermediate zones", "全市", "全区域", "全城", "整市", "整个区域", "全部中间区", "改回全区域", "back to whole"),
    "zone": ("selected intermediate", "one intermediate", "按中间区", "按所选", "单个中间区", "一个中间区", "某个中间区", "某个街区", "换一个", "重新选择中间区", "another zone", "another intermediate", "interzone"),
}


def chat_kind(text: Column) -> Column:
    """Kind of small talk: whole greetings first, then words anywhere, acknowledgements last; else ``other``.

    A null or blank text is ``other``. Punctuation at the end does not count.
    """
    bare = F.rtrim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")), F.lit(CHAT_ENDINGS))
    starts = (F.char_length(bare) <= 16) & reduce(or_, [F.startswith(bare, F.lit(w)) for w in GREETING_STARTS])
    kind = F.when(bare == "", "other").when(bare.isin(*CHAT_WORDS["greet"]) | starts, "greet")
    for name in ("identity", "wellbeing", "capabilities", "thanks", "farewell"):
        hit = _has(bare, CHAT_WORDS[name])
        kind = kind.when(hit | bare.isin(*HELP_WORDS) if name == "capabilities" else hit, name)
    return kind.when(bare.isin(*CHAT_WORDS["ack"]), "ack").otherwise("other")


def wanted_view(text: Column) -> Column:
    """``region`` or ``zone`` where the text asks for such a view, else null; the region goes first."""
    low = F.lower(F.coalesce(text, F.lit("")))
    region = ~_has(low, VIEW_WORDS["not_region"]) & _has(low, VIEW_WORDS["region"])
    return F.when(region, "region").when(_has(low, VIEW_WORDS["zone"]), "zone")


def intent(text: Column, sites: Column | None = None, zones: Column | None = None) -> Column:
    """Site, zone, compare, notes, forecast, plan, allocation or help, first rule that holds.

    ``sites`` (an array) names a site wherever one of its ids stands in the text; with ``zones`` a zone
    code counts only if it is one of them. Both are the short lists of one planning area.
    """
    low = F.lower(text)
    planning = _has(low, INTENT_WORDS["plan"]) | low.rlike(r"\bplan\b")
    scenario = scenario_mentioned(text).isNotNull()
    site = low.rlike(r"\b(?:gp|ph|ms)_\d+\b")
    if sites is not None:
        site |= F.exists(sites, lambda s: F.contains(low, F.lower(s)))
    zone = low.rlike(ZONE_CODE)
    if zones is not None:
        zone &= F.array_contains(zones, F.upper(F.regexp_extract(low, ZONE_CODE, 0)))
    return (
        F.when(site, "explain_site")
        .when(zone, "explain_zone")
        .when(_has(low, INTENT_WORDS["compare"]), "compare")
        .when(_has(low, INTENT_WORDS["notes"]), "notes")
        .when(_has(low, INTENT_WORDS["forecast"]), "forecast")
        .when(_has(low, INTENT_WORDS["allocation"]) & ~planning, "allocation")
        .when(planning | _has(low, INTENT_WORDS["allocation"]) | scenario, "plan")
        .otherwise("help")
    )


def scenario_mentioned(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(_has(low, w), F.lit(k)) for k, w in SCENARIO_WORDS.items()])


def scenario_code(label: Column) -> Column:
    """Canonical scenario; null marks an unknown label, an empty one means balanced."""
    key = F.lower(F.trim(F.coalesce(label, F.lit("balanced"))))
    pairs = [x for k, v in SCENARIO_ALIASES.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.when(key == "", "balanced").otherwise(key))


def population_code(label: Column) -> Column:
    return F.when(F.lower(F.trim(F.coalesce(label, F.lit("all")))).isin(*TOTAL_POPULATION), "all")


def area_code(label: Column, areas: dict[str, str]) -> Column:
    """Area code by name fragment or by the code itself; UNKNOWN otherwise. ``areas``: fragment -> code."""
    low = F.lower(F.trim(label))
    hits = [F.when(low.contains(name.lower()) | (low == code.lower()), F.lit(code)) for name, code in areas.items()]
    return F.coalesce(*hits, F.lit("UNKNOWN"))


def language(text: Column) -> Column:
    """zh with any CJK character, en with two Latin letters in a row, null for bare dates, bare areas and
    fixed commands."""
    raw = trimmed(text)
    bare = raw.rlike(r"^20\d{2}-\d{2}-\d{2}(?:\s+\(.*\))?$") | F.lower(raw).isin(*COMMANDS) | raw.rlike(AREA_ONLY)
    return F.when(raw.rlike(CJK), "zh").when(~bare & raw.rlike("[A-Za-z]{2,}"), "en")
