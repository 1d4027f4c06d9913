"""The driver tables, and the views of them that stand in for panels, sites, flows, points and messages.

Every view reads its whole table; only columns it needs are scanned. Aggregated panels are
written once (``pin``), so that operators which look at a panel several times do not
scan the fact table again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from zonewise.functions.scalars import one_row
from zonewise.session import pin


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_zone(key: str = "l_suppkey") -> Column:
    return F.concat(F.lit("S020"), F.lpad(F.col(key).cast("string"), 6, "0"))


def day(col: str) -> Column:
    return F.col(col).cast("date")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw all-text panel rows, one per order line: a zone is a supplier, an area a return flag."""
    q = F.col("l_quantity").cast("int")
    ymd, iso = F.date_format("l_shipdate", "yyyyMMdd"), F.date_format("l_shipdate", "yyyy-MM-dd")
    date = (
        F.when(F.col("l_linenumber") == 7, F.concat(ymd, F.lit(".0")))
        .when(F.col("l_linenumber") == 6, F.concat(F.lit("on "), iso))
        .when(F.col("l_linenumber") % 2 == 0, ymd)
        .otherwise(iso)
    )
    count = (
        F.when(F.col("l_discount") == 0.0, "")
        .when(q < 3, "c")
        .when(q == 50, "n/a")
        .when(q == 49, "inf")
        .otherwise(q.cast("string"))
    )
    population = (
        F.when((F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.0), "")
        .when((F.col("l_discount") == 0.0) & (F.col("l_tax") == 0.01), "0")
        .when((F.col("l_discount") == 0.0) & (F.col("l_tax") == 0.02), "-10")
        .otherwise((F.lit(1000) + F.col("l_suppkey") % 500 * 10).cast("string"))
    )
    return table(spark, sf_dir, "lineitem").select(
        date.alias("Date"),
        supplier_zone().alias("IntZone"),
        F.concat(F.lit("Zone "), F.col("l_suppkey").cast("string")).alias("IntZoneName"),
        F.concat(F.lit("S12_"), F.col("l_returnflag")).alias("CA"),
        F.when(
            (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), F.lit("City old R")
        ).otherwise(F.concat(F.lit(" City "), F.col("l_returnflag"))).alias("CAName"),
        count.alias("Positive7Day"),
        F.when((F.col("l_tax") == 0.08) & (q < 10), "C ").otherwise("").alias("Positive7DayQF"),
        population.alias("Population"),
        F.when(F.col("l_tax") < 0.03, "200 to 399").otherwise((q * 90).cast("string")).alias("CrudeRate7DayPositive"),
        F.when(q < 3, "c").otherwise("").alias("CrudeRate7DayPositiveQF"),
        F.col("l_linenumber").alias("source_index"),
        F.col("l_orderkey").alias("row_id"),
    )


def supplier_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(supplier_zone("s_suppkey").alias("zone"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique (date, zone) panel over suppliers; some rates are null."""
    daily = table(spark, sf_dir, "lineitem").groupBy(day("l_shipdate").alias("date"), "l_suppkey").agg(
        F.sum("l_quantity").alias("cases")
    )
    pop = (F.lit(1000) + F.col("l_suppkey") % 500 * 10).cast("double")
    return pin(
        daily.select(
            "date",
            supplier_zone().alias("zone"),
            "cases",
            pop.alias("population"),
            F.when(F.col("cases") % 11 != 0, F.col("cases") / pop * 100000).alias("rate"),
        )
    )


def panel_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day x event type with a complete calendar at every scale."""
    daily = table(spark, sf_dir, "events").groupBy(day("ts").alias("date"), F.col("event_type").alias("zone")).agg(
        F.count(F.lit(1)).alias("cases")
    )
    pop = (F.lit(5000) + 250 * F.length("zone")).cast("double")
    return pin(
        daily.select("date", "zone", "cases", pop.alias("population"), (F.col("cases") / pop * 100000).alias("rate"))
    )


def panel_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day x user group; absent cells and null rates occur."""
    zone = F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))
    daily = table(spark, sf_dir, "events").groupBy(day("ts").alias("date"), zone.alias("zone")).agg(
        F.count(F.lit(1)).alias("cases")
    )
    dom = F.dayofmonth("date")
    absent = (dom == 9) | ((dom == 20) & (F.col("zone") == "u7"))
    null_rate = (dom % 13 == 0) & (F.col("zone") == "u3")
    return pin(
        daily.filter(~absent).select(
            "date", "zone", F.when(~null_rate, F.col("cases") / 20000.0 * 100000).alias("rate")
        )
    )


def panel_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long series: trailing seven-day order counts per region, one row per region and day."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", day("o_orderdate").alias("d"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    home = cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey")
    daily = (
        orders.join(home, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("zone"), "d")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    span = table(spark, sf_dir, "orders").agg(F.min(day("o_orderdate")).alias("lo"), F.max(day("o_orderdate")).alias("hi"))
    week = (
        daily.select("zone", "n", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("lag"), "d")
        .groupBy("zone", F.date_add("d", F.col("lag")).alias("date"))
        .agg(F.sum("n").alias("cases"))
    )
    bounds = span.select(F.struct("lo", "hi").alias("v")).scalar()
    pop = F.lit(20000.0)
    return pin(
        week.withColumn("_b", bounds)
        .filter((F.col("date") >= F.date_add("_b.lo", 6)) & (F.col("date") <= F.col("_b.hi")))
        .select("date", "zone", "cases", pop.alias("population"), (F.col("cases") / pop * 100000).alias("rate"))
    )


def block_zone(key: str) -> Column:
    """A zone for every hundred customers, so that zones grow with the tables."""
    return F.concat(F.lit("b"), F.lpad(F.floor(F.col(key) / 100).cast("string"), 9, "0"))


def panel_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete series per zone of customers: 1,000 and the net number of urgent orders of the last 180 days."""
    urgent = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).when(F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW"), -1).otherwise(0)
    orders = table(spark, sf_dir, "orders").select("o_custkey", day("o_orderdate").alias("date"), urgent.alias("net"))
    span = one_row(orders.agg(F.min("date").alias("lo"), F.max("date").alias("hi")))
    zones = table(spark, sf_dir, "customer").select(block_zone("c_custkey").alias("zone")).distinct()
    # An order counts from its day on and is taken back after 180 days, so a running sum gives the level.
    turns = F.array(F.struct("date", "net"), F.struct(F.date_add("date", 180).alias("date"), (-F.col("net")).alias("net")))
    changes = orders.withColumn("zone", block_zone("o_custkey")).join(zones, "zone", "left_semi").select("zone", F.inline(turns))
    first = zones.select("zone", span["lo"].alias("date"), F.lit(0).alias("net"))
    # A fixed number of parts: the rows grow after the shuffle, so its bytes do not tell how many tasks they need.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = changes.unionByName(first).repartition(parts, "zone").groupBy("zone", "date").agg(F.sum("net").alias("net"))
    w = W.partitionBy("zone").orderBy("date")
    held = each.select("zone", "date", (F.lit(1000) + F.sum("net").over(w.rowsBetween(W.unboundedPreceding, 0))).alias("cases"), F.lead("date").over(w).alias("next"))
    until = F.least(F.coalesce(F.date_sub("next", 1), span["hi"]), span["hi"])  # a level holds until the day before the next change
    cases = held.filter(F.col("date") <= span["hi"]).select("zone", "cases", F.explode(F.sequence("date", until)).alias("date"))
    return pin(cases.select("date", "zone", "cases", F.lit(100000.0).alias("population"), F.col("cases").cast("double").alias("rate")))


def block_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the customers of a zone, and the place of the zone on a lattice of seven columns."""
    bal = F.abs(F.floor("c_acctbal"))
    at = F.floor(F.min("c_custkey") / 100)
    return pin(
        table(spark, sf_dir, "customer").groupBy(block_zone("c_custkey").alias("zone")).agg(
            F.avg(bal % 200).alias("income"),
            F.avg(bal % 80).alias("crime"),
            F.avg("c_nationkey").alias("access"),
            (at % 7).cast("double").alias("x"),
            F.floor(at / 7).cast("double").alias("y"),
        )
    )


def block_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): how often an order of one zone is followed by one of a zone at most two further."""
    orders = table(spark, sf_dir, "orders")
    at = F.floor(F.col("o_custkey") / 100)
    a = orders.select("o_orderkey", block_zone("o_custkey").alias("src"), at.alias("i"))
    b = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), block_zone("o_custkey").alias("dst"), at.alias("j"))
    near = a.join(b, "o_orderkey").filter((F.col("i") != F.col("j")) & (F.abs(F.col("i") - F.col("j")) <= 2))
    return pin(near.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")))


def nation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("zone"), F.col("n_nationkey").alias("node_index"))


def small_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as small areas of a nation, indicators as raw text."""
    c = table(spark, sf_dir, "customer")
    bal = F.floor("c_acctbal").cast("long")
    key = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("S010"), F.lpad(key.cast("string"), 8, "0")).alias("area"),
        F.col("c_nationkey").alias("nationkey"),
        F.when(key % 97 == 0, "0").otherwise((F.lit(500) + key % 700).cast("string")).alias("Total_population"),
        (F.lit(300) + key % 400).cast("string").alias("Working_age_population"),
        (F.abs(bal) % 200).cast("string").alias("Income_count"),
        F.when(key % 211 == 5, " ").otherwise((F.abs(bal) % 150).cast("string")).alias("Employment_count"),
        (key % 60).cast("string").alias("overcrowded_count"),
        F.when(F.abs(bal) % 10 < 2, "*").otherwise((F.abs(bal) % 80).cast("string")).alias("crime_count"),
        F.when(key % 503 == 7, "<null>").otherwise((key % 40).cast("string")).alias("University"),
        (F.lit(3) + key % 25).cast("string").alias("PT_GP"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin-destination shares: customer nation to supplier nation, share of the origin's spend in percent."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    per = (
        li.join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))
        .agg(F.sum("l_extendedprice").alias("spend"))
    )
    per = pin(per)
    total = per.groupBy("src").agg(F.sum("spend").alias("total"))
    return pin(per.join(total, "src").select("src", "dst", (F.col("spend") / F.col("total") * 100).alias("share")))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the customers of consecutive orders (a graph that grows)."""
    orders = table(spark, sf_dir, "orders")
    a = orders.select("o_orderkey", F.col("o_custkey").alias("src"))
    b = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("dst"))
    return a.join(b, "o_orderkey").filter("src <> dst").select("src", "dst").distinct()


GRID, STEP = 40, 100


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street segments between grid positions of customers, one per order, raw text attributes."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    reach = F.when(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), 6).otherwise(1)
    dx, dy = (k % 3 - 1) * reach, (F.floor(k / 3) % 3 - 1) * reach
    dx = F.when((dx == 0) & (dy == 0), reach * 2).otherwise(dx)
    i, j = F.col("o_custkey") % GRID, F.floor(F.col("o_custkey") / GRID)
    kinds = {
        "1-URGENT": "Primary",
        "2-HIGH": "cycleway",
        "3-MEDIUM": "residential",
        "4-NOT SPECIFIED": "footway",
        "5-LOW": "motorway",
    }
    fclass = F.coalesce(*[F.when(F.col("o_orderpriority") == p, F.lit(c)) for p, c in kinds.items()])
    return o.select(
        k.alias("seg_id"),
        (i * STEP).cast("double").alias("x1"),
        (j * STEP).cast("double").alias("y1"),
        ((i + dx) * STEP).cast("double").alias("x2"),
        ((j + dy) * STEP).cast("double").alias("y2"),
        fclass.alias("fclass"),
        F.when(F.col("o_orderstatus") == "F", "f").when(F.col("o_orderstatus") == "O", "T").alias("oneway"),
        F.when(k % 11 == 0, "1").when(k % 17 != 0, "0").alias("layer"),
        F.when(k % 11 == 0, "T").otherwise("F").alias("bridge"),
        F.when(k % 13 != 0, "F").alias("tunnel"),
    )


def depots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as points on the same plane as the street grid."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("SITE_"), F.lpad(k.cast("string"), 6, "0")).alias("site_id"),
        F.col("s_name").alias("site_name"),
        (k * 13 % 4000 + 7.3).alias("x"),
        (k * 29 % 3700 + 4.1).alias("y"),
        F.element_at(F.array(F.lit("gp"), F.lit("pharmacy"), F.lit("mobile_stop")), (k % 3 + 1).cast("int")).alias("site_type"),
        F.col("s_nationkey").alias("nationkey"),
        F.col("s_acctbal").alias("balance"),
    )


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as zone centroids on the street grid."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("zone"),
        n.alias("node_index"),
        (n % 5 * 700 + 351.5).alias("x"),
        (F.floor(n / 5) * 650 + 402.25).cast("double").alias("y"),
    )


def planning_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as planning zones with demand drivers derived from their customers."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        (F.count(F.lit(1)) * 100.0).alias("population"),
        (F.avg(F.abs("c_acctbal")) / 10000).alias("income_rate"),
        (F.avg(F.col("c_custkey") % 25) + 3).alias("pt_gp_min"),
        (F.avg("c_acctbal") / 10).alias("predicted_rate"),
        (F.stddev_pop("c_acctbal") / 100).alias("predicted_sigma"),
    )
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("zone"))
    return pin(n.join(c, "c_nationkey").drop("c_nationkey"))


def travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long zone x site x mode minutes: the smallest quantity a nation ever ordered from a supplier."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    least = (
        li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "l_suppkey", "l_linestatus")
        .agg(F.min("l_quantity").alias("q"))
    )
    return pin(
        least.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("n_name").alias("zone"),
            F.concat(F.lit("SITE_"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("site_id"),
            F.when(F.col("l_linestatus") == "O", "drive").otherwise("walk").alias("mode"),
            F.when(F.col("q") <= 30, F.col("q")).alias("minutes"),
        )
    )
