"""SQL twins of the views in ``zonewise.sources.tables``."""

REPORTS = """
SELECT CASE WHEN l_linenumber=7 THEN strftime(l_shipdate,'%Y%m%d')||'.0'
            WHEN l_linenumber=6 THEN 'on '||strftime(l_shipdate,'%Y-%m-%d')
            WHEN l_linenumber%2=0 THEN strftime(l_shipdate,'%Y%m%d')
            ELSE strftime(l_shipdate,'%Y-%m-%d') END AS "Date",
  'S020'||lpad(CAST(l_suppkey AS VARCHAR),6,'0') AS IntZone, 'Zone '||l_suppkey AS IntZoneName,
  'S12_'||l_returnflag AS CA,
  CASE WHEN l_returnflag='R' AND l_linenumber=1 THEN 'City old R' ELSE ' City '||l_returnflag END AS CAName,
  CASE WHEN l_discount=0.0 THEN '' WHEN CAST(l_quantity AS INT)<3 THEN 'c' WHEN CAST(l_quantity AS INT)=50 THEN 'n/a'
       WHEN CAST(l_quantity AS INT)=49 THEN 'inf' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS Positive7Day,
  CASE WHEN l_tax=0.08 AND CAST(l_quantity AS INT)<10 THEN 'C ' ELSE '' END AS Positive7DayQF,
  CASE WHEN l_discount=0.1 AND l_tax=0.0 THEN '' WHEN l_discount=0.0 AND l_tax=0.01 THEN '0'
       WHEN l_discount=0.0 AND l_tax=0.02 THEN '-10' ELSE CAST(1000+l_suppkey%500*10 AS VARCHAR) END AS Population,
  CASE WHEN l_tax<0.03 THEN '200 to 399' ELSE CAST(CAST(l_quantity AS INT)*90 AS VARCHAR) END AS CrudeRate7DayPositive,
  CASE WHEN CAST(l_quantity AS INT)<3 THEN 'c' ELSE '' END AS CrudeRate7DayPositiveQF,
  l_linenumber AS source_index, l_orderkey AS row_id
FROM lineitem"""

DATE = """coalesce(try_strptime(regexp_replace(trim("Date"),'\\.0$',''),'%Y%m%d'),
 try_strptime(regexp_replace(trim("Date"),'\\.0$',''),'%Y-%m-%d'))::DATE"""

TYPED = f"""rep AS ({REPORTS}),
typed AS (SELECT *, {DATE} AS d FROM rep),
cls AS (SELECT *, CASE WHEN lower(trim(Positive7DayQF))='c' OR lower(Positive7Day)='c' THEN 'disclosure_controlled_0_2'
    WHEN Positive7Day='' THEN 'true_missing_not_suppressed'
    WHEN TRY_CAST(Positive7Day AS DOUBLE) IS NULL OR isinf(TRY_CAST(Positive7Day AS DOUBLE)) THEN 'invalid_non_numeric_value'
    ELSE 'observed' END AS status FROM typed WHERE d IS NOT NULL),
pop AS (SELECT *, CASE WHEN TRY_CAST(Population AS DOUBLE)>0 THEN TRY_CAST(Population AS DOUBLE) END AS p,
    CASE WHEN status='observed' THEN TRY_CAST(Positive7Day AS DOUBLE) END AS nc FROM cls)"""

SCEN = f"""{TYPED},
scen AS (SELECT *, 'fill'||f AS scenario, CAST(CASE WHEN status='disclosure_controlled_0_2' THEN f ELSE nc END AS BIGINT) AS used
   FROM pop, (SELECT unnest([0,1,2]) AS f)),
rated AS (SELECT *, used/p*100000 AS rate FROM scen)"""

CELLS = """
SELECT date, 'S020'||lpad(CAST(l_suppkey AS VARCHAR),6,'0') AS zone, cases, (1000+l_suppkey%500*10)::DOUBLE AS population,
  CASE WHEN cases%11<>0 THEN cases/(1000+l_suppkey%500*10)::DOUBLE*100000 END AS rate
FROM (SELECT l_shipdate::DATE AS date, l_suppkey, sum(l_quantity) AS cases FROM lineitem GROUP BY ALL)"""

SUPPLIER_ZONES = "SELECT 'S020'||lpad(CAST(s_suppkey AS VARCHAR),6,'0') AS zone FROM supplier"

PANEL_DAILY = """
SELECT date, zone, cases, (5000+250*length(zone))::DOUBLE AS population, cases/(5000+250*length(zone))::DOUBLE*100000 AS rate
FROM (SELECT ts::DATE AS date, event_type AS zone, count(*) AS cases FROM events GROUP BY ALL)"""

PANEL_HOLES = """
SELECT date, zone, CASE WHEN NOT (day(date)%13=0 AND zone='u3') THEN cases/20000.0*100000 END::DOUBLE AS rate
FROM (SELECT ts::DATE AS date, 'u'||(user_id%10) AS zone, count(*) AS cases FROM events GROUP BY ALL)
WHERE NOT (day(date)=9 OR (day(date)=20 AND zone='u7'))"""

PANEL_REGION = """
SELECT zone, date, cases, 20000.0::DOUBLE AS population, cases/20000.0::DOUBLE*100000 AS rate FROM (
 SELECT zone, CAST(d + i AS DATE) AS date, CAST(sum(n) AS BIGINT) AS cases FROM (
   SELECT 'r'||n_regionkey AS zone, o_orderdate::DATE AS d, count(*) AS n
   FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON n_nationkey=c_nationkey GROUP BY ALL),
   (SELECT unnest(range(7))::INT AS i) GROUP BY ALL)
WHERE date >= (SELECT min(o_orderdate)::DATE+6 FROM orders) AND date <= (SELECT max(o_orderdate)::DATE FROM orders)"""

SMALL_AREAS = """
SELECT 'S010'||lpad(CAST(c_custkey AS VARCHAR),8,'0') AS area, c_nationkey AS nationkey,
 CASE WHEN c_custkey%97=0 THEN 0 ELSE 500+c_custkey%700 END::DOUBLE AS tot, (300+c_custkey%400)::DOUBLE AS wrk,
 (abs(floor(c_acctbal)::BIGINT)%200)::DOUBLE AS inc,
 CASE WHEN c_custkey%211=5 THEN NULL ELSE (abs(floor(c_acctbal)::BIGINT)%150)::DOUBLE END AS emp,
 (c_custkey%60)::DOUBLE AS ovr,
 CASE WHEN abs(floor(c_acctbal)::BIGINT)%10<2 THEN NULL ELSE (abs(floor(c_acctbal)::BIGINT)%80)::DOUBLE END AS crm,
 abs(floor(c_acctbal)::BIGINT)%10<2 AS hid,
 CASE WHEN c_custkey%503=7 THEN NULL ELSE (c_custkey%40)::DOUBLE END AS uni, (3+c_custkey%25)::DOUBLE AS gp
FROM customer"""

FLOWS = """
SELECT src, dst, spend/sum(spend) OVER (PARTITION BY src)*100 AS share FROM (
 SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_extendedprice) AS spend FROM lineitem JOIN supplier ON l_suppkey=s_suppkey
 JOIN orders ON o_orderkey=l_orderkey JOIN customer ON c_custkey=o_custkey GROUP BY ALL)"""

TRIPS = """
SELECT DISTINCT a.o_custkey AS src, b.o_custkey AS dst FROM orders a JOIN orders b ON b.o_orderkey=a.o_orderkey+1
WHERE a.o_custkey<>b.o_custkey"""

ROADS = """
SELECT seg_id, (i*100)::DOUBLE AS x1, (j*100)::DOUBLE AS y1,
 ((i+CASE WHEN dx=0 AND dy=0 THEN reach*2 ELSE dx END)*100)::DOUBLE AS x2, ((j+dy)*100)::DOUBLE AS y2, fclass, oneway, layer, bridge, tunnel FROM (
 SELECT o_orderkey AS seg_id, o_custkey%40 AS i, o_custkey//40 AS j, (o_orderkey%3-1)*reach AS dx, ((o_orderkey//3)%3-1)*reach AS dy, reach,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'primary' WHEN '2-HIGH' THEN 'cycleway' WHEN '3-MEDIUM' THEN 'residential'
   WHEN '4-NOT SPECIFIED' THEN 'footway' ELSE 'motorway' END AS fclass,
  CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'T' ELSE 'B' END AS oneway,
  CASE WHEN o_orderkey%11=0 THEN '1' WHEN o_orderkey%17<>0 THEN '0' END AS layer,
  CASE WHEN o_orderkey%11=0 THEN 'T' ELSE 'F' END AS bridge, CASE WHEN o_orderkey%13<>0 THEN 'F' END AS tunnel
 FROM (SELECT *, CASE WHEN o_orderpriority IN ('1-URGENT','5-LOW') THEN 6 ELSE 1 END AS reach FROM orders))"""

DEPOTS = """
SELECT 'SITE_'||lpad(CAST(s_suppkey AS VARCHAR),6,'0') AS site_id, s_suppkey*13%4000+7.3::DOUBLE AS x, s_suppkey*29%3700+4.1::DOUBLE AS y,
 (['gp','pharmacy','mobile_stop'])[s_suppkey%3+1] AS site_type, s_nationkey AS nationkey, s_acctbal AS balance FROM supplier"""

CENTROIDS = """
SELECT n_name AS zone, n_nationkey AS node_index, n_nationkey%5*700+351.5::DOUBLE AS x, (n_nationkey//5)*650+402.25::DOUBLE AS y FROM nation"""

PLANNING_ZONES = """
SELECT n_name AS zone, count(*)*100.0::DOUBLE AS population, avg(abs(c_acctbal))/10000 AS income_rate, avg(c_custkey%25)+3 AS pt_gp_min,
 avg(c_acctbal)/10 AS predicted_rate, stddev_pop(c_acctbal)/100 AS predicted_sigma FROM customer JOIN nation ON n_nationkey=c_nationkey GROUP BY 1"""

TRAVEL = """
SELECT n_name AS zone, 'SITE_'||lpad(CAST(l_suppkey AS VARCHAR),6,'0') AS site_id, CASE WHEN l_linestatus='O' THEN 'drive' ELSE 'walk' END AS mode,
 CASE WHEN min(l_quantity)<=30 THEN min(l_quantity) END AS minutes FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN customer ON c_custkey=o_custkey
 JOIN nation ON n_nationkey=c_nationkey GROUP BY n_name, l_suppkey, l_linestatus"""

BLOCK = "'b'||lpad((({0}//100)::BIGINT)::VARCHAR,9,'0')"

PANEL_BLOCKS = f"""
SELECT date, zone, cases, 100000.0::DOUBLE AS population, cases::DOUBLE AS rate FROM (
 SELECT zone, date, CAST(1000+sum(coalesce(net,0)) OVER (PARTITION BY zone ORDER BY date ROWS BETWEEN 179 PRECEDING AND CURRENT ROW) AS BIGINT) AS cases FROM
  (SELECT zone, d::DATE AS date FROM (SELECT DISTINCT {BLOCK.format('c_custkey')} AS zone FROM customer),
    (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY)) AS d FROM orders))
  LEFT JOIN (SELECT {BLOCK.format('o_custkey')} AS zone, o_orderdate::DATE AS date, sum(CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1
    WHEN o_orderpriority IN ('4-NOT SPECIFIED','5-LOW') THEN -1 ELSE 0 END) AS net FROM orders GROUP BY ALL) USING (zone, date))"""

BLOCK_FEATURES = f"""SELECT {BLOCK.format('c_custkey')} AS zone, avg(abs(floor(c_acctbal)::BIGINT)%200) AS income, avg(abs(floor(c_acctbal)::BIGINT)%80) AS crime,
  avg(c_nationkey) AS access, ((min(c_custkey)//100)%7)::DOUBLE AS x, ((min(c_custkey)//100)//7)::DOUBLE AS y FROM customer GROUP BY 1"""

BLOCK_LINKS = f"""SELECT {BLOCK.format('a.o_custkey')} AS src, {BLOCK.format('b.o_custkey')} AS dst, count(*)::DOUBLE AS weight
 FROM orders a JOIN orders b ON b.o_orderkey=a.o_orderkey+1
 WHERE abs(a.o_custkey//100-b.o_custkey//100) BETWEEN 1 AND 2 GROUP BY ALL"""


def block_supports(directions: str = "fb") -> str:
    """CTE ``sup(direction, r, c, w)`` over ``eg``: shares of a node's weight, transposed."""
    f = "SELECT 'f' AS direction, dst AS r, src AS c, weight/sum(weight) OVER (PARTITION BY src) AS w FROM eg"
    b = "SELECT 'b' AS direction, src AS r, dst AS c, weight/sum(weight) OVER (PARTITION BY dst) AS w FROM eg"
    return f"eg AS ({BLOCK_LINKS}), sup AS ({f} UNION ALL {b})"
