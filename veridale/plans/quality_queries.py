"""Data-quality queries: events are the rows of a document per user, in the order of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import quality as q
from .registry import query


def _values(t):
    e = t("events").select(F.col("user_id").alias("doc"), F.lit("value").alias("col"), F.struct("ts", "event_id").alias("row"), F.col("value").alias("v"), "event_id", "event_type")
    return e


W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query("dq1_melt", "SELECT l_orderkey AS doc, l_linenumber AS row, c.col, CASE c.col WHEN 'l_quantity' THEN l_quantity WHEN 'l_tax' THEN l_tax ELSE l_discount END AS v FROM lineitem CROSS JOIN (VALUES ('l_quantity'),('l_tax'),('l_discount')) AS c(col)")
def dq1(t):
    return q.melted(t("lineitem"), ["l_quantity", "l_tax", "l_discount"], "l_orderkey", "l_linenumber")


@query("dq2_exempt", "SELECT user_id AS doc, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'view') GROUP BY 1")
def dq2(t):
    e = t("events")
    exempt = e.sparkSession.createDataFrame([("error",), ("view",)], "event_type string")
    return e.join(exempt, "event_type", "left_anti").groupBy(F.col("user_id").alias("doc")).agg(F.count(F.lit(1)).alias("n"))


@query("dq3_row_count", """WITH c AS (SELECT o_orderkey AS doc, o_custkey % 8 AS expected FROM orders), n AS (SELECT l_orderkey AS doc, count(*) AS n FROM lineitem GROUP BY 1)
SELECT c.doc, coalesce(n, 0) AS n, expected, CASE WHEN coalesce(n, 0) = 0 THEN 'DQ-SELF-ROW-02' WHEN n <> expected THEN 'DQ-SELF-ROW-01' END AS code FROM c LEFT JOIN n ON c.doc = n.doc""")
def dq3(t):
    return q.row_count_check(t("lineitem").select(F.col("l_orderkey").alias("doc")), t("orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 8).alias("expected")))


@query("dq4_duplicates", "SELECT doc, id, row FROM (SELECT l_orderkey AS doc, l_suppkey % 10 AS id, l_linenumber AS row, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 10 ORDER BY l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem) WHERE k > 1")
def dq4(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 10).alias("id"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("row"))
    return q.duplicates(rows).select("doc", "id", F.col("row.l_linenumber").alias("row"))


@query("dq5_length", "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_extendedprice - l_quantity * 1500) AS diff FROM lineitem WHERE abs(l_extendedprice - l_quantity * 1500) > 20000")
def dq5(t):
    return q.formula_mismatch(t("lineitem"), F.col("l_extendedprice"), F.col("l_quantity") * 1500, 20000).select("l_orderkey", "l_linenumber", "l_partkey", "diff")


@query("dq6_coefficient", "SELECT p_partkey, abs(p_retailprice - 20000 / (pi() * (p_size / 2.0) * (p_size / 2.0))) AS diff FROM part WHERE p_size > 0 AND abs(p_retailprice - 20000 / (pi() * (p_size / 2.0) * (p_size / 2.0))) > 1000")
def dq6(t):
    half = F.col("p_size") / 2
    return q.formula_mismatch(t("part"), F.col("p_retailprice"), F.try_divide(F.lit(20000.0), F.pi() * half * half), 1000).select("p_partkey", "diff")


ALTERNATES = f"""
WITH w AS (SELECT user_id AS doc, event_type AS v, lead(event_type, 1) {W} AS b, lead(event_type, 2) {W} AS c, lead(event_type, 3) {W} AS d FROM events),
alt AS (SELECT doc, coalesce(bool_or(v = c AND b = d AND v <> b), false) AS alternates FROM w GROUP BY 1)
"""


@query("dq8_alternating", ALTERNATES + "SELECT doc, alternates FROM alt")
def dq8(t):
    return q.alternating(_values(t).withColumn("v", F.col("event_type"))).select("doc", "alternates")


@query("dq7_repeats", """
WITH v AS (SELECT l_orderkey AS doc, l_linenumber AS row, l_partkey, l_extendedprice, CAST(l_quantity AS BIGINT) % 3 AS v FROM lineitem),
w AS (SELECT *, lead(v, 1) OVER o AS b, lead(v, 2) OVER o AS c, lead(v, 3) OVER o AS d FROM v WINDOW o AS (PARTITION BY doc ORDER BY row, l_partkey, l_extendedprice)),
g AS (SELECT doc, count(*) AS n, count(DISTINCT v) AS kinds, coalesce(bool_or(v = c AND b = d AND v <> b), false) AS alt FROM w GROUP BY 1 HAVING count(*) >= 4),
r AS (SELECT doc, n, kinds, CASE WHEN kinds = 2 AND alt THEN 'DQ-REPEAT-01' WHEN kinds = 2 THEN 'DQ-REPEAT-02' WHEN kinds = 1 THEN 'DQ-REPEAT-03' WHEN kinds < 0.3 * n THEN 'DQ-REPEAT-04' END AS code FROM g)
SELECT * FROM r WHERE code IS NOT NULL""")
def dq7(t):
    v = t("lineitem").select(F.col("l_orderkey").alias("doc"), F.lit("q").alias("col"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("row"), (F.col("l_quantity").cast("long") % 3).alias("v"))
    return q.repeats(v).drop("col")


@query("dq9_jumps", f"""SELECT doc, event_id, from_value, v AS to_value, abs(v - from_value) / abs(from_value) AS change, CASE WHEN abs(v - from_value) / abs(from_value) >= 0.5 THEN 'high' ELSE 'medium' END AS severity
FROM (SELECT user_id AS doc, event_id, event_type, value AS v, lag(value) {W} AS from_value FROM events) WHERE from_value <> 0 AND event_type <> 'error' AND abs(v - from_value) / abs(from_value) >= 0.3""")
def dq9(t):
    found = q.jumps(_values(t), 0.3, F.col("event_type") == "error")
    return found.select("doc", F.col("row.event_id").alias("event_id"), "from_value", "to_value", "change", "severity")


@query("dq10_time_order", f"""SELECT doc, event_id FROM (SELECT user_id AS doc, event_id, ts AS s, lag(ts + INTERVAL 1 HOUR) {W} AS e FROM events) WHERE s < e""")
def dq10(t):
    spans = t("events").select(F.col("user_id").alias("doc"), F.struct("ts", "event_id").alias("row"), F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 1 hour")).alias("end"))
    return q.time_order(spans).select("doc", F.col("row.event_id").alias("event_id"))


@query("dq11_run", f"""WITH j AS (SELECT user_id AS doc, value AS v, lag(value) {W} AS p FROM events), f AS (SELECT doc, CASE WHEN abs(v - p) / abs(p) >= 0.5 THEN 'high' ELSE 'medium' END AS severity FROM j WHERE p <> 0 AND abs(v - p) / abs(p) >= 0.3)
SELECT doc, count(*) FILTER (WHERE severity = 'high') AS errors, count(*) FILTER (WHERE severity <> 'high') AS warnings, CASE WHEN count(*) FILTER (WHERE severity = 'high') > 0 THEN 'error' ELSE 'warning' END AS status FROM f GROUP BY 1""")
def dq11(t):
    return q.summary(q.jumps(_values(t)))


PREFIX = "CASE WHEN o_orderkey % 7 < 5 THEN 'Z' ELSE '2' END || o_orderkey"


@query("dq12_prefix", f"""WITH i AS (SELECT o_custkey AS doc, o_orderkey AS row, {PREFIX} AS id FROM orders), s AS (SELECT *, avg(CASE WHEN id LIKE 'Z%' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY doc) AS share, count(*) OVER (PARTITION BY doc) AS n FROM i)
SELECT doc, row, id, 'Z' || substr(id, 2) AS suspected, CASE WHEN share > 0.7 THEN 'high' ELSE 'medium' END AS confidence FROM s WHERE n >= 3 AND share > 0.5 AND id LIKE '2%'""")
def dq12(t):
    ids = t("orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("row"), F.concat(F.when(F.col("o_orderkey") % 7 < 5, "Z").otherwise("2"), F.col("o_orderkey").cast("string")).alias("id"))
    return q.prefix_confusion(ids, "Z", "2")


@query("dq14_range", "SELECT l_orderkey, l_linenumber, l_partkey, l_tax FROM lineitem WHERE l_tax > 0.06")
def dq14(t):
    return t("lineitem").where("l_tax > 0.06").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax")


ONE_APART = "length(a) = length(b) AND length(a) > 0 AND list_sum(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN substr(a, i::INT, 1) <> substr(b, i::INT, 1) THEN 1 ELSE 0 END)) = 1"


@query("dq16_one_digit", f"""WITH w AS (SELECT user_id AS doc, event_id, CAST(CAST(value AS BIGINT) AS VARCHAR) AS a, lag(CAST(CAST(value AS BIGINT) AS VARCHAR)) {W} AS b FROM events)
SELECT doc, event_id, b AS before, a AS after FROM w WHERE b IS NOT NULL AND {ONE_APART}""".replace("CAST(value AS BIGINT)", "CAST(trunc(value) AS BIGINT)"))
def dq16(t):
    v = _values(t).withColumn("a", F.col("v").cast("long").cast("string"))
    from pyspark.sql import Window

    v = v.withColumn("b", F.lag("a").over(Window.partitionBy("doc").orderBy("row")))
    return v.where(F.col("b").isNotNull() & x.one_character_apart(F.col("a"), F.col("b"))).select("doc", "event_id", F.col("b").alias("before"), F.col("a").alias("after"))


@query("dq17_letters", """SELECT c_custkey, m.letter, replace(c_mktsegment || c_custkey, m.letter, m.digit) AS suspected FROM customer JOIN (VALUES ('O','0'),('o','0'),('l','1'),('I','1'),('S','5'),('s','5'),('B','8')) AS m(letter, digit) ON contains(c_mktsegment || c_custkey, m.letter)""")
def dq17(t):
    return q.letters_in_numbers(t("customer").select("c_custkey", F.concat("c_mktsegment", F.col("c_custkey").cast("string")).alias("value"))).select("c_custkey", "letter", "suspected")


@query("dq18_counts", "SELECT CASE WHEN l_tax > 0.07 THEN 'high' ELSE 'medium' END AS confidence, count(*) AS n FROM lineitem WHERE l_tax > 0.05 GROUP BY 1")
def dq18(t):
    return t("lineitem").where("l_tax > 0.05").groupBy(F.when(F.col("l_tax") > 0.07, "high").otherwise("medium").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


GAPS = "SELECT doc, n + 1 AS range_start, after - 1 AS range_end, after - n - 1 AS missing FROM (SELECT doc, n, lead(n) OVER (PARTITION BY doc ORDER BY n) AS after FROM (SELECT DISTINCT {doc} AS doc, {n} AS n FROM {t})) WHERE after - n > 1"


@query("dq19_gaps", GAPS.format(doc="o_orderpriority", n="o_custkey", t="orders"))
def dq19(t):
    return q.gaps(t("orders").select(F.col("o_orderpriority").alias("doc"), F.col("o_custkey").alias("n")))


@query("dq20_id_parse", "SELECT p_partkey, CAST(regexp_extract(p_brand, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS number FROM part")
def dq20(t):
    return t("part").select("p_partkey", x.trailing_number(F.col("p_brand")).alias("number"))


@query("dq21_date_gaps", "SELECT doc, DATE '1970-01-01' + CAST(range_start AS INT) AS range_start, DATE '1970-01-01' + CAST(range_end AS INT) AS range_end, missing FROM (" + GAPS.format(doc="o_custkey", n="date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))", t="orders") + ")")
def dq21(t):
    return q.date_gaps(t("orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderdate").cast("date").alias("d")))


SWAPPED = "list_transform(list_filter(range(1, length(s) + 1), lambda i: substr(s, i::INT, 1) = '{a}'), lambda i: TRY_CAST(substr(s, 1, i::INT - 1) || '{b}' || substr(s, i::INT + 1) AS DOUBLE))"


@query("dq13_candidates", f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 20 + 0.06 AS v, printf('%.2f', l_discount * 20 + 0.06) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, v, list_sort(list_distinct(list_filter(CASE WHEN v < 1.0 THEN list_concat({SWAPPED.format(a=0, b=4)}, {SWAPPED.format(a=0, b=6)}) ELSE {SWAPPED.format(a=9, b=3)} END, lambda x: x >= 1.0 AND x <= 1.6))) AS candidates FROM v WHERE v < 1.0 OR v > 1.6""")
def dq13(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") * 20 + 0.06).alias("v"))
    return q.range_confusion(rows, 1.0, 1.6).select("l_orderkey", "l_linenumber", "l_partkey", "v", "candidates")


@query("dq15_near_miss", "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_quantity - l_linenumber * 7) AS diff FROM lineitem WHERE abs(l_quantity - l_linenumber * 7) BETWEEN 0.5 AND 2.0 AND l_returnflag <> 'R'")
def dq15(t):
    diff = F.abs(F.col("l_quantity") - F.col("l_linenumber") * 7)
    return t("lineitem").where(diff.between(0.5, 2.0) & (F.col("l_returnflag") != "R")).select("l_orderkey", "l_linenumber", "l_partkey", diff.alias("diff"))
