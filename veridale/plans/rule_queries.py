"""Rule engine queries on the generated tables.

Orders and their line items stand for two parties that report on one key; line items for rows of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as r
from .registry import query

DEC = "CAST({} AS DECIMAL(18,2))"
LINE_RULES = [
    r.Rule("LN-001", "SINGLE_DOC", "L2", "Sanity Check", "abs(l_extendedprice - l_quantity * 1500) <= 30000", "line {l_linenumber}: price {l_extendedprice}, {missing}", ("l_extendedprice", "l_quantity"), ("A", "R")),
    r.Rule("LN-002", "SINGLE_DOC", "L1", "Fatal", "try_divide(l_tax, l_discount) <= 2", "tax {l_tax} on {l_discount}", ("l_tax", "l_discount"), ("N",)),
    r.Rule("LN-003", "SINGLE_DOC", "L3", "Best Practice", "l_comment is not null", "no comment", ("l_comment",), ("A", "N", "R")),
    r.Rule("LN-004", "SINGLE_DOC", "L2", "Fatal", "l_quantity < 1", "never", (), ("*",)),
    r.Rule("LN-005", "SINGLE_DOC", "L2", "Fatal", "l_quantity < 1", "draft", (), ("A",), "draft"),
    r.Rule("LN-006", "CROSS_DOC", "L3", "Best Practice", "l_quantity <= 48", "many: {l_quantity}"),
]
CU = r.Rule("CU-001", "CROSS_UNIT", "L2", "Sanity Check", "try_divide(abs(field_a - field_b), greatest(field_a, field_b)) <= 0.05", join_keys=("key",), field_a="value", field_b="value")


def _lines(t):
    """Line items as rows: document type by flag, row_index in the order of line numbers."""
    return t("lineitem").select("*", F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("doc_type"), F.col("l_linenumber").alias("row_index"))


def _parties(t):
    a = t("orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    b = t("lineitem").where("l_linenumber <> 3").groupBy(F.col("l_orderkey").alias("key")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("value"))
    return a, b


RECONCILED = """
WITH a AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS va FROM orders),
b AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS vb FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1),
j AS (SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS key, CAST(va AS DOUBLE) AS field_a, CAST(vb AS DOUBLE) AS field_b,
  CASE WHEN a.k IS NULL THEN 'b' WHEN b.k IS NULL THEN 'a' ELSE 'both' END AS side FROM a FULL OUTER JOIN b ON a.k = b.k),
s AS (SELECT *, CASE WHEN side <> 'both' THEN 'Best Practice'
  WHEN abs(field_a - field_b) / greatest(field_a, field_b) > 0.05 THEN 'Sanity Check' END AS severity FROM j)
"""


def _reconciled(t):
    a, b = _parties(t)
    double = lambda x: x.withColumn("value", F.col("value").cast("double"))
    return r.reconciled(double(a), double(b), CU)


@query("re13_cross_unit", RECONCILED + "SELECT key, field_a, field_b, side, severity FROM s WHERE severity IS NOT NULL")
def re13(t):
    return _reconciled(t).where("severity is not null").select("key", "field_a", "field_b", "side", "severity")


@query("re15_pairs", RECONCILED + "SELECT side, severity, count(*) AS n FROM s GROUP BY 1, 2")
def re15(t):
    return _reconciled(t).groupBy("side", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("re16_deviation", RECONCILED + "SELECT key, abs(field_a - field_b) * 100 / greatest(abs(field_a), abs(field_b)) AS deviation FROM s WHERE side = 'both'")
def re16(t):
    return _reconciled(t).where("side = 'both'").select("key", "deviation")


@query("re17_missing", RECONCILED + "SELECT side, key, coalesce(field_a, field_b) AS available FROM s WHERE side <> 'both'")
def re17(t):
    return _reconciled(t).where("side <> 'both'").select("side", "key", F.coalesce("field_a", "field_b").alias("available"))


@query("re14_null_keys", """
WITH a AS (SELECT coalesce(CAST(nullif(o_custkey % 50, 0) AS VARCHAR), '') || '||' || o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT coalesce(CAST(nullif(c_custkey % 70, 0) AS VARCHAR), '') || '||' || '5-LOW' AS key, count(*) AS n FROM customer GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, a.n AS a, b.n AS b FROM a FULL OUTER JOIN b ON a.key = b.key""")
def re14(t):
    key = r.key_of(("x", "y")).alias("key")
    a = t("orders").select(F.expr("nullif(o_custkey % 50, 0)").alias("x"), F.col("o_orderpriority").alias("y")).groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    b = t("customer").select(F.expr("nullif(c_custkey % 70, 0)").alias("x"), F.lit("5-LOW").alias("y")).groupBy(key).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "key", "full_outer")


SINGLE = """
WITH v AS (
SELECT l_orderkey AS doc_id, l_linenumber AS row_index, 'LN-001' AS rule_id, 'L2' AS level, 'Sanity Check' AS severity FROM lineitem
  WHERE l_returnflag IN ('A', 'R') AND NOT abs(l_extendedprice - l_quantity * 1500) <= 30000
UNION ALL SELECT l_orderkey, l_linenumber, 'LN-002', 'L1', 'Fatal' FROM lineitem WHERE l_returnflag = 'N' AND l_discount <> 0 AND NOT l_tax / l_discount <= 2)
"""


@query("re10_single_doc", SINGLE + "SELECT * FROM v")
def re10(t):
    return r.checked_rows(_lines(t), [x for x in LINE_RULES if x.scope == "SINGLE_DOC"]).select("doc_id", "row_index", "rule_id", "level", "severity")


@query("re8_fail_open", "SELECT count(*) FILTER (WHERE l_discount = 0) AS unknown, count(*) FILTER (WHERE l_discount <> 0 AND l_tax / l_discount <= 2) AS held, count(*) FILTER (WHERE l_discount <> 0 AND l_tax / l_discount > 2) AS failed FROM lineitem")
def re8(t):
    check = F.expr(LINE_RULES[1].check)
    return t("lineitem").agg(F.count_if(check.isNull()).alias("unknown"), F.count_if(check).alias("held"), F.count_if(~r.holds(LINE_RULES[1].check)).alias("failed"))


@query("re9_message", "SELECT l_orderkey AS doc_id, l_linenumber AS row_index, 'line ' || l_linenumber || ': flag ' || l_returnflag || ', {missing}' AS message FROM lineitem WHERE l_quantity > 45")
def re9(t):
    rows = _lines(t).where("l_quantity > 45")
    return rows.select("doc_id", "row_index", r.message("line {l_linenumber}: flag {l_returnflag}, {missing}", rows.columns).alias("message"))


@query("re12_cross_doc", "SELECT l_orderkey AS doc_id, l_linenumber AS row_index, 'LN-006' AS rule_id FROM lineitem WHERE l_quantity > 48")
def re12(t):
    return r.checked_rows(_lines(t), [x for x in LINE_RULES if x.scope == "CROSS_DOC"]).select("doc_id", "row_index", "rule_id")


@query("re18_report", SINGLE + """
SELECT p.part, p.name, coalesce(g.n, 0) AS n FROM (VALUES ('total','all'),('level','L1'),('level','L2'),('level','L3'),('severity','Fatal'),('severity','Sanity Check'),('severity','Best Practice')) AS p(part, name)
LEFT JOIN (SELECT 'total' AS part, 'all' AS name, count(*) AS n FROM v UNION ALL SELECT 'level', level, count(*) FROM v GROUP BY level UNION ALL SELECT 'severity', severity, count(*) FROM v GROUP BY severity) g
ON p.part = g.part AND p.name = g.name""")
def re18(t):
    return r.report(re10(t))


@query("re19_findings", SINGLE + "SELECT rule_id, CASE severity WHEN 'Fatal' THEN 'fail' WHEN 'Sanity Check' THEN 'suspicious' ELSE 'pass' END AS result, count(*) AS n FROM v GROUP BY 1, 2")
def re19(t):
    return r.findings(re10(t)).groupBy("rule_id", "result").agg(F.count(F.lit(1)).alias("n"))


@query("re20_snapshot", "SELECT l_orderkey AS doc_id, l_linenumber AS row_index, '{\"l_orderkey\":' || l_orderkey || ',\"l_returnflag\":\"' || l_returnflag || '\"}' AS context FROM lineitem WHERE l_returnflag = 'R'")
def re20(t):
    return _lines(t).where("l_returnflag = 'R'").select("doc_id", "row_index", r.snapshot(["l_orderkey", "l_returnflag"]).alias("context"))


@query("re21_driver", SINGLE + """, c AS (SELECT * FROM v UNION ALL SELECT l_orderkey, l_linenumber, 'LN-006', 'L3', 'Best Practice' FROM lineitem WHERE l_quantity > 48)
SELECT level, severity, rule_id, count(*) AS n, count(DISTINCT doc_id) AS docs FROM c GROUP BY 1, 2, 3""")
def re21(t):
    return r.checked_rows(_lines(t), LINE_RULES).groupBy("level", "severity", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("re11_derived", "SELECT p_partkey, CAST(p_retailprice - p_size AS DOUBLE) AS computed, CASE WHEN p_size > 0 THEN CAST(round(CAST(p_retailprice / (pi() * (p_size / 2.0) * (p_size / 2.0) * 10) AS DECIMAL(18,9)), 6) AS DOUBLE) END AS expected_coeff FROM part")
def re11(t):
    rows = t("part").select("p_partkey", F.col("p_retailprice").alias("top_elev"), F.col("p_size").alias("bottom_elev"), F.col("p_retailprice").alias("volume"), F.col("p_size").alias("diameter"), F.lit(10.0).alias("actual_length"))
    return r.derived(rows).select("p_partkey", "computed", F.round(F.col("expected_coeff").cast("decimal(18,9)"), 6).cast("double").alias("expected_coeff"))


RULE_TABLE = "SELECT 'LG-' || o_orderkey AS rule_id, CASE o_orderstatus WHEN 'F' THEN 'draft' WHEN 'O' THEN 'active' ELSE 'testing' END AS status, o_orderpriority AS scope, o_custkey FROM orders"


def _rule_table(t):
    """A rule for each order; those of every third customer are for that customer's project only."""
    status = F.when(F.col("o_orderstatus") == "F", "draft").when(F.col("o_orderstatus") == "O", "active").otherwise("testing")
    projects = F.when(F.col("o_custkey") % 3 == 0, F.array(F.concat(F.lit("P"), (F.col("o_custkey") % 10).cast("string")))).otherwise(F.array(F.lit("global")))
    return t("orders").select(F.concat(F.lit("LG-"), F.col("o_orderkey").cast("string")).alias("rule_id"), status.alias("status"), F.col("o_orderpriority").alias("scope"), projects.alias("projects"))


@query("re2_active", f"SELECT rule_id, o_custkey % 3 > 0 AS everywhere FROM ({RULE_TABLE}) WHERE status = 'active' AND (o_custkey % 3 > 0 OR o_custkey % 10 = 6)")
def re2(t):
    """Active rules, for all projects or for P6."""
    return r.active(_rule_table(t), "P6").select("rule_id", F.array_contains("projects", "global").alias("everywhere"))


@query("re4_match_type", """SELECT DISTINCT l_orderkey AS doc_id, m.rule_id FROM lineitem JOIN
(VALUES ('LN-001','A'),('LN-001','R'),('LN-002','N'),('LN-003','A'),('LN-003','N'),('LN-003','R'),('LN-004','*'),('LN-005','A')) AS m(rule_id, doc_type) ON l_returnflag = m.doc_type""")
def re4(t):
    return r.matching_type(r.as_frame(t("region").sparkSession, LINE_RULES), _lines(t))


@query("re6_pairs_present", "SELECT o_custkey AS project FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O')")
def re6(t):
    o = t("orders").select(F.col("o_custkey").alias("project"), "o_orderstatus")
    party = lambda s: o.where(F.col("o_orderstatus") == s).select("project").distinct()
    return party("F").join(party("O"), "project", "left_semi")


@query("re7_by_scope", f"SELECT rule_id, status FROM ({RULE_TABLE}) WHERE scope = '1-URGENT'")
def re7(t):
    return r.of_scope(_rule_table(t), "1-URGENT").select("rule_id", "status")
