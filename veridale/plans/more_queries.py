"""The remaining operators of the inventory on the generated tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import classify as c
from ..operators import cluster as cl
from ..operators import lifecycle as lc
from ..operators import review as rv
from ..operators import rule_documents as rd
from ..operators import rules as r
from ..operators import tables as tab
from . import log_queries, rule_queries
from .registry import query

ORDER_RULES = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'R' || o_orderkey ELSE 'LG-' || o_orderkey END AS rule_id, CASE WHEN o_custkey % 5 = 0 THEN 'ROW' ELSE 'CROSS_DOC' END AS scope, 'L' || (o_custkey % 4 + 1) AS level, CASE o_orderstatus WHEN 'F' THEN 'draft' WHEN 'O' THEN 'active' ELSE 'gone' END AS status FROM orders"


def _rules(t):
    return t("orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("R"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("LG-"), F.col("o_orderkey").cast("string"))).alias("rule_id"),
        F.when(F.col("o_custkey") % 5 == 0, "ROW").otherwise("CROSS_DOC").alias("scope"), F.concat(F.lit("L"), (F.col("o_custkey") % 4 + 1).cast("string")).alias("level"), F.lit("Fatal").alias("severity"),
        F.when(F.col("o_orderstatus") == "F", "draft").when(F.col("o_orderstatus") == "O", "active").otherwise("gone").alias("status"), F.lit("true").alias("check"))


@query("re1_rule_records", f"WITH r AS ({ORDER_RULES}) SELECT scope, level, count(*) AS n FROM r GROUP BY 1, 2")
def re1(t):
    return _rules(t).groupBy("scope", "level").agg(F.count(F.lit(1)).alias("n"))


@query("re3_by_id", f"WITH r AS ({ORDER_RULES}) SELECT rule_id, level FROM r WHERE rule_id = 'LG-12'")
def re3(t):
    return r.by_id(_rules(t), "LG-12").select("rule_id", "level")


@query("re5_by_profession", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = '1-URGENT'")
def re5(t):
    return r.matching(t("orders").select("o_orderkey", F.array("o_orderpriority", "o_orderstatus").alias("professional")), "professional", "1-URGENT").select("o_orderkey")


@query("lc41_validate", f"WITH r AS ({ORDER_RULES}) SELECT o_orderkey, concat_ws(',', CASE WHEN NOT regexp_full_match(rule_id, '[A-Z]{{2,3}}-[0-9]+') THEN 'rule_id' END, CASE WHEN scope = 'ROW' THEN 'scope' END, CASE WHEN level = 'L4' THEN 'level' END, CASE WHEN status = 'gone' THEN 'status' END) AS errors FROM r")
def lc41(t):
    return _rules(t).select("o_orderkey", F.array_join(r.rule_errors(), ",").alias("errors"))


#: A rule document for each order with something wrong by its key; the same expression in both engines.
RULE_DOCUMENT = """CASE WHEN o_orderkey % 53 = 0 THEN '[1]' WHEN o_orderkey % 59 = 0 THEN '{broken' ELSE concat('{',
CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '"name":"n",' END, CASE WHEN o_orderkey % 7 = 0 THEN '"rule_id":"lg 1",' ELSE '"rule_id":"LG-1",' END,
CASE o_orderkey % 5 WHEN 0 THEN '"level":"L9",' WHEN 1 THEN '"level":null,' ELSE '"level":"L2-LOGIC",' END, CASE WHEN o_custkey % 3 = 0 THEN '"scope":"CROSS_UNIT",' ELSE '"scope":"CROSS_DOC",' END,
CASE o_custkey % 4 WHEN 0 THEN '"trigger_when":{"doc_type_a":"a","doc_type":["x"]},' WHEN 1 THEN '"trigger_when":{"doc_type":"x"},' WHEN 2 THEN '"trigger_when":7,' ELSE '"trigger_when":{"doc_type_a":"a","doc_type_b":"b","doc_type":[]},' END,
CASE o_orderkey % 3 WHEN 0 THEN '"check_expr":{"type":"expression","expr":"a > 1"},' WHEN 1 THEN '"check_expr":{"type":"other"},' ELSE '"check_expr":[],' END,
CASE WHEN o_orderkey % 13 = 0 THEN '"error_template":"",' ELSE '"error_template":"t",' END, '"status":"', CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'draft' ELSE 'gone' END, '","source":', CASE WHEN o_orderkey % 17 = 0 THEN '3' ELSE '"system"' END,
',"version":"1.', CASE WHEN o_orderkey % 19 = 0 THEN 'x' ELSE '0.2' END, '","created_at":"2026-01-01', CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'T10:00:00+08:00' WHEN 2 THEN ' 10:00' ELSE 'Z' END, '","updated_at":"2026-01-01T00:00:00Z"',
CASE o_custkey % 5 WHEN 0 THEN ',"severity_on_violation":"Bad"' WHEN 1 THEN ',"severity_on_violation":null' ELSE ',"severity_on_violation":"Fatal"' END,
CASE o_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN ',"changelog":{}' WHEN 2 THEN ',"changelog":[{"version":"1","date":"d","author":"a","change":null},{"version":"1"}]' WHEN 3 THEN ',"changelog":[1]' ELSE ',"changelog":[{"version":"1","date":"d","author":"a","change":"c"}]' END,
CASE o_orderkey % 6 WHEN 0 THEN ',"stats":{"total_hits":-1,"hit_rate":0.5}' WHEN 1 THEN ',"stats":{"total_hits":1.5,"total_reviews":null,"false_positive_rate":-0.1}' WHEN 2 THEN ',"stats":"none"' WHEN 3 THEN ',"stats":{"false_positive_count":true,"hit_rate":2}' ELSE '' END,
CASE o_orderkey % 8 WHEN 0 THEN ',"alignment":null' WHEN 1 THEN ',"alignment":{"party_a":{"role":"r","doc_type":"d"},"party_b":{"role":"r"},"join_key":["k"]}' WHEN 2 THEN ',"alignment":{"party_a":{"role":"r","doc_type":"d"},"party_b":{"role":"r","doc_type":"e"},"join_key":[]},"confirmation_required":true'
WHEN 3 THEN ',"alignment":{"party_b":{"role":"r","doc_type":"e"},"join_key":["k",1]},"confirmation_required":"true"' WHEN 4 THEN ',"alignment":"x"' WHEN 5 THEN ',"alignment":{"party_a":{"role":"r","doc_type":"d"},"party_b":{"role":"r","doc_type":"e"},"join_key":["k"]},"confirmation_required":true' ELSE '' END, '}') END"""


def _error_sql() -> str:
    """The format's constraints by DuckDB's JSON functions."""
    kind = lambda p: f"coalesce(json_type(j, '$.{p}'), '')"
    said = lambda p: f"(CASE WHEN {kind(p)} = 'VARCHAR' THEN json_extract_string(j, '$.{p}') END)"
    listed = lambda of: "(" + ", ".join(f"'{x}'" for x in of) + ")"
    wrong = lambda p, of: f"{kind(p)} <> '' AND NOT coalesce({said(p)} IN {listed(of)}, false)"
    empty = lambda p: f"NOT coalesce({said(p)} <> '', false)"
    odd = lambda p, pattern: f"NOT coalesce(regexp_matches({said(p)}, '{pattern}'), true)"
    unit = f"coalesce({said('scope')} = 'CROSS_UNIT', false)"
    below = lambda p, kinds: f"{kind('stats')} = 'OBJECT' AND {kind('stats.' + p)} NOT IN ('', 'NULL') AND NOT ({kind('stats.' + p)} IN {listed(kinds)} AND coalesce(TRY_CAST(json_extract_string(j, '$.stats.{p}') AS DOUBLE) >= 0, false))"
    lacks = " OR ".join(f"json_type(x, '$.{k}') IS NULL" for k in rd.CHANGE)
    side = lambda s: f"{unit} AND {kind('alignment')} = 'OBJECT' AND ({kind('alignment.' + s)} <> 'OBJECT' OR {kind('alignment.' + s + '.role')} = '' OR {kind('alignment.' + s + '.doc_type')} = '')"
    keys = "json_extract(j, '$.alignment.join_key[*]')"
    allowed = list(rd.ALLOWED.items())
    bad = [(f"{kind(f)} = ''", f"no {f}") for f in rd.REQUIRED] + [(odd("rule_id", rd.RULE_ID), "rule_id"), (f"{kind('name')} <> '' AND {empty('name')}", "name")] + [(wrong(f, of), f) for f, of in allowed[:2]]
    bad += [(f"{kind('trigger_when')} NOT IN ('', 'OBJECT')", "trigger_when")] + [(f"{kind('trigger_when')} = 'OBJECT' AND {unit} AND {kind('trigger_when.' + f)} = ''", f"trigger_when.{f}") for f in ("doc_type_a", "doc_type_b")]
    bad += [(f"{kind('trigger_when')} = 'OBJECT' AND NOT {unit} AND {kind('trigger_when.doc_type')} <> 'ARRAY'", "trigger_when.doc_type"), (f"{kind('check_expr')} NOT IN ('', 'OBJECT')", "check_expr")]
    bad += [(f"{kind('check_expr')} = 'OBJECT' AND NOT coalesce({said('check_expr.type')} IN {listed(rd.CHECKS)}, false)", "check_expr.type"), (f"{kind('check_expr')} = 'OBJECT' AND {empty('check_expr.expr')}", "check_expr.expr"), (f"{kind('error_template')} <> '' AND {empty('error_template')}", "error_template")]
    bad += [(wrong(f, of), f) for f, of in allowed[2:]] + [(odd(f, p), f) for f, p in (("version", rd.VERSION), ("created_at", rd.MOMENT), ("updated_at", rd.MOMENT))]
    bad += [(f"{kind('severity_on_violation')} NOT IN ('', 'NULL') AND NOT coalesce({said('severity_on_violation')} IN {listed(rd.SEVERITIES)}, false)", "severity_on_violation"), (f"{kind('changelog')} NOT IN ('', 'ARRAY')", "changelog")]
    bad += [(f"{kind('changelog')} = 'ARRAY' AND len(list_filter(json_extract(j, '$.changelog[*]'), lambda x: json_type(x) <> 'OBJECT' OR {lacks})) > 0", "changelog[]"), (f"{kind('stats')} NOT IN ('', 'OBJECT')", "stats")]
    bad += [(below(f, ("UBIGINT", "BIGINT")), f"stats.{f}") for f in rd.COUNTS] + [(below(f, ("UBIGINT", "BIGINT", "DOUBLE")), f"stats.{f}") for f in rd.RATES]
    bad += [(f"{kind('alignment')} NOT IN ('', 'NULL', 'OBJECT') OR {unit} AND {kind('alignment')} IN ('', 'NULL')", "alignment"), (side("party_a"), "alignment.party_a"), (side("party_b"), "alignment.party_b")]
    bad += [(f"{unit} AND {kind('alignment')} = 'OBJECT' AND NOT ({kind('alignment.join_key')} = 'ARRAY' AND len({keys}) > 0 AND len(list_filter({keys}, lambda x: json_type(x) <> 'VARCHAR')) = 0)", "alignment.join_key"), (f"{unit} AND NOT ({kind('confirmation_required')} = 'BOOLEAN' AND json_extract_string(j, '$.confirmation_required') = 'true')", "confirmation_required")]
    each = ", ".join(f"CASE WHEN {b} THEN '{name}' END" for b, name in bad)
    return f"WITH d AS (SELECT o_orderkey, {RULE_DOCUMENT} AS t FROM orders), v AS (SELECT o_orderkey, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM d) SELECT o_orderkey, CASE WHEN coalesce(json_type(j), '') = 'OBJECT' THEN concat_ws(',', {each}) ELSE 'document' END AS errors FROM v"


@query("lc41_documents", _error_sql())
def lc41_documents(t):
    """Rules as JSON documents against every constraint of their format."""
    documents = t("orders").select("o_orderkey", F.expr(RULE_DOCUMENT).alias("document"))
    return rd.checked(documents, "document").select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query("lc46_upsert", f"WITH r AS ({ORDER_RULES}) SELECT rule_id, CASE WHEN o_orderkey % 3 = 0 THEN 'testing' ELSE status END AS status FROM r")
def lc46(t):
    rules = _rules(t)
    return r.upserted(rules, rules.where("o_orderkey % 3 = 0").withColumn("status", F.lit("testing"))).select("rule_id", "status")


@query("lc46_delete", f"WITH r AS ({ORDER_RULES}) SELECT rule_id FROM r WHERE NOT (status = 'draft' AND o_orderkey % 2 = 0)")
def lc46_delete(t):
    rules = _rules(t)
    return r.without_drafts(rules, rules.where("o_orderkey % 2 = 0").select("rule_id")).select("rule_id")


@query("lc47_sandbox", "SELECT l_orderkey AS doc_id, l_linenumber AS row_index FROM lineitem WHERE l_returnflag = 'N' AND l_discount <> 0 AND NOT l_tax / l_discount <= 2")
def lc47(t):
    return r.checked_rows(rule_queries._lines(t), [rule_queries.LINE_RULES[1]]).select("doc_id", "row_index")


@query("lc38_incubator", f"WITH r AS ({ORDER_RULES}) SELECT rule_id FROM r WHERE status = 'draft' AND level = 'L2'")
def lc38(t):
    return _rules(t).where("status = 'draft' and level = 'L2'").orderBy(F.desc("rule_id")).select("rule_id")


@query("lc39_reports", "SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1")
def lc39(t):
    return t("events").groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("date"))


@query("lc9_create", "SELECT event_id AS feedback_id FROM events WHERE event_type IN ('error', 'signup') AND event_id % 7 <> 0 AND NOT (event_type = 'error' AND event_id % 5 = 0)")
def lc9(t):
    return log_queries._feedback(t).where(F.size(lc.feedback_errors()) == 0).select("feedback_id")


@query("lc17_tf_idf", "WITH e AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS token FROM documents), c AS (SELECT id, token, count(*) AS tf FROM e GROUP BY 1, 2), d AS (SELECT token, count(*) AS df FROM c GROUP BY 1) SELECT id, token, CAST(round(CAST(tf * (ln((SELECT count(*) + 1 FROM documents)::DOUBLE / (df + 1)) + 1) AS DECIMAL(18,8)), 6) AS DOUBLE) AS weight FROM c JOIN d USING (token)")
def lc17(t):
    made = cl.tf_idf(t("documents").select(F.col("doc_id").alias("id"), "text"))
    return made.withColumn("weight", F.round(F.col("weight").cast("decimal(18,8)"), 6).cast("double"))


@query("lc24_analysis")
def lc24(t):
    return cl.analysed(t("documents").select(F.col("doc_id").alias("id"), "text"), 2, 0.7)


@query("lc37_reflection", log_queries.STATS + "SELECT 'high_fp' AS kind, rule_id FROM s WHERE hits >= 5 AND fp_rate > 0.4 UNION ALL SELECT 'low_activity', rule_id FROM s WHERE reviews >= 10 AND hit_rate < 1.5")
def lc37(t):
    stats = log_queries._stats(t)
    return lc.high_false_positive(stats, 0.4).select(F.lit("high_fp").alias("kind"), "rule_id").unionByName(lc.low_activity(stats, 10, 1.5).select(F.lit("low_activity").alias("kind"), "rule_id"))


@query("pr3_private_use", "SELECT doc_id, replace(replace(replace(text, 'a', '—'), 'e', '℃'), 'o', '⊥') AS text FROM documents")
def pr3(t):
    """Three letters as private-use characters, set right."""
    return t("documents").select("doc_id", x.private_use_replaced(F.translate("text", "aeo", chr(0xE000) + chr(0xE004) + chr(0xE011))).alias("text"))


@query("pr4_invisible", "SELECT doc_id, replace(replace(replace(text, 'a', ''), 'e', ''), 'o', '') AS text FROM documents")
def pr4(t):
    return t("documents").select("doc_id", x.invisible_removed(F.translate("text", "aeo", chr(0x200B) + chr(0xFEFF) + chr(0x2028))).alias("text"))


@query("pr7_blank_lines", "SELECT doc_id, regexp_replace(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10) || chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g') AS text FROM documents")
def pr7(t):
    return t("documents").select("doc_id", x.blank_lines_collapsed(F.replace("text", F.lit(". "), F.lit(".\n\n\n\n"))).alias("text"))


ALIASES = {"pile no": "pile_no", "length": "actual_length", "top": "top_elev", "bottom": "bottom_elev"}


def _tables(t):
    """Each order as a page with a header and its line items as a table."""
    cells = F.concat_ws("  ", F.concat(F.lit("Z"), F.col("l_linenumber").cast("string")), F.col("l_quantity").cast("int").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", cells.alias("c"))))["c"], "\n").alias("b"))
    return lines.select("doc_id", F.concat(F.lit("pile no  length  top  bottom\n"), "b").alias("text"), F.when(F.col("doc_id") % 2 == 0, "pile record").otherwise("table").alias("doc_type"))


TABLE_LINES = "SELECT l_orderkey AS doc_id, CAST(1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS INT) AS line_no, 'Z' || l_linenumber AS pile_no, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS actual_length FROM lineitem"


@query("pr15_domain_rows", TABLE_LINES)
def pr15(t):
    return tab.domain_rows(_tables(t), ALIASES, "pile_no").select("doc_id", "line_no", F.col("cells.pile_no").alias("pile_no"), F.col("cells.actual_length").alias("actual_length"))


@query("pr9_header", "SELECT DISTINCT l_orderkey AS doc_id, 'pile_no|actual_length|top_elev|bottom_elev' AS slots FROM lineitem")
def pr9(t):
    each = tab.lines(_tables(t)).where("line_no = 1").withColumn("tokens", x.line_tokens(F.col("line")))
    return each.select("doc_id", F.array_join(tab.header_slots(ALIASES), "|").alias("slots"))


@query("pr22_dispatch", """WITH l AS (SELECT l_orderkey AS doc_id, 1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS line_no, l_linenumber, l_quantity FROM lineitem),
d AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'domain' WHEN doc_id % 3 = 1 THEN 'table' ELSE 'plain' END AS kind, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
p AS (SELECT DISTINCT doc_id, 1 AS line_no FROM d WHERE kind = 'plain' OR (kind = 'table' AND n < 2))
SELECT doc_id, CAST(line_no AS INT) AS line_no, CASE WHEN kind = 'domain' THEN 'pile_no=Z' || l_linenumber WHEN kind = 'table' AND n >= 2 THEN 'no=Z' || l_linenumber ELSE 'raw' END AS cell FROM d
UNION ALL SELECT doc_id, CAST(line_no AS INT), 'raw' FROM p""")
def pr22(t):
    kind = F.col("doc_id") % 3
    docs = _tables(t).withColumns({"doc_type": F.when(kind == 0, "pile record").otherwise("other")})
    head = F.when(kind == 0, "pile no  length  top  bottom").when(kind == 1, "no  size  part  maker").otherwise("12 34 56 78")
    docs = docs.withColumn("text", F.concat(head, F.lit("\n"), F.regexp_replace("text", r"^[^\n]*\n", "")))
    rows = tab.rows_by_type(docs, ALIASES, "pile_no", "pile")
    named = lambda k: F.concat(F.lit(f"{k}="), F.col("cells")[k])
    return rows.select("doc_id", "line_no", F.coalesce(named("pile_no"), named("no"), F.lit("raw")).alias("cell"))


@query("pr16_heuristic", "SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS INT) AS line_no, 'Z' || l_linenumber AS id FROM lineitem")
def pr16(t):
    wide = F.concat_ws(" ", F.concat(F.lit("Z"), F.col("l_linenumber").cast("string")), *[F.col("l_partkey").cast("string")] * 6)
    docs = t("lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", wide.alias("c"))))["c"], "\n").alias("text"))
    return tab.heuristic_rows(tab.lines(docs)).select("doc_id", "line_no", "id")


@query("pr23_candidates", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS l FROM documents) WHERE l <> '' AND NOT contains(l, 'Licensed') AND NOT contains(l, 'token') GROUP BY 1")
def pr23(t):
    return tab.candidate_lines(tab.lines(t("documents")), ["Licensed", "token"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("pr10_slots", "SELECT p_brand AS slot, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS aliases FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1")
def pr10(t):
    status = F.when(F.col("p_partkey") % 3 == 0, "candidate").when(F.col("p_partkey") % 3 == 1, "active")
    a = t("part").select(F.col("p_name").alias("alias"), F.col("p_brand").alias("slot"), status.alias("status"))
    return tab.slot_schema(a).select("slot", F.array_join("aliases", ",").alias("aliases"))


@query("cl1_terms", "SELECT keyword, label, min(strength) AS strength FROM (SELECT p_name AS keyword, p_brand AS label, 'weak' AS strength FROM part WHERE p_size < 20 UNION ALL SELECT p_name, p_brand, 'core' FROM part WHERE p_size > 40) GROUP BY 1, 2")
def cl1(t):
    p = t("part").select(F.col("p_name").alias("keyword"), F.col("p_brand").alias("label"), "p_size")
    nothing = p.where("p_size < 10").select("keyword", "label", F.lit("weak").alias("strength"), F.lit("active").alias("status"))
    return c.all_terms(nothing, p.where("p_size > 40"), p.where("p_size < 20"))


@query("cl2_lookup", "SELECT p_partkey, p_name LIKE '%ring%' OR p_name LIKE '%widget%' AS reference FROM part")
def cl2(t):
    return t("part").select("p_partkey", c.any_of(F.col("p_name"), ["ring", "widget"]).alias("reference"))


@query("cl12_checklists", "SELECT s_suppkey AS task, CASE WHEN s_nationkey < 5 THEN 'C' || s_nationkey WHEN s_suppkey % 2 = 0 THEN 'P0' ELSE '' END AS items FROM supplier")
def cl12(t):
    s = t("supplier").select(F.col("s_suppkey").alias("task"), F.col("s_nationkey").alias("code"), (F.col("s_suppkey") % 2).alias("professional"))
    by_code = t("nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("code"), F.array(F.concat(F.lit("C"), F.col("n_nationkey").cast("string"))).alias("items"))
    by_prof = s.sparkSession.createDataFrame([(0, ["P0"])], "professional long, items array<string>")
    return c.checklists(s, by_code, by_prof).select("task", F.array_join("items", ",").alias("items"))


@query("rv4_document_audit", "SELECT c_custkey AS doc_id, i AS item, CASE WHEN (i = 'balance' AND c_acctbal >= 0) OR (i = 'name' AND c_custkey < 100) THEN 'pass' ELSE 'fail' END AS result FROM customer CROSS JOIN (VALUES ('balance'), ('name')) AS x(i)")
def rv4(t):
    d = t("customer").select(F.col("c_custkey").alias("doc_id"), "c_acctbal")
    return rv.checklist(d, [("balance", F.col("c_acctbal") >= 0), ("name", F.col("doc_id") < 100)])


@query("rv15_recommendations", f"WITH n AS (SELECT {log_queries.RESULT} AS r FROM events) SELECT count(*) || CASE r WHEN 'fail' THEN ' failed items to rectify' WHEN 'suspicious' THEN ' suspicious items to check by hand' ELSE ' items still to be read' END AS text FROM n WHERE r IN ('fail', 'suspicious', 'needs_ai') GROUP BY r")
def rv15(t):
    return rv.recommendations(log_queries._findings(t))


@query("rv17_completed_event", "SELECT 'audit_completed' AS event_type, 'AU-1' AS audit_id, count(*) AS n FROM events")
def rv17(t):
    return rv.completed_event(log_queries._findings(t), "AU-1", "2024-02-01 00:00:00").select("event_type", "audit_id", F.col("n").cast("long").alias("n"))


@query("rv18_review", f"SELECT CASE WHEN event_id % 20 / 20.0 + 0.04 < 0.85 AND {log_queries.RESULT} <> 'not_applicable' THEN 'suspicious' ELSE {log_queries.RESULT} END AS result, count(*) AS n FROM events GROUP BY 1")
def rv18(t):
    docs = t("customer").select(F.lit(True).alias("verified"))
    return rv.reviewed(docs, log_queries._findings(t)).groupBy("result").agg(F.count(F.lit(1)).alias("n"))


@query("rv25_supported", "WITH l AS (SELECT o_custkey AS doc_id, bool_or(contains(o_orderpriority, 'URGENT')) AS s, bool_or(contains(o_orderpriority, 'LOW')) AS o FROM orders GROUP BY 1) SELECT c_custkey AS doc_id, CASE WHEN s AND o THEN 'both' WHEN s THEN 'suspected' WHEN o THEN 'original' ELSE 'none' END AS support FROM customer LEFT JOIN l ON c_custkey = doc_id")
def rv25(t):
    suspects = t("customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("suspect"), F.lit("LOW").alias("original"), F.lit("URGENT").alias("suspected"))
    return rv.supported(suspects, t("orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("line"))).select("doc_id", "support")
