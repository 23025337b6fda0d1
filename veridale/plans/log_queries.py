"""Review, graph, clusters, event log and rule lifecycle on the generated tables. Events stand for the audit log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import charts
from ..operators import cluster as cl
from ..operators import events as ev
from ..operators import folds
from ..operators import graph as g
from ..operators import lifecycle as lc
from ..operators import review as rv
from ..operators import signature as sg
from ..sources import store
from ..sources.scratch import new_folder
from ..streaming import trials
from .registry import query

RESULT = "CASE event_type WHEN 'view' THEN 'pass' WHEN 'signup' THEN 'needs_ai' WHEN 'click' THEN 'not_applicable' WHEN 'error' THEN 'fail' ELSE 'suspicious' END"
SEVERITY = "CASE WHEN value > 120 THEN 'Fatal' WHEN value > 30 THEN 'Sanity Check' ELSE 'Best Practice' END"


def _findings(t):
    return t("events").select(F.col("user_id").alias("doc_id"), F.expr(RESULT).alias("result"), F.expr(SEVERITY).alias("severity"), (F.col("event_id") % 20 / 20 + 0.04).alias("confidence"), "event_id", F.expr("concat('R', event_id % 12)").alias("rule_id"))


@query("rv1_gate", "SELECT bool_and(c_acctbal > -1e9) AS ok, count(*) FILTER (WHERE NOT c_acctbal > -1e9) AS pending, count(*) AS n FROM customer")
def rv1(t):
    return rv.gate(t("customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_acctbal") > -1e9).alias("verified")), "verified")


@query("rv2_gate", "SELECT bool_and(c_acctbal > 0) AS ok, count(*) FILTER (WHERE NOT c_acctbal > 0) AS pending, count(*) AS n FROM customer")
def rv2(t):
    return rv.gate(t("customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_acctbal") > 0).alias("confirmed")), "confirmed")


@query("rv3_checklist", """SELECT o_custkey AS doc_id, 'gap' AS item, CASE WHEN max(o_orderkey) - min(o_orderkey) < 5000 THEN 'pass' ELSE 'fail' END AS result FROM orders GROUP BY 1
UNION ALL SELECT o_custkey, 'count', CASE WHEN count(*) <= 10 THEN 'pass' ELSE 'fail' END FROM orders GROUP BY 1 UNION ALL SELECT DISTINCT o_custkey, 'seal', 'needs_ai' FROM orders""")
def rv3(t):
    d = t("orders").groupBy(F.col("o_custkey").alias("doc_id")).agg((F.max("o_orderkey") - F.min("o_orderkey")).alias("gap"), F.count(F.lit(1)).alias("n"))
    return rv.checklist(d, [("gap", F.col("gap") < 5000), ("count", F.col("n") <= 10), ("seal", F.lit(None).cast("boolean"))])


@query("rv5_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def rv5(t):
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("dated "), F.date_format("o_orderdate", "yyyy-M-d"), F.lit(" in text"))).otherwise(F.concat(F.lit("no. "), F.date_format("o_orderdate", "yyyyMMdd")))
    return t("orders").select("o_orderkey", x.first_date(said).alias("d"))


@query("rv6_document_date", "SELECT l_orderkey AS doc_id, CAST(min(l_shipdate) AS DATE) AS d FROM lineitem GROUP BY 1")
def rv6(t):
    return t("lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min("l_shipdate").cast("date").alias("d"))


@query("rv7_date_role", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'acceptance' WHEN o_orderpriority LIKE '%HIGH%' THEN 'submission' ELSE 'record' END AS role FROM orders")
def rv7(t):
    from ..operators.classify import ladder

    return t("orders").select("o_orderkey", ladder(F.col("o_orderpriority"), [("URGENT", "acceptance"), ("HIGH", "submission")], "record").alias("role"))


@query("rv8_date_logic", """WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'signup'), b AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase')
SELECT a.user_id, count(*) AS n_pairs FROM a JOIN b ON a.user_id = b.user_id AND a.d > b.d GROUP BY 1""")
def rv8(t):
    days = t("events").select("user_id", F.to_date("ts").alias("d"), "event_type").distinct()
    side = lambda e: days.where(F.col("event_type") == e).select("user_id", "d", F.col("d").cast("string").alias("doc"))
    return rv.later_than_any(side("signup"), side("purchase"), "user_id").select("user_id", "n_pairs")


@query("rv9_downgrade", f"SELECT event_id, CASE WHEN event_id % 20 / 20.0 + 0.04 < 0.85 AND {RESULT} <> 'not_applicable' THEN 'suspicious' ELSE {RESULT} END AS result FROM events")
def rv9(t):
    return rv.downgraded(_findings(t)).select("event_id", "result")


@query("rv10_review_list", f"SELECT event_id, {RESULT} AS original_result FROM events WHERE event_id % 20 / 20.0 + 0.04 < 0.85 AND {RESULT} <> 'not_applicable'")
def rv10(t):
    return rv.downgraded(_findings(t)).where("original_result is not null").select("event_id", "original_result")


@query("rv11_links", """WITH k AS (SELECT DISTINCT s_nationkey AS key, s_suppkey AS d FROM supplier), h AS (SELECT key, min(d) AS a FROM k GROUP BY 1)
SELECT a AS "from", d AS "to", CAST(k.key AS VARCHAR) AS key FROM k JOIN h USING (key) WHERE d <> a""")
def rv11(t):
    return _edges(t).select("from", "to", "key")


def _edges(t):
    return g.links(t("supplier").select(F.col("s_suppkey").alias("doc_id"), "s_nationkey"), {"s_nationkey": ("same_key", 1.0)})


@query("rv12_walk", """WITH k AS (SELECT s_nationkey AS key, s_suppkey AS d FROM supplier), h AS (SELECT key, min(d) AS a FROM k GROUP BY 1), e AS (SELECT a, d FROM k JOIN h USING (key) WHERE d <> a),
b AS (SELECT a, d FROM e UNION SELECT d, a FROM e), one AS (SELECT d FROM b WHERE a = 1), two AS (SELECT b.d FROM b JOIN one ON b.a = one.d)
SELECT node, min(distance) AS distance FROM (SELECT 1 AS node, 0 AS distance UNION ALL SELECT d, 1 FROM one UNION ALL SELECT d, 2 FROM two) GROUP BY 1""")
def rv12(t):
    e = _edges(t)
    return g.neighbours(e, e.sparkSession.createDataFrame([(1,)], "node long"), 2)


@query("rv13_summary", f"SELECT doc_id, count(*) FILTER (WHERE r = 'pass') AS n_pass, count(*) FILTER (WHERE r = 'fail') AS n_fail, count(*) FILTER (WHERE r = 'suspicious') AS n_suspicious, count(*) FILTER (WHERE r = 'not_applicable') AS n_not_applicable, count(*) FILTER (WHERE r = 'needs_ai') AS n_needs_ai FROM (SELECT user_id AS doc_id, {RESULT} AS r FROM events) GROUP BY 1")
def rv13(t):
    return rv.summary(_findings(t), "doc_id")


@query("rv14_conclusion", f"SELECT count(*) FILTER (WHERE {SEVERITY} = 'Fatal' AND {RESULT} = 'fail') AS fatal, count(*) FILTER (WHERE {RESULT} = 'fail') AS fail, 'rejected' AS conclusion FROM events")
def rv14(t):
    return rv.conclusion(_findings(t)).select("fatal", "fail", "conclusion")


@query("rv16_rule_details", "SELECT 'R' || event_id % 12 AS rule_id, count(*) AS hits, count(DISTINCT user_id) AS docs, min(user_id) AS first FROM events GROUP BY 1")
def rv16(t):
    return rv.rule_details(_findings(t))


@query("rv19_shares", f"SELECT {RESULT} AS result, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM events) AS share FROM events GROUP BY 1")
def rv19(t):
    return rv.shares(_findings(t), "result")


@query("rv19_ring", f"""WITH c AS (SELECT {RESULT} AS result, count(*) AS n FROM events GROUP BY 1),
o AS (SELECT result, n, list_position(['pass', 'fail', 'suspicious', 'needs_ai', 'not_applicable'], result) AS k FROM c),
s AS (SELECT result, n, n / sum(n) OVER () AS share, (sum(n) OVER (ORDER BY k) - n) / sum(n) OVER () * 360 - 90 AS a FROM o),
e AS (SELECT *, a + share * 360 AS b, radians(a) AS u, radians(a + share * 360) AS w, CASE WHEN share > 0.5 THEN '1' ELSE '0' END AS large FROM s)
SELECT result, n, round(share, 9) AS share, round(a, 6) AS start, round(b, 6) AS "end",
  printf('M %.1f %.1f A 130.0 130.0 0 %s 1 %.1f %.1f L %.1f %.1f A 71.5 71.5 0 %s 0 %.1f %.1f Z', round(140 + 130 * cos(u), 1), round(140 + 130 * sin(u), 1), large, round(140 + 130 * cos(w), 1), round(140 + 130 * sin(w), 1),
  round(140 + 71.5 * cos(w), 1), round(140 + 71.5 * sin(w), 1), large, round(140 + 71.5 * cos(u), 1), round(140 + 71.5 * sin(u), 1)) AS path FROM e""")
def rv19_ring(t):
    return charts.ring(_findings(t)).select("result", "n", F.round("share", 9).alias("share"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "path")


@query("rv19_bars", f"""WITH c AS (SELECT 'documents of ' || user_id AS label, count(*) FILTER (WHERE {RESULT} = 'fail') AS n_fail, count(*) FILTER (WHERE {RESULT} = 'suspicious') AS n_suspicious FROM events WHERE {RESULT} IN ('fail', 'suspicious') GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n_fail + n_suspicious DESC, label) AS k, 420.0 / max(n_fail + n_suspicious) OVER () AS scale FROM c)
SELECT label, CASE WHEN length(label) <= 12 THEN label ELSE label[:11] || '…' END AS shown, n_fail, n_suspicious, CAST(20 + (k - 1) * 34 AS DOUBLE) AS y, round(n_fail * scale, 6)::DOUBLE AS fail_width, round(n_suspicious * scale, 6)::DOUBLE AS suspicious_width FROM r""")
def rv19_bars(t):
    findings = _findings(t).withColumn("unit", F.concat(F.lit("documents of "), F.col("doc_id").cast("string")))
    return charts.bars(findings, "unit").select("label", "shown", "n_fail", "n_suspicious", "y", F.round("fail_width", 6).alias("fail_width"), F.round("suspicious_width", 6).alias("suspicious_width"))


@query("rv21_similarity", """WITH f AS (SELECT label, arg_min(embedding, vec_id) AS first, min(vec_id) AS i FROM embeddings GROUP BY 1), s AS (SELECT vec_id AS id, e.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(first AS DOUBLE[])) AS s FROM embeddings e JOIN f ON e.label = f.label WHERE vec_id <> i)
SELECT id, label, round(CAST(s AS DECIMAL(18,8)), 6)::DOUBLE AS similarity FROM s""")
def rv21(t):
    v = t("embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return cl.against_first(v, 0.85, 0.70).select("id", "label", F.round(F.col("similarity").cast("decimal(18,8)"), 6).cast("double").alias("similarity"))


GREY = "CAST(least(greatest(floor((CAST(x AS DOUBLE) + 1) * 127.5), 0), 255) AS {0})"


def _pictures(t):
    """Embeddings of 64 numbers as grey pictures of 8 x 8."""
    grey = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)))
    pixels = F.unhex(F.array_join(F.transform(grey, lambda g: F.lpad(F.hex(g), 2, "0")), ""))
    return t("embeddings").where("size(embedding) = 64").select(F.col("vec_id").alias("id"), F.col("label").alias("signer"), F.lit(8).alias("width"), F.lit(8).alias("height"), pixels.alias("pixels"))


@query("rv21_structure", f"""WITH g AS (SELECT vec_id AS id, label AS signer, list_transform(embedding, lambda x: {GREY.format("DOUBLE")}) AS p FROM embeddings WHERE len(embedding) = 64),
f AS (SELECT signer, arg_min(p, id) AS q, min(id) AS first_id FROM g GROUP BY 1),
w AS (SELECT r, c FROM range(2) a(r), range(2) b(c)), o AS (SELECT i, j FROM range(7) a(i), range(7) b(j)),
v AS (SELECT id, g.signer, r, c, p[(r + i) * 8 + c + j + 1] AS x, q[(r + i) * 8 + c + j + 1] AS y FROM g JOIN f ON g.signer = f.signer AND id <> first_id, w, o),
m AS (SELECT id, signer, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS cxy FROM v GROUP BY id, signer, r, c),
s AS (SELECT id, signer, avg((2 * mx * my + 6.5025) * (2 * cxy + 58.5225) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225))) AS s FROM m GROUP BY 1, 2)
SELECT id, signer, CAST(round(CAST(s AS DECIMAL(18,8)), 6) AS DOUBLE) AS similarity, CASE WHEN s >= 0.85 THEN 'pass' WHEN s >= 0.70 THEN 'suspect' ELSE 'forged' END AS verdict FROM s""")
def rv21_structure(t):
    """By structural similarity at the pictures' own size."""
    return sg.compared(_pictures(t), None, None).select("id", "signer", F.round(F.col("similarity").cast("decimal(18,8)"), 6).cast("double").alias("similarity"), "verdict")


@query("rv21_hash")
def rv21_hash(t):
    """By perceptual hash."""
    return sg.compared(_pictures(t), None, None).select("id", "signer", "hash", "hash_distance")


@query("rv24_verify_tasks", "SELECT user_id AS doc_id, event_id AS suspect, 'VERIFY-' || lpad(CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS VARCHAR), 3, '0') AS task FROM events WHERE event_type = 'error'")
def rv24(t):
    return rv.verify_tasks(t("events").where("event_type = 'error'").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("suspect")))


@query("rv23_located", "WITH b AS (SELECT o_custkey AS doc_id, min(o_orderkey) AS item FROM orders WHERE contains(o_orderpriority, 'URGENT') GROUP BY 1) SELECT c_custkey AS doc_id, CAST(item - 20 AS DOUBLE) AS x1 FROM customer LEFT JOIN b ON c_custkey = doc_id")
def rv23(t):
    items = t("orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("text"), *[F.col("o_orderkey").cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")])
    suspects = t("customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("suspect"), F.lit("URGENT").alias("value"))
    return rv.located_suspects(suspects, items).select("doc_id", "box.x1")


@query("rv26_merged", "SELECT o_orderkey AS row, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 6 = 0 THEN o_totalprice END AS old, CASE WHEN o_orderkey % 6 = 0 THEN -1.0 ELSE o_totalprice END AS v FROM orders")
def rv26(t):
    values = t("orders").select(F.lit("d").alias("doc"), F.col("o_orderkey").alias("row"), F.lit("price").alias("col"), F.col("o_totalprice").alias("v"))
    verified = values.where("row % 3 = 0").select("doc", "row", "col", F.lit(-1.0).alias("v"), F.when(F.col("row") % 2 == 0, "high").otherwise("low").alias("confidence"))
    return rv.merged(values, verified).select("row", "old", "v")


def _log(t):
    e = t("events")
    return e.select("event_id", F.to_date("ts").alias("date"), "ts", "event_type", F.col("user_id").alias("audit_id"), (F.col("event_id") % 12).alias("rule_id"), F.array(F.struct(F.from_json("props", "k int")["k"].alias("rule_id"), F.lit(1).alias("hits"))).alias("rule_details"))


@query("lc1_numbered", "SELECT CAST(ts AS DATE) AS date, 'EVT-' || strftime(ts, '%Y%m%d') || '-' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS event_id, n FROM (SELECT ts, event_id AS n, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events)")
def lc1(t):
    return ev.numbered(t("events").select(F.to_date("ts").alias("date"), "ts", F.col("event_id").alias("n")), "EVT").select("date", "event_id", "n")


@query("lc2_types", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def lc2(t):
    return t("events").where(F.col("event_type").isin("view", "click")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("lc3_last_number", "SELECT CAST(ts AS DATE) AS date, CAST(count(*) AS INT) AS last_number FROM events GROUP BY 1")
def lc3(t):
    return ev.last_numbers(lc1(t))


@query("lc4_by_date", "SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'")
def lc4(t):
    return ev.by_date(_log(t), "2024-01-05").select("event_id")


@query("lc5_by_audit", "SELECT event_id FROM events WHERE user_id = 8")
def lc5(t):
    return ev.by_audit(_log(t), 8).select("event_id")


@query("lc6_by_rule", "SELECT event_id FROM events WHERE event_id % 12 = 7 OR CAST(json_extract(props, '$.k') AS INT) = 7")
def lc6(t):
    return ev.by_rule(_log(t), 7).select("event_id")


@query("lc7_recent", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY")
def lc7(t):
    return ev.recent(_log(t), F.lit("2024-01-20 12:00:00").cast("timestamp"), 7).select("event_id")


@query("lc8_counts", "SELECT coalesce(m.name, e.name) AS name, coalesce(e.n, 0) AS n FROM (VALUES ('view'), ('click'), ('gone')) AS m(name) FULL OUTER JOIN (SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'unknown:' || event_type END AS name, count(*) AS n FROM events GROUP BY 1) e ON m.name = e.name")
def lc8(t):
    return ev.counts(t("events"), "event_type", ["view", "click", "gone"])


def _feedback(t):
    return t("events").where("event_type in ('error', 'signup')").select(
        F.col("event_id").alias("feedback_id"), F.col("user_id").cast("string").alias("audit_id"), F.when(F.col("event_type") == "error", "false_positive").otherwise("missed").alias("type"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("R"), (F.col("event_id") % 12).cast("string"))).alias("rule_id"), F.when(F.col("event_id") % 7 != 0, "u").alias("user_id"), "ts")


@query("lc10_validate", "SELECT event_id AS feedback_id, concat_ws(';', CASE WHEN event_id % 7 = 0 THEN 'user_id is missing' END, CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'rule_id is missing' END) AS errors FROM events WHERE event_type IN ('error', 'signup')")
def lc10(t):
    return _feedback(t).select("feedback_id", F.array_join(lc.feedback_errors(), ";").alias("errors"))


@query("lc11_list", "SELECT event_id AS feedback_id FROM events WHERE event_type = 'error' AND user_id = 8")
def lc11(t):
    return _feedback(t).where("type = 'false_positive' and audit_id = '8'").orderBy(F.desc("ts")).select("feedback_id")


@query("lc12_states", "SELECT event_id AS feedback_id, CASE WHEN event_id % 3 = 0 THEN 'clustered' WHEN event_id % 3 = 1 THEN 'analyzed' ELSE 'new' END AS status, CASE WHEN event_id % 3 < 2 THEN ts + INTERVAL 1 DAY END AS analyzed_at FROM events WHERE event_type IN ('error', 'signup')")
def lc12(t):
    f = _feedback(t)
    step = lambda cond, days, status: f.where(cond).select("feedback_id", (F.col("ts") + F.expr(f"interval {days} days")).alias("ts"), F.lit(status).alias("status"), F.lit(None).cast("string").alias("cluster_id"))
    return lc.feedback_states(f, step("feedback_id % 3 < 2", 1, "analyzed").unionByName(step("feedback_id % 3 = 0", 2, "clustered"))).select("feedback_id", "status", "analyzed_at")


@query("lc13_feedback_counts", "SELECT m.name, coalesce(n, 0) AS n FROM (VALUES ('missed'), ('false_positive')) AS m(name) LEFT JOIN (SELECT CASE WHEN event_type = 'error' THEN 'false_positive' ELSE 'missed' END AS name, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1) USING (name)")
def lc13(t):
    return ev.counts(_feedback(t), "type", list(lc.FEEDBACK_TYPES))


HAN_RUNS = "regexp_extract_all(t, '[一-鿿]+')"


@query("lc14_tokens", f"""WITH d AS (SELECT doc_id, lower(translate(coalesce(text, ''), 'qxyzö', '一丁七万丈')) AS t FROM documents),
g AS (SELECT doc_id, list_concat(regexp_extract_all(t, '[a-z0-9_]{{2,}}'), flatten(list_transform({HAN_RUNS}, lambda r: list_concat(string_split(r, ''), list_transform(range(1, length(r)), lambda i: r[i:i + 1]))))) AS l FROM d)
SELECT doc_id, array_to_string(list_sort(list_distinct(l)), ' ') AS tokens FROM g""")
def lc14(t):
    """With some letters as Han characters, so that texts have both kinds of tokens."""
    texts = t("documents").select(F.col("doc_id").alias("id"), F.translate(F.coalesce("text", F.lit("")), "qxyzö", "一丁七万丈").alias("text"))
    return cl.token_sets(texts).select(F.col("id").alias("doc_id"), F.array_join("tokens", " ").alias("tokens"))


def _words(t):
    """The tokens of whole documents as sets."""
    return cl.token_sets(t("documents").select(F.col("doc_id").alias("id"), "text"))


@query("lc15_jaccard")
def lc15(t):
    return cl.similar_pairs(_words(t), 0.7)


@query("lc16_cosine", "SELECT a.vec_id AS a, round(CAST(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS DECIMAL(18,8)), 6)::DOUBLE AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def lc16(t):
    e = t("embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("a"), F.round(x.cosine(F.col("embedding"), F.col("e2")).cast("decimal(18,8)"), 6).cast("double").alias("s"))


@query("lc18_feedback_text", "SELECT event_id, concat_ws(' ', event_type, CASE WHEN user_id % 2 = 0 THEN 'even' END, props) AS text FROM events")
def lc18(t):
    return t("events").select("event_id", F.concat_ws(" ", "event_type", F.when(F.col("user_id") % 2 == 0, "even"), "props").alias("text"))


@query("lc19_dbscan")
def lc19(t):
    return cl.dbscan(_words(t), 0.7, 3)


@query("lc20_greedy")
def lc20(t):
    return cl.greedy(_words(t), 0.7, 2)


@query("lc21_patterns", "SELECT user_id, event_type AS value, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE k <= 2")
def lc21(t):
    return lc.top_per_group(t("events").drop("value").withColumnRenamed("event_type", "value"), ["user_id"], "value", 2, "value")


@query("lc23_candidates", "SELECT 'INC-20240130-' || lpad(CAST(row_number() OVER (ORDER BY user_id) AS VARCHAR), 3, '0') AS event_id, user_id FROM (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 10)")
def lc23(t):
    many = t("events").where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    return ev.numbered(many.select(F.lit("2024-01-30").cast("date").alias("date"), F.col("user_id").alias("ts")), "INC").select("event_id", F.col("ts").alias("user_id"))


@query("lc25_trigger", "SELECT count(*) FILTER (WHERE event_type = 'signup') >= 20 AS triggered FROM events")
def lc25(t):
    return t("events").agg((F.count_if(F.col("event_type") == "signup") >= 20).alias("triggered"))


HITS = "SELECT 'R' || event_id % 12 AS rule_id, user_id AS audit_id, ts FROM events WHERE event_type IN ('view', 'click') AND event_id % 12 <> 3"
STATS = f"""WITH h AS (SELECT rule_id, count(*) AS hits, count(DISTINCT audit_id) AS reviews, max(ts) AS last_hit FROM ({HITS}) GROUP BY 1),
f AS (SELECT 'R' || event_id % 12 AS rule_id, count(*) AS fp FROM events WHERE event_type = 'error' AND event_id % 5 <> 0 GROUP BY 1),
s AS (SELECT coalesce(h.rule_id, f.rule_id) AS rule_id, coalesce(hits, 0) AS hits, coalesce(reviews, 0) AS reviews, coalesce(fp, 0) AS false_positives, last_hit, coalesce(coalesce(fp, 0)::DOUBLE / nullif(coalesce(hits, 0), 0), 0) AS fp_rate, coalesce(hits::DOUBLE / nullif(reviews, 0), 0) AS hit_rate FROM h FULL OUTER JOIN f ON h.rule_id = f.rule_id)
"""


def _stats(t):
    hits = t("events").where("event_type in ('view', 'click') and event_id % 12 <> 3").select(F.expr("concat('R', event_id % 12)").alias("rule_id"), F.col("user_id").alias("audit_id"), "ts")
    return lc.rule_stats(hits, _feedback(t).where("rule_id is not null").select("rule_id", "type"))


@query("lc26_stats", STATS + "SELECT * FROM s")
def lc26(t):
    return _stats(t)


@query("lc26_incremental", STATS + "SELECT * FROM s")
def lc26_incremental(t):
    """The same statistics, folded in three runs as the logs come in."""
    e = t("events")
    hits = e.where("event_type in ('view', 'click') and event_id % 12 <> 3").select(F.lit("hit").alias("kind"), F.expr("concat('R', event_id % 12)").alias("rule_id"), F.col("user_id").cast("string").alias("audit_id"), "ts")
    false = _feedback(t).where("type = 'false_positive' and rule_id is not null").select(F.lit("false_positive").alias("kind"), "rule_id", F.lit(None).cast("string").alias("audit_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = hits.unionByName(false).withColumn("ts", F.col("ts").cast("timestamp"))
    to, spark = new_folder(e.sparkSession), e.sparkSession
    for k in range(3):
        store.append(rows.where(F.coalesce(F.dayofmonth("ts"), F.lit(0)) % 3 == k), f"{to}/log", f"day {k}")
        folds.fold(spark, f"{to}/log", f"{to}/stats")
    return folds.stats(spark, f"{to}/stats")


@query("lc32_announced", """WITH e AS (SELECT 'R' || event_id % 12 AS rule_id, user_id AS project, event_id % 5 AS hits, CASE WHEN event_id % 40 = 0 THEN 1 ELSE 0 END AS fp, ts, event_id FROM events WHERE ts IS NOT NULL),
k AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY rule_id, project ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS fresh FROM e),
w AS (SELECT rule_id, ts, event_id, sum(hits) OVER o AS hits, sum(fp) OVER o AS false_positives, sum(fresh) OVER o AS projects FROM k WINDOW o AS (PARTITION BY rule_id ORDER BY ts, event_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ts, event_id) AS k FROM w WHERE projects >= 3 AND (false_positives < 0.1 * hits OR hits = 0))
SELECT rule_id, ts AS at, CAST(hits AS BIGINT) AS hits, CAST(false_positives AS BIGINT) AS false_positives, CAST(projects AS BIGINT) AS projects FROM f WHERE k = 1""")
def lc32_announced(t):
    """Tests in the order of time, in four files that the stream takes one by one."""
    e = t("events")
    spark, to = e.sparkSession, new_folder(e.sparkSession)
    tests = e.select(F.col("event_id").alias("test_id"), F.col("ts").cast("timestamp").alias("ts"), F.expr("concat('R', event_id % 12)").alias("rule_id"), F.col("user_id").cast("string").alias("project"), (F.col("event_id") % 5).alias("hits"), F.when(F.col("event_id") % 40 == 0, 1).otherwise(0).cast("long").alias("false_positives"))
    quarter = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    for k in range(4):
        tests.where(quarter == k).coalesce(1).write.mode("append").parquet(f"{to}/tests")
    stream = spark.readStream.schema(tests.schema).option("maxFilesPerTrigger", 1).parquet(f"{to}/tests")
    return trials.run(stream, to)


@query("lc27_low_activity", STATS + "SELECT rule_id, reviews FROM s WHERE reviews >= 10 AND hit_rate < 2.5")
def lc27(t):
    return lc.low_activity(_stats(t), 10, 2.5).select("rule_id", "reviews")


@query("lc28_high_fp", STATS + "SELECT rule_id, fp_rate FROM s WHERE hits >= 5 AND fp_rate > 0.3")
def lc28(t):
    return lc.high_false_positive(_stats(t)).select("rule_id", "fp_rate")


@query("lc29_dormant", STATS + "SELECT rule_id, CAST(floor((epoch(TIMESTAMP '2024-06-01') - floor(epoch(last_hit))) / 86400) AS BIGINT) AS idle_days FROM s WHERE floor((epoch(TIMESTAMP '2024-06-01') - floor(epoch(last_hit))) / 86400) > 90")
def lc29(t):
    return lc.dormant(_stats(t), F.lit("2024-06-01").cast("timestamp")).select("rule_id", "idle_days")


@query("lc30_downgrade", STATS + """, r AS (SELECT 'R' || i AS rule_id, 'L' || (i % 3 + 1) AS level FROM range(12) AS x(i))
SELECT r.rule_id, CASE WHEN level = 'L2' AND s.rule_id IS NOT NULL THEN 'L3' ELSE level END AS level, CASE WHEN level = 'L3' AND s.rule_id IS NOT NULL THEN 'deprecated' ELSE 'active' END AS status, CASE WHEN level <> 'L1' AND s.rule_id IS NOT NULL THEN '1.0.10' ELSE '1.0.9' END AS version FROM r LEFT JOIN s ON r.rule_id = s.rule_id AND hits >= 5 AND fp_rate > 0.4""")
def lc30(t):
    spark = t("region").sparkSession
    rules = spark.range(12).select(F.expr("concat('R', id)").alias("rule_id"), F.expr("concat('L', id % 3 + 1)").alias("level"), F.lit("active").alias("status"), F.lit("1.0.9").alias("version"))
    return lc.downgraded(rules, lc.high_false_positive(_stats(t), 0.4))


@query("lc31_report", STATS + "SELECT count(*) AS rules, avg(fp_rate) AS fp_rate FROM s")
def lc31(t):
    return _stats(t).agg(F.count(F.lit(1)).alias("rules"), F.avg("fp_rate").alias("fp_rate"))


@query("lc32_trials", "SELECT o_orderpriority AS rule_id, sum(o_orderkey % 5) AS hits, sum(CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END) AS false_positives, count(DISTINCT o_custkey) AS projects, sum(CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END)::DOUBLE / sum(o_orderkey % 5) AS fp_rate, count(DISTINCT o_custkey) >= 3 AND sum(CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END)::DOUBLE / sum(o_orderkey % 5) < 0.1 AS eligible FROM orders GROUP BY 1")
def lc32(t):
    return lc.trials(t("orders").select(F.col("o_orderpriority").alias("rule_id"), F.col("o_custkey").alias("project"), (F.col("o_orderkey") % 5).alias("hits"), F.when(F.col("o_orderkey") % 40 == 0, 1).otherwise(0).alias("false_positives")))


MOVES = ", ".join(f"('{a}', '{b}')" for a, b in lc.MOVES)


@query("lc45_transition", f"""WITH r AS (SELECT c_custkey AS rule_id, list_value('draft', 'testing', 'incubating', 'active', 'deprecated')[c_custkey % 5 + 1] AS status, list_value('draft', 'testing', 'incubating', 'active', 'deprecated')[c_custkey % 3 + 2] AS want FROM customer)
SELECT rule_id, CASE WHEN m.a IS NOT NULL THEN want ELSE status END AS status, m.a IS NOT NULL AS moved FROM r LEFT JOIN (VALUES {MOVES}) AS m(a, b) ON status = a AND want = b""")
def lc45(t):
    names = F.array(*map(F.lit, ("draft", "testing", "incubating", "active", "deprecated")))
    k = F.col("c_custkey")
    rules = t("customer").select(k.alias("rule_id"), F.get(names, (k % 5).cast("int")).alias("status"))
    return lc.transitioned(rules, t("customer").select(k.alias("rule_id"), F.get(names, (k % 3 + 1).cast("int")).alias("to")))


@query("lc33_promote", "SELECT c_custkey AS rule_id, 'incubating' AS status FROM customer WHERE c_custkey % 5 = 1")
def lc33(t):
    rules = t("customer").select(F.col("c_custkey").alias("rule_id"), F.when(F.col("c_custkey") % 5 == 1, "testing").otherwise("active").alias("status"))
    return lc.transitioned(rules, rules.select("rule_id", F.lit("incubating").alias("to"))).where("moved").select("rule_id", "status")


@query("lc34_eligible", "SELECT o_orderpriority AS rule_id FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 3 AND sum(CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END)::DOUBLE / sum(o_orderkey % 5) < 0.1")
def lc34(t):
    return lc32(t).where("eligible").select("rule_id")


@query("lc35_weekly", "SELECT CAST(json_extract(props, '$.k') AS INT) AS rule_id, count(*) AS hits FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY GROUP BY 1")
def lc35(t):
    return lc7_rows(t).select(F.explode("rule_details").alias("d")).groupBy("d.rule_id").agg(F.sum("d.hits").alias("hits"))


def lc7_rows(t):
    return ev.recent(_log(t), F.lit("2024-01-20 12:00:00").cast("timestamp"), 7)


@query("lc36_suggestions", "SELECT event_type, value, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, value) AS k FROM (SELECT event_type, user_id AS value, count(*) AS n FROM events GROUP BY 1, 2)) WHERE k <= 5")
def lc36(t):
    return lc.top_per_group(t("events").drop("value").withColumnRenamed("user_id", "value"), ["event_type"], "value", 5, "value")


@query("lc40_registry", "SELECT 'level' AS part, o_orderstatus AS name, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'scope', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'status', CAST(o_custkey % 3 AS VARCHAR), count(*) FROM orders GROUP BY 2")
def lc40(t):
    return lc.registry(t("orders").select(F.col("o_orderstatus").alias("level"), F.col("o_orderpriority").alias("scope"), (F.col("o_custkey") % 3).cast("string").alias("status")))


@query("lc40_repeated", "SELECT l_orderkey AS rule_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def lc40b(t):
    return lc.repeated_ids(t("lineitem").select(F.col("l_orderkey").alias("rule_id")))


@query("lc42_list", "SELECT p_partkey AS rule_id FROM part WHERE contains(lower(p_name), 'ring') AND p_type = 'ECONOMY'")
def lc42(t):
    return lc.found(t("part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("name"), "p_type"), "ring", p_type="ECONOMY").select("rule_id")


@query("lc43_overview", "SELECT event_type, user_id % 3 AS bucket, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 3))")
def lc43(t):
    e = t("events").select("event_type", (F.col("user_id") % 3).alias("bucket"))
    return e.groupingSets([["event_type"], ["bucket"]], "event_type", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("lc44_feedback_stats", "SELECT event_type, user_id, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY GROUPING SETS ((event_type), (user_id))")
def lc44(t):
    return t("events").where("event_type in ('error', 'signup')").groupingSets([["event_type"], ["user_id"]], "event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("lc48_index_upkeep", "SELECT doc_id, (doc_id % 4 <> 0) AS present FROM documents")
def lc48(t):
    index = t("documents").select("doc_id")
    there = index.where("doc_id % 4 <> 0").select("doc_id", F.lit(True).alias("_p"))
    return index.join(there, "doc_id", "left").select("doc_id", F.coalesce("_p", F.lit(False)).alias("present"))
