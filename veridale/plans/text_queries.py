"""Sources, cleaning, tables, layout and classification on the generated tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import classify as c
from ..operators import layout as lay
from ..operators import tables as tab
from ..sources import files as fs
from .registry import query


@query("sc1_scan", "SELECT page_id, url FROM pages WHERE NOT list_contains(string_split(url, '/'), 'en') AND NOT regexp_matches(regexp_extract(url, '([^/]*)$', 1), '^(\\.|~\\$)|\\.tmp$')")
def sc1(t):
    return t("pages").where(fs.wanted(F.col("url"), "en", True)).select("page_id", "url")


@query("sc2_sniff", "SELECT page_id, CASE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' ELSE 'unknown' END AS method FROM pages")
def sc2(t):
    return t("pages").select("page_id", fs.method(F.col("url")).alias("method"))


@query("sc3_scanned", "SELECT doc_id, avg(length(s)) < 10 AS scanned FROM (SELECT doc_id, unnest(list_slice(string_split(text, chr(10)), 1, 3)) AS s FROM documents) GROUP BY 1")
def sc3(t):
    return fs.scanned(tab.pages(t("documents"), "\n"))


@query("sc5_joined_pages", "SELECT doc_id, string_agg('=== 第 ' || k || ' 页 ===' || chr(10) || s, chr(10) ORDER BY k) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) GROUP BY 1")
def sc5(t):
    return fs.joined_pages(tab.pages(t("documents"), "\n"))


@query("sc12_preview", "SELECT doc_id, substr(array_to_string(list_slice(string_split(text, chr(10)), 1, 5), chr(10)), 1, 300) AS preview FROM documents")
def sc12(t):
    return t("documents").select("doc_id", fs.preview(F.col("text")).alias("preview"))


@query("sc13_page_map", "SELECT doc_id, CAST(k AS INT) AS page, s AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)")
def sc13(t):
    return tab.pages(t("documents"), "\n")


@query("sc16_json_events", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def sc16(t):
    return t("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("sc21_markdown", "SELECT n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation")
def sc21(t):
    return t("nation").select("n_nationkey", fs.markdown_rows(["n_nationkey", "n_name"]).alias("line"))


@query("sc22_report", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def sc22(t):
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query("sc23_cheapest", "SELECT s_name AS name, s_acctbal AS price FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal, s_name LIMIT 1")
def sc23(t):
    p = t("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("price"), (F.col("s_acctbal") > 0).alias("configured"))
    return fs.cheapest(p).select("name", "price")


@query("sc24_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def sc24(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("sc25_incremental", "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS content_hash FROM documents WHERE NOT (doc_id % 3 = 0 AND lang <> 'de')")
def sc25(t):
    d = t("documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("content_hash"), "doc_id", "lang")
    index = d.where("doc_id % 3 = 0").select("path", "content_hash", F.when(F.col("lang") == "de", "failed").otherwise("completed").alias("status"))
    return fs.changed(d.select("path", "content_hash"), index)


PUNCT = "translate(text, '“”‘’–—' || chr(160) || chr(12288), '\"\"''''--  ')"
CLEAN = f"trim(regexp_replace(regexp_replace({PUNCT}, '([A-Za-z0-9])\\n([A-Za-z0-9])', '\\1\\2', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(32) || chr(9) || chr(10) || chr(13))"


@query("pr1_clean", f"SELECT doc_id, {CLEAN} AS text FROM documents")
def pr1(t):
    return t("documents").select("doc_id", x.cleaned(F.col("text")).alias("text"))


@query("pr2_half_width", "SELECT doc_id, text AS halved FROM documents")
def pr2(t):
    wide = F.translate("text", x.HALF_WIDTH, x.FULL_WIDTH)
    return t("documents").select("doc_id", x.half_width(wide).alias("halved"))


@query("pr5_punctuation", f"SELECT doc_id, {PUNCT} AS text FROM documents")
def pr5(t):
    return t("documents").select("doc_id", x.punctuation_normalised(F.col("text")).alias("text"))


@query("pr6_hard_breaks", "SELECT doc_id, regexp_replace(text, '([A-Za-z0-9])\\n([A-Za-z0-9])', '\\1\\2', 'g') AS text FROM documents")
def pr6(t):
    return t("documents").select("doc_id", x.hard_breaks_joined(F.col("text")).alias("text"))


LINES = """WITH l AS (SELECT doc_id, k, trim(s) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) WHERE trim(s) <> ''),
n AS (SELECT doc_id, 1 AS page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INT) AS line_no, line FROM l),
w AS (SELECT *, list_filter(regexp_split_to_array(line, '[ \\t]{2,}'), lambda s: s <> '') AS wide, list_filter(regexp_split_to_array(line, '[ \\t]+'), lambda s: s <> '') AS narrow FROM n),
k AS (SELECT doc_id, page, line_no, line, CASE WHEN len(wide) >= 3 THEN wide ELSE narrow END AS tokens FROM w)
"""


@query("pr20_lines", LINES + "SELECT doc_id, page, line_no, line FROM n")
def pr20(t):
    return tab.lines(t("documents"))


@query("pr8_tokens", LINES + "SELECT doc_id, line_no, array_to_string(tokens, '|') AS tokens FROM k")
def pr8(t):
    return tab.lines(t("documents")).select("doc_id", "line_no", F.array_join(x.line_tokens(F.col("line")), "|").alias("tokens"))


TEXT_TOKEN = "regexp_full_match(s, '[a-zA-Z]+')"


@query("pr18_generic_header", LINES + f"SELECT doc_id, line_no FROM k WHERE len(tokens) >= 3 AND len(list_filter(tokens, lambda s: {TEXT_TOKEN})) * 2 >= len(tokens) AND len(list_filter(tokens, lambda s: {TEXT_TOKEN})) >= 2")
def pr18(t):
    each = tab.lines(t("documents")).withColumn("tokens", x.line_tokens(F.col("line")))
    return each.where(tab.generic_header(F.col("tokens"))).select("doc_id", "line_no")


@query("pr21_first_header", LINES + f"SELECT doc_id, min(line_no) AS line_no FROM k WHERE len(tokens) >= 3 AND len(list_filter(tokens, lambda s: {TEXT_TOKEN})) * 2 >= len(tokens) AND len(list_filter(tokens, lambda s: {TEXT_TOKEN})) >= 2 GROUP BY 1")
def pr21(t):
    return pr18(t).groupBy("doc_id").agg(F.min("line_no").alias("line_no"))


@query("pr19_generic_rows")
def pr19(t):
    return tab.generic_rows(t("documents"))


@query("pr17_coerce", "SELECT DISTINCT p_name, p_brand, CASE WHEN p_size % 2 = 0 THEN 'int' ELSE 'double' END AS kind, CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size + 0.5 END AS number FROM part")
def pr17(t):
    raw = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5")))
    return t("part").select("p_name", "p_brand", x.coerced(raw).alias("c")).select("p_name", "p_brand", "c.kind", "c.number").distinct()


@query("pr12_chain", "SELECT o AS doc, count(*) AS n, avg(CASE WHEN abs(l - (e - b)) <= 30000 THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT l_orderkey AS o, l_extendedprice AS l, l_quantity * 1500 AS e, l_linenumber AS b FROM lineitem) GROUP BY 1")
def pr12(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_extendedprice").alias("l"), (F.col("l_quantity") * 1500).alias("e"), F.col("l_linenumber").alias("b"))
    return tab.chain_holds(rows, "l", "e", "b", 30000 - 1e-9).select("doc", "n", "share")


@query("pr11_column_features", "SELECT o_orderpriority AS doc_id, 'd' AS name, avg(CASE WHEN o_custkey % 4 > 0 THEN 1.0 ELSE 0.0 END) AS numeric FROM orders GROUP BY 1")
def pr11(t):
    raw = F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey").cast("string")).otherwise("x" )
    cells = t("orders").select(F.col("o_orderpriority").alias("doc_id"), F.lit("d").alias("name"), x.coerced(raw).alias("c")).select("doc_id", "name", "c.*")
    return tab.column_features(cells).select("doc_id", "name", "numeric")


@query("pr13_inferred_chain", "SELECT l_orderkey AS doc, 't' AS top, 'b' AS bottom FROM lineitem GROUP BY 1 HAVING count(*) >= 3")
def pr13(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    rows = t("lineitem").withColumn("k", F.row_number().over(w))
    v = rows.select(F.col("l_orderkey").alias("doc"), F.col("k").alias("row"), F.expr("stack(4, 'len', l_quantity, 't', l_extendedprice, 'b', l_extendedprice - l_quantity, 'z', l_tax)").alias("col", "v"))
    return tab.inferred_chain(v, "len", 1e-6).select("doc", "top", "bottom")


@query("pr14_fusion", "SELECT p_partkey, least(1.0, 0.5 + 0.3 * (p_size / 50.0) + 0.2 * CASE WHEN p_size % 2 = 0 THEN greatest(p_size / 60.0, 0.7) ELSE p_size / 60.0 END) AS confidence FROM part")
def pr14(t):
    s = F.col("p_size")
    return t("part").select("p_partkey", tab.header_fusion(s / 50.0, s / 60.0, s % 2 == 0)["confidence"].alias("confidence"))


@query("pr24_expected", "SELECT p_partkey AS doc_id, CASE WHEN p_brand = 'Brand#1' THEN 99 ELSE p_size * CASE WHEN p_type = 'ECONOMY' THEN 20 ELSE 15 END END AS expected FROM part")
def pr24(t):
    docs = t("part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("name"), F.col("p_size").alias("pages"), F.when(F.col("p_type") == "ECONOMY", "pdf").otherwise("txt").alias("file_type"))
    return tab.expected_rows(docs, docs.sparkSession.createDataFrame([("Brand#1", 99)], "name string, rows int"))


@query("pr25_row_gate", "SELECT l_orderkey AS doc, coalesce(count(*) / nullif(l_orderkey % 8, 0)::DOUBLE >= 0.8, true) AS ok FROM lineitem GROUP BY 1")
def pr25(t):
    n = t("lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("doc", tab.row_gate(F.col("n"), F.col("doc") % 8).alias("ok"))


def _items(t):
    li = t("lineitem")
    left, top = F.col("l_quantity") * 10, F.col("l_linenumber") * 20.0 + F.col("l_partkey") % 7
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("l_partkey") * 100000 + F.col("l_extendedprice").cast("int") % 100000).alias("item"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"),
        (1 - F.col("l_discount")).alias("confidence"), left.alias("x1"), top.alias("y1"), (left + 30 + F.col("l_suppkey") % 40).alias("x2"), (top + 12).alias("y2"))


ITEMS = """WITH i AS (SELECT l_orderkey AS doc_id, l_partkey * 100000 + trunc(l_extendedprice)::BIGINT % 100000 AS item, l_returnflag || l_linenumber AS text, 1 - l_discount AS confidence,
l_quantity * 10 AS x1, l_linenumber * 20.0 + l_partkey % 7 AS y1, l_quantity * 10 + 30 + l_suppkey % 40 AS x2, l_linenumber * 20.0 + l_partkey % 7 + 12 AS y2 FROM lineitem)
"""
INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
AREAS = "(a.x2 - a.x1) * (a.y2 - a.y1)", "(b.x2 - b.x1) * (b.y2 - b.y1)"


def _pairs(t):
    box = F.struct("x1", "y1", "x2", "y2")
    i = _items(t)
    a = i.select("doc_id", F.col("item").alias("i"), box.alias("a"))
    return a.join(i.select("doc_id", F.col("item").alias("j"), box.alias("b")), "doc_id").where("i < j")


@query("ly1_iou", ITEMS + f"SELECT a.doc_id, a.item AS i, b.item AS j, CAST({INTER} / ({AREAS[0]} + {AREAS[1]} - {INTER}) AS DOUBLE) AS iou FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.item < b.item")
def ly1(t):
    return _pairs(t).select("doc_id", "i", "j", lay.iou("a", "b").alias("iou"))


@query("ly2_min_overlap", ITEMS + f"SELECT a.doc_id, a.item AS i, b.item AS j, CAST({INTER} / least({AREAS[0]}, {AREAS[1]}) AS DOUBLE) AS share FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.item < b.item")
def ly2(t):
    return _pairs(t).select("doc_id", "i", "j", lay.min_overlap("a", "b").alias("share"))


@query("ly3_merge", ITEMS + "SELECT a.doc_id, a.item AS i, b.item AS j, least(a.x1, b.x1) AS x1, greatest(a.y2, b.y2) AS y2 FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.item < b.item")
def ly3(t):
    return _pairs(t).select("doc_id", "i", "j", lay.merged("a", "b").alias("m")).select("doc_id", "i", "j", "m.x1", "m.y2")


@query("ly4_without_overlaps")
def ly4(t):
    return lay.without_overlaps(_items(t))


@query("ly5_text_rows")
def ly5(t):
    return lay.text_rows(_items(t))


@query("ly5_gap_rows", ITEMS + ", c AS (SELECT *, (y1 + y2) / 2 AS c FROM i), g AS (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY doc_id ORDER BY c, x1, item) > 8 THEN 1 ELSE 0 END AS n FROM c) SELECT doc_id, item, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY c, x1, item ROWS UNBOUNDED PRECEDING) AS BIGINT) AS text_row FROM g")
def ly5_gap(t):
    return lay.gap_rows(_items(t)).select("doc_id", "item", "text_row")


@query("ly6_table_text", ITEMS + ", c AS (SELECT *, (y1 + y2) / 2 AS c FROM i), g AS (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY doc_id ORDER BY c, x1, item) > 8 THEN 1 ELSE 0 END AS n FROM c), r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY c, x1, item ROWS UNBOUNDED PRECEDING) AS k FROM g), l AS (SELECT doc_id, k, string_agg(text, '  ' ORDER BY x1, item) AS line FROM r GROUP BY 1, 2) SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text FROM l GROUP BY 1")
def ly6(t):
    return lay.table_text(lay.gap_rows(_items(t))).select("doc_id", "text")


@query("ly7_located_column", ITEMS + ", f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN text LIKE 'R%' THEN 0 ELSE 1 END, x1, item) AS k FROM i WHERE text LIKE 'R%' OR text LIKE 'A%') SELECT doc_id, x1 - 0.2 * (x2 - x1) AS \"left\", x2 + 0.4 * (x2 - x1) AS \"right\" FROM f WHERE k = 1")
def ly7(t):
    return lay.located_column(_items(t), ["^R", "^A"]).drop("page")


@query("ly7_fallback", ITEMS + ", f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN text LIKE 'R1%' THEN 0 ELSE 1 END, x1, item) AS k FROM i WHERE text LIKE 'R1%' OR contains(text, 'N') AND length(text) <= 4 AND (x1 + x2) / 2 < 275) SELECT doc_id, greatest(0, x1 - 0.2 * (x2 - x1)) AS \"left\", least(550, x2 + 0.4 * (x2 - x1)) AS \"right\" FROM f WHERE k = 1")
def ly7_fallback(t):
    """By a header, else by a short text in the left half."""
    return lay.located_column(_items(t), ["^R1"], "N", 550).drop("page")


@query("ly8_in_column", ITEMS + ", f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY x1, item) AS k FROM i WHERE text LIKE 'R%'), c AS (SELECT doc_id, x1 - 0.2 * (x2 - x1) AS l, x2 + 0.4 * (x2 - x1) AS r FROM f WHERE k = 1) SELECT i.doc_id, item FROM i JOIN c ON i.doc_id = c.doc_id WHERE (x1 + x2) / 2 BETWEEN l AND r")
def ly8(t):
    i = _items(t)
    return lay.in_column(i, lay.located_column(i, ["^R"])).select("doc_id", "item")


@query("ly9_mode", "SELECT o_custkey AS doc_id, count(*) FILTER (WHERE regexp_full_match(CAST(o_orderkey AS VARCHAR), '2[4-9][0-9]{2}[A-D]?')) >= 2 AS numbered FROM orders GROUP BY 1")
def ly9(t):
    return lay.numbered_pages(t("orders").select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), F.col("o_orderkey").cast("string").alias("text"))).drop("page")


@query("ly10_edit_distance", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON substr(a.c_name, 1, length(a.c_name) - 1) = substr(b.c_name, 1, length(b.c_name) - 1) AND a.c_custkey < b.c_custkey WHERE levenshtein(a.c_name, b.c_name) <= 1")
def ly10(t):
    cust = t("customer").select("c_custkey", "c_name", F.expr("substring(c_name, 1, length(c_name) - 1)").alias("block"))
    a, b = (cust.select("block", F.col("c_custkey").alias(n), F.col("c_name").alias(f"name_{n}")) for n in "ab")
    return a.join(b, "block").where((F.col("a") < F.col("b")) & (F.levenshtein("name_a", "name_b") <= 1)).select("a", "b")


@query("ly11_id_patterns", "SELECT o_orderkey FROM orders WHERE regexp_full_match(CAST(o_orderkey AS VARCHAR), '2[4-9][0-9]{2}[A-D]?')")
def ly11(t):
    return t("orders").where(F.col("o_orderkey").cast("string").rlike(lay.NUMBERED_ID)).select("o_orderkey")


@query("ly12_corrected", "SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 400 AND 999 THEN '2' || o_orderkey ELSE 'Z' || o_orderkey END AS id FROM orders")
def ly12(t):
    return t("orders").select("o_orderkey", lay.corrected_id(F.concat(F.lit("Z"), F.col("o_orderkey").cast("string"))).alias("id"))


CELL = "CASE o_orderkey % 8 WHEN 0 THEN concat('24', o_custkey % 10, 'O') WHEN 1 THEN concat('2.4', o_custkey % 100) WHEN 2 THEN concat('21l', o_custkey % 10, ',S', o_custkey % 10) WHEN 3 THEN concat('2OB', o_custkey % 10, '.I') WHEN 4 THEN concat('1', o_custkey % 10, ';3', o_custkey % 6) WHEN 5 THEN concat(' ', 400 + o_custkey % 600, ' ') WHEN 6 THEN concat('Z5', o_custkey % 10, 'o') ELSE o_orderpriority END"


@query("ly12_text", f"""WITH c AS (SELECT o_orderkey, o_custkey % 2 = 0 AS id_column, trim({CELL}) AS t FROM orders),
a AS (SELECT *, CASE WHEN regexp_matches(t, '^2[.,;:-]?[4-9][0-9]{{1,2}}[A-DI-Z0Oo]?$') THEN regexp_replace(regexp_replace(t, '^2[.,;:-]?([4-9][0-9]{{1,2}})([A-DI-Z0Oo]?)$', 'Z\\1\\2'), '^(Z[4-9][0-9]{{1,2}})I$', '\\1') ELSE t END AS u FROM c),
b AS (SELECT *, regexp_replace(regexp_replace(u, '^(Z[4-9][0-9]{{1,2}})[0Oo]$', '\\1D'), '^([4-9][0-9]{{1,2}})$', 'Z\\1') AS v FROM a),
e AS (SELECT o_orderkey, CASE WHEN id_column THEN v ELSE t END AS w FROM b)
SELECT o_orderkey, regexp_replace(CASE WHEN regexp_matches(w, '^2[0-9IlSBO]{{3}}[.,][0-9IlSBO]{{1,3}}$') THEN translate(w, 'IlSBO,', '11580.') ELSE w END, '^([0-9]{{2}})[:;.-]([0-9]{{2}})$', '\\1:\\2') AS text FROM e""")
def ly12_text(t):
    """Cells of the id column and of others, set right by their form."""
    return t("orders").select("o_orderkey", lay.corrected_text(F.expr(CELL), F.col("o_custkey") % 2 == 0).alias("text"))


@query("ly13_filled")
def ly13(t):
    """The orders of a customer as a page of numbered rows: some numbers unread, some cut short."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    n = F.lit(430) + F.col("o_custkey") % 300 + F.row_number().over(w) * F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(-1)
    text = F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("Z"), F.substring(n.cast("string"), 1, 2))).when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("2"), n.cast("string"))).otherwise(F.concat(F.lit("Z"), n.cast("string")))
    return lay.filled_ids(t("orders").select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), F.col("o_orderkey").alias("item"), text.alias("text"))).select("doc_id", "item", "text", "inferred")


@query("ly14_retry", ITEMS + ", k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence, item) AS k FROM i WHERE confidence < 0.95) SELECT doc_id, item FROM k WHERE k <= 2")
def ly14(t):
    return lay.to_retry(_items(t), 0.95, 2).select("doc_id", "item")


@query("ly15_flatten", ITEMS + "SELECT doc_id, text, x1, y2 FROM i")
def ly15(t):
    quad = F.struct(F.array(F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"), F.array("x1", "y2")).alias("points"), "text", F.col("confidence").alias("score"))
    return lay.flattened(_items(t).groupBy("doc_id", "page").agg(F.collect_list(quad).alias("quads"))).select("doc_id", "text", "x1", "y2")


@query("ly16_density", "SELECT vec_id, len(list_filter(embedding, lambda v: v < 0))::DOUBLE / len(embedding) AS density FROM embeddings")
def ly16(t):
    return t("embeddings").select("vec_id", lay.density(F.col("embedding"), 0).alias("density"))


CORE = {"red": ["red", "scarlet"], "blue": ["blue"], "metal": ["ring", "bolt"]}
WEAK = {"small": ["small"], "large": ["large", "big"]}


@query("cl3_classify", """WITH n AS (SELECT p_partkey AS path_id, p_name, (CASE WHEN p_name LIKE '%red%' OR p_name LIKE '%scarlet%' THEN 1 ELSE 0 END) AS r, (CASE WHEN p_name LIKE '%blue%' THEN 1 ELSE 0 END) AS b, (CASE WHEN p_name LIKE '%ring%' OR p_name LIKE '%bolt%' THEN 1 ELSE 0 END) AS m,
(CASE WHEN p_name LIKE '%small%' THEN 1 ELSE 0 END) AS s, (CASE WHEN p_name LIKE '%large%' OR p_name LIKE '%big%' THEN 1 ELSE 0 END) AS l FROM part)
SELECT path_id, CASE WHEN p_name LIKE '%widget%' THEN 'reference' WHEN r + b + m = 1 THEN 'core' WHEN r + b + m > 1 THEN 'core' WHEN s + l > 0 THEN 'weak' ELSE 'default' END AS source,
CASE WHEN p_name LIKE '%widget%' THEN 0.9 WHEN r + b + m = 1 THEN 0.9 WHEN r + b + m > 1 THEN 0.6 WHEN s + l = 1 THEN 0.6 WHEN s + l > 1 THEN 0.4 ELSE 0.3 END::DOUBLE AS confidence,
CASE WHEN p_name LIKE '%widget%' THEN NULL WHEN r = 1 THEN 'red' WHEN b = 1 THEN 'blue' WHEN m = 1 THEN 'metal' WHEN s = 1 THEN 'small' WHEN l = 1 THEN 'large' ELSE 'general' END AS label FROM n""")
def cl3(t):
    files = t("part").select(F.col("p_partkey").alias("path_id"), F.col("p_name").alias("path"))
    return c.classified(files, CORE, WEAK, ["widget"], ["nothing"]).select("path_id", "source", "confidence", "label")


@query("cl4_subtype", "SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_name LIKE '%red%' THEN 'red' ELSE 'other' END AS kind FROM part")
def cl4(t):
    return t("part").select("p_partkey", c.ladder(F.col("p_name"), [("ring", "ring"), ("red", "red")], "other").alias("kind"))


@query("cl5_formal", "SELECT p_brand, bool_or(p_name LIKE '%ring%') AS formal FROM part GROUP BY 1")
def cl5(t):
    return t("part").groupBy("p_brand").agg(F.bool_or(c.any_of(F.col("p_name"), ["ring"])).alias("formal"))


@query("cl6_drawing", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'as_built' WHEN p_size % 3 = 1 THEN 'process_sketch' ELSE 'design_basis' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'audited' ELSE 'reference' END AS role FROM part WHERE p_size % 3 < 2")
def cl6(t):
    name = F.when(F.col("p_size") % 3 == 0, "竣工图.pdf").when(F.col("p_size") % 3 == 1, "示意图.pdf")
    kind = c.drawing_type(name)
    return t("part").where("p_size % 3 < 2").select("p_partkey", kind.alias("kind"), c.drawing_role(kind, F.lit("竣工"), F.lit("general")).alias("role"))


TERMS = "(VALUES ('red','C1',1),('ring','C2',2),('small','C2',2),('blue','C3',3),('widget','C3',3)) AS m(word, code, ord)"


@query("cl8_best_label", f"SELECT doc_id, code, n FROM (SELECT doc_id, code, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ord) AS k FROM (SELECT p_partkey AS doc_id, code, ord, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) JOIN {TERMS} USING (word) GROUP BY 1, 2, 3)) WHERE k = 1")
def cl8(t):
    terms = t("part").sparkSession.createDataFrame([("red", "C1", 1), ("ring", "C2", 2), ("small", "C2", 2), ("blue", "C3", 3), ("widget", "C3", 3)], "word string, code string, ord int")
    return c.best_label(t("part").select(F.col("p_partkey").alias("doc_id"), F.explode(F.split("p_name", " ")).alias("word")), terms)


@query("cl9_assign", f"WITH b AS (SELECT doc_id, code FROM (SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ord) AS k FROM (SELECT p_partkey AS doc_id, code, ord, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) JOIN {TERMS} USING (word) GROUP BY 1, 2, 3)) WHERE k = 1) SELECT p_partkey AS doc_id, coalesce(CASE WHEN p_type = 'ECONOMY' THEN 'E1' END, CASE WHEN p_type LIKE '%AND%' THEN 'S1' END, b.code) AS code FROM part LEFT JOIN b ON p_partkey = b.doc_id")
def cl9(t):
    docs = t("part").select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("doc_type"))
    return c.assigned(docs, {"ECONOMY": "E1"}, {"AND": "S1"}, cl8(t)).select("doc_id", "code")


@query("cl10_tree", "SELECT r_name AS professional, string_agg(n_name, ',' ORDER BY n_nationkey) AS subs FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def cl10(t):
    dim = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("professional"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    return c.tree(dim).select("professional", F.array_join("subs.label", ",").alias("subs"))


@query("cl11_tasks", """WITH d AS (SELECT s_suppkey, s_nationkey % 5 AS p, CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE s_nationkey END AS s, s_suppkey % 3 AS i FROM supplier), n AS (SELECT *, count(*) OVER (PARTITION BY p, s) AS n FROM d)
SELECT CASE WHEN s IS NULL THEN 'unassigned' WHEN n > 3 THEN p || '/' || s || '/' || i ELSE p || '/' || s END AS task, count(*) AS n_docs, string_agg(s_suppkey, ',' ORDER BY s_suppkey) AS docs FROM n GROUP BY 1""")
def cl11(t):
    d = t("supplier").select(F.col("s_suppkey").alias("doc_id"), (F.col("s_nationkey") % 5).alias("professional"), F.when(F.col("s_suppkey") % 17 != 0, F.col("s_nationkey")).alias("sub"), (F.col("s_suppkey") % 3).alias("item"), F.array(F.lit("G1")).alias("checks"))
    return c.tasks(d, 3).select("task", "n_docs", F.array_join("docs", ",").alias("docs"))


@query("cl13_corrections", "SELECT DISTINCT c_mktsegment AS keyword, CAST(c_nationkey AS VARCHAR) AS label, 'candidate' AS status FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_nationkey < 10)")
def cl13(t):
    x_ = t("customer").select(F.col("c_mktsegment").alias("keyword"), F.col("c_nationkey").cast("string").alias("label"))
    return c.new_terms(x_, x_.where("keyword = 'BUILDING' and int(label) < 10").distinct())
