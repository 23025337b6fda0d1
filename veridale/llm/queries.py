"""The queries opN_<name>: thin forms of the operators, with the columns that their contracts name."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from . import chat, contamination, convtrie, langid, mixing, negatives, pii, quality, sharding, simhash, suffix, tokencount, urlfilter
from .urlfilter import UrlRule
from .words import unsigned_hex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learned(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, rules).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


#: A conversation whose texts hold other templates' marks.
EXTRA_TURNS = [(-7, k, role, "\\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))]


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(EXTRA_TURNS, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.formatted(chat.text_parts(turns)))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.placed(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extracted(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, s -> s.k = {k}))").cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    spans = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


URL_RULES = [UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"), UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/")]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{scratch.shared_dir(spark)}/veridale/token_cache/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.trie(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash, "op2_chat": op2_chat, "op10_token_counts": op10_token_counts, "op3_sharding": op3_sharding, "op4_suffix_dedup": op4_suffix_dedup, "op5_pii": op5_pii, "op6_contamination": op6_contamination, "op7_url_filters": op7_url_filters, "op8_mixing": op8_mixing, "op9_quality_rules": op9_quality_rules,
           "op11_conversation_trie": op11_conversation_trie, "op12_hard_negatives": op12_hard_negatives, "op13_language_id": op13_language_id}
_MARKS = len(chat.TURN) + len(chat.TEXT) + len(chat.END)
_SAID = EXTRA_TURNS[0][3]
_ESCAPED = "replace(replace({}, '\\', '\\\\'), '|', '\\|')"

CHAT_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')),
e AS (SELECT *, {_ESCAPED.format("text")} AS body, {_ESCAPED.format("role")} AS head FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + {_MARKS}) AS BIGINT) AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM e GROUP BY conv_id"""

_HOST = f"translate(regexp_extract({{0}}, '^[^/?#]*'), '{urlfilter.UPPER}', '{urlfilter.LOWER}')"
_AFTER = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
_NODE = f"{_HOST} || regexp_extract({{0}}, '^[^/?#]*([^#]*)', 1)"
_Q = "[\"'']"

URL_SQL = f"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
u AS (SELECT *, {_AFTER.format("url")} AS rest FROM p),
h AS (SELECT *, {_HOST.format("rest")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, {_NODE.format("rest")} AS node,
  list_transform(regexp_extract_all(html, '(?i)<link\\s[^<>]*\\brel\\s*=\\s*{_Q}?canonical\\b[^<>]*>'), lambda s: regexp_extract(s, '(?i)\\bhref\\s*=\\s*{_Q}?([^"''\\s>]+)', 1)) AS hrefs,
  list_transform(regexp_extract_all(html, '(?i)<meta\\s[^<>]*\\bhttp-equiv\\s*=\\s*{_Q}?refresh\\b[^<>]*>'), lambda s: regexp_extract(s, '(?i)\\burl\\s*=\\s*{_Q}?([^"''\\s>]+)', 1)) AS forwards FROM u),
t AS (SELECT host, path, node, replace(unnest(list_concat(hrefs, forwards)), '&amp;', '&') AS said FROM h),
x AS (SELECT *, CASE WHEN instr(said, '://') > 0 THEN said WHEN said LIKE '//%' THEN 'x:' || said WHEN said LIKE '/%' THEN 'x://' || host || said WHEN said = '' THEN '' ELSE 'x://' || host || regexp_extract(path, '^(.*/)?') || said END AS full_target FROM t),
y AS (SELECT *, {_AFTER.format("full_target")} AS target_rest FROM x),
e AS (SELECT * FROM (SELECT node AS a, {_NODE.format("target_rest")} AS b FROM y) WHERE a <> '' AND b <> '' AND a <> b),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
rules(verdict, host, path) AS (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}),
m AS (SELECT page_id, node, h.host, h.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS own
  FROM h LEFT JOIN rules r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY 1, 2, 3, 4),
c AS (SELECT r.a AS node, min(r.b) AS component, coalesce(bool_or(own = 'block'), false) AND NOT coalesce(bool_or(own = 'allow'), false) AS passed FROM reach r LEFT JOIN m ON m.node = r.b GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN passed THEN 'block' END, 'allow') AS verdict, component FROM m LEFT JOIN c ON m.node = c.node"""

#: Crc32 by its table of bytes; nodes by their digests joined.
TRIE_SQL = """
WITH bytes AS (SELECT list(list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS crcs FROM range(256) r(v)),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT *, sha256(length(role) || ':' || role || text) AS digest, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words FROM t),
own AS (SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS k FROM g),
c AS (SELECT conv_id, conv_id - ((conv_id % 20) + 20) % 20 AS family,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own), bytes),
both_parts AS (SELECT c.conv_id, k, digest, words FROM c JOIN own ON own.conv_id = c.family AND k <= h UNION ALL SELECT c.conv_id, k, digest, words FROM c JOIN own ON own.conv_id = c.conv_id AND k > h),
p AS (SELECT conv_id, words, string_agg(digest, '') OVER w AS path, row_number() OVER w AS depth, count(*) OVER (PARTITION BY conv_id) AS turns FROM both_parts WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
m AS (SELECT conv_id, words, path, depth, depth = turns AS last FROM p UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM p) FROM c),
n AS (SELECT path, min(depth) AS depth, min(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM m GROUP BY path),
d AS (SELECT n.path, n.conv_id, n.depth, n.n_convs, n.words, n.ends_sha256, up.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND starts_with(x.path, n.path)) AS n_children
  FROM n LEFT JOIN n up ON n.depth > 0 AND up.path = left(n.path, greatest(length(n.path) - 64, 0)))
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, a.parent_conv_id, a.n_convs, CAST(a.n_children AS BIGINT) AS n_children, CAST(count(*) FILTER (WHERE b.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens, a.ends_sha256
FROM d a JOIN d b ON starts_with(b.path, a.path) GROUP BY ALL"""

NEGATIVES_SQL = f"""
WITH r AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE alike) WHERE k <= {negatives.N_POSITIVES}),
n AS (SELECT p.a, p.b AS positive, p.score AS positive_score, s.b AS negative, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS k
  FROM p JOIN s ON s.a = p.a AND NOT s.alike WHERE {negatives.LOW} * p.score <= 100 * s.score AND 100 * s.score <= {negatives.HIGH} * p.score)
SELECT a AS anchor_id, positive AS positive_id, CAST(k AS INT) AS rank, negative AS negative_id, positive_score, negative_score FROM n WHERE k <= {negatives.N_NEGATIVES}"""

#: The others need hashes that SQL lacks, learned models or the tokenizer: tests hold them against plain versions.
ORACLE_SQL = {"op2_chat": CHAT_SQL, "op7_url_filters": URL_SQL, "op11_conversation_trie": TRIE_SQL, "op12_hard_negatives": NEGATIVES_SQL}
