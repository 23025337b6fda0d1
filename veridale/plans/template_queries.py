"""The rule catalogue, its templates, and streams, on the generated tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, rules as r
from ..operators import templates as tp
from .registry import query
from .source_queries import folder

#: Columns of records and of parties, made from the tables; the same expressions in Spark and in DuckDB.
RECORD = {
    "actual_length": "l_quantity", "top_elev": "l_tax * 100", "bottom_elev": "l_linenumber", "filling_coeff": "l_discount * 10", "volume": "l_extendedprice / 1000", "diameter": "l_suppkey % 3",
    "sink_time": "CASE WHEN l_returnflag <> 'R' THEN '08:30' END", "pull_time": "CASE WHEN l_linestatus = 'O' THEN ' ' ELSE '09:00' END", "read_rows": "l_linenumber", "actual_rows": "l_suppkey % 7 + 1",
    "plan_rate": "l_discount * 10", "report_rate": "l_tax * 10", "review_rate": "l_quantity / 50", "sign_day": "CASE WHEN l_partkey % 3 > 0 THEN l_linestatus END", "seal": "CASE WHEN l_partkey % 5 = 0 THEN '' ELSE l_linestatus END"}
PARTY = {
    "project_no": "o_custkey", "pile_no": "o_custkey", "pay_period": "o_orderkey % 4", "process_name": "o_orderpriority", "day": "o_orderkey % 30", "lot_no": "o_orderkey % 5", "trial_no": "o_orderkey % 6",
    "scheme_no": "o_orderkey % 7", "batch": "o_orderkey % 9", "meeting_no": "o_orderkey % 3", "item_no": "o_orderkey % 2"}


def _columns(of: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in of.items())


def _in_duckdb(check: str) -> str:
    """The catalogue's predicates use two functions that DuckDB names otherwise."""
    for a, b in (("volume", "3.14159265 * power(diameter / 2, 2) * actual_length"), ("abs(field_a - field_b)", "greatest(field_a, field_b)")):
        check = check.replace(f"try_divide({a}, {b})", f"({a} / nullif({b}, 0))")
    return check.replace("unix_timestamp(", "epoch(")


ROW_SQL = f"WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS row_index, {_columns(RECORD)} FROM lineitem)\n" + "\nUNION ALL ".join(
    f"SELECT doc_id, row_index, '{x.rule_id}' AS rule_id FROM r WHERE NOT coalesce({_in_duckdb(x.check)}, true)" for x in catalog.row_rules(("record",)) if x.status == "active")


@query("rules_row_catalogue", ROW_SQL)
def row_catalogue(t):
    """Every rule of kind row that is active, on every line item as a record."""
    rows = t("lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS row_index", "'record' AS doc_type", *[f"{e} AS {n}" for n, e in RECORD.items()])
    return r.checked_rows(rows, catalog.row_rules(("record",))).select("doc_id", "row_index", "rule_id")


ENTRIES = ", ".join(f"('{i}', '{scope}', '{level}', '{severity}')" for i, scope, level, severity, kind, _ in catalog.entries() if kind == "row")


@query("rules_catalogue", f"WITH v AS ({ROW_SQL}) SELECT id AS rule_id, scope, level, severity, CAST(count(doc_id) AS BIGINT) AS n FROM (VALUES {ENTRIES}) AS x(id, scope, level, severity) LEFT JOIN v ON rule_id = id GROUP BY 1, 2, 3, 4")
def catalogue(t):
    """The row rules of the catalogue, and how many line items each finds something wrong with; none for those that aren't active."""
    found = row_catalogue(t).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    rows = [e[:4] for e in catalog.entries() if e[4] == "row"]
    listed = t("lineitem").sparkSession.createDataFrame(rows, "rule_id string, scope string, level string, severity string")
    return listed.join(found, "rule_id", "left").select("rule_id", "scope", "level", "severity", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _value(rule_id: str, side: str) -> str:
    """What a rule compares: dates, but for the one on lengths."""
    return f"{'max' if side == 'a' else 'min'}({'o_totalprice' if rule_id == 'CU-001' else 'o_orderdate'})"


def _pair_sql(x) -> str:
    keys = ", ".join(x.join_keys)
    a, b = (f"(SELECT {keys}, {_value(x.rule_id, s)} AS field_{s}, true AS in_{s} FROM o WHERE o_orderstatus = '{status}' GROUP BY ALL)" for s, status in (("a", "F"), ("b", "O")))
    return f"""SELECT '{x.rule_id}' AS rule_id, CASE WHEN in_a AND in_b THEN '{x.severity}' ELSE 'Best Practice' END AS severity, count(*) AS n FROM {a} FULL JOIN {b} USING ({keys})
WHERE in_a IS NULL OR in_b IS NULL OR NOT coalesce({_in_duckdb(x.check)}, true) GROUP BY ALL"""


@query("rules_pair_catalogue", f"WITH o AS (SELECT o_orderstatus, o_totalprice, o_orderdate, {_columns(PARTY)} FROM orders)\n" + "\nUNION ALL ".join(map(_pair_sql, catalog.pair_rules())))
def pair_catalogue(t):
    """Every rule of kind pair, between finished and open orders as two parties."""
    o = t("orders").selectExpr("o_orderstatus", "o_totalprice", "o_orderdate", *[f"{e} AS {n}" for n, e in PARTY.items()])
    a, b = (o.where(F.col("o_orderstatus") == status) for status in "FO")
    found = r.reconciled_together(a, b, catalog.pair_rules(), lambda x: _value(x.rule_id, "a"), lambda x: _value(x.rule_id, "b"))
    return found.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("tp_chain", "SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE NOT (o_orderdate <= a AND a <= b)")
def chain(t):
    ship = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    return tp.chain(t("orders").join(ship, "o_orderkey"), "o_orderdate", "first", "last").select("o_orderkey")


def _quantities(t):
    parts = t("lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"))
    return parts, t("orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"))


SUMS = "SELECT o_orderkey AS key, o_totalprice AS value, s::DOUBLE AS total FROM orders JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"


@query("tp_rollup", SUMS + " WHERE abs(s::DOUBLE - o_totalprice) > 0.05 * o_totalprice")
def rollup(t):
    return tp.rollup(*_quantities(t), "key", 0.05).select("key", *[F.col(c).cast("double").alias(c) for c in ("value", "total")])


@query("tp_not_above", SUMS + " WHERE s > CAST(o_totalprice AS DECIMAL(18,2))")
def not_above(t):
    return tp.not_above(*_quantities(t), "key").select("key", *[F.col(c).cast("double").alias(c) for c in ("value", "total")])


def _by(t, kind):
    return t("events").where(F.col("event_type") == kind).select("user_id", F.to_date("ts").alias("day"))


@query("tp_without", "WITH e AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events) SELECT user_id, day FROM e WHERE event_type = 'error' AND NOT (EXISTS (SELECT 1 FROM e x WHERE x.user_id = e.user_id AND x.day = e.day AND x.event_type = 'view') AND EXISTS (SELECT 1 FROM e x WHERE x.user_id = e.user_id AND x.day = e.day AND x.event_type = 'click'))")
def without(t):
    return tp.without(_by(t, "error").distinct(), _by(t, "view"), _by(t, "click"), on=["user_id", "day"])


@query("tp_unless", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT l_quantity >= 5 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT')")
def unless(t):
    excuse = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return tp.unless(t("lineitem"), F.col("l_quantity") >= 5, excuse, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("tp_different_sets", "WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS a, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS b FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2) SELECT user_id, count(*) FILTER (WHERE b = 0) AS only_a, count(*) FILTER (WHERE a = 0) AS only_b FROM s GROUP BY 1 HAVING count(*) FILTER (WHERE b = 0 OR a = 0) > 0")
def different_sets(t):
    return tp.different_sets(_by(t, "view"), _by(t, "click"), "user_id", "day")


@query("tp_missing_members", "SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'signup' EXCEPT SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'purchase'")
def missing_members(t):
    return tp.missing_members(_by(t, "signup"), _by(t, "purchase"), "user_id", "day")


@query("tp_several_values", "SELECT l_orderkey AS key, count(DISTINCT l_returnflag) AS kinds FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def several_values(t):
    return tp.several_values(t("lineitem").select(F.col("l_orderkey").alias("key"), "l_returnflag"), "key", "l_returnflag")


@query("tp_implies", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'A' AND NOT l_quantity >= 10")
def implies(t):
    return tp.implies(t("lineitem"), F.col("l_returnflag") == "A", F.col("l_quantity") >= 10).select("l_orderkey", "l_linenumber", "l_partkey")


@query("tp_fewer", "WITH n AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS n, count(*) FILTER (WHERE event_type = 'click') AS needed FROM events GROUP BY 1) SELECT * FROM n WHERE n < needed")
def fewer(t):
    return tp.fewer(_by(t, "view"), _by(t, "click"), "user_id")


@query("tp_hours", "SELECT e.event_id FROM events e JOIN events f ON f.event_id = e.event_id + 1 WHERE NOT (floor(epoch(f.ts)) - floor(epoch(e.ts))) / 3600 >= 0.05")
def hours(t):
    e = t("events")
    later = e.select((F.col("event_id") - 1).alias("event_id"), F.col("ts").alias("later"))
    return e.join(later, "event_id").where(~(tp.hours_between(F.col("later"), F.col("ts")) >= 0.05)).select("event_id")


@query("tp_intervals", "SELECT user_id, day, previous, CAST(date_diff('day', previous, day) AS INT) AS days FROM (SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS previous FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)) WHERE date_diff('day', previous, day) > 2")
def intervals(t):
    return tp.wide_intervals(t("events").select("user_id", F.to_date("ts").alias("day")), "user_id", "day", 2)


@query("tp_as_of", "SELECT e.event_id, f.value AS last_price FROM (SELECT * FROM events WHERE event_type = 'view') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) f ON e.user_id = f.user_id AND e.ts >= f.ts")
def as_of(t):
    e = t("events")
    rows = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return tp.as_of(rows, e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_price")), "user_id", "ts", "last_price").select("event_id", "last_price")


@query("tp_total_source", "SELECT p_partkey, CASE WHEN p_size % 2 = 1 AND p_size % 5 > 0 THEN 'no_row' WHEN p_size % 2 = 0 AND p_size % 5 > 0 AND p_size % 5 <> 2 THEN 'mismatch' WHEN p_size % 2 = 1 THEN 'no_total' ELSE 'consistent' END AS state FROM part")
def total_source(t):
    rows = t("part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("has_row"), F.when(F.col("p_size") % 5 > 0, F.col("p_size") % 5).alias("total"), F.lit(2).alias("parts"))
    return tp.total_source(rows).select("p_partkey", "state")


def _streamed(t, derive):
    """derive() over the events as a stream that ends with what is there now."""
    from ..streaming import logs

    events = t("events")
    to = folder(events)
    events.write.parquet(f"{to}/in")
    return logs.run_once(derive(logs.source(events.sparkSession, f"{to}/in")), to)


@query("st_totals", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def st_totals(t):
    from ..streaming import logs

    return _streamed(t, logs.totals).select("event_type", "n")


@query("st_triggered", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 60")
def st_triggered(t):
    from ..streaming import logs

    return _streamed(t, lambda e: logs.triggered(e, 60))


@query("st_windows", "SELECT w AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest(list_transform(range(7), lambda i: date_trunc('day', ts) - to_days(i::INT))) AS w FROM events) GROUP BY 1, 2")
def st_windows(t):
    from ..streaming import logs

    return _streamed(t, logs.recent_counts)
