"""Rule engine: rules are Spark SQL predicates over rows, and fail open.

A rule passes a row unless its predicate is false: null operands, a zero divisor or a value of the wrong
type make it null (try_divide, try_cast), which passes. A rule whose fields the rows don't have is
skipped, so it passes as well. All active rules of a scope are evaluated in one pass over the rows, as an array of
structs; only violations are exploded. Documents against each other: one full outer equi-join per rule.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Also the severities' order in reports.
SEVERITIES = ("Fatal", "Sanity Check", "Best Practice")
LEVELS = ("L1", "L2", "L3")
RESULTS = {"Fatal": "fail", "Sanity Check": "suspicious", "Best Practice": "pass"}
VIOLATION = ("rule_id", "level", "scope", "severity", "row_index", "message", "context")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    scope: str
    level: str
    severity: str
    check: str
    template: str = ""
    fields: tuple[str, ...] = ()
    doc_types: tuple[str, ...] = ()
    status: str = "active"
    projects: tuple[str, ...] = ("global",)
    join_keys: tuple[str, ...] = ()
    field_a: str = ""
    field_b: str = ""
    doc_type_a: str = ""
    doc_type_b: str = ""
    extra: dict = field(default_factory=dict, compare=False, hash=False)


COLUMNS = ("rule_id", "scope", "level", "severity", "status")


def as_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a table, arrays for doc_types, fields and projects."""
    rows = [(*[getattr(r, c) for c in COLUMNS], [*r.doc_types], [*r.fields], [*r.projects]) for r in rules]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS) + ", doc_types array<string>, fields array<string>, projects array<string>")


def active(rules: DataFrame, project: str | None = None) -> DataFrame:
    """status active, for all projects or for this one."""
    scoped = F.array_contains("projects", "global")
    return rules.where((F.col("status") == "active") & (F.lit(True) if project is None else scoped | F.array_contains("projects", project)))


def matching_type(rules: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, rule_id by literal membership of the document's type; `*` is no wildcard.

    Rules are configuration, so they are broadcast, one row a type: rows of documents don't meet by their few types, and are made distinct before rules are listed.
    """
    each = rules.select("rule_id", F.explode("doc_types").alias("doc_type")).groupBy("doc_type").agg(F.collect_set("rule_id").alias("rule_ids"))
    found = documents.select("doc_id", "doc_type").join(F.broadcast(each), "doc_type").groupBy("doc_id").agg(F.collect_set("rule_ids").alias("rule_ids"))
    return found.select("doc_id", F.explode(F.array_distinct(F.flatten("rule_ids"))).alias("rule_id"))


def message(template: str, columns: list[str]) -> Column:
    """The template with {field} replaced by the row's value; unknown or null fields stay as they are."""
    parts = [F.lit("")]
    for text, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", template):
        parts.append(F.lit(text))
        if name:
            kept = F.lit("{" + name + "}")
            parts.append(F.coalesce(F.col(name).cast("string"), kept) if name in columns else kept)
    return F.concat(*parts)


def holds(check: str) -> Column:
    """True where the predicate passes: it is true or can't be told."""
    return F.coalesce(F.expr(check), F.lit(True))


def deviation(a: Column, b: Column) -> Column:
    """Difference in percent of the larger magnitude; 0 for two zeros, null without both."""
    top = F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.abs(a), F.abs(b)))
    return F.when(top == 0, 0.0).otherwise(F.abs(a - b) * 100 / top)


def snapshot(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def usable(rule: Rule, columns: list[str]) -> bool:
    return all(f in columns for f in rule.fields)


def checked_rows(rows: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("doc_id", "row_index"), context: tuple[str, ...] = ()) -> DataFrame:
    """Violations of single rows, under all rules at once.

    For scope SINGLE_DOC, rows have doc_type and a rule looks at its types and at rows that have all its
    fields; for CROSS_DOC, at every row.
    """
    columns = rows.columns
    found = []
    for r in rules:
        if r.status != "active" or not usable(r, columns):
            continue
        applies = F.lit(True)
        if r.scope == "SINGLE_DOC":
            applies = F.col("doc_type").isin(*r.doc_types) if r.doc_types else F.lit(False)
        found.append(F.when(applies & ~holds(r.check), F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.level).alias("level"), F.lit(r.scope).alias("scope"), F.lit(r.severity).alias("severity"),
            message(r.template or r.rule_id, columns).alias("message"))))
    if not found:
        found = [F.lit(None).cast("struct<rule_id:string,level:string,scope:string,severity:string,message:string>")]
    hits = rows.withColumn("_v", F.explode(F.array_compact(F.array(*found))))
    return hits.select(*keep, "_v.*", *([snapshot([*context]).alias("context")] if context else []))


def key_of(keys: tuple[str, ...]) -> Column:
    """Key values as strings, null as empty, so null keys meet."""
    return F.concat_ws("||", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def reconciled(a: DataFrame, b: DataFrame, rule: Rule) -> DataFrame:
    """Every pair of rows of the two parties with one key, and rows without a partner.

    key, field_a, field_b, deviation (percent), side (both, a, b), severity (null: passes). A pair fails if the predicate
    over field_a and field_b is false; a missing partner is a Best Practice finding.
    """
    left = a.select(key_of(rule.join_keys).alias("key"), F.col(rule.field_a).alias("field_a"), F.lit(True).alias("in_a"))
    right = b.select(key_of(rule.join_keys).alias("key"), F.col(rule.field_b).alias("field_b"), F.lit(True).alias("in_b"))
    pairs = left.join(right, "key", "full_outer")
    side = F.when(F.col("in_a").isNull(), "b").when(F.col("in_b").isNull(), "a").otherwise("both")
    severity = F.when(F.col("side") != "both", "Best Practice").when(~holds(rule.check), rule.severity)
    numbers = all(isinstance(pairs.schema[f].dataType, NumericType) for f in ("field_a", "field_b"))
    percent = deviation(F.col("field_a"), F.col("field_b")) if numbers else F.lit(None).cast("double")
    return pairs.withColumn("side", side).withColumn("deviation", percent).withColumn("severity", severity).select("key", "field_a", "field_b", "deviation", "side", "severity")


def reconciled_together(a: DataFrame, b: DataFrame, rules: list[Rule], of_a: Callable[[Rule], str], of_b: Callable[[Rule], str]) -> DataFrame:
    """rule_id, key, side, severity of every finding of all rules between two parties, from one pass over each.

    of_a, of_b: the aggregate (SQL) that a side's value for a key is. Each row is given one key for each different list of join keys, and
    all values of all keys come from one aggregate that is combined before its shuffle; a key's two sides meet there, so
    nothing is joined. The rules of a list are then evaluated together.
    """
    lists = list(dict.fromkeys(r.join_keys for r in rules))
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("list"), key_of(names).alias("key")) for k, names in enumerate(lists)]))
    both = a.withColumn("_in_a", F.lit(True)).unionByName(b.withColumn("_in_a", F.lit(False)), allowMissingColumns=True).withColumn("_k", keys)
    values = list(dict.fromkeys([f"{of_a(r)} FILTER (WHERE _in_a)" for r in rules] + [f"{of_b(r)} FILTER (WHERE NOT _in_a)" for r in rules]))
    made = both.groupBy("_k.list", "_k.key").agg(F.bool_or("_in_a").alias("has_a"), F.bool_or(~F.col("_in_a")).alias("has_b"), *[F.expr(v).alias(f"v{k}") for k, v in enumerate(values)])
    side = F.when(~F.col("has_b"), "a").when(~F.col("has_a"), "b").otherwise("both")
    found = []
    for r in rules:
        names = {"field_a": f"v{values.index(f'{of_a(r)} FILTER (WHERE _in_a)')}", "field_b": f"v{values.index(f'{of_b(r)} FILTER (WHERE NOT _in_a)')}"}
        check = re.sub(r"\bfield_[ab]\b", lambda m, names=names: names[m[0]], r.check)
        severity = F.when(F.col("side") != "both", "Best Practice").when(~holds(check), r.severity)
        found.append(F.when((F.col("list") == lists.index(r.join_keys)) & severity.isNotNull(), F.struct(F.lit(r.rule_id).alias("rule_id"), severity.alias("severity"))))
    each = made.withColumn("side", side).select("key", "side", F.explode(F.array_compact(F.array(*found))).alias("f"))
    return each.select("f.rule_id", "key", "side", "f.severity")


def report(violations: DataFrame) -> DataFrame:
    """part (total, level, severity), name, n, zero-filled, from one pass of grouping sets."""
    spark = violations.sparkSession
    sets = violations.groupingSets([["level"], ["severity"], []], "level", "severity").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    named = sets.select(F.when(F.col("g") == 1, "level").when(F.col("g") == 2, "severity").otherwise("total").alias("part"), F.coalesce("level", "severity", F.lit("all")).alias("name"), "n")
    wanted = spark.createDataFrame([("total", "all"), *[("level", x) for x in LEVELS], *[("severity", x) for x in SEVERITIES]], "part string, name string")
    return wanted.join(named, ["part", "name"], "left").select("part", "name", F.coalesce("n", F.lit(0)).alias("n"))


def findings(violations: DataFrame) -> DataFrame:
    """violations with result: fail, suspicious or pass by severity."""
    out = F.lit(None).cast("string")
    for severity, result in RESULTS.items():
        out = F.when(F.col("severity") == severity, result).otherwise(out)
    return violations.withColumn("result", out)


def derived(rows: DataFrame) -> DataFrame:
    """computed (top - bottom), diff, expected_coeff, coeff_diff, has_time_pair where they can be told and aren't there yet."""
    made = {
        "computed": "try_cast(top_elev as double) - try_cast(bottom_elev as double)",
        "diff": "bround(abs(try_cast(actual_length as double) - (try_cast(top_elev as double) - try_cast(bottom_elev as double))), 4)",
        "expected_coeff": "try_divide(try_cast(volume as double), pi() * power(try_cast(diameter as double) / 2, 2) * try_cast(actual_length as double))",
        "coeff_diff": "abs(try_cast(filling_coeff as double) - try_divide(try_cast(volume as double), pi() * power(try_cast(diameter as double) / 2, 2) * try_cast(actual_length as double)))",
        "has_time_pair": "start_time is not null and end_time is not null",
    }
    needs = {"computed": ("top_elev", "bottom_elev"), "diff": ("actual_length", "top_elev", "bottom_elev"), "expected_coeff": ("volume", "diameter", "actual_length"), "coeff_diff": ("filling_coeff", "volume", "diameter", "actual_length"), "has_time_pair": ("start_time", "end_time")}
    return rows.withColumns({n: F.expr(e) for n, e in made.items() if n not in rows.columns and all(c in rows.columns for c in needs[n])})


def by_id(rules: DataFrame, rule_id: str) -> DataFrame:
    """The first rule with this id."""
    return rules.where(F.col("rule_id") == rule_id).limit(1)


def matching(rules: DataFrame, column: str, value: str) -> DataFrame:
    """Rules whose array `column` has the value literally."""
    return rules.where(F.array_contains(column, value))


def of_scope(rules: DataFrame, scope: str) -> DataFrame:
    return rules.where(F.col("scope") == scope)


def rule_errors() -> Column:
    """Array of what is wrong with a rule row (rule_id, scope, level, severity, status, check); empty if nothing."""
    bad = [
        (~F.coalesce(F.col("rule_id").rlike("^[A-Z]{2,3}-[0-9]+$"), F.lit(False)), "rule_id"), (~F.coalesce(F.col("scope").isin("SINGLE_DOC", "CROSS_DOC", "CROSS_UNIT"), F.lit(False)), "scope"),
        (~F.coalesce(F.col("level").isin(*LEVELS), F.lit(False)), "level"), (~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), "severity"),
        (~F.coalesce(F.col("status").isin("draft", "testing", "incubating", "active", "deprecated"), F.lit(False)), "status"), (F.coalesce(F.col("check"), F.lit("")) == "", "check"),
    ]
    return F.array_compact(F.array(*[F.when(b, name) for b, name in bad]))


def upserted(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """rules with the rows of changes (same columns) in place of those of their id, and new ones added."""
    return rules.join(changes.select("rule_id"), "rule_id", "left_anti").unionByName(changes.select(rules.columns))


def without_drafts(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """rules without those of ids that are drafts; others can't be deleted."""
    gone = rules.join(ids, "rule_id", "left_semi").where("status = 'draft'").select("rule_id")
    return rules.join(gone, "rule_id", "left_anti")
