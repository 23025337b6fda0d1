"""Validation of rules as JSON documents: every constraint of the rule format, as Columns over a parsed value.

Absent fields, nulls and values of another type are told apart, so a document is one VARIANT and not a row of a fixed schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The format's required fields, lists of allowed values and patterns; fixed values.
REQUIRED = ("rule_id", "name", "level", "scope", "trigger_when", "check_expr", "error_template", "status", "source", "version", "created_at", "updated_at", "changelog")
ALLOWED = {
    "level": ("L1-IRON", "L2-LOGIC", "L3-BUSINESS"), "scope": ("SINGLE_DOC", "CROSS_DOC", "CROSS_UNIT"),
    "status": ("draft", "testing", "active", "incubating", "deprecated", "pending_confirmation"), "source": ("system", "custom", "incubated")}
SEVERITIES, CHECKS = ("Fatal", "Sanity Check", "Best Practice"), ("expression", "cross_compare", "aggregation")
RULE_ID, VERSION = "^[A-Z]+-[A-Z0-9-]+$", r"^\d+\.\d+\.\d+$"
MOMENT = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?(Z|[+-]\d{2}:\d{2})?$"
COUNTS, RATES, CHANGE = ("total_hits", "total_reviews", "false_positive_count"), ("hit_rate", "false_positive_rate"), ("version", "date", "author", "change")


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID (null) or a kind of number; empty where there is nothing."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit(""))


def checked(rows: DataFrame, column: str, name: str = "errors") -> DataFrame:
    """rows with `name`: an array of what is wrong with the rule in a column of JSON text: fields and constraints in a fixed order; `document` alone if it is no JSON object.

    A text is parsed once, and the kind and value of each path are taken once, before the constraints are put together from them.
    """
    found: dict[tuple[str, str], Column] = {}

    def once(what: str, path: str, value: Column) -> Column:
        found.setdefault((what, path), value)
        return F.col(f"_of.`{what} {path}`")

    whole = F.col("_whole")
    at = lambda path: F.try_variant_get(whole, f"$.{path}", "variant")
    kind = lambda path: once("kind", path, _kind(at(path)))
    there = lambda path: kind(path) != ""
    said = lambda path: F.when(kind(path) == "STRING", once("text", path, F.try_variant_get(whole, f"$.{path}", "string")))
    among = lambda path, of: F.coalesce(said(path).isin(*of), F.lit(False))
    full = lambda path: F.coalesce(said(path) != "", F.lit(False))
    odd = lambda path, pattern: F.coalesce(~said(path).rlike(pattern), F.lit(False))
    number = lambda path, kinds: kind(path).isin(*kinds) & F.coalesce(once("number", path, F.try_variant_get(whole, f"$.{path}", "double")) >= 0, F.lit(False))
    unit = among("scope", ("CROSS_UNIT",))
    trigger, check, aligned, stats = (kind(p) == "OBJECT" for p in ("trigger_when", "check_expr", "alignment", "stats"))
    items = F.try_variant_get(whole, "$.changelog", "array<variant>")
    lacking = lambda v: (_kind(v) != "OBJECT") | ~F.coalesce(F.forall(F.array(*map(F.lit, CHANGE)), lambda k: F.array_contains(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), k)), F.lit(False))
    keys = F.try_variant_get(whole, "$.alignment.join_key", "array<variant>")
    bad_changes = once("bad items of", "changelog", F.coalesce(F.exists(items, lacking), F.lit(False)))
    sound_keys = once("strings only", "alignment.join_key", F.coalesce((F.size(keys) > 0) & F.forall(keys, lambda k: _kind(k) == "STRING"), F.lit(False))) & (kind("alignment.join_key") == "ARRAY")
    confirmed = once("truth", "confirmation_required", F.coalesce(F.try_variant_get(whole, "$.confirmation_required", "boolean"), F.lit(False))) & (kind("confirmation_required") == "BOOLEAN")
    bad = [(~there(f), f"no {f}") for f in REQUIRED]
    bad += [(odd("rule_id", RULE_ID), "rule_id"), (there("name") & ~full("name"), "name")]
    bad += [(there(f) & ~among(f, of), f) for f, of in list(ALLOWED.items())[:2]]
    bad += [(there("trigger_when") & ~trigger, "trigger_when")]
    bad += [(trigger & unit & ~there(f"trigger_when.{f}"), f"trigger_when.{f}") for f in ("doc_type_a", "doc_type_b")]
    bad += [(trigger & ~unit & (kind("trigger_when.doc_type") != "ARRAY"), "trigger_when.doc_type"), (there("check_expr") & ~check, "check_expr")]
    bad += [(check & ~among("check_expr.type", CHECKS), "check_expr.type"), (check & ~full("check_expr.expr"), "check_expr.expr"), (there("error_template") & ~full("error_template"), "error_template")]
    bad += [(there(f) & ~among(f, of), f) for f, of in list(ALLOWED.items())[2:]]
    bad += [(odd("version", VERSION), "version"), (odd("created_at", MOMENT), "created_at"), (odd("updated_at", MOMENT), "updated_at")]
    bad += [(~kind("severity_on_violation").isin("", "VOID") & ~among("severity_on_violation", SEVERITIES), "severity_on_violation")]
    bad += [(there("changelog") & (kind("changelog") != "ARRAY"), "changelog"), (bad_changes, "changelog[]"), (there("stats") & ~stats, "stats")]
    bad += [(stats & ~kind(f"stats.{f}").isin("", "VOID") & ~number(f"stats.{f}", ("BIGINT",)), f"stats.{f}") for f in COUNTS]
    bad += [(stats & ~kind(f"stats.{f}").isin("", "VOID") & ~number(f"stats.{f}", ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")), f"stats.{f}") for f in RATES]
    bad += [(~kind("alignment").isin("", "VOID", "OBJECT") | (unit & kind("alignment").isin("", "VOID")), "alignment")]
    bad += [(unit & aligned & ((kind(f"alignment.{s}") != "OBJECT") | ~there(f"alignment.{s}.role") | ~there(f"alignment.{s}.doc_type")), f"alignment.{s}") for s in ("party_a", "party_b")]
    bad += [(unit & aligned & ~sound_keys, "alignment.join_key"), (unit & ~confirmed, "confirmation_required")]
    object_ = once("kind", "", _kind(whole)) == "OBJECT"
    wrong = F.when(object_, F.array_compact(F.array(*[F.when(b, text) for b, text in bad]))).otherwise(F.array(F.lit("document")))
    parsed = rows.withColumn("_whole", F.try_parse_json(column))
    taken = parsed.withColumn("_of", F.struct(*[v.alias(f"{what} {path}") for (what, path), v in found.items()]))
    return taken.withColumn(name, wrong).drop("_whole", "_of")
