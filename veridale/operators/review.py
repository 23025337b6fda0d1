"""Review: gates, checklist, date logic, downgrades, summaries and conclusions over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULTS = ("pass", "fail", "suspicious", "not_applicable", "needs_ai")


def gate(docs: DataFrame, flag: str) -> DataFrame:
    """ok, pending, n: whether all documents have the flag, and which don't (first 20)."""
    not_yet = F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col("doc_id"))
    return docs.agg(F.coalesce(F.bool_and(F.coalesce(F.col(flag), F.lit(False))), F.lit(True)).alias("ok"), F.count(not_yet).alias("pending"), F.count(F.lit(1)).alias("n"))


def checklist(docs: DataFrame, items: list[tuple[str, Column]]) -> DataFrame:
    """doc_id, item, result: every item of the checklist on every document; an unknown answer needs a person or model."""
    each = [F.struct(F.lit(name).alias("item"), F.when(ok.isNull(), "needs_ai").when(ok, "pass").otherwise("fail").alias("result")) for name, ok in items]
    return docs.select("doc_id", F.inline(F.array(*each)))


def later_than_any(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """key, n_pairs, examples (5): pairs of one key whose first date lies after the second.

    Counted from sorted dates of the key: for each first date, the second dates before it.
    """
    both = first.select(key, "d", F.lit(1).alias("kind"), "doc").unionByName(second.select(key, "d", F.lit(0).alias("kind"), "doc"))
    before = F.sum((F.col("kind") == 0).cast("long")).over(Window.partitionBy(key).orderBy("d").rangeBetween(Window.unboundedPreceding, -1))
    day = both.withColumn("d", F.datediff("d", F.lit("1970-01-01").cast("date"))).withColumn("before", F.coalesce(before, F.lit(0)))
    return day.where("kind = 1 and before > 0").groupBy(key).agg(F.sum("before").alias("n_pairs"), F.slice(F.sort_array(F.collect_list("doc")), 1, 5).alias("examples"))


def downgraded(findings: DataFrame, least: float = 0.85) -> DataFrame:
    """Findings on documents read with less confidence become suspicious; what they were is kept."""
    low = (F.col("confidence") < least) & (F.col("result") != "not_applicable")
    return findings.withColumn("original_result", F.when(low, F.col("result"))).withColumn("result", F.when(low, "suspicious").otherwise(F.col("result")))


def summary(findings: DataFrame, by: str) -> DataFrame:
    """by, and a count for each result."""
    return findings.groupBy(by).agg(*[F.count_if(F.col("result") == r).alias(f"n_{r}") for r in RESULTS])


def conclusion(findings: DataFrame) -> DataFrame:
    """The verdict over all findings: the first that holds of fatal, over 5 failures, over 10 suspicious, mostly unchecked, some failure, some suspicion; else pass."""
    n = lambda c: F.count_if(c)
    sums = findings.agg(
        n((F.col("severity") == "Fatal") & (F.col("result") == "fail")).alias("fatal"), n(F.col("result") == "fail").alias("fail"), n(F.col("result") == "suspicious").alias("suspicious"),
        n(F.col("result") == "needs_ai").alias("needs_ai"), F.count(F.lit(1)).alias("n"))
    verdict = (
        F.when(F.col("fatal") > 0, "rejected").when(F.col("fail") > 5, "not_qualified").when(F.col("suspicious") > 10, "major_rectification")
        .when(F.col("needs_ai") * 2 > F.col("n"), "incomplete").when(F.col("fail") > 0, "rectification").when(F.col("suspicious") > 0, "conditional_pass").otherwise("pass"))
    return sums.withColumn("conclusion", verdict)


def shares(findings: DataFrame, column: str) -> DataFrame:
    """column, n, share of all: what a chart shows."""
    counts = findings.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def rule_details(violations: DataFrame) -> DataFrame:
    """rule_id, hits, docs, first: by hits, most first."""
    return violations.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first")).orderBy(F.desc("hits"), "rule_id")


def verify_path(has_agent: Column, has_api: Column, forced: Column | None = None) -> Column:
    """How a task is verified: as forced, else by an agent, else by a service, else by enhancing the picture."""
    path = F.when(has_agent, "agent").when(has_api, "api").otherwise("enhance")
    return path if forced is None else F.coalesce(forced, path)


#: Characters of the grams that texts meet on.
GRAM = 3


def _meetings(longer: DataFrame, shorter: DataFrame, key: str) -> DataFrame:
    """doc_id, suspect, item where the shorter text may be in the longer: its first GRAM characters (or all, if fewer) are a gram of that. Both: doc_id, `key` or the other id, t."""
    starts = F.sequence(F.lit(1), F.length("t"))
    grams = F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, range(1, GRAM + 1))), lambda n: F.transform(F.filter(starts, lambda i: i + n <= F.length("t") + 1), lambda i: F.substr("t", i, n)))))
    a = longer.where("length(t) > 0").select("doc_id", key, F.explode(grams).alias("g"))
    other = "item" if key == "suspect" else "suspect"
    b = shorter.where("length(t) > 0").select("doc_id", other, F.substring("t", 1, GRAM).alias("g"))
    return a.join(b.hint("merge"), ["doc_id", "g"]).select("doc_id", "suspect", "item")


def may_hold(suspects: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, suspect, item: the pairs of a document whose texts may hold one another, by a gram of one that the other begins with."""
    s, i = suspects.select("doc_id", "suspect", F.col("value").alias("t")), items.select("doc_id", "item", F.col("text").alias("t"))
    return _meetings(s, i, "suspect").unionByName(_meetings(i, s, "item")).distinct()


#: Pairs of texts for each text of a document up to which all its pairs are compared; that is no more work than its grams.
DIRECT = 16


def located_suspects(suspects: DataFrame, items: DataFrame, padding: float = 20.0) -> DataFrame:
    """suspects (doc_id, suspect, value) with the padded box of the first item on the document whose text holds the value or is held by it.

    Different values meet different texts, both once a document. They are compared by pairs where a document has few for its texts; in the others texts
    meet on grams, so that only pairs that share one are compared. Nothing is broadcast for being narrow: sides are shuffled by document. An
    empty value is held by every text, so it has the document's first.
    """
    box = F.struct((F.col("x1") - padding).alias("x1"), (F.col("y1") - padding).alias("y1"), (F.col("x2") + padding).alias("x2"), (F.col("y2") + padding).alias("y2"))
    near = F.col("text").contains(F.col("value")) | F.col("value").contains(F.col("text"))
    boxed = items.where("length(text) > 0").select("doc_id", "item", "text", box.alias("box"))
    texts = boxed.groupBy("doc_id", "text").agg(F.min("item").alias("item"), F.min_by("box", "item").alias("box"))
    values = suspects.where("value <> ''").select("doc_id", "value").distinct()
    each = values.groupBy("doc_id").agg(F.count(F.lit(1)).alias("v")).join(boxed.groupBy("doc_id").agg(F.count_distinct("text").alias("t")).hint("merge"), "doc_id")
    many = each.where(F.col("v") * F.col("t") > DIRECT * (F.col("v") + F.col("t"))).select("doc_id").hint("merge")
    few = values.join(many, "doc_id", "left_anti").join(texts.join(many, "doc_id", "left_anti").hint("merge"), "doc_id").where(near)
    of_many = values.join(many, "doc_id", "left_semi").select("doc_id", F.col("value").alias("suspect"), "value"), boxed.join(many, "doc_id", "left_semi").select("doc_id", F.col("text").alias("item"), "text").distinct()
    met = may_hold(*of_many).select("doc_id", F.col("suspect").alias("value"), F.col("item").alias("text")).where(near).join(texts.hint("merge"), ["doc_id", "text"])
    found = few.select("doc_id", "value", "item", "box").unionByName(met.select("doc_id", "value", "item", "box")).groupBy("doc_id", "value").agg(F.min_by("box", "item").alias("box"))
    empty = suspects.where("value = ''").select("doc_id", "value").distinct().join(boxed.groupBy("doc_id").agg(F.min_by("box", "item").alias("box")).hint("merge"), "doc_id").select("doc_id", "value", "box")
    return suspects.join(found.unionByName(empty).hint("merge"), ["doc_id", "value"], "left").select(*suspects.columns, "box")


def verify_tasks(suspects: DataFrame) -> DataFrame:
    """suspects with task VERIFY-NNN, numbered in each document."""
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("suspect"))
    return suspects.withColumn("task", F.format_string("VERIFY-%03d", k))


def merged(values: DataFrame, verified: DataFrame) -> DataFrame:
    """values (doc, row, col, v) with verified ones put in where the confidence is high or medium; old is kept where something changed."""
    good = verified.where(F.col("confidence").isin("high", "medium")).select("doc", "row", "col", F.col("v").alias("new"))
    both = values.join(good, ["doc", "row", "col"], "left")
    changed = F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("v"))
    return both.select("doc", "row", "col", F.when(changed, F.col("v")).alias("old"), F.coalesce("new", "v").alias("v"))


def recommendations(findings: DataFrame) -> DataFrame:
    """text: a line for each result that needs something done, with its number."""
    lines = {"fail": "failed items to rectify", "suspicious": "suspicious items to check by hand", "needs_ai": "items still to be read"}
    sums = findings.agg(*[F.count_if(F.col("result") == r).alias(r) for r in lines])
    each = F.explode(F.array_compact(F.array(*[F.when(F.col(r) > 0, F.concat(F.col(r).cast("string"), F.lit(f" {what}"))) for r, what in lines.items()])))
    return sums.select(each.alias("text"))


def completed_event(findings: DataFrame, audit_id: str, at: str) -> DataFrame:
    """The audit_completed event of a review: counts, and hits by rule."""
    per = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    return per.agg(F.sum("hits").alias("n"), F.sort_array(F.collect_list(F.struct("rule_id", "hits"))).alias("rule_details")).select(
        F.lit("audit_completed").alias("event_type"), F.lit(audit_id).alias("audit_id"), F.lit(at).cast("timestamp").alias("ts"), "n", "rule_details")


def supported(suspects: DataFrame, lines: DataFrame) -> DataFrame:
    """suspects (doc_id, suspect, original, suspected) with what a second reading (doc_id, line) supports: suspected, original, both or none."""
    found = suspects.join(lines, "doc_id", "left").groupBy("doc_id", "suspect").agg(
        F.coalesce(F.bool_or(F.col("line").contains(F.col("suspected"))), F.lit(False)).alias("s"), F.coalesce(F.bool_or(F.col("line").contains(F.col("original"))), F.lit(False)).alias("o"))
    return found.select("doc_id", "suspect", F.when(F.col("s") & F.col("o"), "both").when(F.col("s"), "suspected").when(F.col("o"), "original").otherwise("none").alias("support"))


def reviewed(docs: DataFrame, findings: DataFrame, force: bool = False) -> DataFrame:
    """Findings after the gate: none while a document isn't verified, unless forced; downgraded by confidence."""
    open_ = docs.where(~F.coalesce(F.col("verified"), F.lit(False))).limit(1).select(F.lit(1).alias("_x"))
    passed = findings if force else findings.withColumn("_x", F.lit(1)).join(open_, "_x", "left_anti").drop("_x")
    return downgraded(passed)
