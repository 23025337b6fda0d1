"""Feedback, rule statistics, detectors, trials, states and registry, as derivations of append-only facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEEDBACK_TYPES = ("missed", "false_positive")
FEEDBACK_STATES = ("new", "analyzed", "clustered", "resolved")


def feedback_errors() -> Column:
    """Array of what is wrong with a feedback row; empty if nothing."""
    rules = [
        (F.coalesce("audit_id", F.lit("")) == "", "audit_id is missing"), (~F.coalesce(F.col("type").isin(*FEEDBACK_TYPES), F.lit(False)), "type is unknown"),
        (F.coalesce("user_id", F.lit("")) == "", "user_id is missing"), ((F.col("type") == "false_positive") & F.col("rule_id").isNull(), "rule_id is missing"),
    ]
    return F.array_compact(F.array(*[F.when(bad, text) for bad, text in rules]))


def feedback_states(feedback: DataFrame, updates: DataFrame) -> DataFrame:
    """feedback with its latest state, cluster_id and the time when it was first analyzed, from updates (feedback_id, ts, status, cluster_id)."""
    latest = updates.groupBy("feedback_id").agg(
        F.max_by("status", F.struct("ts", "status")).alias("_status"), F.max_by("cluster_id", F.when(F.col("cluster_id").isNotNull(), F.struct("ts", "status"))).alias("cluster_id"),
        F.min(F.when(F.col("status") != "new", F.col("ts"))).alias("analyzed_at"))
    return feedback.join(latest, "feedback_id", "left").withColumn("status", F.coalesce("_status", F.lit("new"))).drop("_status")


def rule_stats(hits: DataFrame, feedback: DataFrame) -> DataFrame:
    """rule_id, hits, reviews, false_positives, fp_rate, hit_rate, last_hit from hits (rule_id, audit_id, ts) and feedback (rule_id, type)."""
    h = hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("audit_id").alias("reviews"), F.max("ts").alias("last_hit"))
    f = feedback.where("type = 'false_positive'").groupBy("rule_id").agg(F.count(F.lit(1)).alias("false_positives"))
    both = h.join(f, "rule_id", "full_outer").select("rule_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "reviews", "false_positives")], "last_hit")
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return both.withColumn("fp_rate", rate("false_positives", "hits")).withColumn("hit_rate", rate("hits", "reviews"))


def low_activity(stats: DataFrame, reviews: int = 50, rate: float = 0.05) -> DataFrame:
    return stats.where((F.col("reviews") >= reviews) & (F.col("hit_rate") < rate)).orderBy(F.desc("reviews"), "rule_id")


def high_false_positive(stats: DataFrame, rate: float = 0.30, hits: int = 5) -> DataFrame:
    return stats.where((F.col("hits") >= hits) & (F.col("fp_rate") > rate)).orderBy(F.desc("fp_rate"), "rule_id")


def dormant(stats: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Whole days since the last hit over `days`; rules without any hit aren't dormant."""
    return stats.withColumn("idle_days", F.floor((F.unix_timestamp(now) - F.unix_timestamp("last_hit")) / 86400)).where(F.col("idle_days") > days)


def next_version(version: Column) -> Column:
    """The patch number one higher."""
    return F.concat(F.regexp_extract(version, r"^(.*\.)[0-9]+$", 1), (F.regexp_extract(version, r"([0-9]+)$", 1).cast("int") + 1).cast("string"))


def downgraded(rules: DataFrame, flagged: DataFrame) -> DataFrame:
    """rules (rule_id, level, status, version) with L2 to L3 and L3 to deprecated where flagged; L1 is exempt."""
    hit = F.col("_hit").isNotNull() & (F.col("level") != "L1") & (F.col("status") == "active")
    return rules.join(flagged.select("rule_id", F.lit(True).alias("_hit")), "rule_id", "left").select(
        "rule_id", F.when(hit & (F.col("level") == "L2"), "L3").otherwise(F.col("level")).alias("level"),
        F.when(hit & (F.col("level") == "L3"), "deprecated").otherwise(F.col("status")).alias("status"),
        F.when(hit, next_version(F.col("version"))).otherwise(F.col("version")).alias("version"))


def trials(results: DataFrame, projects: int = 3, rate: float = 0.10) -> DataFrame:
    """rule_id, hits, false_positives, projects, fp_rate, eligible from (rule_id, project, hits, false_positives)."""
    sums = results.groupBy("rule_id").agg(F.sum("hits").alias("hits"), F.sum("false_positives").alias("false_positives"), F.count_distinct("project").alias("projects"))
    fp = F.coalesce(F.try_divide(F.col("false_positives").cast("double"), F.col("hits").cast("double")), F.lit(0.0))
    return sums.withColumn("fp_rate", fp).withColumn("eligible", (F.col("projects") >= projects) & (F.col("fp_rate") < rate))


#: Legal moves of a rule's status; fixed values.
MOVES = (("draft", "testing"), ("testing", "incubating"), ("incubating", "active"), ("incubating", "deprecated"), ("active", "deprecated"), ("deprecated", "draft"))


def transitioned(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """rules with the wanted status (rule_id, to) where the move is legal, and `moved`."""
    legal = F.lit(False)
    for a, b in MOVES:
        legal = legal | ((F.col("status") == a) & (F.col("to") == b))
    both = rules.join(wanted, "rule_id", "left").withColumn("moved", F.coalesce(legal, F.lit(False)))
    return both.withColumn("status", F.when(F.col("moved"), F.col("to")).otherwise(F.col("status"))).drop("to")


def registry(rules: DataFrame) -> DataFrame:
    """Counts by level, scope and status from one pass of grouping sets: part, name, n."""
    sets = rules.groupingSets([["level"], ["scope"], ["status"]], "level", "scope", "status").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return sets.select(F.when(F.col("g") == 3, "level").when(F.col("g") == 5, "scope").otherwise("status").alias("part"), F.coalesce("level", "scope", "status").alias("name"), "n")


def repeated_ids(rules: DataFrame) -> DataFrame:
    return rules.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def found(rules: DataFrame, q: str = "", **equal: str) -> DataFrame:
    """Rules with these values and with q in their id or name, whatever the case."""
    out = rules.where(F.lower("rule_id").contains(q.lower()) | F.lower("name").contains(q.lower()))
    for k, v in equal.items():
        out = out.where(F.col(k) == v)
    return out


def top_per_group(frame: DataFrame, by: list[str], value: str, k: int, order: str) -> DataFrame:
    """group, value, n: the k most frequent values in each group, ties by `order`."""
    counts = frame.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), order))
    return counts.withColumn("k", rank).where(F.col("k") <= k).drop("k")
