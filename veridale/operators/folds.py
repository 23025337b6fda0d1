"""Rule statistics that are kept up to date: each run folds only the logs that are new.

    folder/sums/<run>/, folder/pairs/<run>/   partial sums by rule; the (rule, audit) pairs that a run saw first
    folder/versions/<number>.json             {"mark", "sums", "pairs"}

A version holds all batches of the log up to its mark. It appears by one rename, so a reader has the version before or the one after,
and of two runs over the same batches one counts. A run that dies leaves nothing that is read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store

#: Rows of the log: hits and false positives.
LOG = "kind string, rule_id string, audit_id string, ts timestamp"
SUMS = "rule_id string, hits long, false_positives long, reviews long, last_hit timestamp"
PAIRS = "rule_id string, audit_id string"


def current(spark: SparkSession, folder: str) -> dict:
    """The newest version: mark (0: none yet), sums, pairs (paths)."""
    names = [n for n in store.Folder(spark, folder).names("versions") if n.endswith(".json") and n[0].isdigit()]
    if not names:
        return {"mark": 0, "sums": None, "pairs": []}
    return json.loads(spark.read.text(f"{folder}/versions/{names[-1]}", wholetext=True).first().value)


def _sums(spark: SparkSession, version: dict) -> DataFrame:
    return spark.read.schema(SUMS).parquet(version["sums"]) if version["sums"] else spark.createDataFrame([], SUMS)


def fold(spark: SparkSession, log: str, folder: str) -> int:
    """Adds the log's new batches to the statistics; how many batches that were."""
    folder, version = folder.rstrip("/"), current(spark, folder.rstrip("/"))
    new = [n for n, _, _ in store.entries(spark, log) if n > version["mark"]]
    if not new:
        return 0
    mark, run = max(new), uuid.uuid4().hex
    rows = store.read(spark, log, LOG, version["mark"], mark).where("rule_id is not null")
    seen = spark.read.schema(PAIRS).parquet(*version["pairs"]) if version["pairs"] else spark.createDataFrame([], PAIRS)
    fresh = rows.where("kind = 'hit'").select("rule_id", "audit_id").where("audit_id is not null").distinct().join(seen, ["rule_id", "audit_id"], "left_anti")
    fresh.write.parquet(f"{folder}/pairs/{run}")
    reviews = spark.read.schema(PAIRS).parquet(f"{folder}/pairs/{run}").groupBy("rule_id").agg(F.count(F.lit(1)).alias("reviews"))
    hit, never = F.col("kind") == "hit", F.lit(None).cast("timestamp")
    part = rows.groupBy("rule_id").agg(F.count_if(hit).alias("hits"), F.count_if(F.col("kind") == "false_positive").alias("false_positives"), F.lit(0).cast("long").alias("reviews"), F.max(F.when(hit, F.col("ts"))).alias("last_hit"))
    seen_now = reviews.select("rule_id", F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("false_positives"), "reviews", never.alias("last_hit"))
    total = _sums(spark, version).unionByName(part).unionByName(seen_now).groupBy("rule_id").agg(*[F.sum(c).alias(c) for c in ("hits", "false_positives", "reviews")], F.max("last_hit").alias("last_hit"))
    total.write.parquet(f"{folder}/sums/{run}")
    made = {"mark": mark, "sums": f"{folder}/sums/{run}", "pairs": [*version["pairs"], f"{folder}/pairs/{run}"]}
    return len(new) if store.Folder(spark, folder).published(f"versions/{mark:020d}.json", json.dumps(made)) else 0


def stats(spark: SparkSession, folder: str) -> DataFrame:
    """rule_id, hits, reviews, false_positives, last_hit, fp_rate, hit_rate as of the newest version."""
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    at = _sums(spark, current(spark, folder.rstrip("/")))
    return at.select("rule_id", "hits", "reviews", "false_positives", "last_hit", rate("false_positives", "hits").alias("fp_rate"), rate("hits", "reviews").alias("hit_rate"))
