"""Audit log: events (event_id, date, ts, event_type, audit_id, rule_id, rule_details array<struct<rule_id,hits>>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numbering

TYPES = ("audit_completed", "feedback_received", "rule_transitioned", "rule_proposed", "report_generated", "reflection_completed")


def numbered(events: DataFrame, prefix: str, last: DataFrame | None = None) -> DataFrame:
    """events (date, ts, ..) with event_id <prefix>-<yyyymmdd>-NNN, dense per day after the last number of the day, in the order of ts and the other columns."""
    out = numbering.numbered(events, ["date"], ["ts", *[c for c in events.columns if c not in ("date", "ts")]], "_k")
    if last is not None:
        out = out.join(last.select("date", "last_number"), "date", "left").withColumn("_k", F.col("_k") + F.coalesce("last_number", F.lit(0))).drop("last_number")
    name = F.concat(F.lit(prefix + "-"), F.date_format("date", "yyyyMMdd"), F.lit("-"), F.when(F.col("_k") < 1000, F.lpad(F.col("_k").cast("string"), 3, "0")).otherwise(F.col("_k").cast("string")))
    return out.withColumn("event_id", name).drop("_k")


def last_numbers(events: DataFrame) -> DataFrame:
    """date, last_number: the highest number of each day's ids."""
    return events.groupBy("date").agg(F.max(F.regexp_extract("event_id", "-([0-9]+)$", 1).try_cast("int")).alias("last_number"))


def known_types(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of a known type, and the others."""
    ok = F.col("event_type").isin(*TYPES)
    return events.where(ok), events.where(~F.coalesce(ok, F.lit(False)))


def by_date(events: DataFrame, date: str) -> DataFrame:
    return events.where(F.col("date") == F.lit(date).cast("date")).orderBy("ts", "event_id")


def by_audit(events: DataFrame, audit_id) -> DataFrame:
    return events.where(F.col("audit_id") == audit_id)


def by_rule(events: DataFrame, rule_id) -> DataFrame:
    """Of the rule itself, or with it in their details."""
    return events.where(F.coalesce(F.col("rule_id") == rule_id, F.lit(False)) | F.coalesce(F.exists("rule_details", lambda d: d["rule_id"] == rule_id), F.lit(False)))


def recent(events: DataFrame, now: Column, days: int) -> DataFrame:
    """From the day `days` before now on: dates first (partitions are pruned), then times; unknown times stay."""
    from_ = now - F.expr(f"interval {days} days")
    return events.where((F.col("date") >= F.to_date(from_)) & (F.col("ts").isNull() | (F.col("ts") >= from_)))


def counts(events: DataFrame, column: str, names: list[str]) -> DataFrame:
    """name, n by value: all known names (0 if none), others as unknown:<value>."""
    spark = events.sparkSession
    known = spark.createDataFrame([(n,) for n in names], "name string")
    label = F.when(F.col(column).isin(*names), F.col(column)).otherwise(F.concat(F.lit("unknown:"), F.coalesce(F.col(column), F.lit("null"))))
    got = events.groupBy(label.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(got, "name", "full_outer").select("name", F.coalesce("n", F.lit(0)).alias("n"))
