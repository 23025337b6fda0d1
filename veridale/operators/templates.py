"""Declared rules that compare several documents, as joins and groups. Each gives the violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chain(rows: DataFrame, *ordered: str) -> DataFrame:
    """Rows whose columns aren't in ascending order; unknown values pass."""
    ok = F.lit(True)
    for a, b in zip(ordered, ordered[1:]):
        ok = ok & F.coalesce(F.col(a) <= F.col(b), F.lit(True))
    return rows.where(~ok)


def rollup(parts: DataFrame, whole: DataFrame, key: str, tolerance: float) -> DataFrame:
    """key, total, value: sums of parts.value that differ from whole.value by more than the share `tolerance`."""
    sums = parts.groupBy(key).agg(F.sum("value").alias("total"))
    both = whole.select(key, "value").join(sums, key)
    return both.where(F.abs(F.col("total") - F.col("value")) > tolerance * F.abs("value")).select(key, "total", "value")


def not_above(parts: DataFrame, limit: DataFrame, key: str) -> DataFrame:
    """key, total, value: sums of parts.value over limit.value."""
    return rollup_sums(parts, limit, key).where(F.col("total") > F.col("value"))


def rollup_sums(parts: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    return whole.select(key, "value").join(parts.groupBy(key).agg(F.sum("value").alias("total")), key)


def without(rows: DataFrame, *needed: DataFrame, on: list[str]) -> DataFrame:
    """Rows that lack a partner in any of the needed tables."""
    complete = rows
    for other in needed:
        complete = complete.join(other.select(*on).distinct(), on, "left_semi")
    return rows.join(complete.select(*on).distinct(), on, "left_anti")


def unless(rows: DataFrame, ok: Column, excuse: DataFrame, on: list[str]) -> DataFrame:
    """Rows that fail and have no excuse."""
    return rows.where(~F.coalesce(ok, F.lit(True))).join(excuse.select(*on).distinct(), on, "left_anti")


def different_sets(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, only_a, only_b of keys whose values aren't the same set in both."""
    sides = a.select(key, value, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, value, F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = sides.groupBy(key, value).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = per.groupBy(key).agg(F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b"))
    return out.where("only_a > 0 or only_b > 0")


def missing_members(required: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """key, value that are required but not there."""
    return required.select(key, value).distinct().join(actual.select(key, value), [key, value], "left_anti")


def several_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, kinds of keys with more than one value."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("kinds")).where("kinds > 1")


def implies(rows: DataFrame, condition: Column, then: Column) -> DataFrame:
    """Rows with the condition and without what follows from it."""
    return rows.where(condition & ~F.coalesce(then, F.lit(True)))


def fewer(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """key, n, needed: keys with fewer rows than in others."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    needed = others.groupBy(key).agg(F.count(F.lit(1)).alias("needed"))
    return needed.join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), "needed").where("n < needed")


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 3600


def wide_intervals(rows: DataFrame, key: str, at: str, days: int) -> DataFrame:
    """key, at, previous, days: neighbours in time that are over `days` apart."""
    w = Window.partitionBy(key).orderBy(at)
    found = rows.select(key, at).distinct().withColumn("previous", F.lag(at).over(w)).withColumn("days", F.datediff(at, "previous"))
    return found.where(F.col("days") > days)


def as_of(rows: DataFrame, facts: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """rows with the latest `value` of facts (key, at, value) not after the row's own time, over one sort of both."""
    marked = rows.select("*", F.lit(None).cast(facts.schema[value].dataType).alias("_v"), F.lit(1).alias("_row"))
    told = facts.groupBy(key, at).agg(F.max(value).alias("_v")).withColumn("_row", F.lit(0))
    both = marked.unionByName(told, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_row")
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_row = 1").drop("_v", "_row")


def total_source(rows: DataFrame) -> DataFrame:
    """rows (doc, has_row, total, parts) with state: consistent, no_row, mismatch, no_total."""
    state = (
        F.when(~F.col("has_row") & F.col("total").isNotNull(), "no_row").when(F.col("has_row") & (F.col("total") != F.col("parts")), "mismatch")
        .when(~F.col("has_row") & F.col("total").isNull(), "no_total").otherwise("consistent"))
    return rows.withColumn("state", state)
