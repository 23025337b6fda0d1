"""Equal rows as one row with a count, and back: however many copies a row has, no task gets them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Copies that are made of one row at once.
CHUNK = 1 << 16


def counted(rows: DataFrame, *columns: str) -> DataFrame:
    """The distinct rows of columns with `n`, how often each occurs. Counted before the shuffle."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def each_copy(rows: DataFrame) -> DataFrame:
    """rows (.., n) with n rows for each, numbered by `copy` from 0, without n. Rows with over CHUNK copies are dealt out in chunks before the copies are made."""
    few = rows.where(F.col("n") <= CHUNK).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    many = rows.where(F.col("n") > CHUNK).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long")))).repartition("_from")
    many = many.withColumn("copy", F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK, "n") - 1))).drop("_from")
    return few.unionByName(many).drop("n")
