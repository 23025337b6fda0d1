"""Dense numbers in an order, by many tasks, also where one key has most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "number") -> DataFrame:
    """rows with `name`: 1, 2, .. within the rows of equal keys (nulls are a key), in an order.

    Rows are dealt to ranges of (keys, order), so a key with many rows spans several and no task holds it whole. What a range has
    of each key is counted; the counts of earlier ranges are where its own numbers begin. Ranges are written first, so a
    task that runs again numbers the same rows. Rows that are equal in the order are told apart by their place.
    """
    place = rows.withColumn("_place", F.monotonically_increasing_id())
    dealt = place.repartitionByRange(*[F.asc_nulls_first(k) for k in keys], *order, "_place").withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    own = ["_key", "_range"]
    keyed = dealt.withColumn("_key", F.struct(*keys))
    before = F.sum("n").over(Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = written(keyed.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).select(*own, F.coalesce(before, F.lit(0)).alias("_before")), "counts")
    inside = F.row_number().over(Window.partitionBy(*own).orderBy(*order, "_place"))
    both = keyed.withColumn("_inside", inside).alias("r").join(counts.alias("c"), (F.col("r._range") == F.col("c._range")) & F.col("r._key").eqNullSafe(F.col("c._key")))
    return both.select(*[F.col(f"r.`{c}`") for c in rows.columns], (F.col("_inside") + F.col("_before")).alias(name))
