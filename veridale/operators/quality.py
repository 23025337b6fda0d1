"""Data-quality detectors over ordered values, as window and group operations.

Values are (doc, col, row, v): a value per document, column and row order. Windows are partitioned by
document and column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ("doc", "col")


def melted(rows: DataFrame, columns: list[str], doc: str, order: str) -> DataFrame:
    """rows as (doc, col, row, v), doubles; values that aren't numbers are null."""
    return rows.select(F.col(doc).alias("doc"), F.col(order).alias("row"), *[F.col(c).try_cast("double").alias(c) for c in columns]).unpivot(["doc", "row"], columns, "col", "v").select("doc", "col", "row", "v")


def _w(*more: str) -> Window:
    return Window.partitionBy(*BY).orderBy("row", *more)


def row_count_check(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """doc, n, expected, code: ROW-02 for no rows, ROW-01 for another number than expected, else null."""
    counts = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    both = expected.join(counts, "doc", "left").select("doc", F.coalesce("n", F.lit(0)).alias("n"), "expected")
    return both.withColumn("code", F.when(F.col("n") == 0, "DQ-SELF-ROW-02").when(F.col("n") != F.col("expected"), "DQ-SELF-ROW-01"))


def duplicates(rows: DataFrame) -> DataFrame:
    """Every repeat after the first of an id in a document: doc, id, row."""
    k = F.row_number().over(Window.partitionBy("doc", "id").orderBy("row"))
    return rows.withColumn("k", k).where("k > 1").select("doc", "id", "row")


def alternating(values: DataFrame) -> DataFrame:
    """doc, col, alternates: some four values in a row are a, b, a, b."""
    v = F.col("v")
    at = lambda k: F.lead(v, k).over(_w())
    hit = (v == at(2)) & (at(1) == at(3)) & (v != at(1))
    return values.withColumn("hit", F.coalesce(hit, F.lit(False))).groupBy(*BY).agg(F.bool_or("hit").alias("alternates"))


def repeats(values: DataFrame) -> DataFrame:
    """doc, col, n, kinds, code of columns with 4 or more numbers and a pattern of repeats."""
    v = values.where("v is not null")
    counts = v.groupBy(*BY).agg(F.count("v").alias("n"), F.count_distinct("v").alias("kinds")).where("n >= 4")
    code = (
        F.when((F.col("kinds") == 2) & F.col("alternates"), "DQ-REPEAT-01").when(F.col("kinds") == 2, "DQ-REPEAT-02")
        .when(F.col("kinds") == 1, "DQ-REPEAT-03").when(F.col("kinds") < 0.3 * F.col("n"), "DQ-REPEAT-04")
    )
    return counts.join(alternating(v), [*BY]).withColumn("code", code).where("code is not null").select(*BY, "n", "kinds", "code")


def jumps(values: DataFrame, threshold: Column | float = 0.3, exempt: Column | None = None) -> DataFrame:
    """doc, col, row, from_value, to_value, change, severity of neighbours that differ by the threshold or more."""
    v = values.where("v is not null")
    before = F.lag("v").over(_w())
    found = v.withColumn("from_value", before).where((F.col("from_value") != 0) & (~exempt if exempt is not None else F.lit(True)))
    found = found.withColumn("change", F.abs(F.col("v") - F.col("from_value")) / F.abs("from_value")).where(F.col("change") >= threshold)
    return found.select(*BY, "row", "from_value", F.col("v").alias("to_value"), "change", F.when(F.col("change") >= 0.5, "high").otherwise("medium").alias("severity"))


def time_order(spans: DataFrame) -> DataFrame:
    """doc, row, start, previous_end of rows that start before the one before has ended."""
    w = Window.partitionBy("doc").orderBy("row")
    return spans.withColumn("previous_end", F.lag("end").over(w)).where(F.col("start") < F.col("previous_end")).select("doc", "row", "start", "previous_end")


def gaps(numbers: DataFrame) -> DataFrame:
    """doc, range_start, range_end, missing of the ranges between the distinct numbers n of a document."""
    after = F.lead("n").over(Window.partitionBy("doc").orderBy("n"))
    return numbers.where("n is not null").select("doc", "n").distinct().withColumn("after", after).where("after - n > 1").select(
        "doc", (F.col("n") + 1).alias("range_start"), (F.col("after") - 1).alias("range_end"), (F.col("after") - F.col("n") - 1).alias("missing"))


def date_gaps(dates: DataFrame) -> DataFrame:
    """gaps() over dates d."""
    day = F.datediff("d", F.lit("1970-01-01").cast("date"))
    found = gaps(dates.select("doc", day.alias("n")))
    back = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c))
    return found.select("doc", back("range_start").alias("range_start"), back("range_end").alias("range_end"), "missing")


def formula_mismatch(rows: DataFrame, value: Column, formula: Column, tolerance: float) -> DataFrame:
    """rows with diff, where value and formula differ by more than the tolerance; not where either is unknown."""
    return rows.withColumn("diff", F.abs(value - formula)).where(F.col("diff") > tolerance)


def prefix_confusion(ids: DataFrame, first: str, second: str) -> DataFrame:
    """doc, row, id, suspected, confidence: ids with the second prefix where over half of 3 or more have the first."""
    everywhere = Window.partitionBy("doc")
    share = F.avg(F.col("id").startswith(first).cast("double")).over(everywhere)
    n = F.count(F.lit(1)).over(everywhere)
    odd = ids.withColumn("share", share).withColumn("n", n).where((F.col("n") >= 3) & (F.col("share") > 0.5) & F.col("id").startswith(second))
    return odd.select("doc", "row", "id", F.concat(F.lit(first), F.expr(f"substring(id, {len(second) + 1})")).alias("suspected"), F.when(F.col("share") > 0.7, "high").otherwise("medium").alias("confidence"))


#: Digits that are taken for one another, by the side of the range that the value is out at.
LOW_SWAPS, HIGH_SWAPS = (("0", "4"), ("0", "6")), (("9", "3"),)


def range_confusion(rows: DataFrame, low: float, high: float) -> DataFrame:
    """rows (.., v) out of [low, high] with candidates: what one swapped digit brings back into it, ascending."""
    text = F.format_string("%.2f", F.col("v"))

    def swapped(pairs) -> Column:
        return F.concat(*[_swaps(text, a, b) for a, b in pairs])

    tried = F.when(F.col("v") < low, swapped(LOW_SWAPS)).otherwise(swapped(HIGH_SWAPS))
    kept = F.array_sort(F.array_distinct(F.filter(F.transform(tried, lambda s: s.try_cast("double")), lambda x: (x >= low) & (x <= high))))
    return rows.where((F.col("v") < low) | (F.col("v") > high)).withColumn("candidates", kept)


def _swaps(text: Column, a: str, b: str) -> Column:
    """text with each single a as b."""
    at = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)) == a)
    return F.transform(at, lambda i: F.overlay(text, F.lit(b), i, F.lit(1)))


LOOKALIKES = {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "s": "5", "B": "8"}


def letters_in_numbers(values: DataFrame) -> DataFrame:
    """A row for each look-alike letter in a string value: letter, suspected (with only that letter replaced)."""
    pairs = F.explode(F.create_map(*[F.lit(x) for kv in LOOKALIKES.items() for x in kv])).alias("letter", "digit")
    each = values.select("*", pairs).where(F.col("value").contains(F.col("letter")) & F.col("value").rlike("[0-9]"))
    return each.withColumn("suspected", F.replace("value", "letter", "digit")).drop("digit")


def summary(warnings: DataFrame) -> DataFrame:
    """doc, errors, warnings, status."""
    counts = warnings.groupBy("doc").agg(F.count_if(F.col("severity").isin("error", "high")).alias("errors"), F.count_if(~F.col("severity").isin("error", "high")).alias("warnings"))
    return counts.withColumn("status", F.when(F.col("errors") > 0, "error").when(F.col("warnings") > 0, "warning").otherwise("pass"))
