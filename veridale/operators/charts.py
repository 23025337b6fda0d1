"""Charts of findings as rows: what is drawn, and where. Counting is all that grows with the findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered
from .review import RESULTS

# Colours by result, others grey.
COLOURS = {"pass": "#34a853", "fail": "#d93025", "suspicious": "#e37400", "needs_ai": "#9334e6", "not_applicable": "#9aa0a6"}
#: Order round the ring.
ORDER = ("pass", "fail", "suspicious", "needs_ai", "not_applicable")
#: Longest label of a bar, in characters.
LABEL = 12


def _text(x: Column) -> Column:
    """With one decimal."""
    return F.format_string("%.1f", F.round(x, 1))


def ring(findings: DataFrame, width: float = 280, height: float = 280, inner: float = 0.55) -> DataFrame:
    """result, piece, n, share, start, end, colour, path: an arc of a ring for each result that occurs.

    Clockwise from the top (-90 degrees) in ORDER; unknown results (a null one too) are left out, as are their counts.
    A result that has all findings is two half rings (piece 0 and 1): an arc that ends where it starts draws nothing.
    No findings give no rows.
    """
    counts = findings.where(F.col("result").isin(*RESULTS)).groupBy("result").agg(F.count(F.lit(1)).alias("n"))
    # five rows at most
    everything = Window.partitionBy()
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("result"))
    before = F.sum("n").over(Window.orderBy(place)) - F.col("n")
    total = F.sum("n").over(everything)
    each = counts.select("result", "n", (F.col("n") / total).alias("share"), (before / total * 360 - 90).alias("start"))
    each = each.withColumn("end", F.col("start") + F.col("share") * 360).withColumn("half", F.col("start") + 180)
    piece = lambda a, b: F.struct(F.col(a).alias("start"), F.col(b).alias("end"))
    pieces = F.when(F.col("share") * 360 >= 359.99, F.array(piece("start", "half"), piece("half", "end"))).otherwise(F.array(piece("start", "end")))
    each = each.select("result", "n", "share", F.posexplode(pieces).alias("piece", "p")).select("result", "piece", "n", "share", "p.start", "p.end")
    outer = min(width, height) / 2 - 10

    def at(radius: float, angle: str) -> list[Column]:
        turn = F.radians(angle)
        return [_text(width / 2 + radius * F.cos(turn)), _text(height / 2 + radius * F.sin(turn))]

    large = F.when(F.col("end") - F.col("start") > 180, "1").otherwise("0")
    arc = lambda radius, sweep, angle: [F.lit("A"), F.lit(f"{radius:.1f}"), F.lit(f"{radius:.1f}"), F.lit("0"), large, F.lit(sweep), *at(radius, angle)]
    path = F.concat_ws(" ", F.lit("M"), *at(outer, "start"), *arc(outer, "1", "end"), F.lit("L"), *at(outer * inner, "end"), *arc(outer * inner, "0", "start"), F.lit("Z"))
    colour = F.coalesce(*[F.when(F.col("result") == r, c) for r, c in COLOURS.items()])
    return each.withColumn("colour", colour).withColumn("path", path)


def bars(findings: DataFrame, by: str, width: float = 600, bar: float = 28, gap: float = 6, label_width: float = 160) -> DataFrame:
    """label, shown, n_fail, n_suspicious, y, fail_x, fail_width, suspicious_x, suspicious_width, total_x: a bar for each value of `by` with failed or suspicious findings.

    Most of both first, ties by label; a null label is "-". The longest bar fills the width. Labels of over LABEL characters end in an ellipsis. Without
    such findings there are no rows. Bars are numbered over ranges, so there may be many.
    """
    failed, doubtful = F.count_if(F.col("result") == "fail"), F.count_if(F.col("result") == "suspicious")
    label = F.coalesce(F.col(by).cast("string"), F.lit("-")).alias("label")
    per = findings.where(F.col("result").isin("fail", "suspicious")).groupBy(label).agg(failed.alias("n_fail"), doubtful.alias("n_suspicious"))
    per = per.withColumn("_all", F.lit(0)).withColumn("_n", F.col("n_fail") + F.col("n_suspicious"))
    ranked = numbered(per, ["_all"], [F.desc("_n"), F.asc("label")], "_k")
    scale = (width - label_width - 20) / ranked.agg(F.max("_n")).scalar()
    shown = F.when(F.length("label") <= LABEL, F.col("label")).otherwise(F.concat(F.substring("label", 1, LABEL - 1), F.lit("…")))
    out = ranked.withColumn("fail_width", F.col("n_fail") * scale).withColumn("suspicious_width", F.col("n_suspicious") * scale)
    fail_x = F.lit(float(label_width))
    return out.select(
        "label", shown.alias("shown"), "n_fail", "n_suspicious", (20 + (F.col("_k") - 1) * (bar + gap)).cast("double").alias("y"), fail_x.alias("fail_x"), "fail_width",
        (fail_x + F.col("fail_width")).alias("suspicious_x"), "suspicious_width", (fail_x + F.col("fail_width") + F.col("suspicious_width") + 6).alias("total_x"))
