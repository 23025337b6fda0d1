"""Layout operators over boxes (x1, y1, x2, y2) of recognised text, a page of a document at a time.

Box arithmetic is Columns. The greedy and order-dependent steps take the boxes of many whole pages at once, each page a bounded
group, with mapInArrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PAGE = ("doc_id", "page")


def _side(a: str, b: str, lo: str, hi: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(f"{a}.{hi}", f"{b}.{hi}") - F.greatest(f"{a}.{lo}", f"{b}.{lo}"))


def _area(a: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{a}.x2") - F.col(f"{a}.x1")) * F.greatest(F.lit(0.0), F.col(f"{a}.y2") - F.col(f"{a}.y1"))


def intersection(a: str, b: str) -> Column:
    return _side(a, b, "x1", "x2") * _side(a, b, "y1", "y2")


def iou(a: str, b: str) -> Column:
    """Intersection over union of two struct columns; 0 without an area."""
    inter = intersection(a, b)
    return F.coalesce(F.try_divide(inter, _area(a) + _area(b) - inter), F.lit(0.0))


def min_overlap(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(intersection(a, b), F.least(_area(a), _area(b))), F.lit(0.0))


def merged(a: str, b: str) -> Column:
    return F.struct(F.least(f"{a}.x1", f"{b}.x1").alias("x1"), F.least(f"{a}.y1", f"{b}.y1").alias("y1"), F.greatest(f"{a}.x2", f"{b}.x2").alias("x2"), F.greatest(f"{a}.y2", f"{b}.y2").alias("y2"))


def _in_order(c: str | Column, down: bool = False) -> Column:
    """Numbers in order, nulls and NaN last."""
    c = F.col(c) if isinstance(c, str) else c
    known = F.when(~F.isnan(c), c)
    return known.desc_nulls_last() if down else known.asc_nulls_last()


def _by_pages(items: DataFrame, order: list[Column], step: Callable[[pa.Table, np.ndarray], pa.Table], schema: StructType) -> DataFrame:
    """`step` on tables of whole pages, each in the order, and the rows where pages start. A task takes its pages as a stream, many at once, so that a small page costs no call of its own."""
    numbered = items.withColumn("_k", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order)))

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        yield from step(table.drop_columns("_k"), np.flatnonzero(table["_k"].to_numpy() == 1)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("_k").to_numpy() == 1)
            if len(starts):  # all before the last page is whole
                done = [*held, batch.slice(0, starts[-1])]
                if sum(map(len, done)):
                    yield from whole(done)
                held = [batch.slice(starts[-1])]
            else:
                held.append(batch)
        if sum(map(len, held)):
            yield from whole(held)

    return numbered.mapInArrow(run, schema)


def _numbers(table: pa.Table, *columns: str) -> list[np.ndarray]:
    """Columns as doubles, NaN for null."""
    return [table[c].cast(pa.float64(), safe=False).to_numpy() for c in columns]


#: Boxes of a page up to which pages of one size are compared together, and comparisons at once.
SMALL, AT_ONCE = 64, 1 << 20


def _clash(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether boxes (.., 4) overlap too much."""
    side = lambda lo, hi: (np.minimum(a[..., hi], b[..., hi]) - np.maximum(a[..., lo], b[..., lo])).clip(0)
    area_a, area_b = ((x[..., 2] - x[..., 0]).clip(0) * (x[..., 3] - x[..., 1]).clip(0) for x in (a, b))
    inter, least = side(0, 2) * side(1, 3), np.minimum(area_a, area_b)
    union = area_a + area_b - inter
    return (union > 0) & (inter > threshold * union) | (least > 0) & (inter > 0.8 * least)


def without_overlaps(items: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of overlapping boxes (IoU over the threshold, or 80 % of the smaller one) the one with the highest confidence, greedily."""

    def keep(table: pa.Table, starts: np.ndarray) -> pa.Table:
        box, kept = np.stack(_numbers(table, "x1", "y1", "x2", "y2"), axis=1), np.ones(len(table), bool)
        sizes = np.diff(starts, append=len(table))
        for n in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
            first, many = starts[sizes == n], max(1, AT_ONCE // int(n * n))
            for k in range(0, len(first), many):
                rows = first[k : k + many, None] + np.arange(n)
                clash, good = _clash(box[rows][:, :, None], box[rows][:, None], threshold), np.ones(rows.shape, bool)
                for i in range(1, n):
                    good[:, i] = ~(clash[:, i, :i] & good[:, :i]).any(axis=1)
                kept[rows] = good
        for at, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            best, m = np.empty((n, 4)), 0
            for i in range(at, at + n):
                kept[i] = not _clash(best[:m], box[i], threshold).any()
                if kept[i]:
                    best[m], m = box[i], m + 1
        return table.filter(pa.array(kept))

    return _by_pages(items, [_in_order("confidence", down=True), _in_order("y1"), _in_order("x1"), F.col("item").asc_nulls_last(), "x2", "y2"], keep, items.schema)


def text_rows(items: DataFrame) -> DataFrame:
    """items with text_row: from top to bottom, an item joins the row while its centre is within half of the median height (8 at least) of the row's mean."""
    schema = items.withColumn("text_row", F.lit(0)).schema

    def cluster(table: pa.Table, starts: np.ndarray) -> pa.Table:
        y1, y2 = _numbers(table, "y1", "y2")
        centre, sizes = (y1 + y2) / 2, np.diff(starts, append=len(table))
        near = np.maximum(0.5 * pd.Series(y2 - y1).groupby(np.repeat(np.arange(len(starts)), sizes)).median().to_numpy(), 8.0)
        by_size = np.argsort(-sizes, kind="stable")
        starts, near = starts[by_size], near[by_size]
        row, mean, n = np.full(len(starts), -1, np.int32), np.zeros(len(starts)), np.zeros(len(starts))
        rows = np.empty(len(table), np.int32)
        ends = np.searchsorted(-sizes[by_size], -np.arange(sizes.max()))  # how many pages have a k-th item
        for k, m in enumerate(ends):
            c = centre[starts[:m] + k]
            new = (row[:m] < 0) | (np.abs(c - mean[:m]) > near[:m])
            mean[:m], n[:m] = np.where(new, c, (mean[:m] * n[:m] + c) / (n[:m] + 1)), np.where(new, 1, n[:m] + 1)
            row[:m] += new
            rows[starts[:m] + k] = row[:m]
        return table.append_column("text_row", pa.array(rows))

    return _by_pages(items, [_in_order((F.col("y1") + F.col("y2")) / 2), _in_order("x1"), F.col("item").asc_nulls_last()], cluster, schema)


def gap_rows(items: DataFrame, gap: float = 8.0) -> DataFrame:
    """items with text_row by the gaps between centres, as a window: a row ends where the next centre is over `gap` away."""
    centre = (F.col("y1") + F.col("y2")) / 2
    w = Window.partitionBy(*PAGE).orderBy("_c", "x1", "item")
    new = F.coalesce((F.col("_c") - F.lag("_c").over(w) > gap).cast("int"), F.lit(0))
    return items.withColumn("_c", centre).withColumn("_n", new).withColumn("text_row", F.sum("_n").over(w)).drop("_c", "_n")


def table_text(rows: DataFrame, separator: str = "  ") -> DataFrame:
    """doc_id, page, text: items of a row from left to right, rows from top to bottom."""
    line = rows.groupBy(*PAGE, "text_row").agg(F.array_join(F.sort_array(F.collect_list(F.struct("x1", "item", "text")))["text"], separator).alias("line"))
    return line.groupBy(*PAGE).agg(F.array_join(F.sort_array(F.collect_list(F.struct("text_row", "line")))["line"], "\n").alias("text"))


def located_column(items: DataFrame, headers: list[str], short: str | None = None, width: float | None = None) -> DataFrame:
    """doc_id, page, left, right: the leftmost item that matches the first header pattern that any does, widened by 20 % and 40 %.

    short: a text that marks the column where no header is found: the leftmost item that holds it, has 4 characters at most (blanks aside)
    and its centre in the left half of the page, `width` wide. With a width, the column is kept on the page.
    """
    rank = F.lit(None).cast("int")
    if short is not None:
        near = F.col("text").contains(short) & (F.length(F.replace("text", F.lit(" "))) <= 4) & ((F.col("x1") + F.col("x2")) / 2 < width * 0.5)
        rank = F.when(near, len(headers))
    for k, pattern in reversed([*enumerate(headers)]):
        rank = F.when(F.col("text").rlike(pattern), k).otherwise(rank)
    first = Window.partitionBy(*PAGE).orderBy("_rank", "x1", "item")
    found = items.withColumn("_rank", rank).where("_rank is not null").withColumn("_k", F.row_number().over(first)).where("_k = 1")
    wide = F.col("x2") - F.col("x1")
    left, right = F.col("x1") - 0.2 * wide, F.col("x2") + 0.4 * wide
    if width is not None:
        left, right = F.greatest(F.lit(0.0), left), F.least(F.lit(float(width)), right)
    return found.select(*PAGE, left.alias("left"), right.alias("right"))


def in_column(items: DataFrame, column: DataFrame) -> DataFrame:
    """items whose centre is in the page's column."""
    return items.join(column, [*PAGE]).where(((F.col("x1") + F.col("x2")) / 2).between(F.col("left"), F.col("right"))).select(items.columns)


NUMBERED_ID = "^2[4-9][0-9]{2}[A-D]?$"


def numbered_pages(items: DataFrame) -> DataFrame:
    """doc_id, page, numbered: 2 items or more are numbered ids."""
    return items.groupBy(*PAGE).agg((F.count_if(F.col("text").rlike(NUMBERED_ID)) >= 2).alias("numbered"))


def corrected_id(text: Column) -> Column:
    """Numbered ids with a leading Z for 2 or a trailing 0 or O for D set right; times with a dot or blank as HH:MM."""
    c = F.regexp_replace(F.btrim(text), "^[Zz]([4-9][0-9]{2}[A-D]?)$", "2$1")
    c = F.regexp_replace(c, "^(2[4-9][0-9]{2})[0O]$", "$1D")
    return F.regexp_replace(c, "^([0-2]?[0-9])[.; ]([0-5][0-9])$", "$1:$2")


#: Letters that are read for digits in elevations; fixed values.
LETTERS, DIGITS = "IlSBO", "11580"


def corrected_text(text: Column, id_column: bool | Column = False) -> Column:
    """What a cell must be by its form: in the id column an id whose Z was read as 2, with a trailing 0 or O for D or the Z lost; elsewhere too
    an elevation with letters for digits or a comma, and a time with another mark."""
    d = lambda c: F.when(c.isin("O", "0", "o"), "D").when(c.isin("I", "l"), "").otherwise(c)
    t = F.btrim(text)
    mended = t
    for pattern in ("^2([4-9][0-9]{1,2})([A-DI-Z0Oo]?)$", "^2[.,;:-]([4-9][0-9]{1,2})([A-DI-Z0Oo]?)$"):
        mended = F.when(mended.rlike(pattern), F.concat(F.lit("Z"), F.regexp_extract(mended, pattern, 1), d(F.regexp_extract(mended, pattern, 2)))).otherwise(mended)
    mended = F.regexp_replace(F.regexp_replace(mended, "^(Z[4-9][0-9]{1,2})[0Oo]$", "$1D"), "^([4-9][0-9]{1,2})$", "Z$1")
    t = F.when(F.lit(id_column) if isinstance(id_column, bool) else id_column, mended).otherwise(t)
    t = F.when(t.rlike("^2[0-9IlSBO]{3}[.,][0-9IlSBO]{1,3}$"), F.translate(t, LETTERS + ",", DIGITS + ".")).otherwise(t)
    return F.regexp_replace(t, "^([0-9]{2})[:;.-]([0-9]{2})$", "$1:$2")


#: A row id that is whole; what may be one that isn't. Fixed values.
WHOLE_ID, ID_LIKE = "^Z[4-9][0-9]{1,2}[A-D]?$", "^[Z2\\d.,;:\\-A-Da-d]+$"


def _id_parts(text: Column) -> Column:
    """struct(num, suffix, digits) of an id; null fields if it isn't one."""
    at = lambda k: F.regexp_extract(F.btrim(text), "^Z?([0-9]+)([A-Da-d]?)$", k)
    num = at(1).try_cast("int")
    return F.struct(num.alias("num"), F.upper(at(2)).alias("suffix"), num.cast("string").alias("digits"))


def _could_be(raw: Column, digits: Column) -> Column:
    """Whether the digits that were read may be a damaged form of `digits`."""
    return (raw == "") | digits.contains(raw) | raw.contains(digits) | (F.levenshtein(raw, digits) <= 1)


def filled_ids(items: DataFrame) -> DataFrame:
    """items (doc_id, page, item, text) with inferred: what a missing or damaged id must be by the ids around it.

    An id between two that are 2 apart is the one between; else it follows the next whole id, else the one before, in the page's
    direction, if what was read can be a damaged form of it. The direction is that of most neighbours 1 apart, else
    from the first to the last id of 3 digits, else to the last id. Ids that are filled in count as whole
    for the rows after them: each page is folded in order, as one array.
    """
    page, after = Window.partitionBy(*PAGE), Window.partitionBy(*PAGE).orderBy("item")
    raw = F.btrim(F.coalesce("text", F.lit("")))
    each = items.withColumn("_raw", raw).withColumn("_whole", F.when(raw.rlike(WHOLE_ID), raw)).withColumn("_p", _id_parts(F.col("_whole")))
    each = each.withColumn("_next", F.first("_whole", ignorenulls=True).over(after.rowsBetween(1, Window.unboundedFollowing)))
    each = each.withColumn("_before", F.last(F.when(F.col("_whole").isNotNull(), F.col("_p")), ignorenulls=True).over(after.rowsBetween(Window.unboundedPreceding, -1)))
    step = F.when((F.col("_p.suffix") == F.col("_before.suffix")) & (F.length("_p.digits") == F.length("_before.digits")), F.col("_p.num") - F.col("_before.num"))
    step = F.when(F.abs(step) == 1, step)
    long_ = F.when(F.length("_p.digits") >= 3, F.col("_p.num"))
    is_whole = F.col("_whole").isNotNull()
    per = each.groupBy(*PAGE).agg(
        F.sum((step > 0).cast("int")).alias("up"), F.count(step).alias("steps"), F.count(long_).alias("longs"), F.count("_whole").alias("wholes"),
        F.max_by(long_, F.when(long_.isNotNull(), F.col("item"))).alias("last_long"), F.min_by(long_, F.when(long_.isNotNull(), F.col("item"))).alias("first_long"),
        F.max_by("_p.num", F.when(is_whole, F.col("item"))).alias("last_num"), F.min_by("_p.num", F.when(is_whole, F.col("item"))).alias("first_num"),
        F.collect_set("_p.digits").alias("all_digits"),
        F.sort_array(F.collect_list(F.struct("item", F.col("_raw").alias("raw"), F.col("_next").alias("next")))).alias("rows"))
    rises = F.when(F.col("steps") > 0, F.col("up") * 2 >= F.col("steps")).when(F.col("longs") >= 2, F.col("last_long") > F.col("first_long")).otherwise(F.col("last_num") > F.col("first_num"))
    per = per.withColumn("dir", F.when(rises, 1).otherwise(-1))

    def name(num: Column, suffix: Column) -> Column:
        return F.concat(F.lit("Z"), num.cast("string"), suffix)

    def inferred(r: Column, before: Column) -> Column:
        own, a, b = _id_parts(r["raw"]), _id_parts(before), _id_parts(r["next"])
        read = F.coalesce(own["digits"], F.regexp_replace(r["raw"], "[^0-9]", ""))
        between = F.when((b["num"] - a["num"] == 2) & (a["suffix"] == b["suffix"]), name(a["num"] + 1, a["suffix"]))
        from_next, from_before = b["num"] - F.col("dir"), a["num"] + F.col("dir")
        by_next = F.when(_could_be(read, from_next.cast("string")), name(from_next, b["suffix"]))
        by_before = F.when(_could_be(read, from_before.cast("string")), name(from_before, a["suffix"]))
        longer = F.exists("all_digits", lambda d: (F.length(d) > F.length(own["digits"])) & d.contains(own["digits"]))
        fits = F.when(between.isNotNull(), _could_be(own["digits"], (a["num"] + 1).cast("string"))).otherwise(_could_be(own["digits"], from_next.cast("string")))
        short = (F.length(own["digits"]) < 3) & (longer | F.coalesce(fits, F.lit(False)))
        wanted = ((r["raw"] == "") | r["raw"].rlike(ID_LIKE)) & (~r["raw"].rlike(WHOLE_ID) | F.coalesce(short, F.lit(False)))
        return F.when(wanted, F.coalesce(between, by_next, by_before))

    def fold(s: Column, r: Column) -> Column:
        found = inferred(r, s["before"])
        now = F.coalesce(found, r["raw"])
        return F.struct(F.when(now.rlike(WHOLE_ID), now).otherwise(s["before"]).alias("before"), F.concat(s["out"], F.array(F.struct(r["item"].alias("item"), found.alias("inferred")))).alias("out"))

    item_type = items.schema["item"].dataType.simpleString()
    start = F.struct(F.lit(None).cast("string").alias("before"), F.array().cast(f"array<struct<item:{item_type},inferred:string>>").alias("out"))
    made = per.where("wholes >= 2").select(*PAGE, F.inline(F.aggregate("rows", start, fold)["out"]))
    return items.join(made, [*PAGE, "item"], "left").select(*items.columns, "inferred")


def to_retry(items: DataFrame, below: float = 0.75, most: int = 10) -> DataFrame:
    """The `most` items of a page with the lowest confidence under `below`: what a page sends to the model again."""
    k = F.row_number().over(Window.partitionBy(*PAGE).orderBy("confidence", "item"))
    return items.where(F.col("confidence") < below).withColumn("_k", k).where(F.col("_k") <= most).drop("_k")


def flattened(results: DataFrame) -> DataFrame:
    """doc_id, page, item, text, confidence, box, of results (doc_id, page, quads array<struct<points array<array<double>>, text, score>>)."""
    each = results.select(*PAGE, F.posexplode("quads").alias("item", "q"))
    xs, ys = F.transform("q.points", lambda p: p[0]), F.transform("q.points", lambda p: p[1])
    return each.select(*PAGE, "item", "q.text", F.col("q.score").alias("confidence"), F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def density(pixels: Column, below: int = 240) -> Column:
    """Share of an array of grey values that is darker than `below`."""
    return F.coalesce(F.try_divide(F.size(F.filter(pixels, lambda p: p < below)).cast("double"), F.size(pixels).cast("double")), F.lit(0.0))
