"""Mixing sources to target weights by Pareto order sampling (native).

A document's expected copies are its source's ratio target / size, tilted by `score` (here longer
texts over shorter ones) so that the size-weighted mean stays the ratio and no document is expected
less than 0 or more than 3 times. The whole part is taken for certain. The rest is an inclusion
probability p, and Pareto order sampling draws a fixed number of documents with about these odds: they
are ranked by the random odds u / (1 - u) divided by p / (1 - p), and the first ones are selected.

A draw is made for each class of lengths of a source (CLASSES to a doubling of the length). Its fixed
number is what its p add up to, rounded so that words add up too: from the longest class to the shortest,
a class is given the number that brings the words drawn nearest to the words expected so far, by its
mean length. A source so misses its target by about the spread of lengths inside classes.

Ranks of a class are never computed in one place: counts per (class, rank bucket) give the bucket
where its number is full, that bucket alone is split into buckets again until none holds more than
EDGE documents, and only those are ordered row by row. u is a hash of doc_id, text, the copy's number
among equal rows, and seed: so reruns agree, and rows that are alike are drawn one by one.

Defined results: null and empty texts have size 0 and take nothing; null sources are one source, the
last; repeated rows are separate documents; an empty table gives no rows; extra columns are kept
by `mixed` if asked for, under any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .repeats import counted, each_copy
from ..operators.graph import dealt_join
from ..sources.scratch import written
from .words import n_words, whole

MOST_COPIES = 3
CLASSES = 4
BUCKETS = 1024
#: Rows of a class that one task may order.
EDGE = 1 << 14


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, n (rows) from the sum of `size` per source.

    Weights 1, 2, 3, repeating in code point order, null last. A target stops at 3 times its source's
    size. Sources reach that stop in the order of size / weight, so running sums in that order tell
    which ones do. The table has a row for each source: it is small enough for one task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    # words per weight if exactly the sources before this one stop
    level = (total - MOST_COPIES * F.coalesce(F.sum("source_size").over(upto), F.lit(0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= MOST_COPIES * F.col("source_size"))
    per = per.withColumn("at", F.min(F.when(F.col("open"), F.struct(F.row_number().over(order).alias("k"), "level"))).over(everything)["level"])
    stop = (MOST_COPIES * F.col("source_size")).cast("double")
    return per.select("source", "n", "source_size", F.coalesce(F.least(stop, F.col("at") * F.col("weight")), stop).alias("target"))


def _uniform(seed: int) -> Column:
    """In (0, 1), from the first 52 bits of a digest of the row's doc_id, text and copy."""
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("digest").cast("string"), F.col("copy").cast("string"), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _with(rows: DataFrame, table: DataFrame, *key: str) -> DataFrame:
    """rows with the columns of table, which has a row for each source (and key) with `n`, its number of rows; sources may be null. The rows of a large source are dealt to tasks by their number."""
    def named(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_src", F.coalesce("source", F.lit(""))).withColumn("_none", F.col("source").isNull())

    return dealt_join(named(rows), named(table).drop("source"), ["_src", "_none", *key], "digest").drop("_src", "_none")


def _numbers(of: DataFrame, seed: int) -> DataFrame:
    """source, class, n, most: how many of its n documents each class draws, from rows (source, class, size, p).

    A source has CLASSES classes for each doubling of the length, some hundred at most: they are one array. Numbers are
    rounded at random, up or down by their fraction, so that no odds are lost in classes of few; the last is rounded to the nearest.
    """
    per = of.where("class is not null").groupBy("source", "class").agg(F.count(F.lit(1)).alias("rows"), F.sum("p").alias("p"), F.sum(F.col("p") * F.col("size")).alias("words"))
    chance = F.pmod(F.xxhash64("source", "class", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    each = per.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("class", "rows", (F.col("words") / F.col("p")).alias("mean"), "words", chance.alias("chance"))), asc=False).alias("c"), F.min("class").alias("last"))
    state = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<struct<class:int,n:bigint,most:bigint>>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        wanted = s["left"] + c["words"]
        up = F.when(c["class"] == F.col("last"), 0.5).otherwise(c["chance"])
        most = F.least(c["rows"], F.greatest(F.lit(0), F.floor(wanted / c["mean"] + up))).cast("bigint")
        return F.struct((wanted - most * c["mean"]).alias("left"), F.concat(s["out"], F.array(F.struct(c["class"].alias("class"), c["rows"].alias("n"), most.alias("most")))).alias("out"))

    return each.select("source", F.inline(F.aggregate("c", state, step)["out"]))


def drawn(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """rows (source, class, rank in [0, 1), doc_id, digest, copy, ..) with `extra`: 1 for the first by rank, as many of each class as numbers (source, class, n, most) say."""
    place, left, done = F.col("rank"), numbers, None
    while True:
        at = rows.withColumn("at", place).withColumn("bucket", F.least(F.floor(F.col("at") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
        of = left.select(F.col("source").alias("_s"), F.col("class").alias("_c"), "most", F.col("n").alias("rows"))
        same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c"))
        sums = at.groupBy("source", "class", "bucket").agg(F.count(F.lit(1)).alias("n")).join(of, same, "left").drop("_s", "_c", "rows")
        before = F.sum("n").over(Window.partitionBy("source", "class").orderBy("bucket")) - F.col("n")
        # the bucket where the number is full; none if all are taken
        full = sums.withColumn("before", before).where(F.col("before") + F.col("n") > F.col("most"))
        cut = full.groupBy("source", "class").agg(F.min(F.struct("bucket", "before", "n", "most")).alias("c"))
        cut = cut.join(of, same, "right").select(F.col("_s").alias("source"), F.col("_c").alias("class"), F.coalesce("c.bucket", F.lit(BUCKETS)).alias("full"), (F.col("c.most") - F.col("c.before")).alias("most"), F.col("c.n").alias("n"), "rows")
        cut = written(cut, "cuts")
        side = F.when(F.col("bucket") < F.col("full"), 1).when(F.col("bucket") > F.col("full"), 0)
        judged = written(_with(at, cut.select("source", "class", "full", F.col("rows").alias("n")), "class").withColumn("extra", side), "judged").drop("full")
        sure = judged.where("extra is not null").drop("at", "bucket")
        done = sure if done is None else done.unionByName(sure)
        rows, left = judged.where("extra is null").drop("extra"), cut.where("n is not null")
        largest = left.agg(F.max("n")).first()[0] or 0
        if largest <= EDGE:
            break
        place = F.col("at") * BUCKETS - F.col("bucket")
    order = Window.partitionBy("source", "class").orderBy("at", "doc_id", "digest", "copy")
    last = _with(rows, left.select("source", "class", "most", "n"), "class").withColumn("extra", (F.row_number().over(order) <= F.col("most")).cast("int"))
    return done.unionByName(last.drop("at", "bucket", "most"))


def ranked(docs: DataFrame, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The rows of docs with what their draw is made from: certain (copies), p, rank and class (null: nothing to draw)."""
    others = [c for c in keep if c not in ("doc_id", "source")]
    # taken before anything else, so that the texts are read once
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("digest"), n_words(whole("text")).alias("size"), *[F.col(f"`{c}`").alias(f"keep_{k}") for k, c in enumerate(others)])
    rows = each_copy(counted(rows, *rows.columns))
    rows = written(rows.withColumn("score", F.floor(1000 * F.col("size") / (F.col("size") + 256)).cast("long")), "sized")
    targets = written(source_targets(rows), "targets")
    means = rows.groupBy(F.col("source").alias("_s")).agg((F.sum(F.col("score") * F.col("size")) / F.greatest(F.sum("size"), F.lit(1))).alias("mean"))
    of = _with(rows, written(targets.join(means, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "targets"))
    ratio = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    tilt = (F.col("score") - F.col("mean")) / 1000
    of = of.withColumn("expected", F.least(F.lit(float(MOST_COPIES)), F.greatest(F.lit(0.0), ratio + tilt * F.least(ratio, MOST_COPIES - ratio))))
    of = of.withColumn("certain", F.floor("expected").cast("int")).withColumn("p", F.col("expected") - F.col("certain"))
    u, p = _uniform(seed), F.col("p")
    odds = F.try_divide(u / (1 - u), F.try_divide(p, 1 - p))
    open_ = (F.col("p") > 0) & (F.col("size") > 0) & (F.col("certain") < MOST_COPIES)
    # rank: the quotient q of the odds as q / (1 + q), in order alike
    return of.withColumn("rank", odds / (1 + odds)).withColumn("class", F.when(open_, F.floor(F.log2("size") * CLASSES)).cast("int")).drop("score", "mean", "expected")


def mixed(docs: DataFrame, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, source, size, source_size, target, copies (0 to 3), taken (copies * size) for every row of docs."""
    of = written(ranked(docs, seed, keep), "ranked")
    out = drawn(of.where("class is not null"), written(_numbers(of, seed), "numbers")).unionByName(of.where("class is null").withColumn("extra", F.lit(0)))
    copies = F.col("certain") + F.col("extra")
    others = [c for c in keep if c not in ("doc_id", "source")]
    named = [F.col(c) if c in ("doc_id", "source") else F.col(f"keep_{others.index(c)}").alias(c) for c in keep]
    return out.select(*named, *[c for c in ("source",) if c not in keep], "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
