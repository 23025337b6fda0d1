"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (native).

Every shard has `virtual_nodes` points on a ring of 65,536 cells and every document falls into the
cell of its doc_id's hash; its home is the next virtual node clockwise. A shard takes its capacity
and no more, and each of its virtual nodes a part of that: what overflows a full virtual node continues
clockwise to the next one with room. Capacities add up to the number of rows and differ by one at most
between shards, so the law `rows` holds: shard counts are at most one apart. A shard over capacity gives
up the same share at each of its virtual nodes, one under it has its free places dealt evenly to them,
so only the overflow moves.

The overflow is settled on tables of fixed size (cells and virtual nodes): going round the ring from
the point where overflow never wraps, the k-th overflowing row takes the k-th free place. Rows only
look up their cell. Each row's slot follows from its virtual node's base and its number in it, gapless
from 0 in each shard.

Rows of a cell are numbered without bringing them together: equal rows are one row with a count, the
others are dealt to parts of a cell by their content, of about PART rows each, parts are numbered by running
sums of their counts, and only a part is ordered. So a doc_id that a third of all rows share, or a null one, takes
many tasks. Equal texts are kept together only as far as the law `rows` lets them: their doc_ids decide.

Defined results: null texts have size 16 and checksum 0; null doc_ids share one cell; repeated rows
get places of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .repeats import counted, each_copy
from ..sources.scratch import written
from .words import whole

CELLS = 1 << 16
VIRTUAL_NODES = 64
#: Distinct rows in a part of a cell, on average, where a cell has more.
PART = 1 << 12


def _cell(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 48).cast("int")


def _nodes(docs: DataFrame, shards: int, virtual_nodes: int) -> DataFrame:
    """node (1, 2, ... clockwise), shard, cell."""
    made = docs.sparkSession.range(shards * virtual_nodes).select((F.col("id") / virtual_nodes).cast("int").alias("shard"), (F.col("id") % virtual_nodes).alias("copy"))
    made = made.withColumn("cell", _cell(F.lit("node"), "shard", "copy"))
    return made.select("shard", "cell", F.row_number().over(Window.orderBy("cell", "shard", "copy")).alias("node"))


def _homes(docs: DataFrame, nodes: DataFrame, virtual_nodes: int, shards: int) -> DataFrame:
    """cell, node: the first node at the cell or after it, clockwise."""
    cells = docs.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell"))
    at = nodes.groupBy("cell").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cells.join(at, "cell", "left").select("cell", (before % (shards * virtual_nodes) + 1).cast("int").alias("node"))


def _parts(total: Column, upto: Column, of: Column) -> Column:
    """floor(total * upto / of), in decimals wide enough for any row counts."""
    wide = total.cast("decimal(19,0)") * upto.cast("decimal(18,0)")
    return F.floor(wide / F.greatest(of, F.lit(1)).cast("decimal(19,0)")).cast("long")


def capacities(nodes: DataFrame, loads: DataFrame, shards: int, virtual_nodes: int) -> DataFrame:
    """node, shard, kept (rows that stay of its own), room (free places), over (rows that move on), base (its first slot), over_at and room_at (their running sums from where overflow never wraps), of loads (node, n)."""
    in_shard, all_of_shard = Window.partitionBy("shard").orderBy("node"), Window.partitionBy("shard")
    ring, everything = Window.orderBy("node"), Window.partitionBy()
    n, cap, load, i = F.col("n"), F.col("cap"), F.col("load"), F.col("i")
    settled = (
        nodes.join(loads, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("rows", F.sum("n").over(everything)).withColumn("load", F.sum("n").over(all_of_shard))
        .withColumn("upto", F.sum("n").over(in_shard)).withColumn("i", F.row_number().over(in_shard))
        .withColumn("cap", F.floor(F.col("rows") / shards) + (F.col("shard") < F.col("rows") % shards).cast("long"))
        .withColumn("kept", F.when(load > cap, _parts(cap, F.col("upto"), load) - _parts(cap, F.col("upto") - n, load)).otherwise(n))
        .withColumn("room", F.when(load < cap, _parts(cap - load, i, F.lit(virtual_nodes)) - _parts(cap - load, i - 1, F.lit(virtual_nodes))).otherwise(F.lit(0)))
        .withColumn("over", n - F.col("kept"))
        .withColumn("base", F.sum(F.col("kept") + F.col("room")).over(in_shard) - F.col("kept") - F.col("room"))
        .withColumn("depth", F.sum(F.col("over") - F.col("room")).over(ring))
        .withColumn("start", F.min(F.struct("depth", "node")).over(everything)["node"])
        .withColumn("turn", F.pmod(F.col("node") - F.col("start") - 1, F.lit(shards * virtual_nodes)))
        .withColumn("over_at", F.sum("over").over(Window.orderBy("turn")) - F.col("over"))
        .withColumn("room_at", F.sum("room").over(Window.orderBy("turn")) - F.col("room"))
    )
    return settled.select("node", "shard", "kept", "room", "over", "base", "over_at", "room_at")


def placed(docs: DataFrame, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, home_shard, home_node, home_rank (number among the rows at home there) for every row of docs."""
    key = F.xxhash64(F.lit("key"), F.col("doc_id"))
    rows = docs.select("doc_id", F.octet_length(whole("text")).cast("long").alias("bytes"), F.crc32(whole("text").cast("binary")).alias("text_crc32"))
    rows = counted(rows, "doc_id", "bytes", "text_crc32").withColumn("key", key).withColumn("cell", F.shiftrightunsigned("key", 48).cast("int"))
    rows = written(rows, "rows")
    # a row for each cell: 65,536 at most
    split = F.broadcast(written(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")), "split"))
    rows = rows.join(split, "cell").withColumn("part", F.pmod(F.xxhash64("key", "text_crc32", "bytes"), F.col("parts"))).drop("parts")
    parts = written(rows.groupBy("cell", "part").agg(F.sum("n").alias("n")), "parts")
    nodes = _nodes(docs, shards, virtual_nodes)
    by_node = Window.partitionBy("node").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = written(
        _homes(docs, nodes, virtual_nodes, shards).join(parts.groupBy("cell").agg(F.sum("n").alias("n")), "cell", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("before", F.coalesce(F.sum("n").over(by_node), F.lit(0))), "cells")
    settled = written(capacities(nodes, cells.groupBy("node").agg(F.sum("n").alias("n")), shards, virtual_nodes), "nodes")

    # pieces of the overflow: from one node to one node
    points = (
        settled.where("over > 0").select(F.col("over_at").alias("lo"), F.struct(F.col("node"), (F.col("over_at") + F.col("over")).alias("end")).alias("src"), F.lit(None).alias("dst"))
        .unionByName(settled.where("room > 0").select(F.col("room_at").alias("lo"), F.lit(None).alias("src"), F.struct("shard", (F.col("base") + F.col("kept") - F.col("room_at")).alias("shift")).alias("dst")))
    )
    along = Window.orderBy("lo")
    pieces = (
        points.groupBy("lo").agg(F.max("src").alias("src"), F.max("dst").alias("dst"))
        .select("lo", F.last("src", ignorenulls=True).over(along).alias("src"), F.last("dst", ignorenulls=True).over(along).alias("dst"), F.lead("lo").over(along).alias("next"))
        .select(F.col("src.node").alias("node"), "lo", F.least(F.coalesce("next", "src.end"), "src.end").alias("hi"), F.col("dst.shard").alias("to_shard"), F.col("dst.shift").alias("shift"))
    )

    # the parts of a cell are ordered, then the distinct rows of a part
    in_cell = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("first", F.coalesce(F.sum("n").over(in_cell), F.lit(0))).select("cell", "part", "first")
    in_part = Window.partitionBy("cell", "part").orderBy("key", "doc_id", "text_crc32", "bytes").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("k", F.coalesce(F.sum("n").over(in_part), F.lit(0))).join(starts, ["cell", "part"])
    copies = each_copy(numbered.select("cell", "doc_id", "bytes", "text_crc32", "n", (F.col("first") + F.col("k")).alias("k")))
    home = cells.select("cell", "node", "before").join(settled.select("node", "shard", "kept", "base", "over_at"), "node")
    # the two tables have 65,536 rows and at most 2 * shards * virtual_nodes rows: bounded broadcasts
    at_home = copies.join(F.broadcast(home), "cell").withColumn("rank", F.col("before") + F.col("k") + F.col("copy"))
    at_home = at_home.withColumn("x", F.when(F.col("rank") >= F.col("kept"), F.col("over_at") + F.col("rank") - F.col("kept")))
    p = F.broadcast(pieces.withColumnRenamed("node", "from_node"))
    out = at_home.join(p, (F.col("node") == F.col("from_node")) & (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")), "left")
    stays = F.col("x").isNull()
    return out.select(
        "doc_id", (F.col("bytes") + 16).alias("size"), "text_crc32",
        F.when(stays, F.col("shard")).otherwise(F.col("to_shard")).cast("int").alias("shard"),
        F.when(stays, F.col("base") + F.col("rank")).otherwise(F.col("x") + F.col("shift")).cast("long").alias("slot"),
        F.col("shard").cast("int").alias("home_shard"), F.col("node").alias("home_node"), F.col("rank").alias("home_rank"),
    )
