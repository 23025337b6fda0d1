"""Links between documents and walks along them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows of one key that a task may get in `dealt_join`: LEAST, or one in MOST of all rows if that is more.
LEAST, MOST = 1 << 11, 1 << 16


def links(docs: DataFrame, keys: dict[str, tuple[str, float]]) -> DataFrame:
    """from, to, type, strength, key: documents that share a key, each linked to the smallest document of the key.

    keys: column -> (type, strength). A star has the components and, at two steps, the neighbours of all pairs
    without their number.
    """
    out = None
    for column, (kind, strength) in keys.items():
        d = docs.where(F.col(column).isNotNull()).select("doc_id", F.col(column).cast("string").alias("key")).distinct()
        hub = d.groupBy("key").agg(F.min("doc_id").alias("from"))
        part = d.join(hub, "key").where("doc_id <> from").select("from", F.col("doc_id").alias("to"), F.lit(kind).alias("type"), F.lit(strength).alias("strength"), "key")
        out = part if out is None else out.unionByName(part)
    return out


def neighbours(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, distance: what is reached from start (node) in `depth` undirected steps, by shortest way."""
    both = edges.select("from", "to").unionByName(edges.select(F.col("to").alias("from"), F.col("from").alias("to")))
    seen = start.select("node", F.lit(0).alias("distance")).distinct()
    last = seen
    for k in range(1, depth + 1):
        step = last.join(both, F.col("node") == F.col("from")).select(F.col("to").alias("node"), F.lit(k).alias("distance")).distinct()
        last = step.join(seen, "node", "left_anti")
        seen = seen.unionByName(last)
    return seen


def dealt_join(rows: DataFrame, per_key: DataFrame, key: list[str], spread: str) -> DataFrame:
    """rows joined (left) to per_key, which has a row for each `key` with `n`, how many of rows have it; n is left out.

    A key with more rows than LEAST and than one in MOST of all is dealt to several tasks by the hash of its rows' column `spread`,
    to more the more rows it has; its row of per_key goes to each. There are fewer than MOST such keys, so they are broadcast.
    per_key is read three times: it should be a written table. No key is null.
    """
    total = per_key.agg(F.sum("n")).first()[0] or 0
    share = max(LEAST, total // MOST)
    hot = F.broadcast(per_key.where(F.col("n") > share).select(*key, F.ceil(F.col("n") / share).alias("_tasks")))
    tasks = F.coalesce("_tasks", F.lit(1).cast("long"))
    left = rows.join(hot, key, "left").withColumn("_task", F.pmod(F.xxhash64(spread), tasks)).drop("_tasks")
    right = per_key.drop("n").join(hot, key, "left").withColumn("_task", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1))).drop("_tasks")
    return left.join(right, [*key, "_task"], "left").drop("_task")


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node) of undirected edges (from, to). Edges with a null end, loops and repeated edges don't matter.

    Every round a node points to the least of itself and its neighbours, by the hash of their ids, and edges move to what
    their ends point to, until none is left: that takes about as many rounds as the logarithm of the longest path. Minima are
    pre-aggregated before the shuffle, and large components are dealt to several tasks in the last join. Every round is
    written to the shared folder.
    """
    left = written(edges.select(F.col("from").alias("a"), F.col("to").alias("b")).where("a <> b").distinct(), "edges")
    pointers: list[DataFrame] = []
    while not left.isEmpty():
        near = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min(F.struct(F.xxhash64("b"), "b")).alias("m"))
        own = F.struct(F.xxhash64("a").alias("col1"), F.col("a").alias("b"))
        point = written(near.select(F.col("a").alias("node"), F.least(own, F.col("m"))["b"].alias("to")), "pointers")
        pointers.append(point)
        ends = left.join(point.toDF("a", "pa"), "a").join(point.toDF("b", "pb"), "b").where("pa <> pb")
        left = written(ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not pointers:
        return left.toDF("node", "component")
    at = pointers[0]
    for point in pointers[1:]:
        at = at.join(point.toDF("to", "next"), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    least = written(at.groupBy("to").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")), "least")
    return dealt_join(at, least, ["to"], "node").select("node", "component")
