"""Conversation prefix trie: each distinct sequence of first turns is a node, with rollups of its subtree.

A conversation is rebuilt from the first turns of its family's opening conversation and its own later turns. Each turn becomes a
digest before anything is shuffled; texts stay where they are. A chain of digests along each
conversation names its prefixes, and Spark counts and sums the rows of each prefix, combined before the shuffle, so a
turn that a third of all conversations begin with arrives once from each task.

Nodes with over SHARD turns beneath them, copies counted, are the heavy upper levels. What hangs below them falls into prefix
shards, each of at most SHARD nodes, dealt to groups of about as many. For each group numpy builds
a succinct level-order trie: the LOUDS bitvector (a one for each child, then a zero, in level order, with a super-root above the
shards' tops) and the labels and values of its edges in the same order. Degrees, parents and levels are read from the bits
by rank and select, and a reverse breadth-first pass of add.at over the levels gives the rollups.

Heavy levels merge separately: every node belongs to its smallest member, so what a conversation owns below and in
the heavy levels is summed from its end to each of its heavy prefixes, and those sums are added by prefix. That takes one pass
however many levels there are.

Defined results: turns are ordered by turn (null first), then role, then digest of role and text; repeated turns
are kept; null roles and texts are empty; rows with a null conv_id belong to no conversation and take no part; an empty table gives no rows;
extra columns are ignored. A conversation's digests (about 60 bytes a turn) are numbered in one task, as a stream that may spill.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .words import n_words, whole

#: Turns beneath a node from which it belongs to the heavy upper levels.
SHARD = 200_000
FAMILY = 20
#: Conversations share at most this many first turns with their family, less one.
SHARED = 4
#: Conversation ids are joined to strings in ranges of so many before a node's are digested.
IDS = 4096
ROOT = b""
NODE = "id binary, n_children long, n_leaves long, saved long, parent_conv_id long"


def opening(conv_id: Column) -> tuple[Column, Column]:
    """The family's first conversation, and how many of its first turns a conversation begins with."""
    return conv_id - F.pmod(conv_id, F.lit(FAMILY)), F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), turns (in the conversation), digest, words for turns (conv_id, turn, role, text)."""
    role, text = whole("role"), whole("text")
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    each = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), n_words(text).alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    own = written(each.select("conv_id", F.row_number().over(order).alias("k"), "digest", "words"), "turns")
    family, h = opening(F.col("conv_id"))
    first = own.where(F.col("k") < SHARED).select(F.col("conv_id").alias("family"), "k", "digest", "words")
    wanted = own.where("k = 1").select("conv_id", family.alias("family"), h.alias("h"))
    borrowed = wanted.join(first, "family").where("k <= h").select("conv_id", "k", "digest", "words")
    both = own.where(F.col("k") > h).unionByName(borrowed)
    at = Window.partitionBy("conv_id")
    return both.select("conv_id", F.row_number().over(at.orderBy("k")).alias("depth"), F.count(F.lit(1)).over(at).alias("turns"), "digest", "words")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import blake2b

    conv, at = None, ROOT
    for batch in batches:
        ids, parents = [], []
        for c, digest in zip(batch["conv_id"].to_pylist(), batch["digest"].to_pylist()):
            if c != conv:
                conv, at = c, ROOT
            parents.append(at)
            at = blake2b(at + digest, digest_size=16).digest()
            ids.append(at)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("conv_id", "depth", "turns", "words")), pa.array(ids, pa.binary()), pa.array(parents, pa.binary())], ["conv_id", "depth", "turns", "words", "id", "parent"])


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, turns, words, id, parent: the node of each prefix; parent is empty for the root."""
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return dealt.mapInArrow(_chained, "conv_id long, depth int, turns long, words long, id binary, parent binary")


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of each node's joined ids, from their ranges in order."""
    from hashlib import sha256

    node, digest = None, None
    for batch in batches:
        done = []
        for i, ids in zip(batch["id"], batch["ids"]):
            if i != node:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = i, sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["id", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(node, digest.hexdigest())], columns=["id", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """id, ends_sha256 of (id, conv_id): ids are gathered in ranges of at most IDS, and the ranges of a node streamed through its digest."""
    parts = members.groupBy("id", F.floor(F.col("conv_id") / IDS).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return parts.repartition("id").sortWithinPartitions("id", "part").select("id", "ids").mapInPandas(_hashed, "id binary, ends_sha256 string")


class Louds:
    """A forest in level order below a super-root. order: the place of each node in the arrays given; node 0 is the super-root."""

    def __init__(self, ids: np.ndarray, parents: np.ndarray, depths: np.ndarray) -> None:
        n = len(ids)
        by_id = np.argsort(ids, kind="stable")
        at = np.searchsorted(ids[by_id], parents)
        at[at == n] = 0
        up = np.where(ids[by_id[at]] == parents, by_id[at], -1)
        # tops stand at any depth, so levels are counted from them
        level, todo = np.zeros(n, np.int64), np.argsort(depths, kind="stable")
        edges = np.flatnonzero(np.diff(depths[todo], prepend=depths[todo][:1] - 1)) if n else []
        for a, b in zip(edges, [*edges[1:], n]):
            i = todo[a:b]
            level[i] = np.where(up[i] < 0, 1, level[up[i]] + 1)
        place = np.zeros(n + 1, np.int64)  # of the super-root at the end, which -1 finds
        order, seen = [], 1
        by_level = np.argsort(level, kind="stable")
        starts = np.searchsorted(level[by_level], np.arange(1, level.max(initial=0) + 2))
        for a, b in zip(starts, starts[1:]):
            i = by_level[a:b]
            i = i[np.lexsort((ids[i], place[up[i]]))]
            place[i] = seen + np.arange(len(i))
            seen += len(i)
            order.append(i)
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        degrees = np.bincount(place[up], minlength=n + 1)
        #: A one for each child and a zero after them, node by node.
        self.bits = np.ones(2 * n + 1, bool)
        self.bits[np.cumsum(degrees) + np.arange(n + 1)] = False
        self.labels = ids[self.order]

    def degrees(self) -> np.ndarray:
        """Children of each node: the ones between its zero and the one before."""
        return np.diff(np.flatnonzero(~self.bits), prepend=-1) - 1

    def parents(self) -> np.ndarray:
        """Parent of each node but the super-root: the zeros before its one."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones))

    def levels(self) -> list[tuple[int, int]]:
        """First node of each level and of the next, from the tops on: a level's children follow one another."""
        last, out, a, b = np.cumsum(self.degrees()), [], 0, 1
        while last[b - 1] + 1 > b:
            a, b = b, int(last[b - 1]) + 1
            out.append((a, b))
        return out

    def rolled_up(self, *values: np.ndarray) -> list[np.ndarray]:
        """Sums over each node's subtree of values in level order, the super-root first."""
        parents, sums = self.parents(), [v.copy() for v in values]
        for a, b in reversed(self.levels()):
            for s in sums:
                np.add.at(s, parents[a - 1 : b - 1], s[a:b])
        return sums


def _packed(ids: pd.Series) -> np.ndarray:
    """Ids as one array that sorts by bytes; the root's is all zeros."""
    return np.array([bytes(i) for i in ids], dtype="S16")


def _shard(nodes: pd.DataFrame) -> pd.DataFrame:
    trie = Louds(_packed(nodes["id"]), _packed(nodes["parent"]), nodes["depth"].to_numpy())
    there = nodes.iloc[trie.order]
    degrees, up = trie.degrees(), trie.parents()
    saved = np.append(0, ((there["n_convs"] - 1) * there["words"]).to_numpy())
    leaves, saved = trie.rolled_up((degrees == 0).astype(np.int64), saved)
    conv = np.append(0, there["conv_id"].to_numpy())
    above = pd.array(conv[up], dtype="Int64")
    above[up == 0] = pd.NA
    return pd.DataFrame({"id": there["id"].to_numpy(), "n_children": degrees[1:], "n_leaves": leaves[1:], "saved": saved[1:], "parent_conv_id": above})


def trie(turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for every node of the rebuilt conversations."""
    spark = turns.sparkSession
    convs = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    paths = written(prefixes(rebuilt(turns)), "paths")
    beneath = F.sum(F.col("turns") - F.col("depth") + 1)
    nodes = paths.groupBy("id").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("words").alias("words"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), beneath.alias("beneath"))
    nodes = written(nodes, "nodes")
    heavy = written(nodes.where(F.col("beneath") > shard), "heavy")
    light = nodes.where(F.col("beneath") <= shard)
    is_top = light.join(heavy.select(F.col("id").alias("parent")), "parent", "left_semi").unionByName(light.where("depth = 1"), allowMissingColumns=True)
    tops = written(is_top.select(F.col("id").alias("top"), "conv_id", "parent"), "tops")
    # the shard of a node is that of its smallest member
    shards = tops.join(paths.select(F.col("id").alias("top"), F.col("conv_id").alias("member")), "top").select("top", F.col("member").alias("conv_id"))
    groups = max(1, -(-light.count() // shard))
    dealt = light.join(shards, "conv_id").withColumn("shard_group", F.pmod(F.xxhash64("top"), F.lit(groups)))
    rolled = written(dealt.groupBy("shard_group").applyInPandas(lambda p: _shard(p), NODE), "rolled")

    # what smallest members own at and below the heavy levels
    owned = tops.join(rolled.select(F.col("id").alias("top"), "n_leaves", "saved"), "top").select("conv_id", "n_leaves", "saved")
    children = nodes.where("depth > 1").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    degrees = written(heavy.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "degrees")
    own = F.col("conv_id") == F.col("owner")
    leaf, kept = F.when(own & (F.col("n_children") == 0), 1).otherwise(0), F.when(own, (F.col("n_convs") - 1) * F.col("words")).otherwise(0)
    inside = paths.select("id", "conv_id", "depth").join(degrees.select("id", F.col("conv_id").alias("owner"), "n_children", "n_convs", "words"), "id")
    inside = inside.select("id", "conv_id", "depth", leaf.cast("long").alias("n_leaves"), kept.alias("saved"), own.alias("own"))
    below = inside.select("conv_id").distinct().join(owned, "conv_id").withColumn("id", F.lit(None).cast("binary")).withColumn("depth", F.lit(np.iinfo(np.int32).max)).withColumn("own", F.lit(True))
    down = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = inside.unionByName(below).select("id", F.sum("n_leaves").over(down).alias("n_leaves"), F.sum("saved").over(down).alias("saved"))
    merged = sums.where("id is not null").groupBy("id").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    upper = written(degrees.join(merged, "id"), "upper")

    above = heavy.select(F.col("id").alias("parent"), F.col("conv_id").alias("above"))
    of_tops = tops.join(above, "parent").select(F.col("top").alias("id"), "above")
    lower = light.join(rolled, "id").join(of_tops, "id", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    upper_rows = upper.join(above, "parent", "left").withColumnRenamed("above", "parent_conv_id")
    columns = ("id", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved")
    every = lower.select(*columns).unionByName(upper_rows.select(*columns))

    # the root's members are all conversations, those without turns included
    all_convs = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    totals = owned.select("n_leaves", "saved").unionByName(inside.where("own").select("n_leaves", "saved")).agg(F.coalesce(F.sum("n_leaves"), F.lit(0)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    first = nodes.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"))
    root = all_convs.join(totals).join(first).select(F.lit(ROOT).alias("id"), "conv_id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved")
    root = written(root, "root")  # one row at most
    top_conv = F.broadcast(root.select(F.col("conv_id").alias("root_conv")))
    every = every.join(top_conv, F.col("depth") == 1, "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "root_conv")).drop("root_conv")
    turnless = convs.join(paths.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select(F.lit(ROOT).alias("id"), "conv_id")
    digests = ends(paths.where("depth = turns").select("id", "conv_id").unionByName(turnless))
    out = every.unionByName(root).join(digests, "id", "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
