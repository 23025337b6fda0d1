"""SimHash near-duplicates by a byte-position inverted index.

A fingerprint is 8 bytes at 8 positions. Two of them that differ in at most 2 bits share at least
6 bytes at their positions, so 6 is the count that a pair has to reach. Pairs whose bytes differ at 2
positions at most agree in two whole blocks of 2 positions, so postings of the index are narrowed to the
fingerprints that have such 4 bytes in common (PREFIX), and under each there is a posting for each of the
other positions and bytes. Pairs are listed from those postings and counted: a pair's tally is 4 and
the number of postings that it occurs in. Pairs under 6 are dropped, the rest are verified by their bits.

A prefix that more than SMALL fingerprints share is never paired up: its postings are narrowed by 2 more of
the other 4 positions, in all ways, so a common posting alone is the count of 6. What still is over
SMALL there differs in 2 bytes only, so it has 65,536 fingerprints at most, and each is looked up
under the 136 changes of 1 or 2 bits of those. Only distinct fingerprints are indexed: copies share
one, and their number never matters.

Links are joined into components; a document's class is the smallest doc_id that links reach.
Defined results: texts without a word, null ones too, have fingerprint zero and link like any other;
repeated rows get a row each; null doc_ids are never a class's smallest unless alone; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components, dealt_join
from ..sources.scratch import written

BITS, NEEDED, PREFIX = 2, 6, 4
SMALL = 16
SEED = 42


def fingerprint(text: str | None, n: int = 3) -> int:
    """64 bits: each is 1 if it is set in over half of the hashes of the n-word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    size = min(n, len(words))
    starts = [0, *(e + 1 for e in ends)]
    counts, total = np.zeros(64, dtype=np.int64), len(words) - size + 1
    for lo in range(0, total, 1 << 15):
        hi = min(total, lo + (1 << 15))
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[lo:hi], ends[lo + size - 1 : hi + size - 1])), dtype="<u8", count=hi - lo)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": np.array([fingerprint(t) for t in batch["text"]], dtype=np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) for every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_fingerprints, "doc_id long, fp long")


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << 8 * p for p in positions)
    return m - (1 << 64) if m >> 63 else m


BLOCKS = [(0, 1), (2, 3), (4, 5), (6, 7)]
FOURS = [a + b for a, b in combinations(BLOCKS, 2)]


def _posted(fps: DataFrame, sets: Column) -> DataFrame:
    """fps with `at` (positions, as the mask of their bytes) and `key` (those bytes), one row for each set, and `size` of the posting."""
    rows = fps.withColumn("at", F.explode(sets)).withColumn("key", F.col("fp").bitwiseAND(F.col("at")))
    return rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("at", "key"))).where("size > 1")


def _listed(posted: DataFrame, *key: str) -> DataFrame:
    """key, a, b: the pairs (a < b) of the postings `key`, SMALL fingerprints at most in each."""
    lists = posted.groupBy(*key).agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    each = lists.select(*key, F.posexplode("fps").alias("i", "a"), "fps")
    return each.select(*key, "a", F.explode(F.slice("fps", F.col("i") + 2, F.lit(SMALL))).alias("b"))


def tallied(posted: DataFrame) -> DataFrame:
    """a, b, shared: how many positional bytes each pair with a common prefix of PREFIX bytes and more shares, from postings (at, key, fp)."""
    other = F.filter(F.array(*[F.lit(_mask((p,))) for p in range(8)]), lambda m: F.col("at").bitwiseAND(m) == 0)
    bytes_ = posted.select("at", "key", "fp", F.explode(other).alias("position"))
    bytes_ = bytes_.withColumn("byte", F.col("fp").bitwiseAND(F.col("position")))
    return _listed(bytes_, "at", "key", "position", "byte").groupBy("at", "a", "b").agg((F.count(F.lit(1)) + PREFIX).alias("shared"))


def _verified(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")


def _residual_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links inside a posting of 6 positions: at most 65,536 fingerprints, each linked to a close one that is smaller, if any."""
    fps = np.sort(group["fp"].to_numpy().view(np.uint64))
    free = np.flatnonzero([int(group["at"].iloc[0]) >> 8 * p & 0xFF == 0 for p in range(8)])
    left = ((fps >> np.uint64(8 * free[0])) & np.uint64(255)).astype(np.int64) | (((fps >> np.uint64(8 * free[1])) & np.uint64(255)).astype(np.int64) << 8)
    index = np.full(1 << 16, -1, dtype=np.int64)
    index[left] = np.arange(len(left))
    a, b = [], []
    for change in [1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)]:
        other = index[left ^ change]
        hit = other > np.arange(len(left))
        a.append(np.flatnonzero(hit))
        b.append(other[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    # a spanning forest of these links is enough for components
    parent = np.arange(len(fps))
    while True:
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        parent = parent[parent]
        if (parent == before).all():
            break
    own = np.flatnonzero(parent != np.arange(len(fps)))
    return pd.DataFrame({"a": fps[parent[own]].view(np.int64), "b": fps[own].view(np.int64)})


def links(fps: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (fp) that give the same components as all pairs at BITS bits or fewer."""
    fours = F.array(*[F.lit(_mask(s)) for s in FOURS])
    posted = written(_posted(fps.select("fp"), fours), "postings")
    wider = F.array(*[
        F.struct(F.lit(_mask(s)).alias("four"), F.array(*[F.lit(_mask(s + two)) for two in combinations([p for p in range(8) if p not in s], 2)]).alias("sixes")) for s in FOURS])
    dense = posted.where(F.col("size") > SMALL).select("fp", F.filter(wider, lambda w: w["four"] == F.col("at"))[0]["sixes"].alias("sixes"))
    sixes = written(_posted(dense.select("fp", F.explode("sixes").alias("six")).distinct(), F.array("six")), "postings")
    sparse = tallied(posted.where(F.col("size") <= SMALL)).where(F.col("shared") >= NEEDED)
    counted = _listed(sixes.where(F.col("size") <= SMALL), "at", "key")
    forest = sixes.where(F.col("size") > SMALL).select("fp", "at", "key").groupBy("at", "key").applyInPandas(_residual_links, "a long, b long")
    return _verified(sparse).unionByName(_verified(counted)).unionByName(forest).distinct()


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, digest (xxhash64 of the text), gone, n: the rows that a class's first row, least doc_id and digest with null doc_ids last, stands for (gone), and first rows that n > 1 equal rows have."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("digest"), "text")

    def of_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id", "digest"]].assign(fp=np.array([fingerprint(t) for t in batch["text"]], dtype=np.int64))

    fps = written(rows.mapInPandas(of_rows, "doc_id long, digest long, fp long").groupBy("fp", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n")), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "digest")
    nodes = written(fps.groupBy("fp").agg(F.min(row).alias("first")), "nodes")
    parts = written(components(links(nodes).toDF("from", "to")).select(F.col("node").alias("fp"), "component"), "parts")
    # a class is named by its least fingerprint: doc_ids can be null or repeated
    linked = written(nodes.join(parts, "fp").groupBy("component").agg(F.min("first").alias("of_class"), F.count(F.lit(1)).alias("n")), "linked")
    of_class = dealt_join(parts, linked, ["component"], "fp").select("fp", "of_class")
    first = written(nodes.join(of_class, "fp", "left").select("fp", F.coalesce("of_class", "first").alias("first")), "firsts")
    return fps.join(first, "fp").select("doc_id", "digest", (row != F.col("first")).alias("gone"), "n").where("gone or n > 1")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    fps = written(fingerprints(docs), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    parts = written(components(links(nodes).toDF("from", "to")).select(F.col("node").alias("fp"), "component"), "parts")
    linked = written(nodes.join(parts, "fp").groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")), "linked")
    of_fp = nodes.join(dealt_join(parts, linked, ["component"], "fp").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    # written, so that both sides of the last join are dealt by it and Spark can split a fingerprint that many copies share
    of_fp = written(of_fp, "classes")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")
