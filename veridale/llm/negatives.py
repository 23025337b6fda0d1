"""Hard negatives by a pivot table.

Vectors are scaled to integers and augmented by one component, sqrt(M - |x|^2) for the greatest squared norm M of their
dimension and 0 for anchors, so that a larger inner product is a smaller Euclidean distance. The index holds
every row's distances to PIVOTS pivots, which are taken farthest-first from a sample of at most SAMPLE rows. By the
triangle inequality a row's distance to an anchor lies between the greatest difference and the least sum
of their distances to a pivot; that brackets the score, and only rows whose bracket meets what is still sought are
multiplied out. Brackets are widened by more than rounding can lose, so results are exact.

Anchors are a stated set of queries. They are taken in blocks of about BLOCK, which are broadcast (BLOCK rows of one
dimension, and five positives each); all rows pass each block twice where they lie, without a shuffle: first for the best of
the same label, then for the best of other labels inside the bands of scores that these set. A task keeps the best few for each
anchor and band, and Spark ranks what tasks have kept. Labels, copies or sources of any size take part in all tasks.

Defined results: rows with a null label, a null vector or a component that is null or not finite (also 256-fold) take no
part; scores are between vectors of one dimension; rows with a null vec_id are no anchors and rank after others of their
score; repeated rows are rows of their own, each of them other than its copies; scores beyond a long are held at its limits;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

SCALE = 256.0
PIVOTS = 16
#: Rows that pivots are chosen from.
SAMPLE = 2048
#: Anchors that are broadcast at once.
BLOCK = 1024
#: Rows that are bracketed at once.
STEP = 2048
N_POSITIVES, N_NEGATIVES = 5, 10
#: A negative's score in percent of its positive's.
LOW, HIGH = 30, 90
#: Integers up to this are exact as doubles, sums included.
EXACT = float(2**53)
LONG = np.iinfo(np.int64)
FOUND = "anchor long, slot int, score long, vec_id long, row long"


def scaled(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label, dim, norm (squared), q (integers as doubles) of the rows that take part. vectors: vec_id, label, embedding."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= float(np.finfo(np.float64).max) / SCALE))
    rows = vectors.where("label is not null and embedding is not null").where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("q"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["q"]
            flat, offsets = np.floor(SCALE * lists.flatten().to_numpy()), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            norm = np.where(np.diff(offsets) > 0, np.add.reduceat(np.append(flat * flat, 0.0), offsets[:-1]), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["vec_id"], batch["label"], pa.array(np.diff(offsets).astype(np.int32)), pa.array(np.asarray(norm, np.float64)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))],
                ["row", "vec_id", "label", "dim", "norm", "q"])

    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "q")
    return rows.mapInArrow(floors, "row long, vec_id long, label long, dim int, norm double, q array<double>")


def _pivots(rows: DataFrame, most: float) -> np.ndarray:
    """Augmented pivots: the sample's first row by hash, then whichever is farthest from those taken."""
    sample = rows.orderBy(F.xxhash64("q"), "row").limit(SAMPLE).select("q", "norm").collect()
    x = np.array([[*r.q, np.sqrt(max(most - r.norm, 0.0))] for r in sample])
    taken, far = [0], np.full(len(x), np.inf)
    while len(taken) < min(PIVOTS, len(x)):
        far = np.minimum(far, np.linalg.norm(x - x[taken[-1]], axis=1))
        taken.append(int(far.argmax()))
    return x[taken]


def _distances(q: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((q - p[:-1]) ** 2).sum(1) + (extra - p[-1]) ** 2) for p in pivots], 1)


def indexed(rows: DataFrame, pivots: np.ndarray, most: float) -> DataFrame:
    """row, vec_id, label, q, near: the distances of rows of one dimension to the pivots."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = batch["q"].flatten().to_numpy().reshape(batch.num_rows, -1)
                near = _distances(q, np.sqrt(np.maximum(most - batch["norm"].to_numpy(), 0.0)), pivots)
                yield pa.RecordBatch.from_arrays([batch[c] for c in ("row", "vec_id", "label", "q")] + [pa.ListArray.from_arrays(np.arange(len(near) + 1, dtype=np.int32) * len(pivots), near.ravel())], ["row", "vec_id", "label", "q", "near"])

    return rows.select("row", "vec_id", "label", "norm", "q").mapInArrow(measured, "row long, vec_id long, label long, q array<double>, near array<double>")


@dataclass
class Block:
    """Anchors of one dimension. low and high: the bands of scores for each slot of an anchor; none for positives."""

    row: np.ndarray
    label: np.ndarray
    q: np.ndarray
    near: np.ndarray
    most: float
    keep: int
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def _products(a: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    if most < EXACT:
        return (a @ x.T).astype(np.int64)
    whole = np.array([[sum(int(u) * int(v) for u, v in zip(p, r)) for r in x] for p in a], dtype=object).reshape(len(a), len(x))
    return np.clip(whole, LONG.min, LONG.max).astype(np.int64)


class Best:
    """The best `keep` rows of each (anchor, slot) so far."""

    def __init__(self, n: int, keep: int) -> None:
        self.keep, self.floor = keep, np.full(n, LONG.min)
        self.cols = [np.zeros(0, np.int64)] * 5  # place, score, no id, vec_id, row

    def add(self, *new: np.ndarray) -> None:
        if not len(new[0]):
            return
        place, score, none, ids, row = (np.concatenate(p) for p in zip(self.cols, new))
        order = np.lexsort((row, ids, none, ~score, place))
        place = place[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        order, place = order[rank < self.keep], place[rank < self.keep]
        self.cols = [place, score[order], none[order], ids[order], row[order]]
        last = np.flatnonzero(rank[rank < self.keep] == self.keep - 1)
        self.floor[place[last]] = self.cols[1][last]


def _sought(block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        n, slots = len(b.row), 1 if b.low is None else b.low.shape[1]
        best = Best(n * slots, b.keep)
        top = (b.q * b.q).sum(1)[:, None] + b.most
        slack = 1e-9 * top + 1e-6
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                x, near = (part[c].flatten().to_numpy().reshape(part.num_rows, -1) for c in ("q", "near"))
                row, label, none = part["row"].to_numpy(), part["label"].to_numpy(), part["vec_id"].is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = part["vec_id"].fill_null(0).to_numpy()
                least, greatest = np.zeros((n, len(row))), np.full((n, len(row)), np.inf)
                for p in range(near.shape[1]):
                    u, v = b.near[:, p, None], near[None, :, p]
                    np.maximum(least, np.abs(u - v), out=least)
                    np.minimum(greatest, u + v, out=greatest)
                most_score, least_score = (top - least * least) / 2 + slack, (top - greatest * greatest) / 2 - slack
                if not b.most < EXACT:  # doubles are too coarse for a bracket
                    most_score, least_score = np.full_like(most_score, np.inf), np.full_like(least_score, -np.inf)
                alike = b.label[:, None] == label[None, :]
                floor = best.floor.reshape(n, slots)
                if b.low is None:
                    open_ = alike & (b.row[:, None] != row[None, :]) & (most_score >= floor)
                else:
                    open_ = ~alike & (most_score >= np.maximum(b.low, floor).min(1, keepdims=True)) & (least_score <= b.high.max(1, keepdims=True))
                cols = np.flatnonzero(open_.any(0))
                if not len(cols):
                    continue
                score, open_ = _products(b.q, x[cols], b.most), open_[:, cols]
                for slot in range(slots):
                    fits = open_ & (score >= floor[:, slot, None])
                    if b.low is not None:
                        fits &= (score >= b.low[:, slot, None]) & (score <= b.high[:, slot, None])
                    i, j = np.nonzero(fits)
                    best.add(i * slots + slot, score[i, j], none[cols[j]], ids[cols[j]], row[cols[j]])
        place, score, none, ids, row = best.cols
        yield pa.RecordBatch.from_arrays([pa.array(b.row[place // slots]), pa.array((place % slots).astype(np.int32)), pa.array(score), pa.array(ids, mask=none.astype(bool)), pa.array(row)], ["anchor", "slot", "score", "vec_id", "row"])

    return sought


def _ranked(index: DataFrame, block: Block) -> DataFrame:
    """FOUND with rank: the best of all tasks for each anchor and slot."""
    sent = index.sparkSession.sparkContext.broadcast(block)
    found = index.mapInArrow(_sought(sent), FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    out = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= block.keep), "best")
    sent.unpersist()
    return out


def _bands(anchors: list[Row], positives: list[Row]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of negatives by anchor and rank of positive; none fits where there is no positive."""
    low, high = np.full((len(anchors), N_POSITIVES), LONG.max), np.full((len(anchors), N_POSITIVES), LONG.min)
    at = {a.row: i for i, a in enumerate(anchors)}
    for p in positives:
        low[at[p.anchor], p.rank - 1], high[at[p.anchor], p.rank - 1] = -(-LOW * p.score // 100), HIGH * p.score // 100
    return low, high


def mined(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the rows whose vec_id is divisible by 100."""
    spark = vectors.sparkSession
    rows = written(scaled(vectors), "scaled")
    is_anchor = F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False))
    out = None
    for d in rows.groupBy("dim").agg(F.max("norm").alias("most"), F.count_if(is_anchor).alias("n")).where("n > 0").orderBy("dim").collect():
        of_dim = rows.where(F.col("dim") == d.dim)
        pivots = _pivots(of_dim, d.most)
        index = written(indexed(of_dim, pivots, d.most), "pivots")
        blocks = -(-d.n // BLOCK)
        for k in range(blocks):
            anchors = index.where(is_anchor & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == k)).orderBy("row").collect()
            if not anchors:
                continue
            q = np.array([a.q for a in anchors], dtype=np.float64).reshape(len(anchors), -1)
            # an anchor's own extra component is 0, so its distances aren't those of its row
            near = _distances(q, np.zeros(len(q)), pivots)
            block = Block(np.array([a.row for a in anchors]), np.array([a.label for a in anchors]), q, near, d.most, N_POSITIVES)
            positives = _ranked(index, block)
            low, high = _bands(anchors, positives.collect())
            negatives = _ranked(index, Block(block.row, block.label, q, near, d.most, N_NEGATIVES, low, high))
            ids = spark.createDataFrame([(a.row, a.vec_id) for a in anchors], "anchor long, anchor_id long")
            pairs = positives.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(ids, "anchor")
            found = pairs.join(negatives.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "slot"])
            found = written(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
