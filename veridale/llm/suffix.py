"""Removal of repeated byte strings by suffix arrays of bounded blocks.

A 100-byte window that occurs twice has the same smallest 24-byte gram at the same place both times.
So documents are cut into segments of consecutive windows with one smallest gram, and only segments
with equal grams can share a window. Segments are first compared whole, by gram and digest:

* the gram occurs once: nothing repeats;
* all segments of the gram are equal: all but the first are removed;
* they differ: the first of each kind goes on, the others are removed.

What goes on, a few segments around the ends of repeated passages, is put together with all segments
of its gram in blocks of bounded size. In a block, a suffix array is sorted, and intervals of its
Burrows-Wheeler transform are extended backwards, breadth first: a step from patterns of length l to
l + 1 finds the borders with a common prefix of l, in increasing order, and it stops at 100. The rows
between two borders then share 100 bytes, and all but the earliest are removed.

A gram with more differing segments than four blocks hold is split: its segments are cut into windows, and
those whose 64-bit digest no other window has are dropped, since nothing repeats them. The others are
dealt out by digest to blocks that are settled by the same extension, on their bytes: first in SALTS parts or more of each digest,
then the earliest of each part. A block of one window only keeps its earliest copy, so however many segments
a gram or a window has, no task holds more than a few blocks.

Segments are taken as equal if the 128-bit BLAKE2b digests of their bytes are: no input is known, or can be made, that
has two with one digest. The other hashes only decide which rows meet, and don't change a result if they collide. A row
of the main shuffle is a segment (one per 39 bytes), not a suffix. Segments that a piece of about 1 MB repeats are found
in the piece, runs of them are one row, and they need no partner. Rows meet by their gram; those of a gram
that has differing segments in many pieces, as the ends of a common passage have, meet by their digest instead, and all
go on. So neither the copies of one segment nor the segments of one gram are sorted in one task.

Defined results: null and empty texts have 0 bytes; rows with the same doc_id and text are one document
and get the same result; rows with one doc_id and different texts are ordered by a hash of the text;
null doc_ids come first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .words import whole

LENGTH = 100
GRAM = 24
#: Bytes that are hashed at once, and bytes of a block.
PIECE = 1 << 20
BLOCK = 1 << 20
SEGMENTS = "h long, s long, s2 long, doc long, d2 long, at long, later boolean"
#: Places of bits in `at`: a run's start, above the number of its windows.
SHIFT = 24
MASK = (1 << SHIFT) - 1
#: Least parts that the copies of one window are dealt to, and copies of the commonest one that a part has.
SALTS, COPIES = 32, 1 << 16
#: A gram is common from so many segments on, and from so large a part of those that are counted: so at most SHARE grams are.
COMMON, SHARE = 1 << 12, 1 << 16
WINDOWS = "k long, g long, doc long, d2 long, at long, bytes binary"

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class _Hasher:
    """Digests of substrings of one buffer, equal for equal bytes wherever they stand."""

    bytes_as = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    up = down = np.empty(0, dtype=np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        if len(self.up) <= len(data):
            _Hasher.up, _Hasher.down = _powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.bytes_as[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, n: int) -> np.ndarray:
        return _mixed((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def segments_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, _Hasher]:
    """Of the documents that end at `ends` in data: gram hash, start and number of windows of each segment; and a hasher of data."""
    hasher = _Hasher(data)
    grams = hasher.grams(GRAM)
    keyed = (grams & np.uint64(_MASK ^ 0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    place = (_sliding_min(keyed, LENGTH - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    # windows that lie in one document
    inside = np.zeros(len(place) + 1, dtype=np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[:-1])
    anchor = place[at]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))))
    first, n = at[new], np.diff(np.append(new, len(at)))
    return grams[anchor[new]], first, n, hasher


def _digests_of(data: bytes, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The digests of segments, two longs each."""
    each = (hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (first + n + LENGTH - 1).tolist()))
    return np.frombuffer(b"".join(each), dtype=np.int64).reshape(-1, 2)


def _pieces(batch: pd.DataFrame) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Lists of (doc, d2, offset, bytes) of at most about PIECE bytes; longer documents in overlapping pieces."""
    out, size = [], 0
    for doc, d2, data in zip(batch["doc"], batch["d2"], batch["data"]):
        for at in range(0, max(1, len(data) - LENGTH + 1), PIECE):
            part = data[at : at + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            out.append((doc, d2, at, part))
            size += len(part)
            if size >= PIECE:
                yield out
                out, size = [], 0
    if out:
        yield out


def _common(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """h, n of the grams of two or more differing segments in a piece."""
    for batch in batches:
        for pieces in _pieces(batch):
            h, first, n, hasher = segments_of(np.frombuffer(b"".join(p[3] for p in pieces), dtype=np.uint8), np.cumsum([len(p[3]) for p in pieces]))
            order = np.argsort(h)
            near = np.concatenate(([False], h[order][1:] == h[order][:-1]))
            own = order[near | np.append(near[1:], False)]
            kinds = pd.DataFrame({"h": h[own], "s": hasher.of(first[own], first[own] + n[own] + LENGTH - 1)}).drop_duplicates()
            grams, counts = np.unique(kinds["h"].to_numpy(), return_counts=True)
            yield pd.DataFrame({"h": grams[counts > 1].view(np.int64), "n": counts[counts > 1]})


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for pieces in _pieces(batch):
            joined = b"".join(p[3] for p in pieces)
            ends = np.cumsum([len(p[3]) for p in pieces])
            h, first, n, _ = segments_of(np.frombuffer(joined, dtype=np.uint8), ends)
            s, s2 = _digests_of(joined, first, n).T
            of = np.searchsorted(ends, first, side="right")
            doc, d2, offset = (np.array([p[k] for p in pieces], dtype=np.int64)[of] for k in range(3))
            start = first - np.concatenate(([0], ends[:-1]))[of] + offset
            # what the piece has earlier, in the order of documents, is removed whatever else there is; rows of one document aren't earlier than each other
            order = np.lexsort((start, d2, doc, s2, s))
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (s[order][1:] != s[order][:-1]) | (s2[order][1:] != s2[order][:-1])
            begun = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
            later = np.zeros(len(order), dtype=bool)
            later[order] = (doc[order] != doc[begun]) | (d2[order] != d2[begun]) | (start[order] != start[begun])
            rows = pd.DataFrame({"h": h.view(np.int64), "s": s, "s2": s2, "doc": doc, "d2": d2, "at": start << SHIFT | n, "later": later})
            yield rows[~later]
            # runs of them are one row each, and go anywhere
            k = np.flatnonzero(later)
            if len(k):
                new = np.concatenate(([True], (np.diff(k) != 1) | (np.diff(of[k]) != 0) | (start[k][1:] != start[k][:-1] + n[k][:-1])))
                run = k[new]
                windows = np.add.reduceat(n[k], np.flatnonzero(new))
                yield pd.DataFrame({"h": doc[run] ^ start[run], "s": 0, "s2": 0, "doc": doc[run], "d2": d2[run], "at": start[run] << SHIFT | windows, "later": True})


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of key, and the rank of each of its values."""
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], sorted_[1:] != sorted_[:-1])))
    return order, rank


def shared_prefixes(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of text (small non-negative integers, 0 ends each string) to a depth of `length` or more, and
    whether each of its places begins a group: False where the suffix shares `length` symbols with the one before."""
    n = len(text)
    padded = np.concatenate((text.astype(np.int64), np.zeros(7, dtype=np.int64)))
    key = np.zeros(n, dtype=np.int64)
    for k in range(7):
        key = key << 9 | padded[k : k + n]
    order, rank = _ranked(key)
    depth = 7
    while depth < length:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(0, n - depth)] = rank[depth:] + 1
        order, rank = _ranked(rank << 32 | ahead)
        depth *= 2
    seven = _ranked(key)[1][order]
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, dtype=np.int64)
    step[by_symbol] = np.arange(n)
    # borders by increasing common prefix, from all patterns of 7 symbols on
    border = np.zeros(n + 1, dtype=bool)
    border[:n] = np.concatenate(([True], seven[1:] != seven[:-1]))
    border[n] = True
    lo = np.flatnonzero(border)[:-1]
    hi = np.append(lo[1:], n)
    for _ in range(7, length):
        if not len(lo):
            break
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        to = step[rows]
        o = np.argsort(to, kind="stable")
        to, which, symbol = to[o], which[o], bwt[rows[o]]
        new = np.concatenate(([True], (which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1])))
        lo = to[new]
        hi = lo + np.diff(np.append(np.flatnonzero(new), len(to)))
        fresh = ~border[hi]
        lo, hi = lo[fresh], hi[fresh]
        border[hi] = True
    return order, border[:n]


def _repeated(group: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Which entries aren't the first of their group in the order of `earlier`."""
    order = np.lexsort((earlier, group))
    out = np.zeros(len(group), dtype=bool)
    out[order[1:]] = group[order][1:] == group[order][:-1]
    return out


def _groups(strings: list[bytes]) -> np.ndarray:
    """For each place of the strings, each with one place after its end: the number of its group of suffixes that share LENGTH bytes."""
    text = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8).astype(np.int64) + 1
    text[np.cumsum([len(x) + 1 for x in strings]) - 1] = 0
    order, border = shared_prefixes(text)
    of = np.empty(len(text), dtype=np.int64)
    of[order] = np.cumsum(border)
    return of


def _removed_windows(block: pd.DataFrame) -> pd.DataFrame:
    """Runs of windows in the block's segments that an earlier segment has as well."""
    block = block.drop_duplicates(["h", "doc", "d2", "at"]).sort_values(["doc", "d2", "at"], ignore_index=True)
    data, n = block["bytes"].tolist(), (block["at"].to_numpy() & MASK)
    sizes = np.array([len(b) for b in data]) + 1
    base = np.cumsum(sizes) - sizes
    # windows begin at the first n places of each segment; segments are in the order of documents
    starts = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(n.sum())
    group = _groups(data)[starts]
    again = _repeated(group, np.arange(len(starts)))
    segment = np.repeat(np.arange(len(n)), n)
    place = starts - base[segment] + (block["at"].to_numpy() >> SHIFT)[segment]
    hit = np.flatnonzero(again)
    if not len(hit):
        return pd.DataFrame({"doc": [], "d2": [], "at": []}).astype("int64")
    new = np.flatnonzero(np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(segment[hit]) != 0))))
    run = np.diff(np.append(new, len(hit)))
    own = segment[hit[new]]
    return pd.DataFrame({"doc": block["doc"].to_numpy()[own], "d2": block["d2"].to_numpy()[own], "at": place[hit[new]] << SHIFT | run})


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by h; all of an h are in one block."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += int(batch["bytes"].str.len().sum())
        if size < BLOCK:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = rows["h"].to_numpy() == rows["h"].iloc[-1]
        if not last.all():
            yield from _split(rows[~last])
        held, size = [rows[last]], int(rows["bytes"][last].str.len().sum())
    if held:
        yield from _split(pd.concat(held, ignore_index=True))


def _split(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Blocks of about BLOCK bytes."""
    per = rows["bytes"].str.len().groupby(rows["h"].to_numpy(), sort=False).sum()
    number = (per.cumsum() // BLOCK).to_dict()
    for _, own in rows.groupby(rows["h"].map(number).to_numpy(), sort=False):
        yield _removed_windows(own)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each window of the segments."""
    for rows, starts, hasher, _ in _windows(batches):
        yield pd.DataFrame({"g": hasher.of(starts, starts + LENGTH).view(np.int64)})


def _cut_windows(batches: Iterator[pd.DataFrame], salts: int) -> Iterator[pd.DataFrame]:
    """A row of WINDOWS for each window of the segments; k: the digest's part, one of `salts`."""
    for rows, starts, hasher, data in _windows(batches):
        g = hasher.of(starts, starts + LENGTH)
        n = rows["at"].to_numpy() & MASK
        own = {c: np.repeat(rows[c].to_numpy(), n) for c in ("doc", "d2")}
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        part = _mixed(g ^ _mixed(own["doc"].view(np.uint64)) % np.uint64(SALTS))
        at = (np.repeat(rows["at"].to_numpy() >> SHIFT, n) + inner) << SHIFT | 1
        yield pd.DataFrame({"k": part.view(np.int64), "g": g.view(np.int64), **own, "at": at, "bytes": [data[a : a + LENGTH] for a in starts.tolist()]})


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, _Hasher, bytes]]:
    """Some segments at a time: rows, places of their windows in the joined bytes, a hasher of these, and these."""
    for batch in batches:
        for lo in range(0, len(batch), 4096):
            rows = batch.iloc[lo : lo + 4096]
            parts, n = rows["bytes"].tolist(), rows["at"].to_numpy() & MASK
            sizes = np.array([len(x) for x in parts])
            starts = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n) + np.arange(n.sum())
            data = b"".join(parts)
            yield rows, starts, _Hasher(np.frombuffer(data, dtype=np.uint8)), data


def _marked(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of WINDOWS with gone: whether an earlier row has the same bytes."""
    rows = rows.drop_duplicates(["k", "doc", "d2", "at"]).sort_values(["doc", "d2", "at"], ignore_index=True)
    starts = np.arange(len(rows)) * (LENGTH + 1)
    return rows.assign(gone=_repeated(_groups(rows["bytes"].tolist())[starts], np.arange(len(rows))))


def _first_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """_marked() of rows that come sorted by k, document and place, in blocks. What is held of one k is cut down to the earliest copies whenever it fills a block."""
    held = None
    for batch in batches:
        for lo in range(0, len(batch), BLOCK // LENGTH):
            part = batch.iloc[lo : lo + BLOCK // LENGTH]
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            if len(held) * LENGTH < BLOCK:
                continue
            last = held["k"].to_numpy() == held["k"].iloc[-1]
            if not last.all():
                yield _marked(held[~last])
                held = held[last]
            if len(held) * LENGTH >= BLOCK:
                marked = _marked(held)
                yield marked[marked["gone"]]
                held = marked[~marked["gone"]].drop(columns="gone")
    if held is not None:
        yield _marked(held)


def _of_large_grams(cut: DataFrame) -> DataFrame:
    """doc, d2, at of the windows in the segments (doc, d2, at, bytes) that an earlier segment has as well."""
    again = written(cut.select("at", "bytes").mapInPandas(_digests, "g long").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    salts = max(SALTS, (again.agg(F.max("n")).first()[0] or 0) // COPIES)
    windows = cut.select("doc", "d2", "at", "bytes").mapInPandas(lambda batches: _cut_windows(batches, salts), WINDOWS)
    rows = windows.join(again, "g", "left_semi").select(*[c.split()[0] for c in WINDOWS.split(", ")])
    gone = None
    for _ in range(2):  # the parts of each digest, then the earliest of each part
        dealt = rows.repartition("k").sortWithinPartitions("k", "doc", "d2", "at")
        marked = written(dealt.mapInPandas(_first_windows, WINDOWS + ", gone boolean"), "windows")
        out = marked.where("gone").select("doc", "d2", "at")
        gone = out if gone is None else gone.unionByName(out)
        rows = marked.where("not gone").select(F.col("g").alias("k"), "g", "doc", "d2", "at", "bytes")
    return gone


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, data, at in zip(batch["doc_id"], batch["data"], batch["at"]):
            n, removed, spans, kept = len(data), 0, 0, data
            if at is not None and len(at):
                at = np.sort(np.asarray(at, dtype=np.int64))
                start, end = at >> SHIFT, (at >> SHIFT) + (at & MASK) + LENGTH - 1
                reach = np.maximum.accumulate(end)
                new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
                lo, hi = start[new], reach[np.append(new[1:], len(start)) - 1]
                removed, spans = int((hi - lo).sum()), len(new)
                kept = b"".join(data[a:b] for a, b in zip([0, *hi], [*lo, n]))
            out.append((doc_id, n, removed, spans, hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc, d2, doc_id, data), and the windows to remove: doc, d2, at (start << SHIFT | number of windows)."""
    t = whole("text").cast("binary")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(t).alias("d2"), F.col("doc_id").cast("long").alias("doc_id"), t.alias("data"))
    texts = base.select("doc", "d2", "data")
    counts = written(texts.mapInPandas(_common, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "grams")
    least = max(COMMON, -(-(counts.agg(F.sum("n")).first()[0] or 0) // SHARE))
    common = counts.where(F.col("n") >= least).select("h", F.lit(True).alias("common"))  # at most SHARE rows
    found = texts.mapInPandas(_segments, SEGMENTS).join(F.broadcast(common), "h", "left")
    # common grams have differing segments, so theirs need not meet to see that
    found = found.withColumn("by", F.when(F.col("common"), F.col("s")).otherwise(0)).repartition("h", "by")
    alike, gram = Window.partitionBy("h", "by", "s", "s2"), Window.partitionBy("h", "by")
    own = ~F.col("later")
    kind = F.struct("s", "s2")
    judged = (
        found.withColumn("first", F.min(F.when(own, F.struct("doc", "d2", "at"))).over(alike))
        .withColumn("low", F.min(F.when(own, kind)).over(gram)).withColumn("high", F.max(F.when(own, kind)).over(gram))
        .select("h", "doc", "d2", "at", (F.col("later") | (F.struct("doc", "d2", "at") != F.col("first"))).alias("gone"), (F.col("common").isNotNull() | (F.col("low") != F.col("high"))).alias("differ"))
        .where("gone or differ")
    )
    judged = written(judged, "segments")
    wanted = judged.where("differ and not gone").groupBy("doc", "d2").agg(F.collect_set(F.struct("h", "at")).alias("wanted"))
    # by lengths, before the bytes are cut
    large = written(judged.where("differ and not gone").groupBy("h").agg(F.sum(F.col("at").bitwiseAND(F.lit(MASK)) + LENGTH - 1).alias("n")).where(F.col("n") > 4 * BLOCK).select("h"), "large")
    cut = base.select("doc", "d2", "data").join(wanted, ["doc", "d2"]).select("doc", "d2", F.explode("wanted").alias("w"), "data").select(
        "w.h", "doc", "d2", "w.at", F.expr(f"substring(data, int(shiftright(w.at, {SHIFT})) + 1, int(w.at & {MASK}) + {LENGTH - 1})").alias("bytes"))
    partly = cut.join(large, "h", "left_anti").repartition("h").sortWithinPartitions("h").mapInPandas(_blocks, "doc long, d2 long, at long")
    if not large.isEmpty():
        partly = partly.unionByName(_of_large_grams(written(cut.join(large, "h", "left_semi"), "large")))
    return base, judged.where("gone").select("doc", "d2", "at").unionByName(partly)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    base, gone = removed(docs)
    per = gone.groupBy("doc", "d2").agg(F.collect_list("at").alias("at"))
    return base.join(per, ["doc", "d2"], "left").select("doc_id", "data", "at").mapInPandas(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
