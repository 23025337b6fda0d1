"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names (capitalised inside a sentence) and units are replaced
by a typed placeholder, other words are lower-cased without the punctuation at their ends. Every window
of WINDOW tokens of the benchmark's templates is hash-joined to the windows of all documents. Matches of
an item and a document are put together along the item: a document is contaminated by an item if it has
at least SIMILARITY of the item's distinct windows and the slots are consistent: of the different
substitutions (value in the item, value in the document), at least SIMILARITY are the only one of their
item's value, as in a re-parameterised question. Slots are judged for each alignment (place in the
document minus place in the item) that a window has: every window of the item is taken at its place in the
document that is nearest to the alignment, and the best alignment counts. So a passage elsewhere that shares
some windows doesn't spoil a copy.

Document windows are made in tasks and first tested against a bit table of fixed size (FILTER_BITS)
that holds the benchmark's window hashes, so nearly all that reach the shuffle are matches. The table
is a broadcast of 2 MB whatever the benchmark's size; a fuller one lets more windows through to the
join, which decides alone. A document names each window once, with all its places. Documents and items meet on the windows
that few items have: a match has at least one of an item's rarest ones. Only such pairs are counted over all windows.

Defined results: null and empty texts have no windows; items with fewer tokens than WINDOW have one
window, the whole of it, and documents have the windows of these sizes too; where such an item is all
placeholders, only its own values match it; rows are documents (items) by doc_id (item_id) and a digest
of the text, so null or repeated ids with different texts are judged apart; an empty benchmark or table gives no rows
in `matches`; extra columns are ignored by `matches` and kept by `clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

WINDOW = 5
SIMILARITY = 0.8
FILTER_BITS = 1 << 24
#: Units that follow or stand among numbers; fixed values.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hours hour minutes minute seconds second days day weeks week months month years year usd eur gbp dollars dollar euros euro cents cent percent % ° °c °f k hz khz mhz ghz w kw v a kb mb gb tb mph kmh km/h m/s".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%)?$")
EDGES = "\"'`.,;:!?()[]{}<>«»„“”‘’…*_|#&$%"
HIT = "doc_id long, doc_text long, window long, places array<int>, said array<array<string>>"
#: Alignments that are judged at once.
PIECE = 1 << 12


def template(text: str) -> tuple[list[str], list[str]]:
    """Template tokens and, for placeholders, the values that they stand for (else empty)."""
    tokens, values, starts = [], [], True
    for raw in text.split():
        word = raw.strip(EDGES)
        ends = raw[-1] in ".!?:|"
        if not word:
            starts = starts or ends
            continue
        low = word.lower()
        if NUMBER.match(word):
            kind = "<number>"
        elif low in UNITS and tokens and tokens[-1] == "<number>":
            kind = "<unit>"
        elif not starts and word[0].isupper() and not word.isupper():
            kind = "<name>"
        else:
            kind = low
        tokens.append(kind)
        values.append(low if kind != low else "")
        starts = ends
    return tokens, values


def _hashes(tokens: list[str], size: int) -> np.ndarray:
    """A 63-bit hash of each window of `size` tokens."""
    from xxhash import xxh3_64_intdigest

    known: dict[str, int] = {}
    each = np.fromiter((known[t] if t in known else known.setdefault(t, xxh3_64_intdigest(t)) for t in tokens), dtype=np.uint64, count=len(tokens))
    n = len(tokens) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out & np.uint64((1 << 63) - 1)).astype(np.int64)


def _places(hashes: np.ndarray, values: list[str], size: int, at: np.ndarray) -> Iterator[tuple[int, list[int], list[list[str]]]]:
    """Hash, places in increasing order and their slots of each distinct window among those that start at `at`."""
    distinct, group = np.unique(hashes[at], return_inverse=True)
    order = np.argsort(group, kind="stable")
    for h, own in zip(distinct, np.split(at[order], np.cumsum(np.bincount(group))[:-1])):
        yield int(h), own.tolist(), [[v for v in values[i : i + size] if v] for i in own]


def _of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for item, digest, text in zip(batch["item_id"], batch["item_text"], batch["text"]):
            tokens, values = template(text or "")
            size = min(WINDOW, len(tokens))
            if not size:
                continue
            hashes = _hashes(tokens, size)
            found = list(_places(hashes, values, size, np.arange(len(hashes))))
            rows += [(item, digest, h, places, slots, len(found), size) for h, places, slots in found]
        yield pd.DataFrame(rows, columns=["item_id", "item_text", "window", "item_places", "slots", "n_windows", "size"])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, item_text (its digest), window, item_places, slots (of each place), n_windows (of the item), size (of the window) for each distinct window of each item."""
    return benchmark.select(F.col("item_id").cast("long"), F.xxhash64("text").alias("item_text"), "text").mapInPandas(_of_items, "item_id long, item_text long, window long, item_places array<int>, slots array<array<string>>, n_windows int, size int")


def consistency(windows: list[tuple[list[int], list[list[str]], list[int], list[list[str]]]], size: int) -> float:
    """The best share of consistent substitutions at any alignment, from (places, slots) in the item and in the document of each window."""
    number: dict[str, int] = {}
    joined = []
    for item_places, slots, places, said in windows:
        # windows of equal hash have as many slots, unless different windows collide
        fits = [k for k, v in enumerate(said) if len(v) == len(slots[0])]
        if fits:
            numbers = np.array([[number.setdefault(v, len(number)) for v in said[k]] for k in fits], dtype=np.int64).reshape(len(fits), -1)
            joined.append((item_places, slots, np.asarray(places, dtype=np.int64)[fits], numbers))
    if size < WINDOW and all(len(v) == size for _, slots, _, _ in joined for v in slots):
        return float(any(list(v) in map(list, slots) for _, slots, _, said in windows for v in said))
    if not any(len(v) for _, slots, _, _ in joined for v in slots):
        return 1.0
    alignments = np.unique(np.concatenate([places - i for item_places, _, places, _ in joined for i in item_places]))
    best = 0.0
    for lo in range(0, len(alignments), PIECE):
        at = alignments[lo : lo + PIECE]
        by_value: dict[str, list[np.ndarray]] = {}
        for item_places, slots, places, numbers in joined:
            for i, own in zip(item_places, slots):
                after = np.minimum(np.searchsorted(places, at + i), len(places) - 1)
                before = np.maximum(after - 1, 0)
                near = np.where(np.abs(places[before] - at - i) <= np.abs(places[after] - at - i), before, after)
                for k, value in enumerate(own):
                    by_value.setdefault(value, []).append(numbers[near, k])
        n, alone = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for columns in by_value.values():
            sorted_ = np.sort(np.stack(columns, axis=1), axis=1)
            different = 1 + (np.diff(sorted_, axis=1) != 0).sum(axis=1)
            n += different
            alone += different == 1
        best = max(best, float((alone / n).max()))
        if best == 1.0:
            break
    return best


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        shares = [consistency([(w["item_places"], w["slots"], w["places"], w["said"]) for w in found], size) for found, size in zip(batch["found"], batch["size"])]
        yield batch.drop(columns=["found", "size"]).assign(consistent=np.array(shares, dtype=np.float64))


def _filter(windows: DataFrame) -> np.ndarray:
    """The bit table, put together from its set words: at most FILTER_BITS / 64 rows reach the driver."""
    bit = F.pmod(F.col("window"), F.lit(FILTER_BITS))
    words = windows.select((bit / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, int(pmod(window, {FILTER_BITS}) % 64))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    got = words.toPandas()
    table[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return table


def document_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """HIT rows of the windows of docs that pass the bit table, in the sizes that items have: WINDOW sizes at most."""
    table = docs.sparkSession.sparkContext.broadcast(_filter(windows))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())

    def of_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = table.value
        for batch in batches:
            rows = []
            for doc, digest, text in zip(batch["doc_id"], batch["doc_text"], batch["text"]):
                tokens, values = template(text or "")
                for size in sizes:
                    if size > len(tokens):
                        break
                    hashes = _hashes(tokens, size)
                    bit = hashes % FILTER_BITS
                    at = np.flatnonzero(bits[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))
                    if len(at):
                        rows += [(doc, digest, *found) for found in _places(hashes, values, size, at)]
            yield pd.DataFrame(rows, columns=["doc_id", "doc_text", "window", "places", "said"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("doc_text"), "text").mapInPandas(of_documents, HIT)


def ranked(windows: DataFrame) -> DataFrame:
    """windows of items with rank: the place of each among its item's, those that the fewest items have first."""
    shared = windows.groupBy("window").agg(F.count(F.lit(1)).alias("items"))
    rank = F.row_number().over(Window.partitionBy("item_id", "item_text").orderBy("items", "window"))
    distinct = windows.dropDuplicates(["item_id", "item_text", "window"])
    return distinct.join(shared, "window").withColumn("rank", rank).drop("items")


def candidates(found: DataFrame, windows: DataFrame, similarity: float) -> DataFrame:
    """doc_id, doc_text, item_id, item_text of the pairs that may match: they share one of the item's rarest windows, as many as a match can lack, and one.

    So a window that many items share joins a document with those only that have nothing rarer.
    """
    rare = windows.where(F.col("rank") <= F.col("n_windows") - F.ceil(similarity * F.col("n_windows") - 1e-9) + 1)
    return found.select("doc_id", "doc_text", "window").join(rare.select("item_id", "item_text", "window"), "window").drop("window").distinct()


def _matches(docs: DataFrame, benchmark: DataFrame, similarity: float) -> DataFrame:
    """matches with doc_text and item_text, the digests that tell rows of one id apart."""
    windows = written(ranked(item_windows(benchmark)), "windows")
    found = written(document_windows(docs, windows), "hits")
    pairs = written(candidates(found, windows, similarity), "candidates")
    item = F.col("p.item_id").eqNullSafe(F.col("w.item_id")) & (F.col("p.item_text") == F.col("w.item_text"))
    wanted = pairs.alias("p").join(windows.alias("w"), item).select("p.*", *[f"w.{c}" for c in ("window", "item_places", "slots", "n_windows", "size")])
    own = (F.col("a.doc_text") == F.col("d.doc_text")) & (F.col("a.window") == F.col("d.window")) & F.col("a.doc_id").eqNullSafe(F.col("d.doc_id"))
    # repeated rows of a document name the same windows
    each = found.select("doc_id", "doc_text", "window", "places", "said").dropDuplicates(["doc_id", "doc_text", "window"])
    met = wanted.alias("a").join(each.alias("d"), own).select("a.*", "d.places", "d.said")
    counted = met.groupBy("doc_id", "doc_text", "item_id", "item_text").agg(
        F.max("n_windows").alias("n_windows"), F.count(F.lit(1)).alias("n_matched"), F.max("size").alias("size"), F.collect_list(F.struct("item_places", "slots", "places", "said")).alias("found"))
    enough = counted.where(F.col("n_matched") >= similarity * F.col("n_windows"))
    judged = enough.mapInPandas(_judged, "doc_id long, doc_text long, item_id long, item_text long, n_windows int, n_matched long, consistent double")
    return judged.where(F.col("consistent") >= similarity)


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, consistent for every contaminated document and what it holds."""
    return _matches(docs, benchmark, similarity).drop("doc_text", "item_text")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    # written, so that its size is known and Spark can broadcast it where it is small
    held = written(_matches(docs, benchmark, similarity).select("doc_id", "doc_text").distinct(), "held")
    return docs.join(held, docs["doc_id"].eqNullSafe(held["doc_id"]) & (F.xxhash64(docs["text"]) == held["doc_text"]), "left_anti")
