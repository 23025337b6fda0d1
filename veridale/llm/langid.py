"""Language identification by character models with interpolated Kneser-Ney smoothing.

Text becomes symbols: letters lower-cased (letters beyond the basic plane as one symbol), every run of
other characters as one boundary. A gram of up to ORDER symbols is one 64-bit code, 16 bits a symbol,
so codes never collide. Tasks count the grams of whole training texts by language and add them up
before anything is shuffled; lower orders, contexts, discounts and probabilities are joins and sums over
the distinct grams, so the statistics cover every training row.

In log space an interpolated model is a sum: each position adds what its gram of each order gains over
the order below (`gain`) and the weight that its context leaves to lower orders (`rest`), where known.
A language's numbers are sorted arrays of codes with their values, searched by bisection. Tasks get them
as a broadcast of at most SEGMENT entries; a larger model is dealt to several by hash, with a pass over the
texts for each that carries the sums on: same result, bounded memory. Only distinct grams of a piece
of text are looked up. The language with the least cross-entropy per symbol is predicted.

Calibration: training rows are put in classes by their evidence (nats by which the best language leads);
`score` is the share of right predictions in a text's class. `rejected` marks texts with a score under half,
and those whose cross-entropy is above what all but one in a thousand training texts of that language have.

Defined results: null texts and texts without a letter are `und` with score 0, and so is every text if there is nothing to
learn from; rows with a null doc_id count as the empty id; repeated rows get a row each; ties go to the first language by
code point; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written

ORDER = 4
BITS = 16
BOUNDARY, OTHER = 0x20, 0xFFFF
#: Symbols that are handled at once; longer texts are cut into pieces that share their last symbols.
PIECE = 1 << 21
#: Distinct grams that a task keeps before it hands their counts on.
POOL = 1 << 20
#: Entries of the model that are broadcast at once (16 bytes each, and 40 while they are collected).
SEGMENT = 1 << 21
#: Share of training texts that may have a higher cross-entropy than the limit of their language.
ODD = 0.001
UNKNOWN = "und"


@cache
def _symbols() -> np.ndarray:
    """The symbol of each code point."""
    out = np.full(0x110000, BOUNDARY, np.uint16)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            out[c] = low if low < OTHER else OTHER
    return out


def grams(text: str) -> Iterator[np.ndarray]:
    """Codes of the grams of ORDER symbols that end at each symbol, piece by piece. The first have boundaries before them."""
    carry = np.full(ORDER - 1, BOUNDARY, np.uint64)
    for at in range(0, len(text), PIECE):
        s = _symbols()[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        kept = s != BOUNDARY
        kept[1:] |= kept[:-1].copy()
        kept[0] |= carry[-1] != BOUNDARY
        x = np.concatenate((carry, s[kept].astype(np.uint64)))
        n, code = len(x) - ORDER + 1, np.uint64(0)
        for k in range(ORDER):
            code = code << np.uint64(BITS) | x[k : k + n]
        yield code
        carry = x[len(x) - ORDER + 1 :]


def _added(codes: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    at, distinct = pd.factorize(np.concatenate(codes))
    return distinct, np.bincount(at, None if counts is None else np.concatenate(counts), len(distinct))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pool: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    fresh: dict[str, list[np.ndarray]] = {}
    waiting = 0

    def settled() -> int:
        for lang, codes in fresh.items():
            pool.setdefault(lang, []).append(_added(codes))
        fresh.clear()
        for lang, parts in pool.items():
            if len(parts) > 1:
                pool[lang] = [_added(*map(list, zip(*parts)))]
        return sum(len(p[0][0]) for p in pool.values())

    def handed() -> Iterator[pa.RecordBatch]:
        for lang, [(codes, counts)] in pool.items():
            for at in range(0, len(codes), 1 << 16):
                part = codes[at : at + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.repeat(lang, len(part)), "code": part, "n": counts[at : at + (1 << 16)].astype(np.int64)})
        pool.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            for codes in grams(text):
                fresh.setdefault(lang, []).append(codes)
                waiting += len(codes)
                if waiting >= PIECE:
                    waiting = 0
                    if settled() > POOL:
                        yield from handed()
    settled()
    yield from handed()


def _suffix(k: int) -> Column:
    return F.col("code").bitwiseAND(F.lit((1 << BITS * k) - 1))


@dataclass
class Model:
    langs: list[str]
    #: What every position adds, by language.
    base: list[float]
    #: lang (its place in langs), kind (0 gain, 1 rest), k, code, value.
    entries: DataFrame


def learned(docs: DataFrame) -> Model:
    """The models of the languages in docs (lang, text), of rows that have both."""
    spark = docs.sparkSession
    rows = docs.select("lang", "text").where("lang is not null and text is not null")
    counts = written(rows.mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "grams")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return Model([], [], spark.createDataFrame([], "lang int, kind int, k int, code long, value double"))
    place = F.array_position(F.lit(langs), F.col("lang")) - 1
    of = {ORDER: counts.select(place.cast("int").alias("lang"), "code", "n")}
    for k in range(ORDER - 1, 0, -1):  # below the highest order, in how many contexts a gram continues
        of[k] = written(of[k + 1].groupBy("lang", _suffix(k).alias("code")).agg(F.count(F.lit(1)).alias("n")), f"grams{k}")
    symbols = of[1].select("code").distinct().count() + 1
    below, entries, base = None, None, {}
    for k in range(1, ORDER + 1):
        once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = of[k].groupBy("lang").agg(F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.try_divide(once, once + 2 * twice), F.lit(0.95))).alias("d"))
        contexts = of[k].groupBy("lang", F.shiftrightunsigned("code", BITS).alias("context")).agg(F.sum("n").alias("of"), F.count(F.lit(1)).alias("kinds")).join(discount, "lang")
        contexts = written(contexts.withColumn("rest", F.log(F.col("d") * F.col("kinds") / F.col("of"))), f"contexts{k}")
        at = of[k].withColumn("context", F.shiftrightunsigned("code", BITS)).join(contexts, ["lang", "context"])
        if below is None:
            at = at.withColumn("lower", F.lit(-float(np.log(symbols))))
            base = {r.lang: r.rest - float(np.log(symbols)) for r in contexts.collect()}
        else:
            at = at.withColumn("suffix", _suffix(k - 1)).join(below, ["lang", "suffix"])
        p = F.log((F.col("n") - F.col("d")) / F.col("of") + F.exp(F.col("rest") + F.col("lower")))
        at = written(at.select("lang", "code", p.alias("p"), (p - F.col("lower") - F.col("rest")).alias("gain")), f"model{k}")
        below = at.select("lang", F.col("code").alias("suffix"), F.col("p").alias("lower"))
        parts = [at.select("lang", F.lit(0).alias("kind"), F.lit(k).alias("k"), "code", F.col("gain").alias("value"))]
        if k > 1:
            parts.append(contexts.select("lang", F.lit(1).alias("kind"), F.lit(k).alias("k"), F.col("context").alias("code"), F.col("rest").alias("value")))
        for part in parts:
            entries = part if entries is None else entries.unionByName(part)
    return Model(langs, [base[k] for k in range(len(langs))], entries)


Arrays = dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]]


def _arrays(entries: DataFrame) -> Arrays:
    """(lang, kind, k) -> sorted codes, values."""
    t = entries.toArrow()
    lang, kind, k, code, value = (t[c].to_numpy() for c in ("lang", "kind", "k", "code", "value"))
    code = code.view(np.uint64)
    order = np.lexsort((code, k, kind, lang))
    key = ((lang.astype(np.int64) * 2 + kind) * (ORDER + 1) + k)[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    out = {}
    for a, b in zip(starts, [*starts[1:], len(key)]):
        i = order[a:b]
        out[int(lang[i[0]]), int(kind[i[0]]), int(k[i[0]])] = np.ascontiguousarray(code[i]), value[i]
    return out


def _values(model: Arrays, lang: int, code: np.ndarray) -> np.ndarray:
    """What the segment's entries of a language add at positions with these grams."""
    out = np.zeros(len(code))
    for kind in (0, 1):
        for k in range(1 + kind, ORDER + 1):
            found = model.get((lang, kind, k))
            if found is None:
                continue
            part = code if (kind, k) == (0, ORDER) else (code >> np.uint64(BITS * kind)) & np.uint64((1 << BITS * (k - kind)) - 1)
            at = np.searchsorted(found[0], part)
            at[at == len(found[0])] = 0
            out += np.where(found[0][at] == part, found[1][at], 0.0)
    return out


def _scorer(model, n_langs: int, kept: list[str]):
    """Adds n (symbols) and total (sums by language) of a segment to those that rows have, if any. Texts go on if `kept` has them."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"]
            n, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), n_langs))
            waiting: list[tuple[int, np.ndarray]] = []

            def settled() -> None:
                if not waiting:
                    return
                rows, starts = np.array([r for r, _ in waiting]), np.cumsum([0, *(len(c) for _, c in waiting[:-1])])
                at, distinct = pd.factorize(np.concatenate([c for _, c in waiting]))
                for lang in range(n_langs):
                    np.add.at(total[:, lang], rows, np.add.reduceat(_values(model.value, lang, distinct)[at], starts))
                waiting.clear()

            held = 0
            for r in range(len(texts)):
                for codes in grams(texts[r].as_py() or ""):
                    if len(codes):
                        waiting.append((r, codes))
                        n[r] += len(codes)
                        held += len(codes)
                    if held >= PIECE:
                        settled()
                        held = 0
            settled()
            if "total" in batch.schema.names:
                total += batch["total"].flatten().to_numpy().reshape(total.shape)
            sums = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * n_langs, total.ravel())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(n), sums], [*kept, "n", "total"])

    return score


def cross_entropies(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, with n (symbols) and ce (nats a symbol for each of model.langs; null without symbols). Other columns go along."""
    spark, n_langs, others = docs.sparkSession, len(model.langs), [c for c in docs.columns if c != "text"]
    segments = -(-model.entries.count() // SEGMENT)
    if not segments:
        return docs.select(*others, F.lit(0).cast("long").alias("n"), F.lit(None).cast("array<double>").alias("ce"))
    at = docs
    for s in range(segments):
        part = model.entries if segments == 1 else model.entries.where(F.pmod(F.xxhash64("lang", "kind", "k", "code"), F.lit(segments)) == s)
        arrays = spark.sparkContext.broadcast(_arrays(part))
        kept = others if s == segments - 1 else docs.columns
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
        at = written(at.mapInArrow(_scorer(arrays, n_langs, kept), f"{schema}, n long, total array<double>"), "scores")
        arrays.unpersist()
    ce = F.array(*[-(F.col("total")[k] / F.col("n") + F.lit(b)) for k, b in enumerate(model.base)])
    return at.select(*others, "n", F.when(F.col("n") > 0, ce).alias("ce"))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for every row of docs (doc_id, text, lang), learned from its rows that aren't held out."""
    rows = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = learned(rows.where("not held_out"))
    langs = F.lit(model.langs) if model.langs else F.array().cast("array<string>")
    ranked = F.sort_array("ce")
    evidence = F.when(F.size("ce") > 1, (ranked[1] - ranked[0]) * F.col("n"))
    at = cross_entropies(rows, model).select(
        "doc_id", "held_out", F.when(~F.col("held_out"), F.col("lang")).alias("lang"), "ce", F.array_min("ce").alias("least"), F.get(langs, (F.array_position("ce", F.array_min("ce")) - 1).cast("int")).alias("lang_pred"),
        F.greatest(F.lit(-4), F.least(F.lit(16), F.coalesce(F.floor(F.log2(evidence)), F.lit(-4)))).cast("int").alias("class"))
    at = written(at, "predicted")
    known = at.where("lang is not null and lang_pred is not null")
    classes = known.groupBy("class").agg(((F.count_if(F.col("lang") == F.col("lang_pred")) + 1) / (F.count(F.lit(1)) + 2)).alias("score"))
    own = F.get("ce", (F.array_position(langs, F.col("lang")) - 1).cast("int"))
    limits = known.groupBy(F.col("lang").alias("lang_pred")).agg(F.percentile_approx(own, 1 - ODD, 10000).alias("limit"))
    out = at.join(F.broadcast(classes), "class", "left").join(F.broadcast(limits), "lang_pred", "left")  # at most 21 classes, and a row a language
    score = F.when(F.col("lang_pred").isNull(), 0.0).otherwise(F.coalesce("score", F.lit(0.5)))
    return out.select(
        "doc_id", "held_out", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"), F.col("least").alias("cross_entropy"),
        (F.col("lang_pred").isNull() | (score < 0.5) | F.coalesce(F.col("least") > F.col("limit"), F.lit(False))).alias("rejected"))
