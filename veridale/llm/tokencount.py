"""Token counts by way of a digest cache.

The cache is a Parquet table (digest, version, n_tokens): digest is the SHA-256 of the normalised
text, version that of the tokenizer's file. A run joins the digests of its documents to the counts of
its version, encodes the distinct texts that are missing, appends their counts, and joins again.
Texts are normalised only as the tokenizer's own file says that it does: where that folds runs of white
space and drops them at both ends, so does the digest; any other tokenizer gets the bytes as they are.

Digests and sizes are written once, so texts are read for the digests and, where the cache lacks any, for
the misses alone. Equal texts are combined before the shuffle, so a text that a third of all rows repeat
arrives once from each input partition and is encoded once. The tokenizer runs in tasks over batches.

Defined results: null texts count as empty, with 0 tokens; repeated rows get a row each; an empty
table gives no rows and appends nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written
from .words import SPACE_RUN, SPACES, whole

#: Words that a task remembers, and the length up to which it does.
WORDS, LETTERS = 1 << 19, 32
CACHE_SCHEMA = "digest string, version string, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def folds_space(path: str) -> bool:
    """Whether the tokenizer makes every run of white space one blank and then drops blanks, so that counts are the same for texts folded before."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        made = json.load(f)

    def steps(part: dict | None, name: str) -> list[dict]:
        return [] if part is None else part.get(name, [part])

    folds = any(n.get("type") == "Replace" and n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " " for n in steps(made.get("normalizer"), "normalizers"))
    # words are what the pattern finds or leaves; blanks belong to none of them
    drops = any(p.get("type") == "Split" and p.get("behavior") == "Removed" for p in steps(made.get("pre_tokenizer"), "pretokenizers"))
    return folds and drops


def _normalised(folded: bool):
    return F.btrim(F.regexp_replace(whole("text"), SPACE_RUN, " "), F.lit(SPACES)) if folded else whole("text")


def _counter(path: str, folded: bool):
    """A function from texts to their numbers of tokens: tokenizers for .json, sentencepiece for .model.

    folded: blanks part the words that the tokenizer sees and belong to none, so a text has the tokens of its words, and a word is encoded
    once for as long as a task remembers it.
    """
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()

    def whole_texts(texts: list[str]) -> list[int]:
        return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    known: dict[str, int] = {}

    def by_words(texts: list[str]) -> list[int]:
        if len(known) > WORDS:
            known.clear()
        each = [t.split(" ") for t in texts]
        fresh = list({w for words in each for w in words if w not in known})
        now = dict(zip(fresh, whole_texts(fresh)))
        known.update((w, n) for w, n in now.items() if len(w) <= LETTERS)
        return [sum(known[w] if w in known else now[w] for w in words) for words in each]

    return by_words if folded else whole_texts


def _encoder(path: str, version: str):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = _counter(path, folds_space(path))
        for batch in batches:
            counts: list[int] = []
            texts = batch["text"].tolist()
            for at in range(0, len(texts), 32):
                counts += count(texts[at : at + 32])
            yield pd.DataFrame({"digest": batch["digest"], "version": version, "n_tokens": counts})

    return encode


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest, n_tokens of a version; no rows where there is no cache yet."""
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE_SCHEMA)
    return found.where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs; the cache has gained what was missing."""
    spark = docs.sparkSession
    version, text = tokenizer_version(tokenizer_path), _normalised(folds_space(tokenizer_path))
    sizes = docs.select("doc_id", F.octet_length(whole("text")).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = written(sizes, "digests")
    known = cached(spark, cache, version).select(F.unhex("digest").alias("digest"))
    missing = written(rows.select("digest").distinct().join(known, "digest", "left_anti"), "missing")
    if not missing.isEmpty():
        # combined before the shuffle; Spark moves the join below it where `missing` is small
        texts = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
        misses = texts.join(missing, "digest", "left_semi").select(F.lower(F.hex("digest")).alias("digest"), "text")
        misses.mapInPandas(_encoder(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache)
    # written, so that both sides of the last join are dealt by it and Spark can split a text that many rows share
    counts = written(cached(spark, cache, version).select(F.unhex("digest").alias("digest"), "n_tokens").join(rows.select("digest").distinct(), "digest", "left_semi"), "counts")
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
