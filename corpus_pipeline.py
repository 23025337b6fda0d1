"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing and sharding of documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last
return the columns of docs. What a stage decides is a table of ids and marks of the rows that it changes;
Spark broadcasts that where its files are small and shuffles the texts once for it where they aren't.

Defined results: a row is known by its doc_id, null or repeated ones too, and a digest of its text, so rows of
one doc_id with different texts are judged apart, and after near-dedup such a pair occurs once; null, empty and
short texts fail the quality rules; a tie goes to the smaller doc_id, then digest; other columns go along under
any name; an empty table goes through every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridale.llm import contamination, mixing, quality, sharding, simhash
from veridale.sources.scratch import written

SHARDS = 40


def _same(docs: DataFrame, marks: DataFrame) -> Column:
    """The row is the one that marks (doc_id, digest, ..) means."""
    return docs["doc_id"].eqNullSafe(marks["doc_id"]) & (F.xxhash64(docs["text"]) == marks["digest"])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail the base rule or a learned rule."""
    return quality.kept_rows(docs, quality.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id (and digest) of each group of near copies, once."""
    marks = written(simhash.repeated(docs), "repeated")
    gone, several = written(marks.where("gone"), "gone"), written(marks.where("not gone"), "several")
    kept = docs.join(gone, _same(docs, gone), "left_anti")
    if several.isEmpty():
        return kept
    rest = kept.join(several, _same(kept, several), "left_anti")
    return rest.unionByName(kept.join(several, _same(kept, several), "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents to meet the target weights of their sources."""
    named = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("digest"))
    drawn = mixing.mixed(named, keep=("doc_id", "digest", "source"))
    per = drawn.groupBy("doc_id", "digest", "source").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    per = written(per.where("copies <> 1 or n > 1"), "copies")
    single, several = written(per.where("n = 1"), "single"), written(per.where("n > 1"), "several")

    def same(rows: DataFrame, found: DataFrame) -> Column:
        return _same(rows, found) & rows["source"].eqNullSafe(found["source"])

    def repeated(joined: DataFrame, times: Column) -> DataFrame:
        row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
        each = joined.select(row.alias("row"), times.cast("int").alias("times"))
        return each.select(F.explode(F.array_repeat("row", "times")).alias("row")).select("row.*")

    out = repeated(docs.join(single, same(docs, single), "left"), F.coalesce(single["copies"], F.lit(1)))
    if several.isEmpty():
        return out
    # equal rows share their copies evenly
    alike = docs.join(several, same(docs, several))
    k = F.row_number().over(Window.partitionBy(several["doc_id"], several["digest"], several["source"]).orderBy(several["digest"]))
    share = F.floor(several["copies"] / several["n"]) + (k <= several["copies"] % several["n"]).cast("long")
    others = docs.join(several, same(docs, several), "left_anti")
    return repeated(others.join(single, same(others, single), "left"), F.coalesce(single["copies"], F.lit(1))).unionByName(repeated(alike, share))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row."""
    return sharding.placed(docs, SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mix), ("sharding", shard)]
#: Learned rules and hash-ordered samples aren't expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
