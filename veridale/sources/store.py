"""A log that batches are added to exactly once, whatever fails and however often a batch is sent.

    folder/data/<attempt>/     rows of one attempt to add a batch, as JSON lines
    folder/log/<number>.json   {"batch", "attempt"}: that attempt is the batch

Rows are written first, to a place of their own; the batch is there when its entry is. An entry takes the next free number by
a rename that fails if the number is taken, so entries are whole and ordered. Where two attempts of a batch got an entry each, the
one with the lower number counts. Data of attempts without an entry is never read, and `swept` deletes it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "batch string, attempt string"
#: Times to the microsecond.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class Folder:
    """The Hadoop file system of a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.jvm, self.folder = spark, spark.sparkContext._jvm, folder.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str) -> list[str]:
        at = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def published(self, name: str, text: str) -> bool:
        """Puts a small file in its place whole; False if there is one already."""
        part, to = self.path(f".{uuid.uuid4().hex}"), self.path(name)
        self.fs.mkdirs(to.getParent())
        out = self.fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(to):
            self.fs.delete(part, False)
            return False
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        keep = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.fs.makeQualified(part), self.fs.makeQualified(to), keep)
        except Exception as e:  # py4j hands on whatever the file system raises
            if "FileAlreadyExists" not in str(e):
                raise
            self.fs.delete(part, False)
            return False
        return True

    def deleted(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def entries(spark: SparkSession, folder: str) -> list[tuple[int, str, str]]:
    """(number, batch, attempt) of the batches in the log, in order: a small file each."""
    at = Folder(spark, folder)
    if not at.names("log"):
        return []
    rows = spark.read.schema(LOG).json(f"{at.folder}/log").select(F.regexp_extract(F.col("_metadata.file_name"), "^([0-9]+)", 1).cast("long").alias("n"), "batch", "attempt")
    first = rows.groupBy("batch").agg(F.min(F.struct("n", "attempt")).alias("e"))
    return sorted((r.e.n, r.batch, r.e.attempt) for r in first.collect())


def stage(rows: DataFrame, folder: str) -> str:
    """Writes the rows of an attempt and gives its name. Until it is committed, nobody reads them."""
    attempt = uuid.uuid4().hex
    rows.write.options(**TIMES).json(f"{folder.rstrip('/')}/data/{attempt}")
    return attempt


def commit(spark: SparkSession, folder: str, batch: str, attempt: str) -> bool:
    """Makes an attempt the batch; False if the batch is there already."""
    at, known = Folder(spark, folder), entries(spark, folder)
    if any(b == batch for _, b, _ in known):
        return False
    n = max((int(x.split(".")[0]) for x in at.names("log") if x[0].isdigit()), default=0) + 1
    while not at.published(f"log/{n:020d}.json", json.dumps({"batch": batch, "attempt": attempt})):
        n += 1
    return any(a == attempt for _, _, a in entries(spark, folder))


def append(rows: DataFrame, folder: str, batch: str) -> bool:
    """Adds rows as a batch, once: False, and nothing added, if a batch of that name is there."""
    spark = rows.sparkSession
    if any(b == batch for _, b, _ in entries(spark, folder)):
        return False
    return commit(spark, folder, batch, stage(rows, folder))


def read(spark: SparkSession, folder: str, schema: str, after: int = 0, upto: int | None = None) -> DataFrame:
    """The rows of the batches whose numbers are over `after`; only their files are listed and read."""
    attempts = [a for n, _, a in entries(spark, folder) if n > after and (upto is None or n <= upto)]
    if not attempts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**TIMES).json([f"{folder.rstrip('/')}/data/{a}" for a in attempts])


def swept(spark: SparkSession, folder: str) -> int:
    """Deletes what failed attempts have left; not while others add batches."""
    at, used = Folder(spark, folder), {a for _, _, a in entries(spark, folder)}
    left = [a for a in at.names("data") if a not in used]
    for a in left:
        at.deleted(f"data/{a}")
    return len(left)
