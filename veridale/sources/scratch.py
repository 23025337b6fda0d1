"""Tables and files of a job's own, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where the session names none: the warehouse's, and a local one only where Spark runs on this machine alone (tests)."""
    context = spark.sparkContext
    known = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF) or context.getCheckpointDir()
    if not known and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="veridale-"))
        known = context.getCheckpointDir()
    return (known or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/veridale/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str = "files") -> str:
    """A folder of this application's that isn't there yet."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """The rows of frame, written as Parquet and read again: a lost executor costs no recomputation of what came before."""
    path = new_folder(frame.sparkSession, name)
    frame.write.parquet(path, compression=compression)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def cleared(spark: SparkSession) -> bool:
    """Deletes the tables and folders that this application has written; results that still read them must have been used."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
