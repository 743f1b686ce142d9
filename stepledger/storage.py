"""Work tables in the folder that all executors share.

Loops cut their lineage by writing a Parquet table and reading it back. Unlike a cached or locally
checkpointed DataFrame, such a table outlives the executors that wrote it, and its file sizes give the
planner true statistics, so a small table is broadcast because it *is* small, not because of a hint.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session may fall back to a new one."""
    folder = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stepledger-"))
    return spark.sparkContext.getCheckpointDir()


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stepledger/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, label: str) -> str:
    """A new, unused path for this application below the shared folder."""
    return f"{_application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def work_table(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``df`` written once, for eager work inside the block; nothing that is returned may read it."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove_path(df.sparkSession, path)


def _hadoop_path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def qualified_path(spark: SparkSession, path: str) -> str:
    """The absolute path with its scheme, as listings report it (``file:/…`` with one slash), without a slash at the end."""
    filesystem, hadoop = _hadoop_path(spark, path)
    return filesystem.makeQualified(hadoop).toString().rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    filesystem, hadoop = _hadoop_path(spark, path)
    return filesystem.exists(hadoop)


def create_file(spark: SparkSession, path: str) -> None:
    """An empty file, with the folders above it; one that exists stays as it is."""
    filesystem, hadoop = _hadoop_path(spark, path)
    if not filesystem.exists(hadoop):
        filesystem.create(hadoop, True).close()


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a work table that no returned DataFrame reads any more."""
    filesystem, hadoop = _hadoop_path(spark, path)
    filesystem.delete(hadoop, True)


def clear_work_tables(spark: SparkSession) -> None:
    """Delete all work tables of this application; DataFrames that read them become unusable."""
    remove_path(spark, _application_folder(spark))
