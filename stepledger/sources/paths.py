"""Ids and line positions of files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepledger.sources.ranges import RANGE_BYTES, Range, count_lines, line_batches
from stepledger.storage import materialize, qualified_path

# Where a store keeps its files below the root. The readers' globs have these depths, so the ends of the paths decide.
RUN_META = r"([^/]+)/runs/([^/]+)/meta\.json$"
RUN_LOG = r"([^/]+)/runs/([^/]+)/(stdout|stderr)\.log$"
STATE = r"([^/]+)/state\.json$"
MARKER = r"([^/]+)/running/([^/]+)$"
LOCK = r"([^/]+)/daemon\.json$"
_RANGE = "file STRING, length BIGINT, begin BIGINT, `end` BIGINT"


def plain(path: Column) -> Column:
    """A local path with one slash after the scheme, however the reader reports it."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def decoded(path: Column) -> Column:
    """``_metadata.file_path``, which is URL-encoded, as the file is named on disk."""
    return plain(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def path_part(path: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(path, pattern, group)


def below_root(spark: SparkSession, path: Column, root: str) -> Column:
    """The part of a plain path below ``root``, whatever the names above it are."""
    return F.substring(path, F.lit(len(qualified_path(spark, root)) + 2), F.length(path))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``(file, value)``, a row per file, of the small files that ``path``, which may hold wildcards, names; no rows where none is there."""
    try:
        texts = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file STRING, value STRING")
    return texts.select(decoded(F.col("_metadata.file_path")).alias("file"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)`` of the few text files that ``path``, which may hold wildcards, names; the driver lists them."""
    try:
        files = spark.read.format("binaryFile").load(path).select(plain(F.col("path")).alias("file"), "length")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file STRING, line_no BIGINT, line STRING")
    return lines_of_files(files)


def lines_of_files(files: DataFrame) -> DataFrame:
    """``(file, line_no, line)`` of all text files ``(file, length)``.

    Files are cut into ranges of bytes. One pass counts the lines that end in each range, which gives the number of its first
    line; a second reads the same ranges and numbers on from there. The text is read twice and copied nowhere, and a large
    file is read by many tasks.
    """
    begins = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(RANGE_BYTES).cast("bigint"))
    ranges = files.filter("length > 0").select("file", "length", F.explode(begins).alias("begin"))
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    ranges = ranges.withColumn("end", F.least("length", F.col("begin") + RANGE_BYTES)).repartition(tasks, "file", "begin")

    def parts(batch: pa.RecordBatch) -> list[Range]:
        rows = batch.to_pylist()
        return [Range(r["file"], r["begin"], r["end"], r["begin"] == 0, r["end"] == r["length"]) for r in rows]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pa.array([count_lines(part) for part in parts(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, lines], [*batch.schema.names, "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first in zip(parts(batch), batch["first"].to_pylist(), strict=True):
                for found in line_batches(part):
                    numbers = pa.array(range(first, first + found.num_rows), pa.int64())
                    first += found.num_rows
                    yield pa.RecordBatch.from_arrays([found["file"], numbers, found["value"]], ["file", "line_no", "line"])

    earlier = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    counted = materialize(ranges.mapInArrow(count, f"{_RANGE}, n BIGINT"), "ranges")  # a row per range
    numbered = counted.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return numbered.repartition(tasks, "file", "begin").mapInArrow(read, "file STRING, line_no BIGINT, line STRING")
