"""Listings made by the tasks that hold the folders, not by the driver; folders are seen even if they are empty."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepledger.sources.store import is_hidden, opened
from stepledger.storage import qualified_path

_ENTRY = "path STRING, name STRING, is_folder BOOLEAN, length BIGINT, modified_at TIMESTAMP"
#: Folders are dealt to this many tasks per core, since some hold far more than others.
_TASKS_PER_CORE = 4
#: Entries of one batch, however many a folder holds.
_BATCH = 10_000


def entries(folder: str, recursive: bool, hidden: bool = False) -> list[tuple]:
    """``(path below the folder, name, is it a folder, bytes, modified at)``; nothing where there is no such folder.

    Work files of writers are left out unless ``hidden`` is set.
    """
    store, path = opened(folder)
    found = []
    for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=recursive)):
        below = info.path.removeprefix(path.rstrip("/")).strip("/")
        if hidden or not any(is_hidden(part) for part in below.split("/")):
            is_folder = info.type == fs.FileType.Directory
            found.append((below, below.rsplit("/", 1)[-1], is_folder, None if is_folder else info.size, info.mtime))
    return found


def list_folders(folders: DataFrame, recursive: bool = False, hidden: bool = False) -> DataFrame:
    """The rows of ``folders``, which have a full name ``folder``, with each entry in it, or anywhere below it."""
    spark = folders.sparkSession
    columns = folders.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in folders.schema), _ENTRY])
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")]
    names = ["path", "name", "is_folder", "length", "modified_at"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, folder in enumerate(batch["folder"].to_pylist()):
                listed = entries(folder, recursive, hidden)
                for at in range(0, len(listed), _BATCH):
                    found = listed[at : at + _BATCH]
                    own = batch.take(pa.array([k] * len(found)))
                    values = [pa.array(v, kind) for v, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*own.columns, *values], [*columns, *names])

    tasks = _TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    return folders.repartition(tasks, "folder").mapInArrow(work, schema)


def list_workspaces(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """``(workspace_id, folder)`` of the folders directly below the root: one level, and all that the driver lists."""
    top = qualified_path(spark, root)
    found = [(name, f"{top}/{name}") for _, name, is_folder, *_ in entries(top, False, hidden) if is_folder]
    return spark.createDataFrame(found, "workspace_id STRING, folder STRING")


def list_below(workspaces: DataFrame, kind: str, hidden: bool = False) -> DataFrame:
    """``(workspace_id, name, folder)`` of the folders directly in the folder ``kind`` of each workspace."""
    inside = workspaces.select("workspace_id", F.concat("folder", F.lit(f"/{kind}")).alias("folder"))
    found = list_folders(inside, hidden=hidden).filter("is_folder")
    return found.select("workspace_id", "name", F.concat_ws("/", "folder", "path").alias("folder"))


def files_in(folders: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(file, length)`` of the files called one of ``names`` in the folders ``(folder)``: looked up by tasks, nothing is listed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for folder in batch["folder"].to_pylist():
                store, path = opened(folder)
                infos = store.get_file_info([f"{path}/{name}" for name in names])
                found += [(f"{folder}/{name}", info.size) for name, info in zip(names, infos, strict=True) if info.type == fs.FileType.File]
            if found:
                files, lengths = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(lengths, pa.int64())], ["file", "length"])

    tasks = _TASKS_PER_CORE * folders.sparkSession.sparkContext.defaultParallelism
    return folders.select("folder").repartition(tasks, "folder").mapInArrow(work, "file STRING, length BIGINT")
