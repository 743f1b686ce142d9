"""Lines of text files that are still being written, as a stream.

An offset is a number of bytes per file. A trigger takes what has been added since, cut into ranges of bytes, and a task
reads the lines that *end* in its range: it steps back to where the first of them begins, maybe before the range, and
leaves what follows the last line break to a later trigger. So a line that came in two halves is read once, whole, no state is
kept beside the offsets, and a repeated trigger reads the same lines.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from stepledger.sources.ranges import RANGE_BYTES, Range, line_batches
from stepledger.sources.store import is_hidden, opened
from stepledger.storage import qualified_path

FORMAT = "stepledger_tail"
_SCHEMA = "file STRING, position BIGINT, value STRING"


class _TailReader(DataSourceStreamReader):
    """Offsets are ``{file: {"bytes": read so far, "closed": was the end of the file taken as the end of a line}}``."""

    def __init__(self, root: str, quiet_seconds: float | None) -> None:
        self.root, self.quiet_seconds = root, quiet_seconds

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, path = opened(self.root)
        if store.get_file_info(path).type == fs.FileType.File:
            found = [store.get_file_info(path)]
        else:
            found = store.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
        prefix, now, out = self.root.removesuffix(path), time.time(), {}
        for info in found:
            below = info.path.removeprefix(path).strip("/")
            if info.type == fs.FileType.File and not any(is_hidden(name) for name in below.split("/")):
                quiet = self.quiet_seconds is not None and now - info.mtime.timestamp() >= self.quiet_seconds
                out[prefix + info.path] = {"bytes": info.size, "closed": quiet}
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for file, now in sorted(end.items()):
            before = start.get(file, {"bytes": 0, "closed": True})
            if now["bytes"] < before["bytes"]:  # another file under this name
                before = {"bytes": 0, "closed": True}
            begin, to, closed = before["bytes"], now["bytes"], now["closed"]
            if begin == to and (before["closed"] or not closed):
                continue
            edges = [*range(begin, max(to, begin + 1), RANGE_BYTES), to]
            for a, b in zip(edges, edges[1:], strict=False):
                out.append(Range(file, a, b, a == begin and before["closed"], b == to and closed))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return line_batches(partition)


class TailSource(DataSource):
    """``spark.readStream.format("stepledger_tail").load(folder)``: ``file, position, value`` of lines as they are completed."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        quiet = self.options.get("quietseconds")
        return _TailReader(self.options["path"], None if quiet is None else float(quiet))


def tail_lines(spark: SparkSession, path: str, quiet_seconds: float | None = None) -> DataFrame:
    """``file, position, value`` of every line below ``path`` (a folder or one file) once its line break is there.

    ``position`` is the byte at which the line begins. With ``quiet_seconds``, the end of a file that has not changed for so
    long ends its last line too, and what is added later begins a new one. A file that has become shorter is a new
    one. Files and folders whose names begin with ``_`` or ``.`` are left out. The offset names every file, so the folder of a
    stream should hold the files of its live jobs, not of all times.
    """
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format(FORMAT)
    if quiet_seconds is not None:
        reader = reader.option("quietSeconds", str(quiet_seconds))
    return reader.load(qualified_path(spark, path))
