"""Which sinks have taken which write, kept as empty files in a shared folder, so that a repeated write skips them."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import SparkSession

from stepledger.storage import create_file, path_exists


class SinkLedger:
    """Records ``<folder>/<write>/<sink>``; the folder must outlive the job and belong to one stream or export.

    A record is made after its sink has returned. A job that dies between the two repeats that one sink's write, so a sink that
    must not even then see rows twice replaces what it wrote under the same id, as ``batch_folders`` does.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder.rstrip("/")

    def _path(self, write: int | str, sink: str) -> str:
        # Dots are quoted too: neither name may leave its folder.
        return "/".join([self._folder, *(quote(str(name), safe="").replace(".", "%2E") for name in (write, sink))])

    def has_taken(self, write: int | str, sink: str) -> bool:
        return path_exists(self._spark, self._path(write, sink))

    def record(self, write: int | str, sink: str) -> None:
        create_file(self._spark, self._path(write, sink))
