"""Streams of envelopes and stateless consumers of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from stepledger import schemas as S
from stepledger.sources.events import parse_envelopes, write_fanout
from stepledger.sources.ledger import SinkLedger
from stepledger.storage import remove_path
from stepledger.streaming.tail import tail_lines


def tail_events(spark: SparkSession, path: str, quiet_seconds: float | None = None) -> DataFrame:
    """Envelopes of NDJSON files that are still being written, each as soon as its line is complete.

    Malformed lines are dropped as in the batch reader; a last line without a line break counts once its file has been
    quiet for ``quiet_seconds``.
    """
    return parse_envelopes(tail_lines(spark, path, quiet_seconds).select("value"))


def stream_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Envelopes of finished NDJSON files as they arrive; malformed lines are dropped as in the batch reader."""
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_envelopes(reader.text(path))


def stream_log_tail(events: DataFrame) -> DataFrame:
    """Log lines with the step in front."""
    step = F.col("event.step.id")
    return events.filter(F.col("type") == S.STEP_LOG).select(
        F.col("event.job_id").alias("job_id"),
        step.alias("step_id"),
        F.col("event.stream").alias("stream"),
        F.concat(F.lit("["), step, F.lit("] "), "event.line").alias("line"),
    )


def stream_fanout(
    events: DataFrame,
    sinks: Sequence[Callable[[DataFrame, int], None]] | Mapping[str, Callable[[DataFrame, int], None]],
    ledger: SinkLedger | None = None,
) -> DataStreamWriter:
    """Hand every micro-batch, with its id, to all sinks.

    A batch that is repeated after a failure has the same id and rows. With a ledger, sinks that have taken it are skipped; the
    ledger's folder belongs to one checkpoint, since ids start anew with another.
    """
    named = sinks if isinstance(sinks, Mapping) else {f"{k}": sink for k, sink in enumerate(sinks)}

    def write(batch: DataFrame, batch_id: int) -> None:
        write_fanout(batch, {name: partial(_with_id, sink, batch_id) for name, sink in named.items()}, ledger, batch_id)

    return events.writeStream.foreachBatch(write)


def _with_id(sink: Callable[[DataFrame, int], None], batch_id: int, rows: DataFrame) -> None:
    sink(rows, batch_id)


def batch_folders(path: str, write: Callable[[DataFrame, str], None]) -> Callable[[DataFrame, int], None]:
    """A sink that gives every micro-batch a folder ``batch_id=…``; a repeated batch replaces its own folder."""

    def sink(rows: DataFrame, batch_id: int) -> None:
        folder = f"{path.rstrip('/')}/batch_id={batch_id}"
        remove_path(rows.sparkSession, folder)
        write(rows, folder)

    return sink
