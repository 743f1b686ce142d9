"""Newline-delimited JSON envelopes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepledger import schemas as S
from stepledger.sources.ledger import SinkLedger
from stepledger.storage import work_table

_CORRUPT = "_corrupt"
#: What may surround a line; the parser itself takes no form feed or vertical tab.
_BLANKS = " \t\n\x0b\f\r"
_PARSED = S.ddl({**S.ENVELOPE_DOCUMENT, _CORRUPT: "STRING"})


def parse_envelopes(lines: DataFrame) -> DataFrame:
    """Envelopes from a ``value`` column; empty and malformed lines are dropped silently."""
    text = F.btrim("value", F.lit(_BLANKS))
    parsed = F.from_json(text, _PARSED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    return (
        lines.filter(text != "")
        # A generator, since a filter is not pushed below it: pushed below a projection it would parse each line once more.
        .select(F.explode(F.array(parsed)).alias("e"))
        .filter(F.col(f"e.{_CORRUPT}").isNull())
        .select("e.seq", "e.timestamp", "e.version", "e.type", F.col("e.event").cast(S.struct(S.EVENT)).alias("event"))
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_envelopes(spark.read.option("lineSep", "\n").text(path))


def envelope_lines(events: DataFrame) -> DataFrame:
    """Envelopes as one compact JSON object per ``value``; absent fields are left out."""
    document = F.struct("seq", "timestamp", "version", "type", F.col("event").cast(S.struct(S.EVENT_DOCUMENT)).alias("event"))
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSX", "timeZone": "UTC"}
    return events.select(F.to_json(document, options).alias("value"))


def write_events(events: DataFrame, path: str) -> None:
    envelope_lines(events).write.option("lineSep", "\n").text(path)


def write_fanout(
    events: DataFrame,
    sinks: Sequence[Callable[[DataFrame], None]] | Mapping[str, Callable[[DataFrame], None]],
    ledger: SinkLedger | None = None,
    write: int | str = 0,
) -> None:
    """Hand the same rows to every sink. With several sinks the rows are computed once, into a work table.

    Sinks go by their name, or by their place in a sequence. With a ledger, a sink that has taken the write of this id before is
    skipped, so a write can be repeated after one sink has failed. The first error ends the write.
    """
    named = sinks if isinstance(sinks, Mapping) else {f"{k}": sink for k, sink in enumerate(sinks)}
    waiting = {name: sink for name, sink in named.items() if ledger is None or not ledger.has_taken(write, name)}

    def hand(rows: DataFrame) -> None:
        for name, sink in waiting.items():
            sink(rows)
            if ledger is not None:
                ledger.record(write, name)

    if len(waiting) < 2:
        hand(events)
        return
    with work_table(events, "fanout") as rows:
        hand(rows)
