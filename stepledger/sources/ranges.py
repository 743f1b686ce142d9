"""Ranges of bytes of text files. A line belongs to the range that it ends in, and begins where it must."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import InputPartition

from stepledger.sources.store import opened

#: Bytes of one range, and of one read.
RANGE_BYTES, READ_BYTES = 32 << 20, 1 << 20


@dataclass
class Range(InputPartition):
    """Lines that end in the bytes ``[begin, end)`` of a file."""

    file: str
    begin: int
    end: int
    #: The first line begins here, not before.
    fresh: bool
    #: The last line ends here, even without a line break.
    closed: bool


def _line_start(stream, at: int) -> int:
    """Where the line that holds the byte before ``at`` begins; ``at`` itself after a line break."""
    while at > 0:
        begin = max(0, at - READ_BYTES)
        stream.seek(begin)
        found = stream.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


def lines_of(part: Range) -> Iterator[tuple[int, bytes]]:
    """``(position, line)`` of the lines of one range; none where the file has gone."""
    store, path = opened(part.file)
    if store.get_file_info(path).type != fs.FileType.File:
        return
    with store.open_input_file(path) as stream:
        begin = part.begin if part.fresh else _line_start(stream, part.begin)
        stream.seek(begin)
        held, at, left = [], begin, part.end - begin
        while left > 0 and (data := stream.read(min(READ_BYTES, left))):
            left -= len(data)
            *whole, rest = data.split(b"\n")
            for line in whole:
                line = b"".join([*held, line])
                held = []
                yield at, line
                at += len(line) + 1
            if rest:
                held.append(rest)
        if part.closed and held:
            yield at, b"".join(held)


def count_lines(part: Range) -> int:
    """How many lines end in a range."""
    store, path = opened(part.file)
    if store.get_file_info(path).type != fs.FileType.File:
        return 0
    with store.open_input_file(path) as stream:
        stream.seek(part.begin)
        n, left, last = 0, part.end - part.begin, b""
        while left > 0 and (data := stream.read(min(READ_BYTES, left))):
            n, left, last = n + data.count(b"\n"), left - len(data), data[-1:]
        return n + (part.closed and last not in (b"", b"\n"))


def line_batches(part: Range) -> Iterator[pa.RecordBatch]:
    """``file, position, value`` of the lines of one range."""
    places, values, size = [], [], 0

    def batch() -> pa.RecordBatch:
        texts = pa.array([v.decode("utf-8", "replace") for v in values], pa.string())
        return pa.RecordBatch.from_arrays([pa.array([part.file] * len(values), pa.string()), pa.array(places, pa.int64()), texts], ["file", "position", "value"])

    for place, line in lines_of(part):
        places.append(place)
        values.append(line)
        size += len(line)
        if size >= READ_BYTES or len(values) >= 10_000:
            yield batch()
            places, values, size = [], [], 0
    if values:
        yield batch()
