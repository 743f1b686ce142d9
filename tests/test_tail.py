"""The tailing source: lines that come in pieces, in many ranges, over restarts."""

from __future__ import annotations

import json

import pytest

from stepledger.sources import ranges
from stepledger.streaming import tail
from stepledger.streaming.events import stream_log_tail, tail_events


def _line(n: int, type_: str = "STEP_LOG") -> str:
    event = {"event": type_, "jobId": "j", "step": {"id": "s"}, "stream": "stdout", "line": f"said {n} é"}
    return json.dumps({"seq": n, "timestamp": "2026-01-01T00:00:00.000Z", "version": 1, "type": type_, "event": event}, ensure_ascii=False)


class _Stream:
    """A query that is started anew for each trigger, so every trigger is a restart."""

    def __init__(self, folder, frame) -> None:
        self.folder, self.frame, self.rows = folder, frame, []

    def trigger(self) -> list:
        got = []
        writer = self.frame().writeStream.foreachBatch(lambda df, _: got.extend(df.collect()))
        writer.option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start().awaitTermination()
        return got


def _append(path, text: str) -> None:
    with path.open("ab") as f:
        f.write(text.encode())


def test_lines_come_once_and_whole(spark, tmp_path):
    source = tmp_path / "in"
    (source / "_work").mkdir(parents=True)
    stream = _Stream(tmp_path, lambda: tail_events(spark, str(source)))
    seen = lambda: sorted(r.seq for r in stream.trigger())
    assert seen() == []
    one, two = source / "one.ndjson", source / "deep" / "two.ndjson"
    _append(one, _line(1) + "\n" + _line(2)[:30])
    assert seen() == [1]
    assert seen() == []
    _append(one, _line(2)[30:60])
    assert seen() == []
    two.parent.mkdir()
    _append(two, _line(10) + "\n\n{bad\n  " + _line(11) + "\r\n")
    _append(source / "_work" / "x", _line(99) + "\n")
    _append(one, _line(2)[60:] + "\n" + _line(3) + "\n" + _line(4))
    assert seen() == [2, 3, 10, 11]
    _append(one, "\n")
    assert seen() == [4]
    two.unlink()
    one.write_text(_line(5) + "\n")  # another, shorter file
    assert seen() == [5]


def test_a_running_query_sees_what_is_added(spark, tmp_path):
    source, got = tmp_path / "live.ndjson", []
    source.write_text(_line(1) + "\n" + _line(2)[:20])
    lines = stream_log_tail(tail_events(spark, str(source)))
    query = lines.writeStream.foreachBatch(lambda df, _: got.extend(r.line for r in df.collect())).start()
    try:
        query.processAllAvailable()
        assert got == ["[s] said 1 é"]
        _append(source, _line(2)[20:] + "\n" + _line(3) + "\n")
        query.processAllAvailable()
        assert sorted(got) == ["[s] said 1 é", "[s] said 2 é", "[s] said 3 é"]
    finally:
        query.stop()


def test_a_quiet_end_of_file_ends_the_line(spark, tmp_path):
    source = tmp_path / "in" / "a.ndjson"
    source.parent.mkdir()
    stream = _Stream(tmp_path, lambda: tail_events(spark, str(source.parent), quiet_seconds=0))
    source.write_text(_line(1) + "\n" + _line(2))
    assert sorted(r.seq for r in stream.trigger()) == [1, 2]
    _append(source, _line(3) + "\n")
    assert [r.seq for r in stream.trigger()] == [3]


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1000])
def test_ranges_share_the_lines_out(tmp_path, size, monkeypatch):
    """However a file is cut into ranges, and into reads, every line ends in one range."""
    monkeypatch.setattr(tail, "RANGE_BYTES", size)
    monkeypatch.setattr(ranges, "READ_BYTES", 5)
    data = b"first\n\nthird line\r\n" + "é日\n".encode() + b"x" * 40 + b"\nno break"
    file = tmp_path / "f"
    file.write_bytes(data)
    reader = tail._TailReader(f"file:{file}", None)
    for closed in (False, True):
        end = {f"file:{file}": {"bytes": len(data), "closed": closed}}
        found = [x for part in reader.partitions({}, end) for x in ranges.lines_of(part)]
        expected, at = [], 0
        for line in data.split(b"\n"):
            expected.append((at, line))
            at += len(line) + 1
        assert found == (expected if closed else expected[:-1])
        assert sum(ranges.count_lines(part) for part in reader.partitions({}, end)) == len(found)
    assert reader.partitions(end, end) == []
    half = {f"file:{file}": {"bytes": 25, "closed": False}}
    both = [x for a, b in (({}, half), (half, end)) for part in reader.partitions(a, b) for x in ranges.lines_of(part)]
    assert both == expected
