"""The session fold: literal sequences, and random events against a plain event loop."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from stepledger import schemas as S
from stepledger.operators.events import assign_seq, failed_stderr_tail
from stepledger.operators.sessions import current_session, fold_session_steps, fold_sessions
from stepledger.sources.events import parse_envelopes, read_events, write_events, write_fanout
from stepledger.sources.ledger import SinkLedger
from stepledger.streaming.events import batch_folders, stream_events, stream_fanout
from stepledger.operators.session_state import merge_state, session_state, state_sessions, state_steps
from stepledger.streaming.sessions import (
    append_state,
    apply_updates,
    compact_session_state,
    session_snapshot,
    session_updates,
    stored_state,
    stream_updates,
    write_session_state,
)

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)


def envelope(seq: int, type_: str, job: str = "j1", step: str | None = None, **fields):
    event = dict.fromkeys(S.EVENT)
    event.update(event=type_, job_id=job, workspace_id=fields.pop("ws", "ws-1"), **fields)
    if step:
        event["step"] = {"id": step, "display_name": fields.get("display_name", f"Step {step}")}
    event.pop("display_name", None)
    return (seq, BASE + timedelta(seconds=seq), 1, type_, event)


def frame(spark, rows):
    return spark.createDataFrame(rows, S.ddl({**S.ENVELOPE_DOCUMENT, "event": S.struct(S.EVENT)}))


def loop(rows):
    """The rules as a plain loop over the events of all jobs in arrival order."""
    sessions: dict = {}
    status = {"STEP_STARTING": "running", "STEP_SKIPPED": "skipped", "STEP_FINISHED": "finished", "STEP_FAILED": "failed"}
    for _, at, _, type_, e in sorted(rows, key=lambda r: r[0]):
        job = e["job_id"]
        if type_ == "PIPELINE_START":
            steps = {s["id"]: {"name": s["display_name"], "status": "pending"} for s in e["steps"] or []}
            sessions[job] = {"ws": e["workspace_id"], "status": "running", "start": at, "end": None, "steps": steps}
        elif type_ in status:
            session = sessions.setdefault(job, {"ws": "", "status": "running", "start": None, "end": None, "steps": {}})
            step = session["steps"].setdefault(e["step"]["id"], {"name": e["step"]["display_name"]})
            step["status"] = status[type_]
            if type_ in ("STEP_SKIPPED", "STEP_FINISHED") and e["run_id"]:
                step["run"] = e["run_id"]
            if type_ == "STEP_FINISHED":
                for field in ("duration_ms", "artifact_size"):
                    if e[field] is not None:
                        step[field] = e[field]
            if type_ == "STEP_FAILED":
                step["exit"] = e["exit_code"]
        elif type_.startswith("PIPELINE") and job in sessions:
            sessions[job].update(status="completed" if type_ == "PIPELINE_FINISHED" else "failed", end=at)
    return sessions


def shown(sessions, steps):
    found = {}
    for r in sessions.collect():
        utc = lambda t: t and t.astimezone(timezone.utc)
        found[r.job_id] = {"ws": r.workspace_id, "status": r.status, "start": utc(r.started_at), "end": utc(r.finished_at), "steps": {}}
    for r in steps.collect():
        step = {"name": r.display_name, "status": r.status, "run": r.run_id, "exit": r.exit_code}
        step.update(duration_ms=r.duration_ms, artifact_size=r.artifact_size)
        found[r.job_id]["steps"][r.step_id] = {k: v for k, v in step.items() if v is not None}
    return found


def random_events(seed: int, jobs: int = 6, n: int = 60, names: bool = True):
    dice = random.Random(seed)
    types = [t for t in S.FOLDED_TYPES for _ in range(4 if t.startswith("STEP") else 1)] + ["STEP_RETRYING", "STEP_LOG"]
    rows = []
    for job in range(jobs):
        for seq in range(n):
            type_ = dice.choice(types)
            step = f"s{dice.randrange(4)}" if type_.startswith("STEP") else None
            fields = {"run_id": dice.choice([None, "", f"r{seq}"]), "duration_ms": dice.choice([None, seq])}
            fields.update(artifact_size=dice.choice([None, seq * 10]), exit_code=dice.choice([1, 2]))
            row = envelope(seq, type_, f"j{job}", step, **fields)
            if step and names:
                row[4]["step"]["display_name"] = f"Step {step} {dice.randrange(3)}"
            if type_ == "PIPELINE_START":
                row[4]["steps"] = [{"id": f"s{i}", "display_name": f"Listed {i}"} for i in range(dice.randrange(3))]
            rows.append(row)
    return rows


def test_lifecycle(spark):
    rows = [
        envelope(0, "PIPELINE_START", pipeline_name="full", steps=[{"id": "a", "display_name": "A"}, {"id": "b", "display_name": "B"}]),
        envelope(1, "STEP_STARTING", step="a"),
        envelope(2, "STEP_FINISHED", step="a", run_id="r1", duration_ms=100, artifact_size=50),
        envelope(3, "PIPELINE_FINISHED"),
        envelope(0, "STEP_STARTING", job="orphan", step="x"),
        envelope(0, "PIPELINE_FAILED", job="early"),
    ]
    df = frame(spark, rows)
    sessions = {r.job_id: r for r in fold_sessions(df).collect()}
    assert set(sessions) == {"j1", "orphan"}
    assert sessions["j1"].status == "completed" and sessions["j1"].pipeline_name == "full"
    assert sessions["orphan"].status == "running" and sessions["orphan"].workspace_id == ""
    steps = {(r.job_id, r.step_id): r for r in fold_session_steps(df).collect()}
    assert steps["j1", "a"].status == "finished" and steps["j1", "a"].run_id == "r1"
    assert steps["j1", "a"].display_name == "A" and steps["j1", "b"].status == "pending"
    assert current_session(fold_sessions(df)).filter("workspace_id = ''").first().job_id == "orphan"


@pytest.mark.parametrize("slice_rows", [7, 100_000])
def test_fold_equals_loop(spark, slice_rows):
    rows = [row for seed in range(4) for row in random_events(seed)]
    rows = [(*r[:4], {**r[4], "job_id": f"{i // 360}-{r[4]['job_id']}"}) for i, r in enumerate(rows)]
    df = frame(spark, rows).repartition(5)
    expected = loop(rows)
    assert shown(fold_sessions(df, slice_rows), fold_session_steps(df, slice_rows)) == {
        job: {**s, "steps": {i: {k: v for k, v in step.items()} for i, step in s["steps"].items()}} for job, s in expected.items()
    }


def streamed(spark, folder, rows, files):
    """The table after a stream has taken ``files`` files of shuffled events, one per micro-batch."""
    source, table = f"{folder}/in", f"{folder}/out"
    for k in range(files):
        write_events(frame(spark, rows[k::files]).coalesce(1), f"{source}/f{k}")
    events = stream_events(spark, f"{source}/*", files_per_trigger=1)
    write_session_state(events, table).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    return table


@pytest.mark.parametrize("seed", [9, 10])
def test_stream_equals_batch_in_any_order(spark, tmp_path, seed):
    """With restarts, names that change, and events that are spread over the files at random."""
    rows = random_events(seed, jobs=4, n=60)
    # Numbers without gaps within a job, as the numbering of events gives them.
    count: dict = {}
    rows = [(count.__setitem__(j := r[4]["job_id"], count.get(j, -1) + 1) or count[j], *r[1:]) for r in sorted(rows, key=lambda r: r[0]) if r[3] != "STEP_LOG"]
    random.Random(seed).shuffle(rows)
    table = streamed(spark, tmp_path, rows, 4)
    assert shown(*session_snapshot(spark, table)) == loop(rows)
    # Compaction of the first batches, and of that with the next, changes nothing.
    first, second = str(tmp_path / "first"), str(tmp_path / "second")
    stored = stored_state(spark, table)
    for k in (1, 2):
        stored.filter(F.col("batch") <= k).write.partitionBy("batch", "kind").parquet(f"{tmp_path}/until{k}")
    compact_session_state(spark, f"{tmp_path}/until1", first)
    assert shown(*session_snapshot(spark, table, first)) == loop(rows)
    compact_session_state(spark, f"{tmp_path}/until2", second, first)
    assert shown(*session_snapshot(spark, table, second)) == loop(rows)
    # A subscriber that holds what the first batches give, and gets the updates of the others, ends where the fold ends.
    until1 = spark.read.schema(stored.schema).parquet(f"{tmp_path}/until1")
    held = [session_snapshot(spark, f"{tmp_path}/until1")]

    def keep(sessions, steps, _):
        held[0] = tuple(spark.createDataFrame(x.collect(), x.schema) for x in apply_updates(held[0], (sessions, steps)))

    writer = stream_updates(spark, table, 1, keep)
    writer.option("checkpointLocation", f"{tmp_path}/u").trigger(availableNow=True).start().awaitTermination()
    assert until1.count() < stored.count() and shown(*held[0]) == loop(rows)


def test_state_in_any_order(spark):
    """State of parts of the events, merged, against the loop; numbers lie on both sides of the blocks of names."""
    rows = [row for seed in range(3) for row in random_events(seed, jobs=3, n=150)]
    rows = [(*r[:4], {**r[4], "job_id": f"{i // 450}-{r[4]['job_id']}"}) for i, r in enumerate(rows)]
    random.Random(1).shuffle(rows)
    parts = [session_state(frame(spark, part)) for part in (rows[::3], rows[1::3], rows[2::3], rows[:40])]
    state = merge_state(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    assert shown(state_sessions(state), state_steps(state)) == loop(rows)


def test_updates_cost_what_arrives(spark, tmp_path):
    """However many events went before, a trigger with one event touches the rows of this event only."""
    for k, n in enumerate((400, 1, 1)):
        rows = [envelope(1000 * k + i, "STEP_STARTING", job=f"j{i % 40}", step=f"s{k}.{i}") for i in range(n)]
        write_events(frame(spark, rows).coalesce(1), f"{tmp_path}/in/f{k}")
    events = stream_events(spark, f"{tmp_path}/in/*", files_per_trigger=1)
    query = write_session_state(events, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]] == [40 + 400 + 400, 3, 3]
    opened = []
    writer = stream_updates(spark, f"{tmp_path}/out", 0, lambda s, t, n: opened.append((s.count(), t.count())))
    writer.option("maxFilesPerTrigger", 1).option("checkpointLocation", f"{tmp_path}/u").trigger(availableNow=True).start().awaitTermination()
    assert sum(t for _, t in opened) == 2


def test_files_of_a_batch_do_not_follow_the_partitions_of_state(spark, tmp_path):
    tasks = spark.sparkContext.defaultParallelism
    rows = [envelope(i, "STEP_STARTING", job=f"j{i}", step="s") for i in range(40 * tasks)]
    state = session_state(frame(spark, rows)).repartition(5 * tasks, "job_id")
    append_state(state, f"{tmp_path}/out", 0)
    for kind in range(3):
        assert len(list((tmp_path / "out" / "batch=0" / f"kind={kind}").glob("*.parquet"))) <= tasks
    assert stored_state(spark, f"{tmp_path}/out").count() == 3 * len(rows)


def test_names_after_a_restart(spark, tmp_path):
    rows = [envelope(0, "PIPELINE_START", steps=[]), envelope(1, "STEP_STARTING", step="s", display_name="A"), envelope(2, "STEP_FINISHED", step="s", display_name="B"), envelope(3, "PIPELINE_START", steps=[]), envelope(4, "STEP_STARTING", step="s", display_name="B"), envelope(5, "STEP_FINISHED", step="s", display_name="A")]
    table = streamed(spark, tmp_path, rows[3:] + rows[:3], 2)
    assert [r.display_name for r in session_snapshot(spark, table)[1].collect()] == ["B"]


def test_updates_hold_the_jobs_of_later_batches(spark, tmp_path):
    table = str(tmp_path / "out")
    old = [envelope(0, "STEP_STARTING", job=j, step="a") for j in ("j1", "j2")]
    append_state(session_state(frame(spark, old)), table, 0)
    append_state(session_state(frame(spark, [envelope(1, "STEP_FAILED", job="j2", step="a", exit_code=3)])), table, 1)
    sessions, steps = session_updates(spark, table, 0)
    assert [r.job_id for r in sessions.collect()] == ["j2"] and [(r.job_id, r.status, r.exit_code) for r in steps.collect()] == [("j2", "failed", 3)]
    got = []
    writer = stream_updates(spark, table, 0, lambda s, t, n: got.append(({r.job_id for r in s.collect()}, t.count())))
    writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert got == [({"j2"}, 1)]


def test_ndjson(spark, tmp_path):
    lines = ['{"seq":1,"type":"STEP_LOG"}', "{bad", "", "   ", '  {"seq":2,"type":"STEP_LOG"}\r', '{"seq":3,"type":"STEP_LOG"}']
    path = tmp_path / "events.ndjson"
    path.write_text("\n".join(lines))  # the last line has no newline
    assert [r.seq for r in read_events(spark, str(path)).orderBy("seq").collect()] == [1, 2, 3]
    one = parse_envelopes(spark.createDataFrame([('{"seq":7,"event":{"jobId":"j","step":{"id":"a","displayName":"A"}}}',)], "value STRING"))
    row = one.first()
    assert row.event.job_id == "j" and row.event.step.display_name == "A"


def test_a_line_is_parsed_once(spark):
    lines = spark.createDataFrame([(" \x0b\f{\"seq\":1}\f\x0b\r",), ("null",), ('{"seq":"a"}',), ("[1]",)], "value STRING")
    found = parse_envelopes(lines)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [r.seq for r in found.collect()] == [1]


def test_fanout(spark, tmp_path):
    df = frame(spark, random_events(1, jobs=1, n=10))
    counts = []
    write_fanout(df, [])
    write_fanout(df, [lambda rows: counts.append(rows.count())] * 2)
    assert counts == [10, 10]


def test_fanout_with_a_ledger(spark, tmp_path):
    """After one sink has failed, the repeated write reaches only the sinks that did not take it."""
    df, ledger, seen, failures = frame(spark, random_events(1, jobs=1, n=10)), SinkLedger(spark, f"file://{tmp_path}/ledger"), [], [1]

    def weak(rows):
        if failures:
            raise OSError(failures.pop())
        seen.append(("weak", rows.count()))

    sinks = {"../first": lambda rows: seen.append(("first", rows.count())), "weak": weak, "last": lambda rows: seen.append(("last", rows.count()))}
    with pytest.raises(OSError):
        write_fanout(df, sinks, ledger, 7)
    assert seen == [("first", 10)]
    write_fanout(df, sinks, ledger, 7)
    write_fanout(df, sinks, SinkLedger(spark, f"file://{tmp_path}/ledger/"), "7")
    assert seen == [("first", 10), ("weak", 10), ("last", 10)]
    write_fanout(df, sinks, ledger, 8)
    assert len(seen) == 6 and sorted(x.name for x in tmp_path.iterdir()) == ["ledger"]


def test_stream_fanout_after_a_failure(spark, tmp_path):
    """A stream that is started again repeats its batch; no sink has a row twice, not even one that failed half way."""
    write_events(frame(spark, random_events(2, jobs=2, n=10)), f"{tmp_path}/in")
    appended, failures = [], [1]
    folders = batch_folders(f"{tmp_path}/out", lambda rows, folder: rows.select("seq").write.parquet(folder))

    def half(rows, batch_id):
        folders(rows, batch_id)
        if failures:
            raise OSError(failures.pop())

    def run():
        events, ledger = stream_events(spark, f"{tmp_path}/in"), SinkLedger(spark, f"{tmp_path}/ledger")
        sinks = {"plain": lambda rows, n: appended.extend(r.seq for r in rows.collect()), "half": half}
        stream_fanout(events, sinks, ledger).option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception):  # noqa: B017
        run()
    run()
    run()
    rows = read_events(spark, f"{tmp_path}/in").count()
    assert len(appended) == rows == spark.read.parquet(f"{tmp_path}/out").count() > 0


def test_seq_without_logs(spark):
    rows = random_events(3, jobs=3, n=30)
    df = frame(spark, rows).select(F.col("event.job_id").alias("job_id"), F.col("seq").alias("at"), "type")
    numbered = assign_seq(df, ["at"]).collect()
    expected = {}
    for job in ("j0", "j1", "j2"):
        kept = sorted(r[0] for r in rows if r[4]["job_id"] == job and r[3] != "STEP_LOG")
        expected.update({(job, at): i for i, at in enumerate(kept)})
    assert {(r.job_id, r["at"]): r.seq for r in numbered} == expected


def test_stderr_tail(spark):
    rows = [envelope(0, "STEP_STARTING", step="a"), envelope(1, "STEP_LOG", step="a", stream="stderr", line="old")]
    rows += [envelope(2, "STEP_FINISHED", step="a"), envelope(3, "STEP_STARTING", step="a")]
    rows += [envelope(4 + i, "STEP_LOG", step="a", stream="stderr", line=f"l{i}") for i in range(25)]
    rows += [envelope(40, "STEP_LOG", step="a", stream="stdout", line="out"), envelope(41, "STEP_FAILED", step="a", exit_code=1)]
    rows += [envelope(42, "STEP_STARTING", step="b"), envelope(43, "STEP_LOG", step="b", stream="stderr", line="fine")]
    tail = failed_stderr_tail(frame(spark, rows)).orderBy("pos").collect()
    assert [(r.step_id, r.pos, r.line) for r in tail] == [("a", i + 1, f"l{i + 5}") for i in range(20)]
