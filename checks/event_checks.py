"""Events, sessions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import Views, check
from stepledger.functions.formats import reason_label
from stepledger.operators import events as E
from stepledger.operators.sessions import current_session, fold_session_steps, fold_sessions
from stepledger.sources.events import envelope_lines, read_events, write_events, write_fanout
from stepledger.sources.ledger import SinkLedger
from stepledger.storage import materialize, work_path
from stepledger.streaming.events import batch_folders, stream_events, stream_fanout, stream_log_tail, tail_events
from stepledger.streaming.sessions import (
    compact_session_state,
    session_snapshot,
    session_updates,
    stored_state,
    write_session_state,
)

_FOLD = """
WITH starts AS (SELECT job_id, max(seq) AS s, arg_max(ts, seq) AS start_at, arg_max(workspace_id, seq) AS ws, arg_max(k, seq) AS k
    FROM ev WHERE type = 'PIPELINE_START' GROUP BY job_id),
live AS (SELECT ev.* FROM ev LEFT JOIN starts USING (job_id)
    WHERE (s IS NULL OR seq > s) AND type IN ('STEP_STARTING', 'STEP_SKIPPED', 'STEP_FINISHED', 'STEP_FAILED')),
seen AS (SELECT job_id, step_id, arg_min(display_name, seq) AS display_name,
    CASE arg_max(type, seq) WHEN 'STEP_STARTING' THEN 'running' WHEN 'STEP_SKIPPED' THEN 'skipped' WHEN 'STEP_FINISHED' THEN 'finished' ELSE 'failed' END AS status,
    arg_max(run_id, seq) FILTER (type IN ('STEP_SKIPPED', 'STEP_FINISHED') AND run_id IS NOT NULL) AS run_id,
    arg_max(exit_code, seq) FILTER (type = 'STEP_FAILED') AS exit_code,
    arg_max(duration_ms, seq) FILTER (type = 'STEP_FINISHED') AS duration_ms,
    arg_max(artifact_size, seq) FILTER (type = 'STEP_FINISHED') AS artifact_size
    FROM live GROUP BY job_id, step_id),
listed AS (SELECT job_id, concat('s', n) AS step_id, concat('Listed ', n) AS listed_name
    FROM (SELECT job_id, unnest(range(0, k % 7 + 1)) AS n FROM starts)),
session_steps AS (SELECT job_id, step_id, coalesce(listed_name, display_name) AS display_name, coalesce(status, 'pending') AS status,
    coalesce(run_id, '-') AS run_id, coalesce(exit_code, -1) AS exit_code, coalesce(duration_ms, -1) AS duration_ms, coalesce(artifact_size, -1) AS artifact_size
    FROM seen FULL JOIN listed USING (job_id, step_id)),
born AS (SELECT job_id, min(seq) FILTER (type <> 'PIPELINE_START') AS first_step, min(ts) AS inserted_at FROM ev
    WHERE type IN ('PIPELINE_START', 'STEP_STARTING', 'STEP_SKIPPED', 'STEP_FINISHED', 'STEP_FAILED') GROUP BY job_id),
ends AS (SELECT job_id, max(seq) AS e, arg_max(type, seq) AS end_type, arg_max(ts, seq) AS end_at FROM ev WHERE type IN ('PIPELINE_FINISHED', 'PIPELINE_FAILED') GROUP BY job_id),
sessions AS (SELECT job_id, coalesce(ws, '') AS workspace_id,
    CASE WHEN e > coalesce(s, first_step) THEN CASE end_type WHEN 'PIPELINE_FINISHED' THEN 'completed' ELSE 'failed' END ELSE 'running' END AS status,
    start_at AS started_at, CASE WHEN e > coalesce(s, first_step) THEN end_at END AS finished_at, inserted_at
    FROM born LEFT JOIN starts USING (job_id) LEFT JOIN ends USING (job_id) WHERE coalesce(s, first_step) IS NOT NULL)
"""
_SESSIONS_SQL = _FOLD + """
SELECT job_id, workspace_id, status, coalesce(epoch_us(started_at) // 1000, -1) AS started_ms, coalesce(epoch_us(finished_at) // 1000, -1) AS finished_ms,
  epoch_us(inserted_at) // 1000 AS inserted_ms FROM sessions
"""
_SESSION_STEPS_SQL = _FOLD + "SELECT * FROM session_steps"


def _sessions(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "job_id",
        "workspace_id",
        "status",
        F.coalesce(F.unix_millis("started_at"), F.lit(-1)).alias("started_ms"),
        F.coalesce(F.unix_millis("finished_at"), F.lit(-1)).alias("finished_ms"),
        F.unix_millis("inserted_at").alias("inserted_ms"),
    )


def _session_steps(steps: DataFrame) -> DataFrame:
    return steps.select(
        "job_id",
        "step_id",
        "display_name",
        "status",
        F.coalesce("run_id", F.lit("-")).alias("run_id"),
        *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("exit_code", "duration_ms", "artifact_size")],
    )


@check("a12_sessions", _SESSIONS_SQL)
def sessions(v: Views) -> DataFrame:
    return _sessions(fold_sessions(v.envelopes()))


@check("a12_session_steps", _SESSION_STEPS_SQL)
def session_steps(v: Views) -> DataFrame:
    return _session_steps(fold_session_steps(materialize(v.envelopes(), "events")))


@check(
    "o4_current_session",
    _FOLD
    + """
SELECT workspace_id, arg_max(job_id, struct_pack(r := status = 'running', i := inserted_at, j := job_id)) AS job_id,
  arg_max(status, struct_pack(r := status = 'running', i := inserted_at, j := job_id)) AS status FROM sessions GROUP BY workspace_id
""",
)
def current(v: Views) -> DataFrame:
    return current_session(fold_sessions(v.envelopes())).select("workspace_id", "job_id", "status")


def _written_events(v: Views, malformed: bool = False) -> str:
    """The envelopes as NDJSON files; on request with broken and empty lines in between."""
    path = work_path(v.spark, "ndjson")
    events = v.envelopes()
    if malformed:
        lines = envelope_lines(events).withColumn(
            "value",
            F.explode(F.array(F.concat(F.lit("  "), "value", F.lit("\r")), F.lit(""), F.substring("value", 1, 40))),
        )
        lines.write.option("lineSep", "\n").text(path)
    else:
        write_events(events, path)
    return path


_PER_TYPE_SQL = """
SELECT type, count(*) AS n, sum(seq) AS seq_sum, count(DISTINCT job_id) AS jobs,
  sum(CASE WHEN type = 'STEP_FINISHED' THEN artifact_size ELSE 0 END) AS bytes, sum(epoch_us(ts) // 1000) AS at_ms FROM ev GROUP BY type
"""


def _per_type(events: DataFrame) -> DataFrame:
    size = F.when(F.col("type") == "STEP_FINISHED", F.col("event.artifact_size")).otherwise(F.lit(0))
    return events.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("seq").alias("seq_sum"),
        F.count_distinct("event.job_id").alias("jobs"),
        F.sum(size).alias("bytes"),
        F.sum(F.unix_millis("timestamp")).alias("at_ms"),
    )


@check("s4_read_events", _PER_TYPE_SQL)
def read(v: Views) -> DataFrame:
    return _per_type(read_events(v.spark, _written_events(v, malformed=True)))


@check(
    "s5_write_events",
    "SELECT job_id, seq, type, 1 AS version, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS at FROM ev",
)
def write(v: Views) -> DataFrame:
    lines = v.spark.read.text(_written_events(v))
    fields = {"job_id": "$.event.jobId", "seq": "$.seq", "type": "$.type", "version": "$.version", "at": "$.timestamp"}
    return lines.select(
        *[
            F.get_json_object("value", path).cast("bigint" if name in ("seq", "version") else "string").alias(name)
            for name, path in fields.items()
        ]
    )


@check(
    "s16_write_fanout",
    "SELECT 'ndjson' AS sink, count(*) AS n, sum(seq) AS seq_sum FROM ev UNION ALL SELECT 'parquet', count(*), sum(seq) FROM ev",
)
def fanout(v: Views) -> DataFrame:
    ndjson, parquet = work_path(v.spark, "sink"), work_path(v.spark, "sink")
    write_fanout(v.envelopes(), [lambda df: write_events(df, ndjson), lambda df: df.write.parquet(parquet)])
    both = {"ndjson": read_events(v.spark, ndjson), "parquet": v.spark.read.parquet(parquet)}
    counts = [
        df.agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum")).select(F.lit(name).alias("sink"), "n", "seq_sum")
        for name, df in both.items()
    ]
    return counts[0].unionByName(counts[1])


@check(
    "p20_event_envelope",
    """SELECT job_id, seq, type, 1 AS version, workspace_id, CASE WHEN type LIKE 'STEP_%' THEN step_id ELSE '-' END AS step_id,
    CASE WHEN type LIKE 'STEP_%' THEN display_name ELSE '-' END AS display_name, CASE WHEN type = 'PIPELINE_START' THEN k % 7 + 1 ELSE 0 END AS listed FROM ev""",
)
def envelope(v: Views) -> DataFrame:
    e = F.col("event")
    return v.envelopes().select(
        e["job_id"].alias("job_id"),
        "seq",
        e["event"].alias("type"),
        "version",
        e["workspace_id"].alias("workspace_id"),
        F.coalesce(e["step"]["id"], F.lit("-")).alias("step_id"),
        F.coalesce(e["step"]["display_name"], F.lit("-")).alias("display_name"),
        F.coalesce(F.size(e["steps"]), F.lit(0)).alias("listed"),
    )


@check(
    "p21_reason_label",
    "SELECT event_id, CASE reason WHEN 'cached' THEN '(cached)' WHEN 'condition' THEN '(condition)' ELSE '(dependency skipped)' END AS label FROM v_events",
)
def label(v: Views) -> DataFrame:
    return v.events().select("event_id", reason_label(F.col("reason")).alias("label"))


DURATION_SQL = """CASE WHEN {ms} < 1000 THEN {ms} || 'ms'
  WHEN {ms} < 60000 THEN CASE WHEN {ms} % 1000 = 250 THEN ({ms} // 1000) || '.3' ELSE printf('%.1f', {ms} / 1000.0) END || 's'
  ELSE ({ms} // 60000) || 'm ' || (({ms} % 60000 + 500) // 1000) || 's' END"""
SIZE_SQL = """CASE WHEN {n} < 1024 THEN {n} || ' B'
  WHEN {n} < 1048576 THEN (({n} * 10 + 512) // 1024 // 10) || '.' || (({n} * 10 + 512) // 1024 % 10) || ' KB'
  WHEN {n} < 1073741824 THEN (({n} * 10 + 524288) // 1048576 // 10) || '.' || (({n} * 10 + 524288) // 1048576 % 10) || ' MB'
  ELSE (({n} * 10 + 536870912) // 1073741824 // 10) || '.' || (({n} * 10 + 536870912) // 1073741824 % 10) || ' GB' END"""


@check(
    "p22_step_detail",
    f"""SELECT job_id, seq, CASE type
    WHEN 'STEP_FINISHED' THEN ' (' || {DURATION_SQL.format(ms='duration_ms')} || CASE WHEN artifact_size > 0 THEN ', ' || {SIZE_SQL.format(n='artifact_size')} ELSE '' END || ')'
    WHEN 'STEP_FAILED' THEN ' (exit ' || exit_code || ')'
    WHEN 'STEP_RETRYING' THEN display_name || ' (retry ' || attempt || '/' || max_retries || ')'
    WHEN 'STEP_SKIPPED' THEN ' ' || CASE reason WHEN 'cached' THEN '(cached)' WHEN 'condition' THEN '(condition)' ELSE '(dependency skipped)' END
    ELSE ' (would run)' END AS detail
    FROM ev WHERE type IN ('STEP_FINISHED', 'STEP_FAILED', 'STEP_RETRYING', 'STEP_SKIPPED', 'STEP_WOULD_RUN')""",
)
def detail(v: Views) -> DataFrame:
    return E.step_details(v.envelopes()).select("job_id", "seq", "detail")


@check("f4_drop_log_events", "SELECT type, count(*) AS n FROM v_events WHERE type <> 'STEP_LOG' GROUP BY type")
def drop_logs(v: Views) -> DataFrame:
    return E.drop_log_events(v.events()).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@check(
    "a9_artifact_totals",
    "SELECT job_id, sum(CASE WHEN type = 'STEP_FINISHED' THEN artifact_size ELSE 0 END) AS total_artifact_size FROM ev GROUP BY job_id",
)
def totals(v: Views) -> DataFrame:
    return E.artifact_totals(v.envelopes())


@check(
    "a14_retry_counts",
    "SELECT job_id, step_id, max(attempt) AS attempt, max(max_retries) AS max_retries FROM ev WHERE type = 'STEP_RETRYING' GROUP BY ALL",
)
def retries(v: Views) -> DataFrame:
    return E.retry_counts(v.envelopes())


@check("a15_skip_counts", "SELECT job_id, reason, count(*) AS skips FROM ev WHERE type = 'STEP_SKIPPED' GROUP BY ALL")
def skips(v: Views) -> DataFrame:
    return E.skip_counts(v.envelopes())


@check("w2_assign_seq", "SELECT event_id, job_id, seq FROM ev")
def seq(v: Views) -> DataFrame:
    return E.assign_seq(v.events(), ["ts", "event_id"]).select("event_id", "job_id", "seq")


@check(
    "w4_failed_stderr_tail",
    """
WITH status_events AS (SELECT job_id, step_id, seq, type FROM ev_all WHERE type IN ('STEP_STARTING', 'STEP_SKIPPED', 'STEP_FINISHED', 'STEP_FAILED', 'STEP_WOULD_RUN')
  UNION ALL SELECT job_id, concat('s', n), seq, 'PIPELINE_START' FROM (SELECT job_id, seq, unnest(range(0, k % 7 + 1)) AS n FROM ev_all WHERE type = 'PIPELINE_START')),
final AS (SELECT job_id, step_id, arg_max(type, seq) AS last_type, max(seq) AS last, max(seq) FILTER (type = 'STEP_FINISHED') AS finished,
  min(seq) FILTER (type IN ('PIPELINE_START', 'STEP_STARTING', 'STEP_SKIPPED')) AS known FROM status_events GROUP BY ALL),
kept AS (SELECT l.job_id, l.step_id, l.seq, l.line, row_number() OVER (PARTITION BY l.job_id, l.step_id ORDER BY l.seq DESC) AS back
  FROM ev_all l JOIN final f USING (job_id, step_id)
  WHERE l.type = 'STEP_LOG' AND l.stream = 'stderr' AND last_type = 'STEP_FAILED' AND known < last AND (finished IS NULL OR l.seq > finished))
SELECT job_id, step_id, seq, line, row_number() OVER (PARTITION BY job_id, step_id ORDER BY seq) AS pos FROM kept WHERE back <= 20
""",
)
def stderr_tail(v: Views) -> DataFrame:
    return E.failed_stderr_tail(materialize(v.all_envelopes(), "events"))


def _run_to_end(writer, path: str) -> None:
    query = writer.option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination()


@check("t1_stream_events", _PER_TYPE_SQL)
def stream(v: Views) -> DataFrame:
    path, out = _written_events(v, malformed=True), work_path(v.spark, "streamed")
    events = tail_events(v.spark, path, quiet_seconds=0)
    _run_to_end(events.writeStream.format("parquet").option("path", out), work_path(v.spark, "progress"))
    return _per_type(v.spark.read.schema(events.schema).parquet(out))


def _streamed_state(v: Views) -> tuple[str, str]:
    """The log that a stream has written, and what compaction makes of its first half."""
    path, out, half = _written_events(v), work_path(v.spark, "sessions"), work_path(v.spark, "half")
    _run_to_end(write_session_state(stream_events(v.spark, path, files_per_trigger=4), out), work_path(v.spark, "progress"))
    stored = stored_state(v.spark, out)
    middle = stored.agg(F.floor(F.max("batch") / 2)).first()[0]
    stored.filter(F.col("batch") <= middle).write.partitionBy("batch", "kind").parquet(half)
    base = work_path(v.spark, "compacted")
    compact_session_state(v.spark, half, base)
    return out, base


@check("t2_stream_sessions", _SESSION_STEPS_SQL)
def streamed_steps(v: Views) -> DataFrame:
    return _session_steps(session_snapshot(v.spark, *_streamed_state(v))[1])


@check("t3_session_snapshot", _SESSIONS_SQL)
def snapshot(v: Views) -> DataFrame:
    """Sessions with news after the first batch, and the others from the snapshot."""
    out, base = _streamed_state(v)
    changed = session_updates(v.spark, out, 0, base)[0]
    whole = session_snapshot(v.spark, out, base)[0]
    return _sessions(changed.unionByName(whole.join(changed, "job_id", "left_anti").select(changed.columns)))


@check(
    "t4_stream_log_tail",
    "SELECT job_id, step_id, stream, concat('[', step_id, '] ', line) AS line FROM v_events WHERE type = 'STEP_LOG'",
)
def log_tail(v: Views) -> DataFrame:
    path, out = work_path(v.spark, "ndjson"), work_path(v.spark, "tail")
    write_events(v.all_envelopes(), path)
    lines = stream_log_tail(tail_events(v.spark, path))
    _run_to_end(lines.writeStream.format("parquet").option("path", out), work_path(v.spark, "progress"))
    return v.spark.read.schema(lines.schema).parquet(out)


@check(
    "t5_stream_fanout",
    "SELECT 'all' AS sink, count(*) AS n, sum(seq) AS seq_sum FROM ev UNION ALL SELECT 'failed', count(*), sum(seq) FROM ev WHERE type = 'STEP_FAILED'",
)
def streamed_fanout(v: Views) -> DataFrame:
    path = _written_events(v)
    outs = {"all": work_path(v.spark, "sink"), "failed": work_path(v.spark, "sink")}
    sinks = {
        "all": batch_folders(outs["all"], lambda df, folder: df.write.parquet(folder)),
        "failed": batch_folders(outs["failed"], lambda df, folder: df.filter("type = 'STEP_FAILED'").write.parquet(folder)),
    }
    events = stream_events(v.spark, path, files_per_trigger=4)
    _run_to_end(stream_fanout(events, sinks, SinkLedger(v.spark, work_path(v.spark, "ledger"))), work_path(v.spark, "progress"))
    counts = [
        v.spark.read.parquet(out)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))
        .select(F.lit(name).alias("sink"), "n", "seq_sum")
        for name, out in outs.items()
    ]
    return counts[0].unionByName(counts[1])
