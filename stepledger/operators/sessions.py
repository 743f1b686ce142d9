"""The batch fold of events into sessions, and queries over sessions.

Rules of the fold: a start event replaces the job's session; step events create a missing session or step;
a step's status is that of its last event, its other fields are the last values given and survive later
events; the display name is the first one seen; terminal events count only once the session exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger import schemas as S
from stepledger.storage import materialize

# Events of one job that share a join key; see _restarted_slices.
SLICE = 100_000

STEP_STATUS = {
    S.STEP_STARTING: "running",
    S.STEP_SKIPPED: "skipped",
    S.STEP_FINISHED: "finished",
    S.STEP_FAILED: "failed",
}


def folded_events(events: DataFrame, slice_rows: int) -> DataFrame:
    e = F.col("event")
    return events.filter(F.col("type").isin(*S.FOLDED_TYPES)).select(
        e["job_id"].alias("job_id"),
        F.floor(F.col("seq") / slice_rows).cast("bigint").alias("slice"),
        "seq",
        "timestamp",
        "type",
        e["workspace_id"].alias("workspace_id"),
        e["pipeline_name"].alias("pipeline_name"),
        e["steps"].alias("steps"),
        e["step"]["id"].alias("step_id"),
        e["step"]["display_name"].alias("display_name"),
        e["run_id"].alias("run_id"),
        e["duration_ms"].alias("duration_ms"),
        e["artifact_size"].alias("artifact_size"),
        e["exit_code"].alias("exit_code"),
    )


def _pieces(folded: DataFrame) -> DataFrame:
    """Job-level facts per (job, slice)."""
    is_start = F.col("type") == S.PIPELINE_START
    is_step = F.col("type").isin(*S.STEP_STATE_TYPES)
    is_end = F.col("type").isin(*S.TERMINAL_TYPES)
    return folded.groupBy("job_id", "slice").agg(
        F.max(F.when(is_start, F.struct("seq", "timestamp", "workspace_id", "pipeline_name", "steps"))).alias("start"),
        F.min(F.when(is_start | is_step, F.struct("seq", "timestamp"))).alias("born"),
        F.min(F.when(is_step, F.col("seq"))).alias("first_step"),
        F.max(F.when(is_end, F.struct("seq", "type", "timestamp"))).alias("end"),
    )


def _jobs(pieces: DataFrame) -> DataFrame:
    """The same facts per job."""
    return pieces.groupBy("job_id").agg(
        F.max("start").alias("start"),
        F.min("born").alias("born"),
        F.min("first_step").alias("first_step"),
        F.max("end").alias("end"),
    )


def _restarted_slices(pieces: DataFrame, slice_rows: int) -> DataFrame:
    """Start position of the restarted jobs, repeated for each slice that may hold older events.

    Joining on (job, slice) instead of the job alone keeps a job with very many events spread over many
    tasks. Jobs that start once, with their first event, need no filter and do not occur here.
    """
    restarted = _jobs(pieces).filter(F.col("start.seq") > F.col("first_step")).select(
        "job_id", F.col("start.seq").alias("start_seq")
    )
    return (
        pieces.select("job_id", "slice")
        .join(restarted, "job_id")
        .filter(F.col("slice") <= F.floor(F.col("start_seq") / slice_rows))
    )


def sessions_of_jobs(jobs: DataFrame) -> DataFrame:
    created = F.coalesce(F.col("start.seq"), F.col("first_step"))
    end = F.when(F.col("end.seq") > created, F.col("end"))
    return jobs.filter(created.isNotNull()).select(
        "job_id",
        F.coalesce("start.workspace_id", F.lit("")).alias("workspace_id"),
        F.col("start.pipeline_name").alias("pipeline_name"),
        F.when(end["type"] == S.PIPELINE_FINISHED, F.lit("completed"))
        .when(end["type"] == S.PIPELINE_FAILED, F.lit("failed"))
        .otherwise(F.lit("running"))
        .alias("status"),
        F.col("start.timestamp").alias("started_at"),
        end["timestamp"].alias("finished_at"),
        F.col("born.timestamp").alias("inserted_at"),
    )


def _last(value: str, when: Column) -> Column:
    return F.max_by(F.col(value), F.when(when, F.col("seq"))).alias(value)


def setters() -> dict[str, Column]:
    """For each field of a step besides its status, the events that set it."""
    finished = F.col("type") == S.STEP_FINISHED
    return {
        "run_id": F.col("type").isin(S.STEP_SKIPPED, S.STEP_FINISHED) & (F.col("run_id") != ""),
        "exit_code": F.col("type") == S.STEP_FAILED,
        "duration_ms": finished & F.col("duration_ms").isNotNull(),
        "artifact_size": finished & F.col("artifact_size").isNotNull(),
    }


def _live(folded: DataFrame, pieces: DataFrame, slice_rows: int) -> DataFrame:
    """Step events after the last start of their job."""
    return (
        folded.filter(F.col("type").isin(*S.STEP_STATE_TYPES))
        .drop("timestamp", "workspace_id", "pipeline_name", "steps")
        .join(_restarted_slices(pieces, slice_rows), ["job_id", "slice"], "left")
        .filter(F.col("start_seq").isNull() | (F.col("seq") > F.col("start_seq")))
    )


def _session_steps(folded: DataFrame, pieces: DataFrame, slice_rows: int) -> DataFrame:
    type_ = F.col("type")
    status = F.when(type_ == S.STEP_STARTING, F.lit(STEP_STATUS[S.STEP_STARTING]))
    for event_type in (S.STEP_SKIPPED, S.STEP_FINISHED, S.STEP_FAILED):
        status = status.when(type_ == event_type, F.lit(STEP_STATUS[event_type]))

    live = _live(folded, pieces, slice_rows).withColumn("status", status)
    seen = live.groupBy("job_id", "step_id").agg(
        F.min_by("display_name", "seq").alias("first_name"),
        F.max_by("status", "seq").alias("status"),
        *[_last(value, when) for value, when in setters().items()],
    )
    return listed_steps(_jobs(pieces), seen)


def listed_steps(jobs: DataFrame, seen: DataFrame) -> DataFrame:
    """The steps that were ``seen`` and those that their job's last start lists, whose names win."""
    listed = (
        jobs.select("job_id", F.posexplode("start.steps").alias("at", "step"))
        .groupBy("job_id", F.col("step.id").alias("step_id"))
        .agg(F.max_by("step.display_name", "at").alias("listed_name"))
    )
    return seen.join(listed, ["job_id", "step_id"], "full").select(
        "job_id",
        "step_id",
        F.coalesce("listed_name", "first_name").alias("display_name"),
        F.coalesce("status", F.lit("pending")).alias("status"),
        "run_id",
        "exit_code",
        "duration_ms",
        "artifact_size",
    )


def fold_sessions(events: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """One row per job that has a session; ``inserted_at`` is the time of its first creating event."""
    return sessions_of_jobs(_jobs(_pieces(folded_events(events, slice_rows))))


def fold(events: DataFrame, slice_rows: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """``(sessions, session steps)``.

    The events are read twice: once for the job-level facts, which are written down because several joins
    need them and their true size decides how these joins run, and once for the steps.
    """
    folded = folded_events(events, slice_rows)
    pieces = materialize(_pieces(folded), "pieces")
    return sessions_of_jobs(_jobs(pieces)), _session_steps(folded, pieces, slice_rows)


def fold_session_steps(events: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """One row per step of each session."""
    return fold(events, slice_rows)[1]


def current_session(sessions: DataFrame) -> DataFrame:
    """Per workspace the running session, else the one inserted last (the newest of several)."""
    rank = F.struct((F.col("status") == "running").alias("running"), "inserted_at", "job_id")
    row = F.struct(*[F.col(c) for c in sessions.columns if c != "workspace_id"])
    return sessions.groupBy("workspace_id").agg(F.max_by(row, rank).alias("row")).select("workspace_id", "row.*")
