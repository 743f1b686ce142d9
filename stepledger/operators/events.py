"""Operators over event envelopes ``(seq, timestamp, version, type, event STRUCT)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepledger import schemas as S
from stepledger.functions.formats import step_detail
from stepledger.scale import number_rows

STDERR_TAIL = 20


def drop_log_events(events: DataFrame) -> DataFrame:
    """Log lines are high-volume and change no state, so they go first."""
    return events.filter(F.col("type") != S.STEP_LOG)


def assign_seq(events: DataFrame, order: list) -> DataFrame:
    """Number the non-log events of each job from 0; ``order`` must order a job's events totally."""
    return number_rows(drop_log_events(events), ["job_id"], order, "seq")


def event_envelope(events: DataFrame) -> DataFrame:
    """Wrap flat events that carry ``seq`` and ``timestamp``; fields an event lacks become null."""
    have = set(events.columns)

    def field(name: str, data_type: str) -> Column:
        if name == "event":
            return F.col("type").alias(name)
        if name == "step":
            known = F.struct(F.col("step_id").alias("id"), F.col("display_name").alias("display_name"))
            return F.when(F.col("step_id").isNotNull(), known).alias(name)
        value = F.col(name) if name in have else F.lit(None)
        return value.cast(data_type).alias(name)

    return events.select(
        F.col("seq").cast("bigint").alias("seq"),
        "timestamp",
        F.lit(1).alias("version"),
        "type",
        F.struct(*[field(name, data_type) for name, data_type in S.EVENT.items()]).alias("event"),
    )


def artifact_totals(events: DataFrame) -> DataFrame:
    """Bytes of the finished steps per job; a job whose steps were all skipped has 0."""
    size = F.when(F.col("type") == S.STEP_FINISHED, F.col("event.artifact_size"))
    return events.groupBy(F.col("event.job_id").alias("job_id")).agg(
        F.sum(F.coalesce(size, F.lit(0))).alias("total_artifact_size")
    )


def retry_counts(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("type") == S.STEP_RETRYING)
        .groupBy(F.col("event.job_id").alias("job_id"), F.col("event.step.id").alias("step_id"))
        .agg(F.max("event.attempt").alias("attempt"), F.max("event.max_retries").alias("max_retries"))
    )


def skip_counts(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("type") == S.STEP_SKIPPED)
        .groupBy(F.col("event.job_id").alias("job_id"), F.col("event.reason").alias("reason"))
        .agg(F.count(F.lit(1)).alias("skips"))
    )


def step_details(events: DataFrame) -> DataFrame:
    """The progress text of every step event that has one."""
    e = F.col("event")
    return (
        drop_log_events(events)
        .filter(e["step"].isNotNull())
        .select(
            e["job_id"].alias("job_id"),
            "seq",
            "type",
            e["step"]["id"].alias("step_id"),
            step_detail(
                F.col("type"),
                e["step"]["display_name"],
                e["duration_ms"],
                e["artifact_size"],
                e["exit_code"],
                e["attempt"],
                e["max_retries"],
                e["reason"],
            ).alias("detail"),
        )
        .filter(F.col("detail").isNotNull())
    )


def failed_stderr_tail(events: DataFrame, lines: int = STDERR_TAIL) -> DataFrame:
    """The last stderr lines of every step that ends failed, oldest first (``pos`` from 1).

    A finished step drops what it has written so far. Lines after the last finish are the newest lines of
    the step, so the tail is taken first, per map task, and only these few lines are compared with the
    step's history.
    """
    job, step = F.col("event.job_id").alias("job_id"), F.col("event.step.id").alias("step_id")
    newest_first = Window.partitionBy("job_id", "step_id").orderBy(F.desc("seq"))
    tail = (
        events.filter((F.col("type") == S.STEP_LOG) & (F.col("event.stream") == "stderr"))
        .select(job, step, "seq", F.col("event.line").alias("line"))
        .withColumn("_back", F.row_number().over(newest_first))
        .filter(F.col("_back") <= lines)
    )

    shown = (S.STEP_STARTING, S.STEP_SKIPPED)
    changes = events.filter(F.col("type").isin(*S.STEP_STATE_TYPES, S.STEP_WOULD_RUN)).select(
        job, step, "seq", "type"
    )
    listed = events.filter(F.col("type") == S.PIPELINE_START).select(
        job, F.explode("event.steps.id").alias("step_id"), "seq", "type"
    )
    known = F.col("type").isin(S.PIPELINE_START, *shown)
    seq_if = lambda test: F.max(F.when(test, F.col("seq")))
    steps = (
        changes.unionByName(listed)
        .groupBy("job_id", "step_id")
        .agg(
            F.max("seq").alias("_last"),
            seq_if(F.col("type") == S.STEP_FAILED).alias("_failed"),
            seq_if(F.col("type") == S.STEP_FINISHED).alias("_finished"),
            F.min(F.when(known, F.col("seq"))).alias("_known"),
        )
        .filter((F.col("_failed") == F.col("_last")) & (F.col("_known") < F.col("_failed")))
    )
    oldest_first = Window.partitionBy("job_id", "step_id").orderBy("seq")
    return (
        tail.join(steps, ["job_id", "step_id"])
        .filter(F.col("_finished").isNull() | (F.col("seq") > F.col("_finished")))
        .withColumn("pos", F.row_number().over(oldest_first))
        .select("job_id", "step_id", "pos", "seq", "line")
    )
