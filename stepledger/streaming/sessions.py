"""The fold of events into sessions over a stream, at the cost of what arrives.

The stream is an aggregation in update mode: the state store holds one row per job, step and block of names (see
``operators.session_state``), and a trigger touches the rows of its own events only. What it touched is appended to a table, the
*log*. A snapshot merges the log; a subscriber is served from the new rows of each batch. Compaction merges a log into one row per
key, so it grows with the sessions, not with their events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from stepledger import schemas as S
from stepledger.operators.session_state import JOB, KEYS, NAME, merge_state, session_state, state_sessions, state_steps, unsettled_names
from stepledger.storage import work_table

Deliver = Callable[[DataFrame, DataFrame, int], None]


def _log_schema(spark: SparkSession) -> str:
    events = spark.createDataFrame([], S.ddl({**S.ENVELOPE_DOCUMENT, "event": S.struct(S.EVENT)}))
    return S.ddl({f.name: f.dataType.simpleString() for f in session_state(events).schema} | {"batch": "bigint"})


def append_state(state: DataFrame, path: str, batch_id: int) -> None:
    """One batch of the log; the same batch again replaces itself. The kinds of rows lie apart, so readers skip those they need not.

    The rows are dealt to as many tasks as can run at once: written by the tasks of the state store, a batch would be a file per
    kind and partition of state, however few its rows.
    """
    tasks = state.sparkSession.sparkContext.defaultParallelism
    state.repartition(tasks, *KEYS).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={batch_id}")


def write_session_state(events: DataFrame, path: str) -> DataStreamWriter:
    """Fold a stream of events; every trigger appends the state it touched to the log ``path``."""
    return session_state(events).writeStream.outputMode("update").foreachBatch(lambda rows, n: append_state(rows, path, n))


def stored_state(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """The rows of a log, from a compacted log ``base`` and the batches after it."""
    schema = _log_schema(spark)
    found = spark.read.schema(schema).parquet(path)
    if base is None:
        return found
    merged = spark.read.schema(schema).parquet(base)
    until = merged.agg(F.max("batch")).first()[0]
    return merged.unionByName(found.filter(F.col("batch") > (-1 if until is None else until)))


def session_snapshot(spark: SparkSession, path: str, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(sessions, session steps)`` as of the last finished trigger."""
    state = merge_state(stored_state(spark, path, base))
    return state_sessions(state), state_steps(state)


def _of_jobs(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    return rows.join(jobs, "job_id", "left_semi")


def session_updates(spark: SparkSession, path: str, after_batch: int, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The current sessions and steps of all jobs that had events after a batch: what a subscriber missed."""
    rows = stored_state(spark, path, base)
    changed = rows.filter((F.col("batch") > after_batch) & (F.col("kind") == JOB)).select("job_id").distinct()
    state = merge_state(_of_jobs(rows, changed))
    return state_sessions(state), state_steps(state)


def _newly_restarted(state: DataFrame) -> DataFrame:
    """Jobs known before whose last start came with these rows: it may void steps that the rows do not name."""
    jobs = state.filter(F.col("kind") == JOB)
    return jobs.filter((F.col("seen") < F.col("since")) & (F.col("start.arrived") >= F.col("since"))).select("job_id")


def batch_updates(rows: DataFrame, log: Callable[[], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(sessions, steps)`` that new rows of state change, each as it is now.

    Of a job that was started anew all steps are given and its former ones are void; of the others only the steps that had
    events. ``log``, all rows so far, is opened only if a known job was started anew or a step changed its name after a restart.
    """
    state = merge_state(rows)
    restarted, unsettled = _newly_restarted(state), unsettled_names(state).select("job_id", "step_id")
    if not restarted.isEmpty():
        state = merge_state(_of_jobs(log(), restarted)).unionByName(state.join(restarted, "job_id", "left_anti"))
    names = None
    if not unsettled.isEmpty():
        names = merge_state(log().filter(F.col("kind") == NAME).join(unsettled, ["job_id", "step_id"], "left_semi"))
    fresh = state.filter((F.col("kind") == JOB) & (F.col("start.arrived") >= F.col("since"))).select("job_id")
    steps = state_steps(state, names)
    touched = rows.filter("step_id IS NOT NULL").select("job_id", "step_id").distinct()
    whole = _of_jobs(steps, fresh)
    changed = steps.join(fresh, "job_id", "left_anti").join(touched, ["job_id", "step_id"], "left_semi")
    return state_sessions(state), whole.unionByName(changed)


def stream_updates(spark: SparkSession, path: str, after_batch: int, deliver: Deliver, base: str | None = None) -> DataStreamWriter:
    """What a subscriber gets after a snapshot: for each further batch of the log, what it changed (see ``batch_updates``)."""
    arrivals = spark.readStream.schema(_log_schema(spark)).parquet(path).filter(F.col("batch") > after_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        with work_table(batch, "arrivals") as rows:
            last = rows.agg(F.max("batch")).first()[0]
            if last is not None:
                # Later batches may be in the log already; their turn comes.
                deliver(*batch_updates(rows, lambda: stored_state(spark, path, base).filter(F.col("batch") <= last)), batch_id)

    return arrivals.writeStream.foreachBatch(write)


def apply_updates(held: tuple[DataFrame, DataFrame], news: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A subscriber's sessions and steps after an update; a session with another start loses the steps that it had."""
    (sessions, steps), (new_sessions, new_steps) = held, news
    restarted = (
        new_sessions.select("job_id", F.col("started_at").alias("new_start"))
        .join(sessions.select("job_id", "started_at"), "job_id")
        .filter(~F.col("started_at").eqNullSafe(F.col("new_start")))
        .select("job_id")
    )
    stay = steps.join(restarted, "job_id", "left_anti").join(new_steps.select("job_id", "step_id"), ["job_id", "step_id"], "left_anti")
    return sessions.join(new_sessions.select("job_id"), "job_id", "left_anti").unionByName(new_sessions), stay.unionByName(new_steps)


def compact_session_state(spark: SparkSession, path: str, target: str, base: str | None = None) -> None:
    """Write a log as a new one ``target`` with one row per key, to be read as ``base`` from then on."""
    rows = stored_state(spark, path, base)
    last = rows.agg(F.max("batch")).first()[0]
    merged = merge_state(rows).drop("since")
    merged.write.partitionBy("kind").parquet(f"{target}/batch={-1 if last is None else last}")

