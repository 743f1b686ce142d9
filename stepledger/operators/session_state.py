"""The fold of events into sessions as an aggregation that can go on forever.

A row of state has one of three kinds: of a job, of a step of a job, or of a step, a display name and a block of event numbers. All
its columns are built-in aggregates (greatest, least, union of bits), so the same function folds a batch and a stream,
rows of one key can be merged in any order, and an event that comes twice changes nothing.

A restart needs no look back: of the events that set a field only the last counts, and it counts if it is younger than the
job's last start, which can only move forward. The one exception is the display name, which is that of the *first* event
since the start. A step that has not been seen before the start, or has had one name only, has it at hand. For the others the
third kind of row knows the exact numbers of the events with each name, as bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger import schemas as S
from stepledger.operators.sessions import SLICE, STEP_STATUS, folded_events, listed_steps, sessions_of_jobs, setters

JOB, STEP, NAME = 0, 1, 2
KEYS = ["kind", "job_id", "step_id", "name", "block"]
#: Event numbers of a row of the third kind; their bits stay clear of the sign.
BLOCK = 32
_JOB_COLUMNS = ["start", "born", "first_step", "end"]


def _status_of(type_: Column) -> Column:
    found = F.lit(None).cast("string")
    for event_type, status in STEP_STATUS.items():
        found = F.when(type_ == event_type, F.lit(status)).otherwise(found)
    return found


def session_state(events: DataFrame) -> DataFrame:
    """The state that ``events`` give, a row per key; over a stream an aggregation for the update mode."""
    is_start = F.col("type") == S.PIPELINE_START
    is_step = F.col("type").isin(*S.STEP_STATE_TYPES)
    is_end = F.col("type").isin(*S.TERMINAL_TYPES)
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def key(kind: int, *rest: Column) -> Column:
        values = (F.lit(kind), *rest)
        return F.struct(*[v.alias(n) for v, n in zip(values, ("kind", "step_id", "name", "block"), strict=True)])

    of_job = key(JOB, no_text, no_text, no_number)
    of_step = key(STEP, F.col("step_id"), no_text, no_number)
    of_name = key(NAME, F.col("step_id"), F.col("display_name"), F.expr(f"seq div {BLOCK}L"))
    keys = F.when(is_step, F.array(of_job, of_step, of_name)).otherwise(F.array(of_job))
    # One instant per batch of a stream.
    keyed = folded_events(events, SLICE).select("*", F.explode(keys).alias("key"), F.current_timestamp().alias("now"))
    kind = F.col("key.kind")
    job, step = kind == JOB, kind == STEP
    last = {n: F.max(F.when(step & when, F.struct("seq", F.col(n).alias("value")))).alias(n) for n, when in setters().items()}
    label = F.coalesce(F.concat(F.lit("="), "display_name"), F.lit(""))
    return keyed.groupBy(kind.alias("kind"), "job_id", F.col("key.step_id").alias("step_id"), F.col("key.name").alias("name"), F.col("key.block").alias("block")).agg(
        F.max(F.when(job & is_start, F.struct("seq", "timestamp", "workspace_id", "pipeline_name", "steps", F.col("now").alias("arrived")))).alias("start"),
        F.min(F.when(job & (is_start | is_step), F.struct("seq", "timestamp"))).alias("born"),
        F.min(F.when(job & is_step, F.col("seq"))).alias("first_step"),
        F.max(F.when(job & is_end, F.struct("seq", "type", "timestamp"))).alias("end"),
        F.max(F.when(step, F.struct("seq", _status_of(F.col("type")).alias("value")))).alias("status"),
        *last.values(),
        F.min(F.when(step, F.struct("seq", "display_name"))).alias("first"),
        F.min(F.when(step, label)).alias("name_low"),
        F.max(F.when(step, label)).alias("name_high"),
        F.bit_or(F.when(kind == NAME, F.expr(f"shiftleft(1L, cast(seq % {BLOCK} AS int))"))).alias("bits"),
        F.min("now").alias("seen"),
        F.max("now").alias("touched"),
    )


def merge_state(rows: DataFrame) -> DataFrame:
    """One row per key of the rows of several batches; ``since`` is the first of the batches that touched it."""
    greatest = ["start", "end", "status", *setters(), "name_high", "touched"]
    least = ["born", "first_step", "first", "name_low", "seen"]
    return rows.groupBy(*KEYS).agg(
        *[F.max(n).alias(n) for n in greatest],
        *[F.min(n).alias(n) for n in least],
        F.bit_or("bits").alias("bits"),
        F.min("touched").alias("since"),
    )


def state_sessions(state: DataFrame) -> DataFrame:
    """One row per job that has a session."""
    return sessions_of_jobs(state.filter(F.col("kind") == JOB))


def _live_steps(state: DataFrame) -> DataFrame:
    """Steps with an event since their job's last start, and that start's number."""
    jobs = state.filter(F.col("kind") == JOB).select("job_id", F.col("start.seq").alias("start_seq"))
    steps = state.filter(F.col("kind") == STEP).drop(*_JOB_COLUMNS, "kind", "name", "block", "bits")
    return steps.join(jobs, "job_id").filter(F.col("start_seq").isNull() | (F.col("status.seq") > F.col("start_seq")))


def unsettled_names(state: DataFrame) -> DataFrame:
    """``(job_id, step_id, start_seq)`` of steps seen before and after a restart under several names."""
    several = F.col("name_low") != F.col("name_high")
    return _live_steps(state).filter(several & (F.col("first.seq") <= F.col("start_seq"))).select("job_id", "step_id", "start_seq")


def first_names(unsettled: DataFrame, names: DataFrame) -> DataFrame:
    """``(job_id, step_id, found)``: the name of the first event after the start, from merged rows of the third kind."""
    older = F.greatest(F.lit(0), F.col("start_seq") + 1 - F.col("block") * BLOCK)  # bits of events up to the start
    kept = F.when(older < BLOCK, F.expr("shiftright(bits, cast(older AS int))")).otherwise(F.lit(0))
    lowest = F.bit_count(F.expr("(kept & -kept) - 1"))
    return (
        names.filter(F.col("kind") == NAME)
        .select("job_id", "step_id", "name", "block", "bits")
        .join(unsettled, ["job_id", "step_id"])
        .withColumn("older", older)
        .withColumn("kept", kept)
        .filter("kept > 0")
        .groupBy("job_id", "step_id")
        .agg(F.min_by(F.struct("name"), F.col("block") * BLOCK + F.col("older") + lowest).alias("found"))
    )


def state_steps(state: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row per step of each session; ``names`` has the third kind of row where ``state`` lacks some of them."""
    live = _live_steps(state)
    after = lambda n: F.col("start_seq").isNull() | (F.col(f"{n}.seq") > F.col("start_seq"))
    seen = live.join(first_names(unsettled_names(state), state if names is None else names), ["job_id", "step_id"], "left").select(
        "job_id",
        "step_id",
        F.coalesce("found", F.struct(F.col("first.display_name").alias("name")))["name"].alias("first_name"),
        F.col("status.value").alias("status"),
        *[F.when(after(n), F.col(f"{n}.value")).alias(n) for n in setters()],
    )
    return listed_steps(state.filter(F.col("kind") == JOB), seen)
