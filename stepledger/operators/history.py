"""Run history: what each workspace holds, what is current, what can go.

Sizes are always summed per run or per workspace before they are joined, so a run with very many files
contributes one row to a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepledger.functions.paths import depth_of, folder_at, resolve_path, slashes, within_boundary

W = "workspace_id"
_RUN = [W, "run_id"]
_STEP = [W, "step_id"]


def artifact_sizes(files: DataFrame) -> DataFrame:
    """Bytes below ``artifacts/`` per run."""
    return (
        files.filter(F.startswith("path", F.lit("artifacts/")))
        .groupBy(*_RUN)
        .agg(F.sum("length").alias("artifact_size"))
    )


def show(state: DataFrame, runs: DataFrame, running: DataFrame, files: DataFrame) -> DataFrame:
    """Status of every step per workspace, in the order ``section, pos``. Only files of current runs are summed.

    A live running marker hides the committed run of the step. A run without metadata or without a status
    is ``unknown``. Live steps that were never committed follow in section 1.
    """
    live = running.filter("alive").select(
        *_STEP, F.lit(True).alias("live"), F.col("step_name").alias("live_name"), F.col("started_at").alias("live_at")
    )
    has_meta = F.col("has_meta") if "has_meta" in runs.columns else F.lit(True)
    meta = runs.select(
        *_RUN, has_meta.alias("has_meta"), "step_name", "status", "duration_ms", "finished_at"
    )
    joined = (
        state.select(*_STEP, "run_id", "pos")
        .join(live, _STEP, "left")
        .join(meta, _RUN, "left")
        .join(artifact_sizes(files.join(active_runs(state), _RUN, "left_semi")), _RUN, "left")
    )
    idle = F.col("live").isNull()
    committed = joined.select(
        *_STEP,
        F.when(idle, F.col("run_id")).alias("run_id"),
        F.when(~idle, F.lit("running")).otherwise(F.coalesce("status", F.lit("unknown"))).alias("status"),
        F.when(idle, F.col("step_name")).otherwise(F.col("live_name")).alias("step_name"),
        F.when(idle, F.col("duration_ms")).alias("duration_ms"),
        F.when(idle & F.col("has_meta"), F.coalesce("artifact_size", F.lit(0))).alias("artifact_size"),
        F.when(idle, F.col("finished_at")).alias("finished_at"),
        F.col("live_at").alias("started_at"),
        F.lit(0).alias("section"),
        F.col("pos").cast("bigint").alias("pos"),
    )
    extra = live.join(state, _STEP, "left_anti").select(
        *_STEP,
        F.lit(None).cast("string").alias("run_id"),
        F.lit("running").alias("status"),
        F.col("live_name").alias("step_name"),
        F.lit(None).cast("bigint").alias("duration_ms"),
        F.lit(None).cast("bigint").alias("artifact_size"),
        F.lit(None).cast("timestamp").alias("finished_at"),
        F.col("live_at").alias("started_at"),
        F.lit(1).alias("section"),
        F.lit(None).cast("bigint").alias("pos"),
    )
    return committed.unionByName(extra)


def show_total(shown: DataFrame) -> DataFrame:
    return shown.groupBy(W).agg(F.sum(F.coalesce("artifact_size", F.lit(0))).alias("total_size"))


def active_runs(state: DataFrame) -> DataFrame:
    return state.select(*_RUN).distinct()


def cache_lookup(
    steps: DataFrame, state: DataFrame, runs: DataFrame, force: bool | Sequence[str] = False
) -> DataFrame:
    """Steps ``(workspace_id, step_id, fingerprint)`` that can reuse a run, with its id."""
    stored = state.select(*_STEP, "fingerprint", "run_id")
    return (
        force_filter(steps, force, keep_forced=False)
        .join(stored, [*_STEP, "fingerprint"])
        .join(runs.select(*_RUN), _RUN, "left_semi")
    )


def force_filter(steps: DataFrame, force: bool | Sequence[str], keep_forced: bool = True) -> DataFrame:
    """Steps that are forced to run (or those that are not): all, none or the listed ones."""
    forced = F.lit(force) if isinstance(force, bool) else F.col("step_id").isin(*force)
    return steps.filter(forced if keep_forced else ~forced)


def current_run(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Requests ``(workspace_id, step_id, …)`` with the current run, or an error for an unknown step."""
    found = requests.join(state.select(*_STEP, "run_id"), _STEP, "left")
    return found.withColumn(
        "error", F.when(F.col("run_id").isNull(), F.concat(F.lit("Step not found: "), "step_id"))
    )


def inspect_runs(requests: DataFrame, state: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests ``(workspace_id, step_id, …)`` with the metadata ``meta`` of their current run, or an error."""
    rest = [c for c in runs.columns if c not in (*_RUN, "step_id")]
    meta = runs.select(*_RUN, F.struct(*rest).alias("meta"))
    found = current_run(requests, state).join(meta, _RUN, "left")
    known = F.col("meta").isNotNull() & (F.col("meta.has_meta") if "has_meta" in rest else F.lit(True))
    missing = F.when(~known, F.concat(F.lit("No metadata: "), "run_id"))
    return found.withColumn("error", F.coalesce("error", missing)).withColumn("meta", F.when(known, F.col("meta")))


def list_artifacts(requests: DataFrame, state: DataFrame, files: DataFrame) -> DataFrame:
    """Entries ``(workspace_id, step_id, path, name, type, size)`` of requested artifact folders, or an error row.

    ``files`` are the files of runs. Folders have size 0. A request that climbs out of the artifacts is an error, and so is
    a folder without any file, which a listing of files can't tell from a missing one; the top folder may be empty.
    """
    top = F.lit("/artifacts")
    below = F.regexp_replace(F.coalesce("path", F.lit("")), "^/+", "")
    asked = current_run(requests.select(*_STEP, "path").distinct(), state)
    inside = within_boundary(top, below, top)
    error = F.coalesce("error", F.when(~inside, F.lit("Invalid path: must be within artifacts directory")))
    asked = asked.withColumn("error", error).withColumn("dir", F.substring(resolve_path(top, below), 2, 1 << 30))
    wanted = asked.filter("error IS NULL").select(*_RUN, "dir").distinct()
    # Files of requested runs only, and only at the depths that were asked for.
    depths = wanted.select(*_RUN, depth_of(F.col("dir")).alias("depth")).distinct()
    reached = F.col("depth") <= slashes(F.col("path"))
    inner = files.filter(F.startswith("path", F.lit("artifacts/"))).join(depths, _RUN).filter(reached).select(
        *_RUN, F.col("path").alias("file"), "length", folder_at(F.col("path"), F.col("depth")).alias("dir")
    )
    rest = F.when(F.col("dir") == "", F.col("file")).otherwise(F.substring(F.col("file"), F.length("dir") + 2, F.length("file")))
    nested = F.contains(rest, F.lit("/"))
    entries = (
        inner.join(wanted, [*_RUN, "dir"], "left_semi")
        .groupBy(*_RUN, "dir", F.substring_index(rest, "/", 1).alias("name"), F.when(nested, "directory").otherwise("file").alias("type"))
        .agg(F.max(F.when(nested, F.lit(0)).otherwise(F.col("length"))).alias("size"))
    )
    found = asked.join(entries, [*_RUN, "dir"], "left")
    nothing = F.col("error").isNull() & F.col("name").isNull() & (F.col("dir") != "artifacts")
    return (
        found.withColumn("error", F.when(nothing, F.concat(F.lit("Folder not found: "), "path")).otherwise(F.col("error")))
        .filter(F.col("name").isNotNull() | F.col("error").isNotNull())
        .select(*_STEP, "path", "name", "type", "size", "error")
    )


def prune_candidates(runs: DataFrame, state: DataFrame) -> DataFrame:
    """Runs that the state does not refer to."""
    return runs.select(*_RUN).distinct().join(active_runs(state), _RUN, "left_anti")


def prune_summary(workspaces: DataFrame, runs: DataFrame, state: DataFrame, files: DataFrame) -> DataFrame:
    """Runs to remove and bytes to free per workspace; the bytes cover the whole run folder."""
    sizes = files.groupBy(*_RUN).agg(F.sum("length").alias("bytes"))
    totals = (
        prune_candidates(runs, state)
        .join(sizes, _RUN, "left")
        .groupBy(W)
        .agg(F.count(F.lit(1)).alias("removed"), F.sum(F.coalesce("bytes", F.lit(0))).alias("freed_bytes"))
    )
    return (
        workspaces.select(W)
        .distinct()
        .join(totals, W, "left")
        .select(
            W,
            F.coalesce("removed", F.lit(0)).alias("removed"),
            F.coalesce("freed_bytes", F.lit(0)).alias("freed_bytes"),
        )
    )


def workspace_summary(runs: DataFrame, caches: DataFrame, files: DataFrame) -> DataFrame:
    """Runs, caches and bytes per workspace, each counted on its own before the join, sorted by name."""
    run_counts = runs.select(*_RUN).distinct().groupBy(W).agg(F.count(F.lit(1)).alias("runs"))
    cache_counts = caches.select(W, "name").distinct().groupBy(W).agg(F.count(F.lit(1)).alias("caches"))
    sizes = files.groupBy(W).agg(F.sum("length").alias("size"))
    joined = run_counts.join(cache_counts, W, "full").join(sizes, W, "full")
    return joined.select(
        W, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "caches", "size")]
    ).orderBy(W)


def sorted_workspaces(workspaces: DataFrame) -> DataFrame:
    return workspaces.select(W).distinct().orderBy(W)


def latest_run_per_step(runs: DataFrame, order: Sequence[str] = ("finished_at", "run_id")) -> DataFrame:
    """The newest run of every step: an aggregate, so old runs are dropped before the shuffle."""
    rest = [c for c in runs.columns if c not in _STEP]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("run")
    return runs.groupBy(*_STEP).agg(newest).select(*_STEP, "run.*")


def clean_targets(workspaces: DataFrame, locks: DataFrame) -> DataFrame:
    """Workspaces without a live lock."""
    return workspaces.select(W).distinct().join(locks.filter("alive"), W, "left_anti")


def unknown_names(requested: DataFrame, existing: DataFrame) -> DataFrame:
    return requested.select(W).distinct().join(existing, W, "left_anti")


def locked_names(requested: DataFrame, locks: DataFrame) -> DataFrame:
    return requested.select(W).distinct().join(locks.filter("alive"), W, "left_semi")


def upsert_state(state: DataFrame, writes: DataFrame) -> DataFrame:
    """State after ``writes (workspace_id, step_id, run_id, fingerprint, write_no)``.

    The last write of a step wins and the step keeps its position; new steps follow the old ones.
    """
    ends = state.groupBy(W).agg((F.max("pos") + 1).alias("end"))
    old = state.select(
        *_STEP, "run_id", "fingerprint", F.lit(-1).cast("bigint").alias("write_no"), F.col("pos").cast("bigint")
    )
    new = writes.select(
        *_STEP, "run_id", "fingerprint", F.col("write_no").cast("bigint"), F.lit(None).cast("bigint").alias("pos")
    )
    merged = old.unionByName(new).groupBy(*_STEP).agg(
        F.max_by(F.struct("run_id", "fingerprint"), "write_no").alias("row"),
        F.min("pos").alias("pos"),
        F.min(F.when(F.col("write_no") >= 0, F.col("write_no"))).alias("first_write"),
    )
    kept = merged.filter(F.col("pos").isNotNull()).select(*_STEP, "row.*", "pos")
    appended = (
        merged.filter(F.col("pos").isNull())
        .join(ends, W, "left")
        .select(*_STEP, "row.*", (F.coalesce("end", F.lit(0)) + F.col("first_write")).alias("pos"))
    )
    return kept.unionByName(appended)


def delete_step_state(state: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(remaining state, runs to delete, unknown requests)`` for requests ``(workspace_id, step_id)``."""
    wanted = requests.select(*_STEP).distinct()
    remaining = state.join(wanted, _STEP, "left_anti")
    deleted = state.join(wanted, _STEP, "left_semi").select(*_STEP, "run_id")
    unknown = wanted.join(state, _STEP, "left_anti")
    return remaining, deleted, unknown
