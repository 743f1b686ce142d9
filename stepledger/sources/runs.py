"""The store of workspaces: run metadata, state, markers, locks, caches, logs, file listings, artifacts.

Layout below the root: ``<workspace>/state.json``, ``<workspace>/daemon.json`` (lock), ``<workspace>/running/<step>``,
``<workspace>/caches/<name>/…``, ``<workspace>/runs/<run>/{meta.json,stdout.log,stderr.log,artifacts/…}``. Documents and logs
are found at exactly this depth, so files of the same name among the artifacts are neither listed nor read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepledger import schemas as S
from stepledger.functions.paths import resolve_path, within_boundary
from stepledger.operators.history import current_run
from stepledger.sources.listing import files_in, list_below, list_folders, list_workspaces
from stepledger.sources.paths import LOCK, MARKER, RUN_LOG, RUN_META, STATE, lines_of_files, path_part, plain, read_text
from stepledger.sources.store import content
from stepledger.storage import materialize, qualified_path

# Fixed value: the largest name that the documents' format sorts as a number.
_LARGEST_INDEX = 4294967294


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(path, name, length, modified_at)`` of every file below ``root``; no file is opened."""
    path = plain(F.col("path"))
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
        .select(
            path.alias("path"),
            F.substring_index(path, "/", -1).alias("name"),
            "length",
            F.col("modificationTime").alias("modified_at"),
        )
    )


def list_workspace_entries(spark: SparkSession, root: str) -> DataFrame:
    """``(workspace_id, path, name, is_folder, length)`` of every file and folder of every workspace, the path relative to it.

    The driver lists the workspaces, tasks what is in them: first one level, then each of its folders for itself; the runs and
    caches, of which there are many, are folders of their own.
    """
    workspaces = list_workspaces(spark, root)
    top = materialize(list_folders(workspaces), "entries")
    inner = lambda found: found.filter("is_folder").select(
        "workspace_id", F.concat_ws("/", "folder", "path").alias("folder"), F.col("path").alias("above")
    )
    crowded = F.col("path").isin("runs", "caches")
    second = materialize(list_folders(inner(top.filter(crowded))), "entries")
    columns = ["workspace_id", F.concat_ws("/", "above", "path").alias("path"), "name", "is_folder", "length"]
    below = second.select("workspace_id", "folder", F.concat_ws("/", "above", "path").alias("above"), "path", "is_folder")
    deep = below.filter("is_folder").select("workspace_id", F.concat_ws("/", "folder", "path").alias("folder"), "above")
    rest = list_folders(inner(top.filter(~crowded)).unionByName(deep), recursive=True)
    return top.select("workspace_id", "path", "name", "is_folder", "length").unionByName(second.select(columns)).unionByName(rest.select(columns))


def list_workspace_files(spark: SparkSession, root: str) -> DataFrame:
    """``(workspace_id, path, name, length)`` of every file of every workspace, the path relative to the workspace."""
    return list_workspace_entries(spark, root).filter("NOT is_folder").drop("is_folder")


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """``(workspace_id, run_id, folder)`` of all run folders, empty ones too; two levels are listed and nothing in the runs."""
    return list_below(list_workspaces(spark, root), "runs").withColumnRenamed("name", "run_id")


def list_run_files(spark: SparkSession, root: str) -> DataFrame:
    """``(workspace_id, run_id, path, name, length)`` of the files of runs, the path relative to the run folder."""
    found = list_folders(list_runs(spark, root), recursive=True).filter("NOT is_folder")
    return found.select("workspace_id", "run_id", "path", "name", "length")


def read_caches(spark: SparkSession, root: str) -> DataFrame:
    """``(workspace_id, name)`` of the caches, empty ones too."""
    return list_below(list_workspaces(spark, root), "caches").select("workspace_id", "name")


def read_runs(spark: SparkSession, root: str, listed: bool = True) -> DataFrame:
    """Run metadata; a run whose metadata is malformed or missing stays, with nulls.

    ``listed`` adds the runs that have a folder but no metadata file.
    """
    document = F.from_json("value", S.ddl({**S.RUN_DOCUMENT, "_corrupt": "STRING"}), {"columnNameOfCorruptRecord": "_corrupt"})
    documents = read_text(spark, f"{root}/*/runs/*/meta.json").withColumn("meta", document)
    valid = F.col("meta").isNotNull() & F.col("meta._corrupt").isNull()
    fields = [
        F.when(valid, F.col(f"meta.{key}").cast(data_type)).alias(name)
        for key, (name, data_type) in zip(S.RUN_DOCUMENT, S.RUN.items(), strict=True)
        if name != "run_id"
    ]
    runs = documents.select(
        path_part(F.col("file"), RUN_META, 1).alias("workspace_id"),
        path_part(F.col("file"), RUN_META, 2).alias("run_id"),
        valid.alias("has_meta"),
        *fields,
    )
    if not listed:
        return runs
    ids = list_runs(spark, root).select("workspace_id", "run_id")
    return ids.join(runs, ["workspace_id", "run_id"], "left").withColumn(
        "has_meta", F.coalesce("has_meta", F.lit(False))
    )


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """``(workspace_id, step_id, run_id, fingerprint, pos)``; a missing or malformed file has no rows.

    Positions follow the key order of the documents' format: numeric names first, by value, then the
    others as written.
    """
    documents = read_text(spark, f"{root}/*/state.json").select(
        path_part(F.col("file"), STATE, 1).alias("workspace_id"),
        F.from_json("value", S.ddl(S.STATE_DOCUMENT)).getField("steps").alias("steps"),
    )

    def keyed(entry, at):
        value = F.when(entry["key"].rlike(r"^(0|[1-9][0-9]*)\z"), entry["key"].try_cast("bigint"))
        numeric = F.coalesce(value <= _LARGEST_INDEX, F.lit(False))
        return F.struct(
            (~numeric).alias("named"),
            F.when(numeric, value).otherwise(at.cast("bigint")).alias("at"),
            entry["key"].alias("key"),
            entry["value"].alias("value"),
        )

    entries = F.array_sort(F.transform(F.map_entries("steps"), keyed))
    return documents.select("workspace_id", F.posexplode(entries).alias("pos", "step")).select(
        "workspace_id",
        F.col("step.key").alias("step_id"),
        F.col("step.value.runId").alias("run_id"),
        F.col("step.value.fingerprint").alias("fingerprint"),
        F.col("pos").cast("bigint").alias("pos"),
    )


def _with_life(found: DataFrame, live: DataFrame) -> DataFrame:
    """``alive`` by the table of ``(pid)`` of live processes."""
    pids = live.select(F.col("pid").cast("bigint").alias("pid")).distinct().withColumn("alive", F.lit(True))
    return found.join(pids, "pid", "left").withColumn("alive", F.coalesce("alive", F.lit(False)))


def read_markers(spark: SparkSession, root: str, live: DataFrame) -> DataFrame:
    """``(workspace_id, step_id, started_at, pid, step_name, alive)`` of the steps marked as running.

    The step's id is the file's name; malformed markers are left out. Whether a process lives is not in the store, so
    ``live`` lists the pids that do.
    """
    schema = "startedAt TIMESTAMP, pid BIGINT, stepName STRING, _corrupt STRING"
    marker = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"})
    found = read_text(spark, f"{root}/*/running/*").withColumn("marker", marker)
    return _with_life(
        found.filter(F.col("marker").isNotNull() & F.col("marker._corrupt").isNull()).select(
            path_part(F.col("file"), MARKER, 1).alias("workspace_id"),
            path_part(F.col("file"), MARKER, 2).alias("step_id"),
            F.col("marker.startedAt").alias("started_at"),
            F.col("marker.pid").alias("pid"),
            F.col("marker.stepName").alias("step_name"),
        ),
        live,
    ).select("workspace_id", "step_id", "started_at", "pid", "step_name", "alive")


def read_locks(spark: SparkSession, root: str, live: DataFrame) -> DataFrame:
    """``(workspace_id, pid, started_at, alive)`` of the workspaces' locks; malformed ones are left out."""
    lock = F.from_json("value", "pid BIGINT, startedAt TIMESTAMP, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    found = read_text(spark, f"{root}/*/daemon.json").withColumn("lock", lock)
    return _with_life(
        found.filter(F.col("lock").isNotNull() & F.col("lock._corrupt").isNull()).select(
            path_part(F.col("file"), LOCK, 1).alias("workspace_id"),
            F.col("lock.pid").alias("pid"),
            F.col("lock.startedAt").alias("started_at"),
        ),
        live,
    ).select("workspace_id", "pid", "started_at", "alive")


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """``(workspace_id, run_id, stream, line_no, line)`` with line numbers from 0.

    The driver lists the workspaces, tasks their runs, and look up the logs of each run by name.
    """
    runs = list_below(list_workspaces(spark, root, hidden=True), "runs", hidden=True)
    return lines_of_files(files_in(runs, ["stdout.log", "stderr.log"])).select(
        path_part(F.col("file"), RUN_LOG, 1).alias("workspace_id"),
        path_part(F.col("file"), RUN_LOG, 2).alias("run_id"),
        path_part(F.col("file"), RUN_LOG, 3).alias("stream"),
        "line_no",
        "line",
    )


def read_artifacts(spark: SparkSession, root: str, requests: DataFrame, state: DataFrame) -> DataFrame:
    """Content of the requested artifacts ``(workspace_id, step_id, path)`` of the current runs, or an error.

    The request and the state name the file, so nothing is listed: the tasks that hold the requests open exactly these
    files, one at a time.
    """
    base = F.format_string("/%s/runs/%s/artifacts", F.col("workspace_id"), F.col("run_id"))
    # A leading slash does not leave the folder: the path is always taken below it.
    below = F.regexp_replace("path", "^/+", "")
    inside = within_boundary(base, below, base)
    error = F.coalesce("error", F.when(~inside, F.lit("Invalid path: must be within artifacts directory")))
    wanted = current_run(requests, state).withColumn("error", error)
    file = F.when(F.col("error").isNull(), F.concat(F.lit(qualified_path(spark, root)), resolve_path(base, below)))
    wanted = wanted.select("*", file.alias("_file"))
    schema = T.StructType([*wanted.drop("_file").schema.fields, T.StructField("content", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, name in enumerate(batch["_file"].to_pylist()):
                row = batch.slice(k, 1).drop_columns(["_file"])
                found = pa.array([name and content(name)], pa.binary())
                yield pa.RecordBatch.from_arrays([*row.columns, found], names=[*row.schema.names, "content"])

    missing = F.concat(F.lit("Artifact not found: "), "path")
    found = wanted.mapInArrow(read, schema)
    return found.withColumn("error", F.coalesce("error", F.when(F.col("content").isNull(), missing)))


def export_step_output(
    spark: SparkSession, state: DataFrame, workspace_id: str, step_id: str, root: str, dest: str
) -> str:
    """Copy the current output table of a step to ``dest``; returns the run id."""
    row = state.filter((F.col("workspace_id") == workspace_id) & (F.col("step_id") == step_id)).first()
    if row is None:
        raise LookupError(f"Step not found: {step_id}")
    spark.read.parquet(f"{root}/{workspace_id}/runs/{row.run_id}/artifacts").write.parquet(dest)
    return row.run_id
