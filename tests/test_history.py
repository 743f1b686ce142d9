"""Run history and inputs on literal tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stepledger.operators import files as O
from stepledger.operators import history as H
from stepledger.operators import inputs as I


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_show(spark):
    state = spark.createDataFrame(
        [("w", "build", "r1", 0), ("w", "test", "r2", 1), ("w", "lint", "r3", 2), ("w", "odd", "r4", 3)],
        "workspace_id STRING, step_id STRING, run_id STRING, pos INT",
    )
    runs = spark.createDataFrame(
        [("w", "r1", "Build", "success", 1234, None), ("w", "r2", None, "failure", 5, None), ("w", "r4", None, None, 7, None)],
        "workspace_id STRING, run_id STRING, step_name STRING, status STRING, duration_ms BIGINT, finished_at TIMESTAMP",
    )
    running = spark.createDataFrame(
        [("w", "test", "Test", True), ("w", "new", None, True), ("w", "lint", None, False)],
        "workspace_id STRING, step_id STRING, step_name STRING, alive BOOLEAN",
    ).withColumn("started_at", F.lit("2024-01-01").cast("timestamp"))
    files = spark.createDataFrame(
        [("w", "r1", "artifacts/output.txt", 11), ("w", "r1", "stdout.log", 99)],
        "workspace_id STRING, run_id STRING, path STRING, length BIGINT",
    )
    shown = H.show(state, runs, running, files)
    got = shown.orderBy("section", "pos").select("step_id", "run_id", "status", "duration_ms", "artifact_size").collect()
    assert [tuple(r) for r in got] == [
        ("build", "r1", "success", 1234, 11),
        ("test", None, "running", None, None),
        ("lint", "r3", "unknown", None, None),
        ("odd", "r4", "unknown", 7, 0),
        ("new", None, "running", None, None),
    ]
    assert rows(H.show_total(shown)) == [("w", 11)]


def test_show_of_a_run_with_broken_metadata(spark):
    state = spark.createDataFrame([("w", "a", "r1", 0)], "workspace_id STRING, step_id STRING, run_id STRING, pos INT")
    schema = "workspace_id STRING, run_id STRING, has_meta BOOLEAN, step_name STRING, status STRING, duration_ms BIGINT, finished_at TIMESTAMP"
    runs = spark.createDataFrame([("w", "r1", False, None, None, None, None)], schema)
    running = spark.createDataFrame(
        [], "workspace_id STRING, step_id STRING, step_name STRING, alive BOOLEAN, started_at TIMESTAMP"
    )
    files = spark.createDataFrame([("w", "r1", "artifacts/x", 3)], "workspace_id STRING, run_id STRING, path STRING, length BIGINT")
    row = H.show(state, runs, running, files).first()
    assert (row.status, row.run_id, row.artifact_size) == ("unknown", "r1", None)


def test_prune(spark):
    runs = spark.createDataFrame([("w", "r1"), ("w", "r2"), ("v", "r3")], "workspace_id STRING, run_id STRING")
    state = spark.createDataFrame([("w", "a", "r1"), ("v", "a", "r3")], "workspace_id STRING, step_id STRING, run_id STRING")
    files = spark.createDataFrame(
        [("w", "r2", "artifacts/x", 5), ("w", "r2", "meta.json", 3), ("w", "r1", "artifacts/x", 9)],
        "workspace_id STRING, run_id STRING, path STRING, length BIGINT",
    )
    assert rows(H.prune_candidates(runs, state)) == [("w", "r2")]
    assert rows(H.prune_summary(runs, runs, state, files)) == [("v", 0, 0), ("w", 1, 8)]


def test_state_writes(spark):
    schema = "workspace_id STRING, step_id STRING, run_id STRING, fingerprint STRING"
    state = spark.createDataFrame([("w", "build", "r1", "f1", 0), ("w", "test", "r2", "f2", 1)], schema + ", pos BIGINT")
    writes = [("w", "build", "r3", "f3", 0), ("w", "new", "r4", "f4", 1), ("w", "build", "r5", "f5", 2), ("x", "a", "r6", "f6", 0)]
    merged = H.upsert_state(state, spark.createDataFrame(writes, schema + ", write_no BIGINT"))
    found = merged.orderBy("workspace_id", "pos").select("step_id", "run_id", "fingerprint").collect()
    assert [tuple(r) for r in found] == [("build", "r5", "f5"), ("test", "r2", "f2"), ("new", "r4", "f4"), ("a", "r6", "f6")]
    asked = spark.createDataFrame([("w", "test"), ("w", "none")], "workspace_id STRING, step_id STRING")
    kept, deleted, unknown = H.delete_step_state(state, asked)
    assert rows(kept, "step_id") == [("build",)] and rows(deleted, "run_id") == [("r2",)] and rows(unknown, "step_id") == [("none",)]


def test_current_run_and_cache(spark):
    state = spark.createDataFrame(
        [("w", "a", "r1", "f"), ("w", "b", "r2", ""), ("w", "c", "r3", "g")],
        "workspace_id STRING, step_id STRING, run_id STRING, fingerprint STRING",
    )
    steps = spark.createDataFrame(
        [("w", "a", "f"), ("w", "b", "x"), ("w", "c", "g")], "workspace_id STRING, step_id STRING, fingerprint STRING"
    )
    runs = spark.createDataFrame([("w", "r1"), ("w", "r2")], "workspace_id STRING, run_id STRING")
    assert rows(H.cache_lookup(steps, state, runs), "step_id", "run_id") == [("a", "r1")]
    assert rows(H.cache_lookup(steps, state, runs, force=["a"])) == [] == rows(H.cache_lookup(steps, state, runs, force=True))
    asked = spark.createDataFrame([("w", "a"), ("w", "z")], "workspace_id STRING, step_id STRING")
    assert {r.step_id: (r.run_id, r.error) for r in H.current_run(asked, state).collect()} == {
        "a": ("r1", None),
        "z": (None, "Step not found: z"),
    }


def test_locks_and_summary(spark):
    workspaces = spark.createDataFrame([("a",), ("b",), ("c",)], "workspace_id STRING")
    locks = spark.createDataFrame([("a", True), ("b", False)], "workspace_id STRING, alive BOOLEAN")
    assert rows(H.clean_targets(workspaces, locks)) == [("b",), ("c",)]
    asked = spark.createDataFrame([("a",), ("z",)], "workspace_id STRING")
    assert rows(H.unknown_names(asked, workspaces)) == [("z",)] and rows(H.locked_names(asked, locks)) == [("a",)]
    runs = spark.createDataFrame([("a", "r1"), ("a", "r2")], "workspace_id STRING, run_id STRING")
    caches = spark.createDataFrame([("b", "npm")], "workspace_id STRING, name STRING")
    files = spark.createDataFrame([("a", 5), ("c", 7)], "workspace_id STRING, length BIGINT")
    assert [tuple(r) for r in H.workspace_summary(runs, caches, files).collect()] == [("a", 2, 0, 5), ("b", 0, 1, 0), ("c", 0, 0, 7)]


def test_directories(spark):
    files = spark.createDataFrame(
        [("r", "a/b/x", 1), ("r", "a/y", 2), ("r", "z", 4)], "run_id STRING, path STRING, length BIGINT"
    )
    assert rows(O.dir_sizes(files), "dir", "size") == [("", 7), ("a", 3), ("a/b", 1)]
    asked = spark.createDataFrame([("r", "none"), ("r", "a")], "run_id STRING, dir STRING")
    assert rows(O.dir_size(files, asked), "dir", "size") == [("a", 3), ("none", 0)]
    asked = spark.createDataFrame([("r", d) for d in ("", "a/b", "a/b/x", "z", None)] + [("q", "a")], "run_id STRING, dir STRING")
    sizes = {tuple(r) for r in O.dir_size(files, asked).collect()}
    assert sizes == {("r", "", 7), ("r", "a/b", 1), ("r", "a/b/x", 0), ("r", "z", 0), ("r", None, 0), ("q", "a", 0)}
    assert rows(O.list_directory(files), "name", "type", "size") == [("a", "directory", 0), ("z", "file", 4)]
    for name in ("a", "./a/", "a/b/.."):
        assert rows(O.list_directory(files, name), "name", "type", "size") == [("b", "directory", 0), ("y", "file", 2)]
    with pytest.raises(ValueError):
        O.list_directory(files, "a/../../x")
    assert [tuple(r) for r in O.file_inventory(files).collect()] == [("x", 1), ("y", 2), ("z", 4)]


def test_templates_and_priorities(spark):
    names = spark.createDataFrame([("shell",), ("geo",), ("@org/kit",), ("plain",)], "name STRING")
    candidates = [
        ("shell", "builtin", "b"), ("shell", "alias", "a"), ("geo", "local_file", "f"), ("geo", "local_dir", "d"),
        ("@org/kit", "package", "p"), ("plain", "package", "p"),
    ]
    found = I.resolve_by_priority(names, spark.createDataFrame(candidates, "name STRING, source STRING, target STRING"))
    assert {r.name: (r.target, r.error) for r in found.collect()} == {
        "shell": ("a", None),
        "geo": ("d", None),
        "@org/kit": ("p", None),
        "plain": (None, 'Unknown template: "plain"'),
    }


def test_copied_files_are_overwritten_in_order(spark):
    inputs = spark.createDataFrame(
        [("p", "c", 0, "a", True), ("p", "c", 1, "b", True), ("p", "c", 2, "d", False)],
        "pipeline_id STRING, step_id STRING, pos INT, dep_id STRING, copy_to_output BOOLEAN",
    )
    step_runs = spark.createDataFrame(
        [("p", "a", "ra"), ("p", "b", "rb"), ("p", "c", "rc"), ("p", "d", "rd")], "pipeline_id STRING, step_id STRING, run_id STRING"
    )
    files = spark.createDataFrame(
        [("ra", "x", 1), ("ra", "y", 1), ("ra", "z", 1), ("rb", "y", 2), ("rb", "z", 2), ("rc", "z", 3), ("rd", "q", 4)],
        "run_id STRING, path STRING, length BIGINT",
    )
    out = I.copy_to_output(inputs, step_runs, files).filter("step_id = 'c'")
    assert rows(out, "path", "source_run", "length") == [("x", "ra", 1), ("y", "rb", 2), ("z", "rc", 3)]


def test_dependencies(spark):
    schema = """pipeline_id STRING, mounts ARRAY<STRUCT<host: STRING, container: STRING>>,
        sources ARRAY<STRUCT<host: STRING, container: STRING>>"""
    steps = spark.createDataFrame([("p", [("./src/", "/app")], None), ("p", None, [("src", "/app"), ("alpha", "/a")])], schema)
    assert [r.path for r in I.collect_dependencies(steps).collect()] == ["alpha", "src"]


def test_copied_files_of_equal_turns(spark):
    """What decides also is what is kept: no length travels twice, and of equal turns the same run wins in any order."""
    inputs = spark.createDataFrame([("p", "c", 0, "a", True), ("p", "c", 0, "b", True)], "pipeline_id STRING, step_id STRING, pos INT, dep_id STRING, copy_to_output BOOLEAN")
    runs = spark.createDataFrame([("p", s, f"r{s}") for s in "abc"], "pipeline_id STRING, step_id STRING, run_id STRING")
    files = spark.createDataFrame([("ra", "x", 5), ("rb", "x", 5), ("ra", "y", 9), ("rc", "y", 1)], "run_id STRING, path STRING, length BIGINT")
    found = I.copy_to_output(inputs, runs, files)
    assert "max_by" not in found._jdf.queryExecution().toString()
    assert rows(found.filter("step_id = 'c'"), "path", "source_run", "length") == [("x", "rb", 5), ("y", "rc", 1)]
