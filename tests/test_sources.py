"""Readers and writers on small folders in the layout that the readers expect by default."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from stepledger.plans.jobs import category_summary_job, text_report_job
from stepledger.sources.definitions import read_dotenv, read_pipelines
from stepledger.sources import listing, paths
from stepledger.sources.paths import read_lines
from stepledger.operators.history import show, workspace_summary
from stepledger.sources.runs import (
    export_step_output,
    list_run_files,
    list_workspace_entries,
    list_workspace_files,
    read_artifacts,
    read_caches,
    read_locks,
    read_logs,
    read_markers,
    read_runs,
    read_state,
)
from stepledger.sources.tables import read_json_doc, write_json_doc, write_text_report


def put(root, path: str, text: str) -> None:
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text)


@pytest.fixture
def workspace(tmp_path):
    meta = {"runId": "run-001", "stepId": "build", "durationMs": 1234, "exitCode": 0, "status": "success", "finishedAt": "2024-01-01T00:00:01.234Z"}
    meta.update(inputs=[{"step": "a", "mountedAs": "/input/a"}], allowNetwork=False, env={"A": "1"})
    put(tmp_path, "ws 1/runs/run-001/meta.json", json.dumps(meta, indent=2))
    put(tmp_path, "ws 1/runs/run-001/stdout.log", "hello\nworld\n")
    put(tmp_path, "ws 1/runs/run-001/stderr.log", "oops\n")
    put(tmp_path, "ws 1/runs/run-001/artifacts/output.txt", "result data")
    put(tmp_path, "ws 1/runs/run-001/artifacts/sub/deep[1].txt", "deep")
    put(tmp_path, "ws 1/runs/broken/meta.json", '{"runId": "bro')
    put(tmp_path, "ws 1/runs/bare/artifacts/x", "x")
    put(tmp_path, "ws 1/state.json", '{"steps": {"zeta": {"runId": "r9", "fingerprint": ""}, "build": {"runId": "run-001", "fingerprint": "f"}, "10": {"runId": "r10", "fingerprint": "g"}, "2": {"runId": "r2", "fingerprint": "h"}}}')
    return tmp_path


def test_runs(spark, workspace):
    runs = {r.run_id: r for r in read_runs(spark, str(workspace)).collect()}
    assert set(runs) == {"run-001", "broken", "bare"}
    run = runs["run-001"]
    assert (run.workspace_id, run.step_id, run.duration_ms, run.exit_code, run.status) == ("ws 1", "build", 1234, 0, "success")
    assert run.inputs[0].mounted_as == "/input/a" and run.env == {"A": "1"} and run.has_meta
    assert not runs["broken"].has_meta and runs["broken"].step_id is None and not runs["bare"].has_meta


def test_state(spark, workspace):
    state = read_state(spark, str(workspace)).orderBy("pos").collect()
    assert [(r.step_id, r.run_id, r.pos) for r in state] == [("2", "r2", 0), ("10", "r10", 1), ("zeta", "r9", 2), ("build", "run-001", 3)]


def test_logs(spark, workspace):
    logs = read_logs(spark, str(workspace)).orderBy(F.desc("stream"), "line_no").collect()
    assert [(r.workspace_id, r.run_id, r.stream, r.line_no, r.line) for r in logs] == [
        ("ws 1", "run-001", "stdout", 0, "hello"),
        ("ws 1", "run-001", "stdout", 1, "world"),
        ("ws 1", "run-001", "stderr", 0, "oops"),
    ]


def test_line_numbers_of_a_file_read_by_many_tasks(spark, tmp_path):
    put(tmp_path, "big.log", "".join(f"line {i}\n" for i in range(5000)))
    put(tmp_path, "other.log", "a\n\nb")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        rows = read_lines(spark, f"{tmp_path}/*.log").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    big = sorted((r.line_no, r.line) for r in rows if r.file.endswith("big.log"))
    assert big == [(i, f"line {i}") for i in range(5000)]
    assert sorted((r.line_no, r.line) for r in rows if r.file.endswith("other.log")) == [(0, "a"), (1, ""), (2, "b")]


def test_listing_and_artifacts(spark, workspace):
    files = {r.path: r.length for r in list_run_files(spark, str(workspace)).filter("run_id = 'run-001'").collect()}
    assert files["artifacts/output.txt"] == 11 and files["stdout.log"] == 12
    state = read_state(spark, str(workspace))
    asked = [("ws 1", "build", "output.txt"), ("ws 1", "build", "/output.txt"), ("ws 1", "build", "./sub/../sub/deep[1].txt"), ("ws 1", "build", "../stdout.log"), ("ws 1", "build", "none.txt"), ("ws 1", "gone", "output.txt")]
    requests = spark.createDataFrame(asked, "workspace_id STRING, step_id STRING, path STRING")
    found = {(r.step_id, r.path): (r.content and bytes(r.content), r.error) for r in read_artifacts(spark, str(workspace), requests, state).collect()}
    assert found["build", "output.txt"] == found["build", "/output.txt"] == (b"result data", None)
    assert found["build", "./sub/../sub/deep[1].txt"] == (b"deep", None)
    assert found["build", "../stdout.log"][1] == "Invalid path: must be within artifacts directory"
    assert found["build", "none.txt"][1] == "Artifact not found: none.txt"
    assert found["gone", "output.txt"][1] == "Step not found: gone"


def test_artifacts_need_no_listing_and_no_driver(spark, workspace, monkeypatch):
    requests = spark.createDataFrame([("ws 1", "build", "output.txt")], "workspace_id STRING, step_id STRING, path STRING")
    state = read_state(spark, str(workspace))
    monkeypatch.setattr(type(requests), "collect", lambda *_: pytest.fail("collected"))
    found = read_artifacts(spark, str(workspace), requests, state)
    assert "binaryFile" not in found._jdf.queryExecution().toString()


def test_files_count_by_depth_only(spark, tmp_path):
    """Names of documents among artifacts, and a store below a folder called runs, mislead no reader."""
    root = tmp_path / "old/runs/store"
    put(root, "ws1/state.json", '{"steps": {"a": {"runId": "r1", "fingerprint": "f"}}}')
    put(root, "ws1/runs/r1/meta.json", '{"stepId": "a", "exitCode": 0}')
    put(root, "ws1/runs/r1/artifacts/state.json", '{"steps": {"junk": {"runId": "x"}}}')
    put(root, "ws1/runs/r1/artifacts/meta.json", '{"stepId": "junk"}')
    put(root, "ws1/runs/r1/artifacts/stdout.log", "junk\n")
    put(root, "ws1/runs/r1/stdout.log", "line\n")
    assert [(r.workspace_id, r.step_id) for r in read_state(spark, str(root)).collect()] == [("ws1", "a")]
    for listed in (True, False):
        assert [(r.workspace_id, r.run_id, r.step_id) for r in read_runs(spark, str(root), listed).collect()] == [("ws1", "r1", "a")]
    assert [(r.workspace_id, r.run_id, r.line) for r in read_logs(spark, str(root)).collect()] == [("ws1", "r1", "line")]
    files = {(r.workspace_id, r.run_id, r.path) for r in list_run_files(spark, str(root) + "/").collect()}
    assert len(files) == 5 and ("ws1", "r1", "artifacts/state.json") in files


def test_state_order_of_long_numbers(spark, tmp_path):
    names = ["x", "4294967295", "4294967294", "99999999999999999999", "1234567890", "7", "007"]
    steps = ", ".join(f'"{n}": {{"runId": "r", "fingerprint": "f"}}' for n in names)
    put(tmp_path, "w/state.json", f'{{"steps": {{{steps}}}}}')
    found = [r.step_id for r in read_state(spark, str(tmp_path)).orderBy("pos").collect()]
    assert found == ["7", "1234567890", "4294967294", "x", "4294967295", "99999999999999999999", "007"]


def test_show_and_summary_of_a_written_store(spark, workspace):
    put(workspace, "ws 1/running/build", '{"startedAt": "2024-01-01T00:00:00.000Z", "pid": 7, "stepName": "Build"}')
    put(workspace, "ws 1/running/late", '{"startedAt": "2024-01-01T00:00:00.000Z", "pid": 8}')
    put(workspace, "ws 1/running/bad", "{")
    put(workspace, "ws 1/daemon.json", '{"pid": 7, "socketPath": "", "startedAt": "2024-01-01T00:00:00.000Z", "version": 1}')
    put(workspace, "ws 1/caches/npm/a/b", "123")
    root, live = str(workspace), spark.createDataFrame([(7,)], "pid BIGINT")
    markers = read_markers(spark, root, live)
    assert {(r.step_id, r.pid, r.step_name, r.alive) for r in markers.collect()} == {("build", 7, "Build", True), ("late", 8, None, False)}
    assert [(r.workspace_id, r.alive) for r in read_locks(spark, root, live).collect()] == [("ws 1", True)]
    shown = show(read_state(spark, root), read_runs(spark, root), markers, list_run_files(spark, root)).collect()
    assert {(r.step_id, r.status) for r in shown} == {("2", "unknown"), ("10", "unknown"), ("zeta", "unknown"), ("build", "running")}
    size = sum(f.stat().st_size for f in workspace.rglob("*") if f.is_file() and not f.name.endswith(".crc"))
    summary = workspace_summary(read_runs(spark, root), read_caches(spark, root), list_workspace_files(spark, root)).collect()
    assert [tuple(r) for r in summary] == [("ws 1", 3, 1, size)]


def test_an_empty_store(spark, tmp_path):
    live = spark.createDataFrame([], "pid BIGINT")
    for found in (read_state(spark, str(tmp_path)), read_runs(spark, str(tmp_path)), read_logs(spark, str(tmp_path)), read_markers(spark, str(tmp_path), live), read_locks(spark, str(tmp_path), live), read_caches(spark, str(tmp_path))):
        assert found.count() == 0


def test_definitions(spark, tmp_path):
    document = {"name": "Étape un", "steps": [{"name": "First Step", "image": "alpine", "cmd": ["a"], "if": "env.CI", "envFile": ".env"}, {"id": "b", "uses": "shell", "with": {"run": "x"}, "inputs": [{"step": "first-step", "copyToOutput": True}]}]}
    put(tmp_path, "one/pipeline.json", json.dumps(document))
    put(tmp_path, "two/pipeline.yml", "id: shadow")
    put(tmp_path, "two/pipeline.json", json.dumps({"id": "hidden", "steps": []}))
    put(tmp_path, "three/other.json", json.dumps({"id": "three", "steps": []}))
    pipelines, steps = read_pipelines(spark, str(tmp_path))
    assert sorted((r.pipeline_id, r.root.rsplit("/", 1)[1]) for r in pipelines.collect()) == [("etape-un", "one"), ("three", "three")]
    first, second = steps.orderBy("pos").collect()
    assert (first.step_id, first.condition, first.env_file, first.pos) == ("first-step", "env.CI", ".env", 0)
    assert second.uses == "shell" and second.params == {"run": "x"} and second.inputs[0].copy_to_output


def test_dotenv(spark, tmp_path):
    put(tmp_path, "a.env", "# note\n\nA=1\nB = two words # tail\nC='single # kept'\nD=\"dou\\nble\"\nexport E=x\nA=last\nF=\nG=`tick`\nM=\"two\nlines\"\n")
    values = {r.key: r.value for r in read_dotenv(spark, str(tmp_path)).collect()}
    assert values == {"A": "last", "B": "two words", "C": "single # kept", "D": "dou\nble", "E": "x", "F": "", "G": "tick", "M": "two\nlines"}


def test_export(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "w/runs/r1/artifacts"))
    state = spark.createDataFrame([("w", "build", "r1")], "workspace_id STRING, step_id STRING, run_id STRING")
    assert export_step_output(spark, state, "w", "build", str(tmp_path), str(tmp_path / "out")) == "r1"
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    with pytest.raises(LookupError):
        export_step_output(spark, state, "w", "none", str(tmp_path), str(tmp_path / "x"))


PEOPLE = [("Alice", "Engineering", 72000), ("Bob", "Marketing", 65000), ("Charlie", "Engineering", 80000), ("Diana", "Marketing", 70000), ("Eve", "Engineering", 90000), ("Frank", "Sales", 60000), ("Grace", "Sales", 55000), ("Henry", "Engineering", 85000)]
LANGUAGES = [("backend", "Go", 92), ("backend", "Rust", 95), ("backend", "Java", 85), ("frontend", "TypeScript", 90), ("frontend", "JavaScript", 82), ("data", "Python", 94), ("data", "R", 78), ("data", "Julia", 80)]


def test_text_report_job(spark, tmp_path):
    people = spark.createDataFrame(PEOPLE, "name STRING, department STRING, salary BIGINT")
    lines = text_report_job(people, F.create_map(F.lit("AUDIT"), F.lit("1")))
    report = [r.line for r in lines.filter("step = 'report'").orderBy("section", "sort_key", "line").collect()]
    assert report == [
        "=== FINAL REPORT ===", "", "Engineering: 4 employees, avg salary $81750", "Marketing: 2 employees, avg salary $67500",
        "Sales: 2 employees, avg salary $57500", "", "--- High earners ---", "Alice Engineering $72000",
        "Charlie Engineering $80000", "Eve Engineering $90000", "Henry Engineering $85000",
    ]
    assert sorted(r.line for r in lines.filter("step <> 'report'").collect()) == ["High earners: 4", "Input records: 8"]
    out = str(tmp_path / "report")
    write_text_report(lines.filter("step = 'report'"), out, ["section", "sort_key", "line"])
    written = read_lines(spark, f"{out}/part-*").orderBy("file", "line_no").collect()
    assert [r.line for r in written] == report


def test_category_job(spark, tmp_path):
    rows = [(i, *row) for i, row in enumerate(LANGUAGES)]
    languages = spark.createDataFrame(rows, "pos BIGINT, category STRING, language STRING, score INT")
    summary, categories = category_summary_job(languages)
    row = summary.first()
    assert row.totalLanguages == 8 and row.bestCategory.name == "backend" and row.bestCategory.rating == "excellent"
    found = {}
    for r in sorted(categories.collect(), key=lambda r: r["at"]):
        found.setdefault(r.category, (r.rating, []))[1].append(r.language)
    assert found == {"backend": ("excellent", ["Go", "Java", "Rust"]), "frontend": ("good", ["JavaScript", "TypeScript"]), "data": ("good", ["Julia", "Python", "R"])}
    write_json_doc(summary, str(tmp_path / "s"))
    assert read_json_doc(spark, str(tmp_path / "s"), "totalLanguages BIGINT").first().totalLanguages == 8


def test_folders_without_files_are_seen(spark, tmp_path):
    for folder in ("ws1/caches/empty", "ws1/caches/full/deep", "ws1/runs/r1/artifacts/none", "ws1/runs/r2", "ws2", "ws1/other/a/b", "ws1/_hidden"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "ws1/caches/full/deep/x").write_text("abc")
    (tmp_path / "ws1/runs/r1/artifacts/y").write_text("12")
    (tmp_path / "ws1/state.json").write_text("{}")
    (tmp_path / "stray").write_text("")
    root = str(tmp_path)
    assert sorted(map(tuple, read_caches(spark, root).collect())) == [("ws1", "empty"), ("ws1", "full")]
    assert {(r.workspace_id, r.run_id, r.has_meta) for r in read_runs(spark, root).collect()} == {("ws1", "r1", False), ("ws1", "r2", False)}
    assert [(r.run_id, r.path, r.length) for r in list_run_files(spark, root).collect()] == [("r1", "artifacts/y", 2)]
    found = {(r.path, r.is_folder, r.length) for r in list_workspace_entries(spark, root).collect()}
    files = {("state.json", False, 2), ("caches/full/deep/x", False, 3), ("runs/r1/artifacts/y", False, 2)}
    folders = {"caches", "caches/empty", "caches/full", "caches/full/deep", "runs", "runs/r1", "runs/r1/artifacts", "runs/r1/artifacts/none", "runs/r2", "other", "other/a", "other/a/b"}
    assert found == files | {(f, True, None) for f in folders}


def test_line_numbers_over_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paths, "RANGE_BYTES", 50)
    texts = {"a.log": "one\n\n" + "x" * 200 + "\nlast", "b.log": "é\n" * 100, "c.log": "", "d.log": "\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    found = sorted((r.file.rsplit("/", 1)[-1], r.line_no, r.line) for r in read_lines(spark, f"{tmp_path}/*.log").collect())
    expected = []
    for name, text in texts.items():
        lines = text.split("\n")
        expected += [(name, n, line) for n, line in enumerate(lines[:-1] if lines[-1] == "" else lines)]
    assert found == sorted(expected)


def test_logs_are_not_listed_by_the_driver(spark, tmp_path, monkeypatch):
    """Folders with the names of work files are runs too; a folder with a log's name is no log."""
    for run in ("r1", "_r2", ".r3", "r [4] {a,b}"):
        put(tmp_path, f"ws 1/runs/{run}/stdout.log", f"line of {run}\n")
    put(tmp_path, "_ws/runs/r5/stderr.log", "line of r5\n")
    put(tmp_path, "ws 1/runs/r6/stdout.log/part", "junk\n")
    monkeypatch.setattr(type(spark.read), "load", lambda *_, **__: pytest.fail("listed by the driver"))
    monkeypatch.setattr(listing, "_BATCH", 2)
    found = read_logs(spark, str(tmp_path))
    assert "binaryFile" not in found._jdf.queryExecution().toString()
    rows = {(r.workspace_id, r.run_id, r.stream, r.line_no, r.line) for r in found.collect()}
    assert rows == {("ws 1", run, "stdout", 0, f"line of {run}") for run in ("r1", "_r2", ".r3", "r [4] {a,b}")} | {("_ws", "r5", "stderr", 0, "line of r5")}
