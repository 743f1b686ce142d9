"""Violations and their order."""

from __future__ import annotations

from stepledger.operators import validation as V

SCHEMA = """pipeline_id STRING, step_id STRING, image STRING, cmd ARRAY<STRING>, env_file STRING,
    inputs ARRAY<STRUCT<step: STRING, copy_to_output: BOOLEAN, optional: BOOLEAN>>,
    mounts ARRAY<STRUCT<host: STRING, container: STRING>>, sources ARRAY<STRUCT<host: STRING, container: STRING>>,
    caches ARRAY<STRUCT<name: STRING, path: STRING, exclusive: BOOLEAN>>,
    setup STRUCT<cmd: ARRAY<STRING>, caches: ARRAY<STRUCT<name: STRING, path: STRING, exclusive: BOOLEAN>>, allow_network: BOOLEAN>"""
GOOD = {"image": "alpine", "cmd": ["x"], "env_file": None, "inputs": None, "mounts": None, "sources": None, "caches": None, "setup": None}


def violations(spark, step_id, **broken):
    step = {**GOOD, **broken}
    df = spark.createDataFrame([("p", step_id, *[step[k] for k in GOOD])], SCHEMA)
    return [tuple(r) for r in V.validate_steps(df).orderBy("rank").select("rule", "field", "problem", "value").collect()]


def test_good_step(spark):
    assert not violations(
        spark, "ok_1-a", inputs=[("dep", None, None)], mounts=[("src", "/app")], caches=[("npm", "/c", None)], setup=(["x"], [("pip", "/p", True)], None)
    )


def test_all_rules_in_order(spark):
    found = violations(
        spark, "bad id", image="", cmd=[], env_file="/abs", inputs=[("a.b", None, None)],
        mounts=[("", "rel"), ("/h", "/a/../b")], sources=[("s", None)], caches=[("", "rel", None), ("bad!", None, None)],
        setup=([], [("ok", "nope", None)], None),
    )
    assert [rule for rule, *_ in found] == [
        "V1", "V2", "V3", "V4", "V5", "V6", "V7", "V6", "V7", "V7", "V8", "V9", "V8", "V9", "V10", "V9",
    ]
    assert found[0] == ("V1", "step_id", "malformed", "bad id")
    assert found[6] == ("V7", "mounts.container", "relative", "rel")
    assert found[11] == ("V9", "caches.path", "relative", "rel") and found[15][1] == "setup.caches.path"


def test_a_line_break_is_no_part_of_a_name(spark):
    found = violations(spark, "ok\n", inputs=[("a\n", None, None)], caches=[("c\n", "/c", None)])
    assert [(rule, problem) for rule, _, problem, _ in found] == [("V1", "malformed"), ("V5", "malformed"), ("V8", "malformed")]


def test_messages(spark):
    df = spark.createDataFrame([("p", "s", *[{**GOOD, "image": None, "env_file": "/x"}[k] for k in GOOD])], SCHEMA)
    texts = [r.message for r in V.describe(V.validate_steps(df)).orderBy("rank").collect()]
    assert texts == ["V2: step s has image missing", "V4: step s has env_file absolute (/x)"]


def test_missing_id(spark):
    assert violations(spark, "")[0][0] == "V1"
    assert violations(spark, None)[0][0] == "V1"


def test_definitions(spark):
    df = spark.createDataFrame(
        [("p", None, "", ["x"]), ("q", "q", None, []), ("r", "r", None, None), ("s", None, "S", ["x"])],
        "pipeline_id STRING, id STRING, name STRING, steps ARRAY<STRING>",
    )
    assert sorted((r.pipeline_id, r.rank) for r in V.validate_definitions(df).collect()) == [("p", 0), ("q", 1), ("r", 1)]
    steps = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b"), ("q", "a")], "pipeline_id STRING, step_id STRING")
    assert [(r.pipeline_id, r.step_id, r.rule) for r in V.duplicate_steps(steps).collect()] == [("p", "a", "V12")]
