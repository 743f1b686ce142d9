"""Checks of step definitions. Every finding is reported, in the order in which the rules are tried.

A finding names the rule, the field it looked at, what is wrong there and the value found. Per field the first problem counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The whole name; ``$`` would let a line break follow it.
_IDENTIFIER = r"^[A-Za-z0-9_-]+\z"
_FINDING = "struct<rule: string, field: string, problem: string, value: string>"


def _empty(value: Column) -> Column:
    return value.isNull() | (value == "")


def _malformed(value: Column) -> Column:
    return ~F.coalesce(value, F.lit("")).rlike(_IDENTIFIER)


def _rooted(value: Column) -> Column:
    return value.startswith("/")


def _no_items(value: Column) -> Column:
    return F.coalesce(F.size(value), F.lit(0)) <= 0


# What may be wrong with a field of a kind, in the order of the tests.
_PROBLEMS = {
    "identifier": [("malformed", _malformed)],
    "name": [("missing", _empty), ("malformed", _malformed)],
    "text": [("missing", _empty)],
    "inner path": [("absolute", _rooted)],
    "host path": [("missing", _empty), ("absolute", _rooted)],
    "container path": [("missing", _empty), ("relative", lambda x: ~_rooted(x)), ("climbing", lambda x: x.contains(".."))],
    "cache path": [("missing", _empty), ("relative", lambda x: ~_rooted(x))],
    "list": [("empty", _no_items)],
}
# Fields of the elements of lists: rule, name, kind.
_MOUNT = [("V6", "host", "host path"), ("V7", "container", "container path")]
_CACHE = [("V8", "name", "name"), ("V9", "path", "cache path")]
# All rules in order: rule, field and kind of a step's own field, or the list whose elements are looked at, and their fields.
_RULES = [
    ("V1", "step_id", "identifier"),
    ("V2", "image", "text"),
    ("V3", "cmd", "list"),
    ("V4", "env_file", "inner path"),
    ("inputs", [("V5", "step", "identifier")]),
    ("mounts", _MOUNT),
    ("sources", _MOUNT),
    ("caches", _CACHE),
    ("V10", "setup.cmd", "list"),
    ("setup.caches", _CACHE),
]


def _finding(rule: str, field: str, value: Column, kind: str, shown: Column | None = None, applies: Column | None = None) -> Column:
    problem = F.lit(None).cast("string")
    for name, test in reversed(_PROBLEMS[kind]):
        problem = F.when(F.coalesce(test(value), F.lit(False)), F.lit(name)).otherwise(problem)
    found = F.struct(F.lit(rule).alias("rule"), F.lit(field).alias("field"), problem.alias("problem"), (value if shown is None else shown).alias("value"))
    holds = problem.isNotNull() if applies is None else applies & problem.isNotNull()
    return F.when(holds, found).cast(_FINDING)


def _findings(rule: tuple) -> Column:
    if len(rule) == 2:
        name, fields = rule
        each = lambda x: F.array(*[_finding(r, f"{name}.{f}", x[f], kind) for r, f, kind in fields])
        return F.coalesce(F.flatten(F.transform(F.col(name), each)), F.array().cast(f"array<{_FINDING}>"))
    code, field, kind = rule
    value = F.col(field)
    shown = F.lit(None).cast("string") if kind == "list" else None
    return F.array(_finding(code, field, value, kind, shown, F.col("setup").isNotNull() if code == "V10" else None))


def _reported(df: DataFrame, keys: list[str], findings: Column) -> DataFrame:
    """A row per finding, with its ``rank`` among all that was looked at; what is in order never becomes a row."""
    placed = F.transform(findings, lambda x, i: F.when(x.isNotNull(), F.struct(i.alias("rank"), x.alias("found"))))
    rows = df.select(*keys, F.explode(F.filter(placed, lambda x: x.isNotNull())).alias("f"))
    return rows.select(*keys, "f.found.rule", "f.rank", "f.found.field", "f.found.problem", "f.found.value")


def validate_steps(steps: DataFrame) -> DataFrame:
    """V1 to V10: ``(pipeline_id, step_id, rule, rank, field, problem, value)``; the lowest rank is what fails first."""
    return _reported(steps, ["pipeline_id", "step_id"], F.concat(*[_findings(rule) for rule in _RULES]))


def _named(df: DataFrame, *extra: str) -> Column:
    """Is there an id, a name or one of ``extra``?"""
    return F.coalesce(*[F.when(~_empty(F.col(c)), F.lit(True)) for c in ("id", "name", *extra)], F.lit(False))


def _lacking(rule: str) -> list[Column]:
    return [F.lit(rule).alias("rule"), F.lit("id").alias("field"), F.lit("missing").alias("problem")]


def validate_definitions(pipelines: DataFrame) -> DataFrame:
    """V11 on ``(pipeline_id, id, name, steps)``: an id or a name, and a non-empty list of steps."""
    nothing = F.lit(None).cast("string")
    named = F.when(_named(pipelines), F.lit("x")).otherwise("")
    findings = F.array(_finding("V11", "id", named, "text", nothing), _finding("V11", "steps", F.col("steps"), "list", nothing))
    return _reported(pipelines, ["pipeline_id"], findings).drop("value")


def validate_step_names(step_defs: DataFrame) -> DataFrame:
    """V11 on ``(pipeline_id, pos, id, name)``: every step has an id or a name."""
    return step_defs.filter(~_named(step_defs)).select("pipeline_id", "pos", *_lacking("V11"))


def duplicate_steps(steps: DataFrame) -> DataFrame:
    """V12: step ids used more than once in a pipeline."""
    uses = steps.groupBy("pipeline_id", "step_id").agg(F.count(F.lit(1)).alias("uses"))
    return uses.filter("uses > 1").select(
        "pipeline_id", "step_id", F.lit("V12").alias("rule"), F.lit("id").alias("field"), F.lit("repeated").alias("problem")
    )


def validate_step_files(step_defs: DataFrame) -> DataFrame:
    """V13 on ``(file, id, name, override)``: a step file needs an id, a name or an override."""
    return step_defs.filter(~_named(step_defs, "override")).select("file", *_lacking("V13"))


def describe(findings: DataFrame) -> DataFrame:
    """Findings of ``validate_steps`` with a ``message`` for people."""
    shown = F.when(F.col("value").isNotNull(), F.concat(F.lit(" ("), "value", F.lit(")"))).otherwise("")
    step = F.coalesce("step_id", F.lit("without id"))
    return findings.withColumn("message", F.concat("rule", F.lit(": step "), step, F.lit(" has "), "field", F.lit(" "), "problem", shown))
