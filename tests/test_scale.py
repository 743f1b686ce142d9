"""Splitting of large groups gives the same rows as handling them whole, and plans keep to it."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from stepledger.operators.events import failed_stderr_tail
from stepledger.operators.files import dir_size, dir_sizes
from stepledger.operators.history import latest_run_per_step
from stepledger.operators.reports import languages_by_category, rank_in_list
from stepledger.scale import number_rows
from stepledger.storage import materialize, path_exists, remove_path, shared_folder, work_path


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def hot(spark):
    """A third of the rows share one key; another key has one row."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") == 1, F.lit("lone")).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    return spark.range(3000).select(key.alias("key"), F.hash("id").alias("order"), "id")


def counted(df, descending=False):
    """The numbers that a loop gives."""
    seen, out = {}, []
    for r in sorted(df.collect(), key=lambda r: (r.order, r.id), reverse=descending):
        seen[r.key] = seen.get(r.key, -1) + 1
        out.append((r.key, r.order, r.id, seen[r.key]))
    return sorted(out)


def test_number_rows_with_hot_key(spark):
    df = hot(spark).repartition(7)
    assert sorted(map(tuple, number_rows(df, ["key"], ["order", "id"], "n").collect())) == counted(df)
    backwards = number_rows(df, ["key"], [F.desc("order"), F.desc("id")], "n", start=1).collect()
    assert sorted((*r[:3], r.n - 1) for r in backwards) == counted(df, descending=True)
    assert sorted(r.n for r in number_rows(df, [], ["order", "id"], "n").collect()) == list(range(3000))
    assert number_rows(df.limit(0), ["key"], ["order", "id"], "n").count() == 0


def test_plans_do_not_change_with_the_size(spark):
    """Neither a count nor a limit stands before the plan."""

    def shape(n):
        table = materialize(spark.range(n).selectExpr("id % 3 AS key", "id"), "sized")
        text = plan(number_rows(table, ["key"], ["id"], "n")).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        return re.findall(r"(Join|Aggregate|Window|Filter|Relation)", text)

    assert shape(5) == shape(20_000)


def test_null_keys_are_numbered_too(spark):
    key = F.when(F.col("id") % 2 == 0, F.concat(F.lit("k"), F.col("id") % 5))
    df = spark.range(200).select(key.alias("key"), "id").repartition(3)
    split = number_rows(df, ["key"], ["id"], "n").collect()
    assert sorted(r.n for r in split if r.key is None) == list(range(100))
    assert len(split) == 200


def test_work_tables(spark):
    path = work_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert path_exists(spark, path)
    remove_path(spark, path)
    assert not path_exists(spark, path)


def test_split_numbering_spreads_the_hot_key(spark):
    split = number_rows(hot(spark).repartition(7), ["key"], ["order", "id"], "n")
    # No window sorts rows: the only one runs over the counts of (key, part) pieces.
    assert "rowsBetween" not in plan(split) and "row_number" not in plan(split)


def test_reports_with_hot_category(spark):
    rows = hot(spark).select(F.col("key").alias("category"), F.concat(F.lit("l"), F.col("id") % 97).alias("language"), F.col("id").alias("pos"))
    placed = languages_by_category(rank_in_list(rows)).collect()
    of_hot = [r.language for r in sorted((r for r in placed if r.category == "hot"), key=lambda r: r.at)]
    assert len(placed) == 3000 and of_hot == sorted(r.language for r in rows.filter("category = 'hot'").collect())


def test_tail_is_cut_before_the_shuffle(spark):
    schema = "seq BIGINT, type STRING, event STRUCT<job_id: STRING, step: STRUCT<id: STRING>, steps: ARRAY<STRUCT<id: STRING>>, stream: STRING, line: STRING>"
    tail = failed_stderr_tail(spark.createDataFrame([], schema))
    text = plan(materialized_plan(spark, tail, schema))
    assert "WindowGroupLimit" in text and "Partial" in text


def materialized_plan(spark, _, schema):
    table = materialize(spark.createDataFrame([], schema), "plan")
    return failed_stderr_tail(table)


def test_latest_run_is_an_aggregate(spark):
    table = materialize(spark.range(10).selectExpr("'w' workspace_id", "'s' step_id", "id run_id", "id finished_at", "id * 2 other"), "plan")
    text = plan(latest_run_per_step(table.select("workspace_id", "step_id", "run_id", "finished_at")))
    assert "partial_max_by" in text and "Window" not in text
    assert "other" not in text.split("ReadSchema")[1]


def test_no_cross_joins_or_hints(spark):
    assert shared_folder(spark)
    from pathlib import Path

    own = [p for p in Path(__file__).parent.parent.joinpath("stepledger").rglob("*.py") if "llm" not in p.parts]
    source = "\n".join(p.read_text() for p in own)
    assert "crossJoin" not in source and "localCheckpoint" not in source and "broadcast(" not in source


def test_folders_are_cut_out_by_compiled_functions(spark):
    """No function of arrays and no list of depths per key, which run row by row outside the compiled plan."""
    table = [("r", "a/b/x", 1), ("r", "a//y", 2), ("r", "z", 4), ("r", None, 8), (None, "a/x", 16), ("q", "", 32)]
    files = spark.createDataFrame(table, "run_id STRING, path STRING, length BIGINT")
    asked = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "a/"), (None, "a"), ("q", "")], "run_id STRING, dir STRING")
    sums, found = dir_sizes(files), dir_size(files, asked)
    for df in (sums, found):
        assert not re.search(r"lambdafunction|collect_set|ObjectHashAggregate", plan(df))
    expected = {("r", "", 7), ("r", "a", 3), ("r", "a/b", 1), ("r", "a/", 2), (None, "", 16), (None, "a", 16), ("q", "", 32)}
    assert {tuple(r) for r in sums.collect()} == expected
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == sorted([("r", "a", 3), ("r", "a", 3), ("r", "a/", 2), (None, "a", 0), ("q", "", 32)], key=repr)
