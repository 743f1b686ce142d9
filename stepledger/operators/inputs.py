"""Inputs of steps: resolution to runs, templates, dependencies on files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepledger import schemas as S
from stepledger.functions.merge import merge_caches, merge_env, merge_mounts, merge_setup
from stepledger.functions.paths import normalize_path
from stepledger.functions.text import input_alias, input_step, mounted_as

# The sources of a template, first wins.
SOURCE_PRIORITY = ("alias", "local_dir", "local_file", "custom", "builtin", "package")


def resolve_inputs(inputs: DataFrame, step_runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs ``(pipeline_id, step_id, dep_id, …)`` as metadata rows (unresolved kept) and as mounts."""
    runs = step_runs.select("pipeline_id", F.col("step_id").alias("dep_id"), "run_id")
    keys = ["pipeline_id", "dep_id"]
    metadata = inputs.join(runs, keys, "left").select(
        "pipeline_id", "step_id", "dep_id", "run_id", mounted_as(F.col("dep_id")).alias("mounted_as")
    )
    mounts = inputs.join(runs, keys).select(
        "pipeline_id", "step_id", "run_id", mounted_as(F.col("dep_id")).alias("container_path")
    )
    return metadata, mounts


def exec_inputs(specs: DataFrame, state: DataFrame) -> DataFrame:
    """Input options ``(workspace_id, step_id, pos, spec)`` with alias, source step, run id or error.

    The last option of an alias counts.
    """
    named = specs.select(
        "workspace_id",
        "step_id",
        input_alias(F.col("spec")).alias("alias"),
        input_step(F.col("spec")).alias("source"),
        "pos",
    )
    last = named.groupBy("workspace_id", "step_id", "alias").agg(F.max_by("source", "pos").alias("source"))
    runs = state.select("workspace_id", F.col("step_id").alias("source"), "run_id")
    return last.join(runs, ["workspace_id", "source"], "left").select(
        "workspace_id",
        "step_id",
        "alias",
        "source",
        "run_id",
        F.when(F.col("run_id").isNull(), F.concat(F.lit("No run found for input step: "), "source")).alias("error"),
    )


def add_exec_inputs(steps: DataFrame, resolved: DataFrame) -> DataFrame:
    """Steps with every resolved alias in ``inputs``; names already listed are not repeated."""
    aliases = (
        resolved.filter(F.col("error").isNull())
        .groupBy("workspace_id", "step_id")
        .agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    )
    fresh = F.array_except("aliases", F.coalesce(F.col("inputs.step"), F.array().cast("array<string>")))
    added = F.transform(
        fresh,
        lambda name: F.struct(
            name.alias("step"),
            F.lit(None).cast("boolean").alias("copy_to_output"),
            F.lit(None).cast("boolean").alias("optional"),
        ).cast(S.struct(S.INPUT)),
    )
    inputs = F.when(F.col("aliases").isNull(), F.col("inputs")).otherwise(
        F.concat(F.coalesce("inputs", F.array().cast(f"array<{S.struct(S.INPUT)}>")), added)
    )
    return steps.join(aliases, ["workspace_id", "step_id"], "left").withColumn("inputs", inputs).drop("aliases")


def apply_templates(step_defs: DataFrame, templates: DataFrame) -> DataFrame:
    """Definitions with ``uses`` completed from the template of that name; the others pass through.

    ``templates`` holds ``(uses, image, cmd, setup, env, caches, mounts, sources, allow_network)``.
    """
    renamed = templates.select("uses", *[F.col(c).alias(f"t_{c}") for c in templates.columns if c != "uses"])
    merged = {
        "setup": merge_setup(F.col("t_setup"), F.col("setup")),
        "env": merge_env(F.col("t_env"), F.col("env")),
        "caches": merge_caches(F.col("t_caches"), F.col("caches")),
        "mounts": merge_mounts(F.col("t_mounts"), F.col("mounts")),
        "sources": merge_mounts(F.col("t_sources"), F.col("sources")),
        "image": F.col("t_image"),
        "cmd": F.col("t_cmd"),
        "allow_network": F.coalesce("allow_network", "t_allow_network"),
    }
    columns = [
        F.when(F.col("uses").isNotNull(), merged[c]).otherwise(F.col(c)).alias(c) if c in merged else F.col(c)
        for c in step_defs.columns
    ]
    return step_defs.join(renamed, "uses", "left").select(*columns)


def resolve_by_priority(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """``names (name)`` with the strongest of ``candidates (name, source, target)``, or an error.

    A package counts only for names with a ``/`` or a leading ``@``.
    """
    priority = F.array_position(F.array(*[F.lit(s) for s in SOURCE_PRIORITY]), F.col("source"))
    packaged = F.col("name").contains("/") | F.col("name").startswith("@")
    best = (
        candidates.filter((F.col("source") != "package") | packaged)
        .groupBy("name")
        .agg(F.min_by(F.struct("source", "target"), priority).alias("best"))
    )
    return names.join(best, "name", "left").select(
        *names.columns,
        "best.source",
        "best.target",
        F.when(F.col("best").isNull(), F.concat(F.lit('Unknown template: "'), "name", F.lit('"'))).alias("error"),
    )


def collect_dependencies(steps: DataFrame) -> DataFrame:
    """Distinct normalised host paths of mounts and sources per pipeline, sorted."""
    hosts = steps.select("pipeline_id", F.explode("mounts.host").alias("host")).union(
        steps.select("pipeline_id", F.explode("sources.host").alias("host"))
    )
    return (
        hosts.select("pipeline_id", normalize_path(F.col("host")).alias("path"))
        .distinct()
        .orderBy("pipeline_id", "path")
    )


def copy_to_output(inputs: DataFrame, step_runs: DataFrame, files: DataFrame) -> DataFrame:
    """Files in the output of each step: those of its copied inputs, then its own; a later path overwrites.

    ``inputs`` holds ``(pipeline_id, step_id, pos, dep_id, copy_to_output)``, ``step_runs`` the run of each
    step, ``files`` the files ``(run_id, path, length)`` that each run wrote itself. What decides and what is kept is one
    struct, so a length travels once and equal turns give the same file in every run.
    """
    runs = step_runs.select("pipeline_id", F.col("step_id").alias("dep_id"), "run_id")
    copied = (
        inputs.filter("copy_to_output")
        .join(runs, ["pipeline_id", "dep_id"])
        .select("pipeline_id", "step_id", "run_id", F.lit(0).alias("own"), "pos")
    )
    own = step_runs.select(
        "pipeline_id", "step_id", "run_id", F.lit(1).alias("own"), F.lit(0).alias("pos")
    )
    return (
        copied.unionByName(own)
        .join(files.select("run_id", "path", "length"), "run_id")
        .groupBy("pipeline_id", "step_id", "path")
        .agg(F.max(F.struct("own", "pos", "length", "run_id")).alias("file"))
        .select("pipeline_id", "step_id", "path", F.col("file.run_id").alias("source_run"), "file.length")
    )
