"""File listings: sizes, inventories, ignore rules, log lines."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger.functions.ignore import DEFAULT_IGNORES, finding_regex, ignoring_regex, is_ignored, rule_columns
from stepledger.functions.paths import ancestors, depth_of, folder_at, parent_of, slashes
from stepledger.functions.text import basename
from stepledger.storage import materialize


def ignore_filter(files: DataFrame, patterns: Iterable[str] = ()) -> DataFrame:
    """Files that an ignore rule matches."""
    return files.filter(is_ignored(F.col("path"), patterns))


def remaining_files(files: DataFrame, patterns: Iterable[str] = ()) -> DataFrame:
    """Files that are left when the ignored ones are taken out."""
    return files.filter(~is_ignored(F.col("path"), patterns))


def _regexes(rules: Column) -> dict[str, Column]:
    return {"_exact": ignoring_regex(rules), "_met": finding_regex(rules, True), "_kept": finding_regex(rules, False)}


def _root_regexes(rules: DataFrame, root: str) -> DataFrame:
    """The regexes of the defaults and a root's own rules, a row per root; roots without rules have no row."""
    parsed = rules.select(root, F.struct("pos", rule_columns(F.col("pattern")).alias("rule")).alias("placed"))
    ordered = F.transform(F.array_sort(F.collect_list("placed")), lambda placed: placed["rule"])
    listed = parsed.filter("placed.rule IS NOT NULL").groupBy(root).agg(ordered.alias("rules"))
    found = _regexes(F.concat(_default_rules(), "rules"))
    return listed.select(root, *[regex.alias(name) for name, regex in found.items()])


def _default_rules() -> Column:
    return F.array(*[rule_columns(F.lit(pattern)) for pattern in DEFAULT_IGNORES])


def mark_ignored(files: DataFrame, rules: DataFrame, root: str) -> DataFrame:
    """Files with a column ``ignored`` by the rules ``(root, pos, pattern)`` of their own root, after the defaults.

    A path is tested as a file and as a folder, the last matching rule decides, and nothing below an ignored folder can be kept
    again. The empty path and files of a null root are never ignored.

    The rules of a root, which come from its rule file, become three regexes in one row, so that no row is multiplied by rules
    or depth. Most files are settled by one search of their path: no ignoring rule is met there, or one is and no keeping rule
    is. Only the others are judged folder by folder. The regexes are written down, so their true size decides how they are
    joined: where they are few, no file is shuffled, and a root with a large part of the files is not dealt to one task.
    """
    regexes = materialize(_root_regexes(rules, root), "rules")

    def met(regex: str, shown: Column) -> Column:
        # Unlike rlike, this keeps the compiled regex from row to row.
        return F.regexp_instr(shown, F.col(regex)) > 0

    # Files of one root stand together, so that its regexes are compiled once.
    known = files.sortWithinPartitions(root).join(regexes, root, "left")
    # Values, since Spark builds a regex from functions of arrays anew for every row, even if all is constant.
    plain = files.sparkSession.range(1).select(*[regex.alias(name) for name, regex in _regexes(_default_rules()).items()]).first()
    unruled = F.col("_exact").isNull()
    known = known.withColumns({f"{name}_": F.when(unruled, F.lit(value)).otherwise(F.col(name)) for name, value in plain.asDict().items()})
    path = F.col("path")
    whole = F.concat(path, F.lit("/"))
    above = F.filter(ancestors(path), lambda folder: folder != "")
    below = F.exists(above, lambda folder: met("_exact_", F.concat(folder, F.lit("/"))))
    settled = ~F.coalesce(met("_kept_", whole), F.lit(False)) & ~path.startswith("/")
    judged = settled | below | met("_exact_", path) | met("_exact_", whole)
    ignored = F.col(root).isNotNull() & (path != "") & met("_met_", whole) & judged
    return known.select(*files.columns, F.coalesce(ignored, F.lit(False)).alias("ignored"))


def files_to_ship(dependencies: DataFrame, files: DataFrame, rules: DataFrame, root: str) -> DataFrame:
    """``(root, dependency, path, length, error)``: the files of each dependency that no rule ignores.

    ``dependencies`` are ``(root, path)``, normalised; the path ``.`` is the whole root. A dependency without any file is an error row.

    A file is looked up only at the depths at which its root has dependencies, and files of other roots are not looked at. What is
    asked is written once, and so are the few depths: their true size decides how they meet the files, which are not dealt by root.
    """
    top = F.when(F.col("path") == ".", "").otherwise(F.col("path"))
    depth = F.when(F.col("top") == "", F.lit(0)).otherwise(F.size(F.split("top", "/")))
    asked = materialize(dependencies.select(root, F.col("path").alias("dependency"), top.alias("top")), "asked")
    depths = materialize(asked.groupBy(root).agg(F.collect_set(depth).alias("depths")), "depths")
    parts = F.split("path", "/")
    reached = F.filter("depths", lambda d: d <= F.size(parts))
    near = (
        files.select(root, "path", "length")
        .join(depths, root)
        .withColumn("top", F.explode(F.transform(reached, lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))))
        .drop("depths")
    )
    held = near.join(asked.select(root, "top").distinct(), [root, "top"], "left_semi")
    found = asked.join(mark_ignored(held, rules, root), [root, "top"], "left").filter("ignored IS NULL OR NOT ignored")
    missing = F.when(F.col("ignored").isNull(), F.concat(F.lit("Dependency not found: "), "dependency"))
    return found.select(root, "dependency", "path", "length", missing.alias("error"))


def dir_sizes(files: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Recursive bytes of every folder, the root as the empty path.

    The files of one folder are summed first, so only one row per folder is multiplied by its depth. Folders are cut out by
    compiled string functions: a function of arrays per row would cost more than the sums.
    """
    direct = files.groupBy(*keys, parent_of(F.col("path")).alias("folder")).agg(F.sum("length").alias("length"))
    above = direct.select(*keys, "folder", "length", F.explode(F.sequence(F.lit(0), depth_of(F.col("folder")))).alias("_depth"))
    return (
        above.select(*keys, folder_at(F.col("folder"), F.col("_depth")).alias("dir"), "length")
        .groupBy(*keys, "dir")
        .agg(F.sum("length").alias("size"))
    )


def dir_size(files: DataFrame, requests: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Recursive bytes of the requested folders ``(keys…, dir)``; a folder that does not exist has 0.

    A file is counted only at the depths at which its key has requests, and files of other keys are not looked at.
    """
    depths = requests.select(*keys, depth_of(F.col("dir")).alias("_depth")).distinct()
    sizes = (
        files.select(*keys, "path", "length")
        .join(depths, list(keys))
        .filter(F.col("_depth") <= slashes(F.col("path")))
        .select(*keys, folder_at(F.col("path"), F.col("_depth")).alias("dir"), "length")
        .groupBy(*keys, "dir")
        .agg(F.sum("length").alias("size"))
    )
    return requests.join(sizes, [*keys, "dir"], "left").select(
        *keys, "dir", F.coalesce("size", F.lit(0)).alias("size")
    )


def list_directory(files: DataFrame, directory: str = "", keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Entries directly below a folder: files with their size, folders with size 0."""
    directory = posixpath.normpath(directory.lstrip("/") or ".")
    if directory.split("/")[0] == "..":
        raise ValueError(f"Invalid path: {directory} is outside of the listed files")
    directory = "" if directory == "." else directory
    prefix = f"{directory}/" if directory else ""
    rest = F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path"))
    nested = F.contains(rest, F.lit("/"))
    return (
        files.filter(F.startswith("path", F.lit(prefix)))
        .groupBy(
            *keys,
            F.substring_index(rest, "/", 1).alias("name"),
            F.when(nested, F.lit("directory")).otherwise(F.lit("file")).alias("type"),
        )
        .agg(F.max(F.when(nested, F.lit(0)).otherwise(F.col("length"))).alias("size"))
    )


def file_inventory(files: DataFrame) -> DataFrame:
    """Base name and size of every file, sorted by full path."""
    return files.orderBy("path", "length").select(
        basename(F.col("path")).alias("filename"), F.col("length").alias("size_bytes")
    )


def filter_stream(logs: DataFrame, stream: str = "both") -> DataFrame:
    """Lines of one stream, or of both with stdout first."""
    if stream != "both":
        logs = logs.filter(F.col("stream") == stream)
    return logs.orderBy("run_id", F.desc("stream"), "line_no")


def line_counts(logs: DataFrame, keys: Sequence[str | Column] = ("run_id", "stream")) -> DataFrame:
    return logs.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"))
