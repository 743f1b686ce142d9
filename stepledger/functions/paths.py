"""POSIX path arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segments(path: Column) -> Column:
    """Resolved segments of a path; ``..`` survives only at the front of a relative path."""
    absolute = path.startswith("/")

    def step(done: Column, part: Column) -> Column:
        can_pop = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return (
            F.when(part.isin("", "."), done)
            .when(part != "..", F.array_append(done, part))
            .when(can_pop, F.slice(done, 1, F.size(done) - 1))
            .when(absolute, done)
            .otherwise(F.array_append(done, part))
        )

    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def normalize_path(path: Column) -> Column:
    """Collapse ``//``, ``.`` and ``a/..`` and drop a trailing slash (so ``/`` alone becomes empty)."""
    joined = F.array_join(_segments(path), "/")
    return (
        F.when(path.startswith("/"), F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("/"), joined)))
        .when(joined == "", F.lit("."))
        .otherwise(joined)
    )


def resolve_path(root: Column, path: Column) -> Column:
    """``path`` seen from the absolute ``root``; an absolute path stands for itself."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", root, path))
    return F.concat(F.lit("/"), F.array_join(_segments(full), "/"))


def within_boundary(root: Column, path: Column, boundary: Column) -> Column:
    resolved = resolve_path(root, path)
    return (resolved == boundary) | F.startswith(resolved, F.concat(boundary, F.lit("/")))


def relative_path(root: Column, path: Column) -> Column:
    """The way from ``root`` to ``path``, both absolute."""
    start, end = _segments(root), _segments(path)
    steps = F.sequence(F.lit(0), F.least(F.size(start), F.size(end)))
    shared = F.array_max(F.filter(steps, lambda n: F.slice(start, F.lit(1), n) == F.slice(end, F.lit(1), n)))
    up = F.array_repeat(F.lit(".."), F.size(start) - shared)
    return F.array_join(F.concat(up, F.slice(end, shared + 1, F.size(end))), "/")


def relativize(root: Column, mounts: Column) -> Column:
    """Mounts with absolute hosts rewritten relative to ``root``."""
    return F.transform(
        mounts,
        lambda m: F.struct(
            F.when(m["host"].startswith("/"), relative_path(root, m["host"])).otherwise(m["host"]).alias("host"),
            m["container"].alias("container"),
        ),
    )


def ancestors(path: Column) -> Column:
    """Every directory prefix of a relative path, the root (empty) first, the path itself excluded."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def slashes(path: Column) -> Column:
    """How many slashes a path has."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def depth_of(folder: Column) -> Column:
    """How many names a relative folder has; the root (empty) has none."""
    return F.when(folder == "", F.lit(0)).otherwise(slashes(folder) + 1)


def parent_of(path: Column) -> Column:
    """The folder of a relative path, empty at the root."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)


def folder_at(path: Column, depth: Column) -> Column:
    """The first ``depth`` names of a relative path that has at least as many."""
    return F.call_function("substring_index", path, F.lit("/"), depth)
