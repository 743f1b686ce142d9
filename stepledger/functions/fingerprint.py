"""The configuration hash that decides whether a step has changed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters that the JSON writer escapes with upper-case hex digits.
_UPPER_CASE_ESCAPES = ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F")


def canonical_json(value: Column) -> Column:
    """Compact JSON with lower-case hex digits in ``\\u`` escapes."""
    text = F.to_json(value)
    lowered = text
    for code in _UPPER_CASE_ESCAPES:
        lowered = F.regexp_replace(lowered, r"(?<!\\)((?:\\\\)*)\\u" + code, r"$1\\u" + code.lower())
    return F.when(text.contains("\\u00"), lowered).otherwise(text)


def _by_locale(items: Column, key) -> Column:
    """The items in the order of the root locale's collation; equal ones keep their places."""
    placed = F.transform(
        items, lambda x, i: F.struct(F.collate(key(x), "UNICODE").alias("key"), i.alias("at"), x.alias("item"))
    )
    return F.transform(F.array_sort(placed), lambda x: x["item"])


def fingerprint(
    image: Column,
    cmd: Column,
    setup_cmd: Column | None = None,
    env: Column | None = None,
    input_run_ids: Column | None = None,
    mounts: Column | None = None,
) -> Column:
    """SHA-256 over the settings one after the other, without separators.

    An absent (null) setting adds nothing, an empty map or list adds ``[]``; only an empty list of mounts
    counts as absent. Entries are sorted by the collation of the root locale, in which ``a`` comes before ``B``.
    ``mounts`` has fields ``host`` and ``container``.
    """
    parts = [image, canonical_json(cmd)]
    if setup_cmd is not None:
        parts.append(F.coalesce(canonical_json(setup_cmd), F.lit("")))
    if env is not None:
        pairs = F.transform(_by_locale(F.map_entries(env), lambda e: e["key"]), lambda e: F.array(e["key"], e["value"]))
        parts.append(F.coalesce(canonical_json(pairs), F.lit("")))
    if input_run_ids is not None:
        parts.append(F.coalesce(canonical_json(_by_locale(input_run_ids, lambda x: x)), F.lit("")))
    if mounts is not None:
        shaped = F.transform(
            _by_locale(mounts, lambda m: m["container"]),
            lambda m: F.struct(m["host"].alias("hostPath"), m["container"].alias("containerPath")),
        )
        parts.append(F.when(F.size(mounts) > 0, canonical_json(shaped)).otherwise(F.lit("")))
    return F.sha2(F.concat(*parts), 256)
