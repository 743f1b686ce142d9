"""Merging of a template's settings (low) with a step's own settings (high)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_env(low: Column, high: Column) -> Column:
    """Map union in which the right side wins; null only if both are null."""
    kept = F.map_filter(low, lambda key, _: ~F.map_contains_key(high, key))
    return F.when(low.isNull(), high).when(high.isNull(), low).otherwise(F.map_concat(kept, high))


def merge_env_levels(*levels: Column) -> Column:
    """Any number of levels, from the weakest to the strongest."""
    merged = levels[0]
    for level in levels[1:]:
        merged = merge_env(merged, level)
    return merged


def _joined(low: Column, high: Column) -> Column:
    return F.when(low.isNull(), high).when(high.isNull(), low).otherwise(F.concat(low, high))


def merge_caches(low: Column, high: Column) -> Column:
    """Union by ``name``: a name keeps its first position, the last entry of that name is used."""
    entries = _joined(low, high)
    names = F.array_distinct(F.transform(entries, lambda c: c["name"]))
    return F.transform(
        names, lambda name: F.element_at(F.filter(entries, lambda c: c["name"].eqNullSafe(name)), -1)
    )


def merge_mounts(low: Column, high: Column) -> Column:
    return _joined(low, high)


def merge_setup(low: Column, high: Column) -> Column:
    return (
        F.when(low.isNull(), high)
        .when(high.isNull(), low)
        .otherwise(
            F.struct(
                high["cmd"].alias("cmd"),
                merge_caches(low["caches"], high["caches"]).alias("caches"),
                F.coalesce(high["allow_network"], low["allow_network"]).alias("allow_network"),
            )
        )
    )
