"""Numbering of groups of any size, by one plan whatever the input's size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepledger.storage import materialize


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str, start: int = 0
) -> DataFrame:
    """Gap-free numbers from ``start`` within each key, in the given (total) order.

    The rows are range-partitioned by key *and* order, so that one key may span many partitions, and written
    once (the partition number is stored with the rows and cannot change on a retry). Every (key, partition) piece
    then needs only the number of its first row, which is a running sum over the piece counts of the key.
    """
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = materialize(
        df.repartitionByRange(*[F.col(k) for k in keys], *order)
        .sortWithinPartitions(*[F.col(k) for k in keys], *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id()),
        "placed",
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        placed.groupBy(*keys, "_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_piece"), "_first", "_before")
    )
    # Null is a key like any other here.
    same = F.col("_part") == F.col("_piece")
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_key{i}"))
    number = F.col("_row") - F.col("_first") + F.col("_before") + F.lit(start)
    return placed.join(pieces, same).select(*df.columns, number.alias(name))
