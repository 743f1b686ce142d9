"""Plain tables: headerless CSV in, CSV, JSON documents and text reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_headerless_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", False).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_json_doc(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Documents of one JSON object per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_doc(df: DataFrame, path: str) -> None:
    """One compact document per row."""
    df.write.json(path)


def write_text_report(lines: DataFrame, path: str, order: list[str], line: str = "line") -> None:
    """Ordered lines as text files; read in the order of their names they are the report.

    The sort is by range, so every task writes its own part of the report.
    """
    lines.orderBy(*order).select(F.col(line).alias("value")).write.text(path)
