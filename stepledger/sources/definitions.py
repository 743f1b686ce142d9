"""Definition files and environment files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepledger import schemas as S
from stepledger.functions.text import derive_id
from stepledger.sources.paths import decoded, plain

# The definition file of a folder, first wins.
DEFINITION_FILES = ("pipeline.yml", "pipeline.yaml", "pipeline.json")

# An assignment is a key, an equals sign and a value: a text in quotes of one kind, or what stands before a comment or the
# end of the line.
_QUOTED = "|".join(rf"{q}(?:[^{q}\\]|\\[\s\S])*{q}" for q in "'\"`")
_ASSIGNMENT = rf"(?dm)^[ \t]*(?:export[ \t]+)?([A-Za-z0-9_.-]+)[ \t]*=[ \t]*({_QUOTED}|[^#\n]*)[ \t]*(?:#[^\n]*)?$"


def definition_files(listing: DataFrame) -> DataFrame:
    """The definition file of each folder from a listing ``(path)``, by the order of preference."""
    name = F.substring_index("path", "/", -1)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    rank = F.array_position(F.array(*[F.lit(n) for n in DEFINITION_FILES]), name)
    return (
        listing.withColumn("rank", rank)
        .filter("rank > 0")
        .groupBy(folder.alias("root"))
        .agg(F.min_by("path", "rank").alias("path"))
    )


def read_pipelines(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """``(pipelines, step_defs)`` of all JSON definition files below ``path``.

    Where a folder has several definition files, those that another one takes precedence over are left out.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(plain(F.col("path")).alias("path"))
    )
    name = F.substring_index("path", "/", -1)
    shadowed = (
        listing.filter(name.isin(*DEFINITION_FILES))
        .join(definition_files(listing).select("path"), "path", "left_anti")
        .withColumnRenamed("path", "file")
    )
    documents = (
        spark.read.schema(S.ddl(S.PIPELINE_DOCUMENT))
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .json(path)
        .select("*", decoded(F.col("_metadata.file_path")).alias("file"))
        .join(shadowed, "file", "left_anti")
        .withColumn("pipeline_id", derive_id(F.col("id"), F.col("name")))
    )
    pipelines = documents.select(
        "pipeline_id",
        "id",
        "name",
        F.regexp_replace("file", "/[^/]*$", "").alias("root"),
        F.size("steps").alias("n_steps"),
    )
    steps = documents.select("pipeline_id", F.posexplode("steps").alias("pos", "step"))
    step_defs = steps.select("pipeline_id", "pos", F.col("step").cast(S.struct(S.STEP)).alias("step")).select(
        "pipeline_id", "pos", derive_id(F.col("step.id"), F.col("step.name")).alias("step_id"), "step.*"
    )
    return pipelines, step_defs


def read_dotenv(spark: SparkSession, path: str, glob: str = "*.env") -> DataFrame:
    """``(file, key, value)`` of environment files; the last assignment of a key counts.

    Blank lines and comments are left out, quotes around a value are taken off. A quoted value may span lines, so each of these small files is read as one text.
    """
    text = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(path, wholetext=True)
        .select(
            decoded(F.col("_metadata.file_path")).alias("file"),
            F.regexp_replace("value", "\r\n?", "\n").alias("text"),
        )
    )
    pairs = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(_ASSIGNMENT), 1).alias("key"),
        F.regexp_extract_all("text", F.lit(_ASSIGNMENT), 2).alias("raw"),
    )
    raw = F.btrim("pair.raw", F.lit(" \t"))
    quote = F.substring(raw, 1, 1)
    quoted = quote.isin("'", '"', "`") & (F.length(raw) > 1) & raw.endswith(quote)
    inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
    # Only double quotes stand for more than the text between them.
    lines = F.replace(F.replace(inner, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    value = F.when(quoted & (quote == '"'), lines).when(quoted, inner).otherwise(raw)
    return (
        text.select("file", F.posexplode(pairs).alias("pos", "pair"))
        .select("file", F.col("pair.key").alias("key"), value.alias("value"), "pos")
        .groupBy("file", "key")
        .agg(F.max_by("value", "pos").alias("value"))
    )
