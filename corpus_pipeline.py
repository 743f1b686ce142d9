"""A corpus from raw documents: language, repeated lines, near copies, benchmark passages, packed sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. All but the last return the columns
of the documents. ``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepledger.llm import blocks as B
from stepledger.llm.decontamination import drop_contaminated
from stepledger.llm.langid import learn_and_identify
from stepledger.llm.lines import dedup_lines
from stepledger.llm.packing import pack_documents
from stepledger.llm.simhash import drop_near_duplicates
from stepledger.storage import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is not clear, go."""
    return B.documents_of(learn_and_identify(docs).where("NOT rejected"), docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents stay in one of them only; no document goes. ``n_chars``, where it is a column, follows the text."""
    kept = dedup_lines(docs)
    out = B.documents_of(kept, docs, text=F.when(F.col("row.text").isNotNull(), F.col("text")))
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: SimHash of three-word shingles, links of at most two differing bits."""
    return B.documents_of(drop_near_duplicates(docs), docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of full length."""
    return pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("lines", remove_repeated_lines),
    ("near_copies", remove_near_copies),
    ("benchmark", remove_benchmark_passages),
    ("packing", pack_sequences),
]

#: No SQL expresses compression, fingerprints, edit distances or tokens; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
