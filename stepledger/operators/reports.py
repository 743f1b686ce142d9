"""The example reports: people per department and languages per category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepledger.functions.formats import rating
from stepledger.scale import number_rows

# Lines of the report.
REPORT_TITLE = "=== FINAL REPORT ==="
HIGH_EARNERS_TITLE = "--- High earners ---"


def department_stats(people: DataFrame) -> DataFrame:
    """Head count and average salary, cut to an integer, sorted by department."""
    return (
        people.groupBy("department")
        .agg(F.count(F.lit(1)).alias("employees"), F.expr("sum(salary) div count(1)").alias("avg_salary"))
        .orderBy("department")
    )


def high_earners(people: DataFrame, threshold: int = 70_000) -> DataFrame:
    return people.filter(F.col("salary") > threshold).select(
        "name", "department", F.concat(F.lit("$"), F.col("salary").cast("string")).alias("salary")
    )


def build_report(stats: DataFrame, high: DataFrame, generated_at: str | None = None) -> DataFrame:
    """Report lines ``(section, sort_key, line)``; ``orderBy(section, sort_key, line)`` gives the report.

    High earners are ordered by their ``pos`` column if they have one, else by name.
    """
    spark = stats.sparkSession
    fixed = [(0, REPORT_TITLE), (1, ""), (3, ""), (4, HIGH_EARNERS_TITLE)]
    if generated_at is not None:
        fixed += [(6, ""), (7, f"Report generated on {generated_at}")]
    frame = spark.createDataFrame(fixed, "section INT, line STRING").select("section", F.lit("").alias("sort_key"), "line")
    stat_lines = stats.select(
        F.lit(2).alias("section"),
        F.col("department").alias("sort_key"),
        F.format_string("%s: %d employees, avg salary $%d", "department", "employees", "avg_salary").alias("line"),
    )
    order = F.lpad(F.col("pos").cast("string"), 20, "0") if "pos" in high.columns else F.col("name")
    high_lines = high.select(
        F.lit(5).alias("section"), order.alias("sort_key"), F.concat_ws(" ", "name", "department", "salary").alias("line")
    )
    return frame.unionByName(stat_lines).unionByName(high_lines)


def category_analysis(languages: DataFrame) -> DataFrame:
    """Per category: count, mean score and first position; its languages in input order are ``rank_in_list``."""
    return languages.groupBy("category").agg(
        F.count(F.lit(1)).alias("count"),
        (F.sum("score") / F.count(F.lit(1))).alias("avg_score"),
        F.min("pos").alias("first_pos"),
    )


def total_rows(analysis: DataFrame) -> DataFrame:
    """Number of rows over all categories."""
    return analysis.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def rank_in_list(languages: DataFrame) -> DataFrame:
    """1-based place of each language in its category, in input order."""
    ranked = number_rows(languages.select("category", "language", "pos"), ["category"], ["pos"], "rank", start=1)
    return ranked.select("category", "language", "rank")


def ranked_by_language(ranked: DataFrame) -> DataFrame:
    return ranked.orderBy("language", "category", "rank")


def category_summary(analysis: DataFrame) -> DataFrame:
    return analysis.select("category", F.struct("count", F.col("avg_score").alias("avgScore")).alias("summary"))


def rated_categories(analysis: DataFrame) -> DataFrame:
    return analysis.withColumn("rating", rating(F.col("avg_score")))


def best_category(analysis: DataFrame) -> DataFrame:
    """The category with the highest mean; the one that came first wins a tie."""
    row = F.struct("category", "avg_score")
    best = F.max_by(row, F.struct(F.col("avg_score"), -F.col("first_pos")))
    return analysis.agg(best.alias("best")).filter(F.col("best").isNotNull()).select("best.*")


def total_languages(placed: DataFrame) -> DataFrame:
    """Number of languages over all categories, from rows ``(category, at, language)``."""
    return placed.agg(F.count("language").alias("total_languages"))


def languages_by_category(ranked: DataFrame) -> DataFrame:
    """Languages of each category in ranked order, one row each with its place ``at`` from 0."""
    rows = ranked.select("category", "language", "rank")
    return number_rows(rows, ["category"], ["language", "rank"], "at").select("category", "at", "language")


def category_languages(stats: DataFrame, placed: DataFrame) -> DataFrame:
    """Category rows with a row per language ``(category, at, language)``; one with nulls where there is none."""
    return stats.join(placed.select("category", "at", "language"), "category", "left")
