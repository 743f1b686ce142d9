"""The example jobs, end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger.functions.condition import eval_condition
from stepledger.operators.reports import (
    best_category,
    build_report,
    category_analysis,
    category_languages,
    department_stats,
    high_earners,
    languages_by_category,
    rank_in_list,
    rated_categories,
    total_languages,
)


def text_report_job(people: DataFrame, env: Column, threshold: int = 70_000) -> DataFrame:
    """Lines ``(step, section, sort_key, line)`` of the report and of the steps that ``env`` switches on."""
    high = high_earners(people, threshold)
    report = build_report(department_stats(people), high)
    count = F.count(F.lit(1)).alias("n")
    notice = report.agg(count).select(F.format_string("Would notify: report ready (%d lines)", "n").alias("line"))
    records = people.agg(count).select(F.format_string("Input records: %d", "n").alias("line"))
    audit = records.unionByName(high.agg(count).select(F.format_string("High earners: %d", "n").alias("line")))

    def optional(name: str, condition: str, lines: DataFrame) -> DataFrame:
        return lines.filter(eval_condition(F.lit(condition), env)).select(
            F.lit(name).alias("step"), F.lit(0).alias("section"), F.lit("").alias("sort_key"), "line"
        )

    return (
        report.select(F.lit("report").alias("step"), "section", "sort_key", "line")
        .unionByName(optional("notify", "env.NOTIFY", notice))
        .unionByName(optional("audit", "env.AUDIT", audit))
    )


def category_summary_job(languages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(summary, categories)``: one summary row, and per category its rating and mean with a row per language."""
    analysis = category_analysis(languages)
    placed = languages_by_category(rank_in_list(languages))
    rated = rated_categories(analysis)
    categories = category_languages(rated.select("category", "avg_score", "rating"), placed)
    best = rated_categories(best_category(analysis)).select(
        F.struct(F.col("category").alias("name"), F.col("avg_score").alias("avgScore"), "rating").alias("bestCategory")
    )
    totals = total_languages(placed).select(F.col("total_languages").alias("totalLanguages"))
    # One row each: put below each other and folded into one row, which needs no join.
    summary = totals.unionByName(best, allowMissingColumns=True).agg(
        F.max("totalLanguages").alias("totalLanguages"), F.max("bestCategory").alias("bestCategory")
    )
    return summary, categories
