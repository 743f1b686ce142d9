"""Sizes, durations and labels as shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepledger import schemas as S


def format_size(size: Column) -> Column:
    """Bytes with one decimal and a 1024 base."""

    def scaled(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", size / F.lit(float(1024**power)))

    return (
        F.when(size.isNull(), F.lit(None).cast("string"))
        .when(size < 1024, F.format_string("%d B", size.cast("bigint")))
        .when(size < 1024**2, scaled(1, "KB"))
        .when(size < 1024**3, scaled(2, "MB"))
        .otherwise(scaled(3, "GB"))
    )


def _tenths_of_second(ms: Column) -> Column:
    """Seconds in tenths, rounded as the binary fraction ``ms / 1000`` rounds.

    Only ``…50`` ms are close to a tie; there the double nearest to ``ms / 1000`` lies above, on or below
    the tie. Scaled by 2**52 it is an integer (below 64 s), which decides the case exactly.
    """
    scaled = (ms.cast("double") / 1000.0 * float(2**52)).cast("decimal(20,0)") * F.lit(1000).cast("decimal(4,0)")
    exact = ms.cast("decimal(10,0)") * F.lit(2**52).cast("decimal(17,0)")
    rest = ms % 100
    up = (rest > 50) | ((rest == 50) & (scaled >= exact))
    return F.floor(ms / 100) + up.cast("bigint")


def format_duration(ms: Column) -> Column:
    """``250ms``, ``1.5s``, ``2m 3s``; seconds are rounded on their own, so ``1m 60s`` can occur."""
    ms = ms.cast("bigint")
    # The tenths are only meant for less than a minute; the cap keeps the arithmetic in range elsewhere.
    tenths = _tenths_of_second(F.least(ms, F.lit(60_000)))
    seconds = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))
    minutes = F.concat(
        F.floor(ms / 60_000).cast("string"),
        F.lit("m "),
        F.floor((ms % 60_000 + 500) / 1000).cast("string"),
        F.lit("s"),
    )
    return (
        F.when(ms.isNull(), F.lit(None).cast("string"))
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, seconds)
        .otherwise(minutes)
    )


def format_finished(finished_at: Column) -> Column:
    return F.coalesce(F.date_format(finished_at, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))


def duration_ms(started_at: Column, finished_at: Column) -> Column:
    return F.unix_millis(finished_at) - F.unix_millis(started_at)


def shown_duration(duration: Column, started_at: Column, now: Column) -> Column:
    """Recorded duration, else the time since the start, else ``-``."""
    return F.coalesce(format_duration(duration), format_duration(duration_ms(started_at, now)), F.lit("-"))


def shown_size(size: Column) -> Column:
    return F.when(size > 0, format_size(size)).otherwise(F.lit("-"))


def run_status(exit_code: Column) -> Column:
    return F.when(exit_code == 0, F.lit("success")).otherwise(F.lit("failure"))


def rating(score: Column) -> Column:
    return F.when(score >= 90, F.lit("excellent")).when(score >= 80, F.lit("good")).otherwise(F.lit("fair"))


def reason_label(reason: Column) -> Column:
    return (
        F.when(reason == "cached", F.lit("(cached)"))
        .when(reason == "condition", F.lit("(condition)"))
        .otherwise(F.lit("(dependency skipped)"))
    )


def step_detail(
    type_: Column,
    display_name: Column,
    duration: Column,
    artifact_size: Column,
    exit_code: Column,
    attempt: Column,
    max_retries: Column,
    reason: Column,
) -> Column:
    """The text that follows (or, for a retry, replaces) a step's name in a progress view."""
    parts = F.concat_ws(", ", format_duration(duration), F.when(artifact_size > 0, format_size(artifact_size)))
    return (
        F.when(
            type_ == S.STEP_FINISHED,
            F.when(parts != "", F.concat(F.lit(" ("), parts, F.lit(")"))).otherwise(F.lit("")),
        )
        .when(type_ == S.STEP_FAILED, F.concat(F.lit(" (exit "), exit_code.cast("string"), F.lit(")")))
        .when(
            type_ == S.STEP_RETRYING,
            F.format_string("%s (retry %d/%d)", display_name, attempt, max_retries),
        )
        .when(type_ == S.STEP_SKIPPED, F.concat(F.lit(" "), reason_label(reason)))
        .when(type_ == S.STEP_WOULD_RUN, F.lit(" (would run)"))
    )
