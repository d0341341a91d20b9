"""Elapsed-time arithmetic on UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3600
DAY = 24 * HOUR
QUARTER = 15 * 60


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def instant(value) -> Column:
    """A UTC literal from ISO text, or the column itself."""
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


def epoch(ts: Column | str) -> Column:
    """Whole seconds since 1970 (rounds down)."""
    return F.unix_seconds(as_col(ts))


def shift(ts: Column | str, seconds: Column | int) -> Column:
    """``ts`` moved by elapsed seconds, microseconds kept."""
    amount = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(F.unix_micros(as_col(ts)) + amount.cast("long") * F.lit(1_000_000))


def floor_to(ts: Column | str, step_s: int) -> Column:
    """``ts`` cut down to a multiple of ``step_s`` since 1970."""
    seconds = epoch(ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(step_s)))


def elapsed_seconds(later: Column | str, earlier: Column | str) -> Column:
    return (F.unix_micros(as_col(later)) - F.unix_micros(as_col(earlier))) / F.lit(1_000_000.0)


def horizon_minutes(target: Column | str, issue: Column | str) -> Column:
    return elapsed_seconds(target, issue) / F.lit(60.0)


def horizon_hours(target: Column | str, issue: Column | str) -> Column:
    return elapsed_seconds(target, issue) / F.lit(3600.0)


def is_exact(ts: Column | str, step_s: int = HOUR) -> Column:
    """True where the timestamp lies on the grid, to the microsecond."""
    return F.pmod(F.unix_micros(as_col(ts)), F.lit(step_s * 1_000_000)) == 0


def between_ts(ts: Column | str, start, end) -> Column:
    """Half-open range; plain comparisons, so Parquet readers can prune by it."""
    column = as_col(ts)
    return (column >= instant(start)) & (column < instant(end))


def calendar(ts: Column | str, prefix: str = "") -> dict[str, Column]:
    """Hour, weekday with Monday = 0, month and weekend flag."""
    column = as_col(ts)
    names = ("hour", "day_of_week", "month", "is_weekend")
    weekday = F.weekday(column)
    values = (F.hour(column), weekday, F.month(column), F.when(weekday >= 5, 1).otherwise(0))
    return {prefix + name: value for name, value in zip(names, values)}


def iso_duration_seconds(text: Column | str) -> Column:
    """Seconds of a ``PT#H#M#S`` duration; null when malformed or not positive.

    The two usual resolutions skip the pattern matching.
    """
    column = as_col(text)
    valid = column.rlike("^PT(?=[0-9])([0-9]+H)?([0-9]+M)?([0-9]+S)?$")

    def part(unit: str) -> Column:
        digits = F.regexp_extract(column, f"([0-9]+){unit}", 1)
        return F.coalesce(digits.try_cast("long"), F.lit(0))

    total = part("H") * 3600 + part("M") * 60 + part("S")
    return (
        F.when(column == "PT60M", F.lit(3600).cast("long")).when(column == "PT15M", F.lit(900).cast("long"))
        .when(valid & (total > 0), total)
    )


def age_label(ts: Column | str, now, hours_suffix: str = " hours", minutes_suffix: str = " min",
              days_suffix: str = " days", missing: str = "N/A", future: str = "N/A") -> Column:
    """Age as text: minutes below an hour, hours below two days, then days."""
    hours = elapsed_seconds(instant(now), ts) / F.lit(3600.0)
    return (
        F.when(as_col(ts).isNull(), missing)
        .when(hours < 0, future)
        .when(hours < 1, F.concat(F.format_string("%.0f", F.round(hours * 60, 0)), F.lit(minutes_suffix)))
        .when(hours < 48, F.concat(F.format_string("%.1f", F.round(hours, 1)), F.lit(hours_suffix)))
        .otherwise(F.concat(F.format_string("%.1f", F.round(hours / 24, 1)), F.lit(days_suffix)))
    )
