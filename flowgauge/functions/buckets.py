"""Time buckets and seasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calendar seasons and their months.
SEASONS = {
    "Winter": (12, 1, 2),
    "Spring": (3, 4, 5),
    "Summer": (6, 7, 8),
    "Fall": (9, 10, 11),
}

_PERIOD_UNITS = {"weekly": "week", "monthly": "month", "quarterly": "quarter"}


def season_months(name: str) -> tuple[int, ...]:
    """Months of a season, whatever the letter case; unknown names raise."""
    by_name = {season.lower(): months for season, months in SEASONS.items()}
    if name.lower() not in by_name:
        raise ValueError(f"unknown season '{name}'; use one of {', '.join(SEASONS)}")
    return by_name[name.lower()]


def season_of_month(month: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        label = F.when(month.isin(*months), name).otherwise(label)
    return label


def season(time: Column) -> Column:
    return season_of_month(F.month(time))


def period(time: Column, grain: str) -> Column:
    """A period on the time line: the first day of it as a date, or the year as an integer.

    Weeks are ISO weeks (they start on Monday), so a week that crosses New Year stays whole.
    """
    grain = grain.lower()
    if grain == "daily":
        return F.to_date(time)
    if grain == "yearly":
        return F.year(time)
    if grain in _PERIOD_UNITS:
        return F.trunc(F.to_date(time), _PERIOD_UNITS[grain])
    raise ValueError(
        f"unknown time grain '{grain}'; use daily, weekly, monthly, quarterly or yearly"
    )


def calendar_part(time: Column, grain: str) -> Column:
    """The part of the calendar a time falls in, whichever the year: month 1-12,
    quarter 1-4, ISO week 1-53."""
    parts = {"monthly": F.month, "quarterly": F.quarter, "weekly": F.weekofyear}
    if grain.lower() not in parts:
        raise ValueError(f"unknown profile grain '{grain}'; use {', '.join(parts)}")
    return parts[grain.lower()](time)


def report_bucket(time: Column, grain: str) -> Column:
    """Bucket of the multi-dimensional report: month 1-12, quarter 1-4, season name,
    day, or start of the ISO week."""
    grain = grain.lower()
    if grain == "seasonal":
        return season(time)
    if grain in ("daily", "weekly"):
        return period(time, grain)
    if grain in ("monthly", "quarterly"):
        return calendar_part(time, grain)
    raise ValueError(
        f"unknown time period '{grain}'; use daily, weekly, monthly, quarterly or seasonal"
    )
