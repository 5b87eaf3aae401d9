"""Unusual transactions and unusual days.

The rolling detectors sum the volume per entity and day first. Their windows then run over at
most one row per day and entity, so a busy entity is no larger a group than a quiet one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from flowgauge.functions.metrics import total
from flowgauge.functions.predicates import apply_filters
from flowgauge.operators.rolling_quantile import with_rolling_quantile
from flowgauge.table import FlowTable, with_keys

Filters = Mapping[str, Any] | None

# The group name that asks for the whole system, and its label.
TOTAL = "total"
TOTAL_LABEL = "Total System"

# Defaults of the detectors.
ROLLING_DAYS = 90
Z_THRESHOLD = 3.0
CHANGE_THRESHOLD_PCT = 50.0
PERCENTILE = 95.0


def anomaly_zscore(
    table: FlowTable, threshold: float = Z_THRESHOLD, filters: Filters = None
) -> DataFrame:
    """The distinct rows whose quantity lies more than ``threshold`` deviations from the
    mean of all rows that pass the filters, with their ``zscore``."""
    rows = apply_filters(table, table.rows(dedup=True), filters)
    moments = rows.agg(F.struct(
        F.avg(table.measure).alias("mean"), F.stddev_samp(table.measure).alias("std")
    )).scalar()
    zscore = F.try_divide(table.measure - F.col("__all.mean"), F.col("__all.std"))
    scored = rows.withColumn("__all", moments).withColumn("zscore", zscore).drop("__all")
    return scored.where(F.abs("zscore") > threshold)


def anomaly_zscore_count(
    table: FlowTable, threshold: float = Z_THRESHOLD, filters: Filters = None
) -> DataFrame:
    return anomaly_zscore(table, threshold, filters).agg(F.count(F.lit(1)).alias("anomalies"))


def anomaly_rolling(
    table: FlowTable, by: str | Sequence[str] = "location", *, days: int = ROLLING_DAYS,
    threshold: float = Z_THRESHOLD, filters: Filters = None, frame: str = "rows",
    include_current: bool = True, limit: int | None = None,
) -> DataFrame:
    """Days whose volume lies more than ``threshold`` deviations above the rolling mean,
    strongest first when limited."""
    daily, keys = daily_volume(table, by, filters=filters, dedup=True)
    window = rolling(keys, days, frame, include_current)
    quantity = F.col("quantity")
    scored = daily.withColumns({
        "roll_mean": _if_filled(F.avg(quantity), window, days),
        "roll_std": _if_filled(F.stddev_samp(quantity), window, days),
    }).withColumn(
        "zscore", F.try_divide(quantity - F.col("roll_mean"), F.col("roll_std"))
    )
    flagged = scored.where(F.col("zscore") > threshold)
    return _strongest(flagged, F.col("zscore"), keys, limit)


def rolling_change(
    table: FlowTable, by: str | Sequence[str] = "location", *, days: int = ROLLING_DAYS,
    filters: Filters = None, frame: str = "rows", include_current: bool = True,
    dedup: bool = False,
) -> tuple[DataFrame, list[str]]:
    """Every day with its distance from the rolling mean in percent (null from a mean of 0)."""
    daily, keys = daily_volume(table, by, filters=filters, dedup=dedup)
    window = rolling(keys, days, frame, include_current)
    recent = daily.withColumn("recent_avg", _if_filled(F.avg("quantity"), window, days))
    distance = F.try_divide(F.col("quantity") - F.col("recent_avg"), F.col("recent_avg")) * 100
    return recent.withColumn("pct_change", distance), keys


def anomaly_change(
    table: FlowTable, by: str | Sequence[str] = "location", *, days: int = ROLLING_DAYS,
    threshold: float = CHANGE_THRESHOLD_PCT, filters: Filters = None, frame: str = "rows",
    include_current: bool = True, dedup: bool = False, limit: int | None = None,
) -> DataFrame:
    """Days whose volume differs from the rolling mean by more than ``threshold`` percent,
    either way; any volume differs from a mean of 0. Looks at raw rows unless told otherwise."""
    changes, keys = rolling_change(
        table, by, days=days, filters=filters, frame=frame,
        include_current=include_current, dedup=dedup,
    )
    from_zero = (F.col("recent_avg") == 0) & (F.col("quantity") != 0)
    flagged = changes.where((F.abs("pct_change") > threshold) | from_zero).withColumn(
        "kind",
        F.when(F.col("quantity") > F.col("recent_avg"), "increase").otherwise("decrease"),
    )
    size = F.coalesce(F.abs("pct_change"), F.lit(float("inf")))
    return _strongest(flagged, size, keys, limit)


def anomaly_percentile(
    table: FlowTable, by: str | Sequence[str] = "location", *, days: int = ROLLING_DAYS,
    percentile: float = PERCENTILE, filters: Filters = None, frame: str = "rows",
    include_current: bool = True, limit: int | None = None,
) -> DataFrame:
    """Days whose volume lies above the rolling percentile, largest first when limited."""
    if not 0 <= percentile <= 100:
        raise ValueError("the percentile must lie between 0 and 100")
    daily, keys = daily_volume(table, by, filters=filters, dedup=True)
    scored = with_rolling_quantile(
        daily, keys, "roll_percentile", days=days, share=float(percentile) / 100, frame=frame,
        include_current=include_current, needed=_needed(days),
    )
    flagged = scored.where(F.col("quantity") > F.col("roll_percentile"))
    return _strongest(flagged, F.col("quantity"), keys, limit)


def daily_volume(
    table: FlowTable, by: str | Sequence[str], *, filters: Filters, dedup: bool
) -> tuple[DataFrame, list[str]]:
    """Volume per entity and day, and the names of the entity columns."""
    rows = apply_filters(table, table.rows(dedup=dedup), filters)
    names = [by] if isinstance(by, str) else list(by)
    if names == [TOTAL]:
        rows, keys = rows.withColumn("entity", F.lit(TOTAL_LABEL)), ["entity"]
    else:
        keys = [table.column(c) for c in names]
    rows = with_keys(rows.withColumn("day", F.to_date(table.time)), *keys, "day")
    return rows.groupBy(*keys, "day").agg(total(table.measure).alias("quantity")), keys


def rolling(keys: Sequence[str], days: int, frame: str, include_current: bool) -> WindowSpec:
    """The last ``days`` day-rows of an entity, or with ``frame='days'`` calendar days."""
    if days < 1:
        raise ValueError("the window must span at least one day")
    last = 0 if include_current else -1
    first = last - days + 1
    window = Window.partitionBy(*keys)
    if frame == "rows":
        return window.orderBy("day").rowsBetween(first, last)
    if frame == "days":
        return window.orderBy(F.unix_date("day")).rangeBetween(first, last)
    raise ValueError(f"unknown frame '{frame}'; use rows or days")


def _needed(days: int) -> int:
    """A quarter of the window's rows, five at least (or all, if fewer)."""
    return min(days, max(5, days // 4))


def _if_filled(value: Column, window: WindowSpec, days: int) -> Column:
    """Null until the window holds the rows needed."""
    return F.when(F.count("quantity").over(window) >= _needed(days), value.over(window))


def _strongest(
    flagged: DataFrame, size: Column, keys: Sequence[str], limit: int | None
) -> DataFrame:
    if limit is None:
        return flagged
    return flagged.orderBy(size.desc(), *keys, "day").limit(limit)
