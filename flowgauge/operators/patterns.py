"""Seasonality, trends, consistency, correlation and before/after comparison."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.functions import stats
from flowgauge.functions.buckets import period, season
from flowgauge.functions.metrics import percent_change, period_metric, total
from flowgauge.functions.predicates import apply_filters, before
from flowgauge.functions.sketches import distinct_sketch
from flowgauge.table import FlowTable, in_small_tasks, with_keys

# Fixed value: months a pipeline must have rows in before its consistency is judged.
MIN_ACTIVE_MONTHS = 3

# The numbers of active entities and the roles they are counted by.
_ACTIVE = {
    "active_locations": "location", "active_pipelines": "pipeline", "active_partners": "partner",
}


def seasonal_patterns(table: FlowTable) -> DataFrame:
    """Per calendar season: volumes (2 decimals), transactions, both directions, and whether
    it is the season with the largest volume."""
    rows = with_keys(table.rows(dedup=True).withColumn("season", season(table.time)), "season")
    seasons = rows.groupBy("season").agg(
        F.bround(total(table.measure), 2).alias("total_volume"),
        F.bround(F.avg(table.measure), 2).alias("average_transaction"),
        F.count(table.measure).alias("transaction_count"),
        table.volume_of(1).alias("receipts_volume"),
        F.abs(table.volume_of(-1)).alias("deliveries_volume"),
    )
    largest_first = Window.partitionBy(F.lit(0)).orderBy(F.col("total_volume").desc(), "season")
    return seasons.withColumn("is_peak", F.row_number().over(largest_first) == 1)


def monthly_trends(
    table: FlowTable, last: int | None = 12, *, approximate: bool = False
) -> DataFrame:
    """Activity per month and the growth of its volume from the month before; the ``last``
    months only, or all. The peak and low month are those of ``monthly_trends_summary``. With
    ``approximate`` the numbers of active entities are estimates."""
    return _last(_monthly_trends(table, approximate), last)


def monthly_trends_summary(table: FlowTable, last: int = 12) -> DataFrame:
    """One row: peak and low month over all months, mean growth of the ``last`` months."""
    months = _numbered_from_end(_monthly_trends(table), "period")
    peak = _first_by(F.col("total_volume").desc(), "period")
    low = _first_by(F.col("total_volume").asc(), "period")
    marked = months.withColumn("high_position", peak).withColumn("low_position", low)
    return marked.agg(
        _where("high_position", "period").alias("peak_month"),
        _where("high_position", "total_volume").alias("peak_volume"),
        _where("low_position", "period").alias("low_month"),
        _where("low_position", "total_volume").alias("low_volume"),
        F.avg(F.when(F.col("from_end") <= last, F.col("volume_growth"))).alias("average_growth"),
    )


def quarterly_activity(
    table: FlowTable, last: int | None = 8, *, approximate: bool = False
) -> DataFrame:
    """Activity per quarter with the growth of volume and of active locations. With ``approximate``
    the numbers of active entities, and the growth of locations with them, are estimates."""
    return _last(_quarterly_activity(table, approximate), last)


def quarterly_activity_summary(table: FlowTable, last: int = 8) -> DataFrame:
    """One row: mean growth over the ``last`` quarters and what it says about the trend."""
    recent = _last(_quarterly_activity(table), last)
    return recent.agg(
        F.avg("volume_growth").alias("average_volume_growth"),
        F.avg("location_growth").alias("average_location_growth"),
    ).select(
        "*",
        F.when(F.col("average_volume_growth") > 0, "Increasing").otherwise("Decreasing")
        .alias("volume_trend"),
        F.when(F.col("average_location_growth") > 0, "Expanding").otherwise("Contracting")
        .alias("activity_trend"),
    )


def consistent_pipelines(
    table: FlowTable, by: str = "pipeline", limit: int | None = 10
) -> DataFrame:
    """Groups whose monthly volume varies least, by coefficient of variation. Groups without
    one (mean not positive) come last, with score 0."""
    by = table.column(by)
    judged = _monthly_consistency(table, by)
    scored = judged.withColumn(
        "score",
        F.when(F.col("cv_pct").isNull(), 0.0).otherwise(1 / (1 + F.col("cv_pct") / 100)),
    )
    if limit is None:
        return scored
    return scored.orderBy(F.col("cv_pct").asc_nulls_last(), by).limit(limit)


def consistency_coverage(table: FlowTable, by: str = "pipeline") -> DataFrame:
    """One row: how many groups had enough months to be judged."""
    judged = _monthly_consistency(table, table.column(by))
    return judged.agg(F.count(F.lit(1)).alias("groups_analyzed"))


def direction_balance(table: FlowTable, last: int | None = 12) -> DataFrame:
    """Receipts, deliveries and net flow per month."""
    return _last(_direction_balance(table), last)


def direction_balance_summary(table: FlowTable) -> DataFrame:
    """One row over all months: how receipts and deliveries move together."""
    balance = _direction_balance(table).agg(
        stats.pearson(F.col("receipts"), F.col("deliveries")).alias("correlation"),
        F.avg("net_flow").alias("average_net_flow"),
        F.stddev_samp("net_flow").alias("net_flow_volatility"),
    )
    strength = stats.label_above(F.col("correlation"), stats.BALANCE_STRENGTH, "Weak")
    return balance.withColumn("strength", strength)


def correlation_points(
    table: FlowTable,
    x_metric: str,
    y_metric: str,
    *,
    grain: str = "daily",
    filters: Mapping[str, Any] | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Both metrics per period, for the periods in which both have a value. One aggregate
    yields both, so nothing needs aligning. ``approximate`` estimates numbers of active entities."""
    rows = apply_filters(table, table.rows(dedup=True), filters)
    rows = with_keys(rows.withColumn("period", period(table.time, grain)), "period")
    return rows.groupBy("period").agg(
        period_metric(table, x_metric, approximate).cast("double").alias("x"),
        period_metric(table, y_metric, approximate).cast("double").alias("y"),
    ).na.drop(subset=["x", "y"])


def calculate_correlation(
    table: FlowTable,
    x_metric: str,
    y_metric: str,
    *,
    grain: str = "daily",
    filters: Mapping[str, Any] | None = None,
    approximate: bool = False,
) -> DataFrame:
    """One row: Pearson r, r squared, regression line, t, significance and labels. No row
    with fewer than two points. A constant metric leaves r and all that follows from it null;
    a perfect correlation has no t but is significant."""
    points = correlation_points(
        table, x_metric, y_metric, grain=grain, filters=filters, approximate=approximate)
    x, y = F.col("x"), F.col("y")
    fitted = points.agg(
        F.count(F.lit(1)).alias("points"),
        stats.pearson(x, y).alias("r"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
    ).where("points >= 2")
    r, n = F.col("r"), F.col("points")
    t = stats.correlation_t(r, n)
    perfect = (n > 2) & (1 - r * r <= 1e-12)
    return fitted.select(
        "points", "r", (r * r).alias("r_squared"), "slope", "intercept",
        t.alias("t_statistic"),
        F.when(perfect, True).otherwise(F.abs(t) > stats.SIGNIFICANT_T).alias("significant"),
        stats.label_above(F.abs(r), stats.CORRELATION_STRENGTH, "Very Weak").alias("strength"),
        F.when(r > 0, "Positive").when(r.isNotNull(), "Negative").alias("direction"),
    )


def before_after_periods(
    table: FlowTable,
    cutoff: dt.date | str,
    *,
    metric: str = "volume",
    grain: str = "daily",
    filters: Mapping[str, Any] | None = None,
) -> DataFrame:
    """The metric before and from the cutoff on: mean over periods, number of periods and of
    rows, first and last day. A cutoff inside a period splits it in two."""
    return _sides(table, cutoff, metric, grain, filters).select(
        "side", "mean_value", "periods", "row_count", "first_day", "last_day"
    )


def before_after_ttest(
    table: FlowTable,
    cutoff: dt.date | str,
    *,
    metric: str = "volume",
    grain: str = "daily",
    filters: Mapping[str, Any] | None = None,
) -> DataFrame:
    """One row: change of the mean from before to after and a two-sided t-test of it. No row
    unless both sides have rows."""
    sides = _sides(table, cutoff, metric, grain, filters)

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    both = sides.agg(*[
        of(side, column).alias(f"{side}_{column}")
        for side in ("before", "after")
        for column in ("mean_value", "variance", "periods")
    ]).where("before_periods > 0 AND after_periods > 0")
    n1, m1, v1 = (F.col(f"before_{c}") for c in ("periods", "mean_value", "variance"))
    n2, m2, v2 = (F.col(f"after_{c}") for c in ("periods", "mean_value", "variance"))
    enough = (n1 > 1) & (n2 > 1)
    change = F.coalesce(F.try_divide(m2 - m1, m1) * 100, F.lit(0.0))
    tested = both.select(
        m1.alias("before_mean"),
        m2.alias("after_mean"),
        (m2 - m1).alias("absolute_change"),
        change.alias("percentage_change"),
        F.when(change > 0, "Increase").when(change < 0, "Decrease").otherwise("No change")
        .alias("direction"),
        enough.alias("enough"),
        F.when(enough, stats.student_t(n1, m1, v1, n2, m2, v2)).otherwise(0.0)
        .alias("t_statistic"),
        (n1 + n2 - 2).alias("degrees_of_freedom"),
    ).withColumn(
        "p_value",
        F.when(~F.col("enough"), 1.0)
        .when(F.col("t_statistic").isNull() & (F.col("absolute_change") != 0), 0.0)
        .otherwise(stats.p_value(F.col("t_statistic"), F.col("degrees_of_freedom"))),
    )
    return tested.withColumn(
        "significance", stats.significance(F.col("enough"), F.col("p_value"))
    ).drop("enough")


def _monthly_trends(table: FlowTable, approximate: bool = False) -> DataFrame:
    months = _activity(table, "monthly", approximate)
    return months.withColumn("volume_growth", _growth("total_volume"))


def _quarterly_activity(table: FlowTable, approximate: bool = False) -> DataFrame:
    quarters = _activity(table, "quarterly", approximate).drop("transaction_count")
    return quarters.withColumn("volume_growth", _growth("total_volume")).withColumn(
        "location_growth", _growth("active_locations")
    )


def daily_activity(table: FlowTable) -> DataFrame:
    """Per day: volume, transactions and sketches of the active locations, pipelines and partners.
    Some KB a day, from which ``activity_from_days`` makes any longer period; a table that grows by
    days need only add its new ones."""
    rows = with_keys(table.rows(dedup=True).withColumn("day", F.to_date(table.time)), "day")
    names = {name: table.roles.require(role) for name, role in _ACTIVE.items()}
    return rows.groupBy("day").agg(
        total(table.measure).alias("volume"),
        F.count(table.measure).alias("transaction_count"),
        *(distinct_sketch(F.col(c)).alias(name) for name, c in names.items()),
    )


def activity_from_days(days: DataFrame, grain: str) -> DataFrame:
    """Activity per period from ``daily_activity``; the numbers of active entities are estimates
    (``sketches.relative_error``)."""
    return days.withColumn("period", period(F.col("day"), grain)).groupBy("period").agg(
        F.bround(F.sum("volume"), 2).alias("total_volume"),
        F.bround(F.try_divide(F.sum("volume"), F.sum("transaction_count")), 2).alias("average_volume"),
        F.sum("transaction_count").alias("transaction_count"),
        *(F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in _ACTIVE),
    )


def _activity(table: FlowTable, grain: str, approximate: bool = False) -> DataFrame:
    """Volumes and numbers of active locations, pipelines and partners per period.

    Rows are first brought down to one per period and combination of the three, in tasks of bounded
    size; the distinct counts, which take four copies of each row, start from there. ``approximate``
    merges daily sketches instead, without any copies."""
    if approximate:
        return activity_from_days(daily_activity(table), grain)
    rows = with_keys(
        table.rows(dedup=True).withColumn("period", period(table.time, grain)), "period"
    )
    names = {name: table.roles.require(role) for name, role in _ACTIVE.items()}
    combination = ["period", *dict.fromkeys(names.values())]
    combined = in_small_tasks(table, rows, *combination).groupBy(*combination).agg(
        F.sum(table.measure).alias("volume"), F.count(table.measure).alias("transactions")
    )
    return combined.groupBy("period").agg(
        F.bround(F.coalesce(F.sum("volume"), F.lit(0.0)), 2).alias("total_volume"),
        F.bround(F.try_divide(F.sum("volume"), F.sum("transactions")), 2).alias("average_volume"),
        F.sum("transactions").alias("transaction_count"),
        *(F.count_distinct(F.col(column)).alias(name) for name, column in names.items()),
    )


def _monthly_consistency(table: FlowTable, by: str) -> DataFrame:
    rows = table.rows(dedup=True).withColumn("period", period(table.time, "monthly"))
    months = with_keys(rows, by, "period").groupBy(by, "period").agg(
        total(table.measure).alias("volume")
    )
    volume = F.col("volume")
    return months.groupBy(by).agg(
        F.avg(volume).alias("mean_monthly_volume"),
        F.stddev_samp(volume).alias("std_monthly_volume"),
        stats.coefficient_of_variation(volume).alias("cv_pct"),
        F.count(F.lit(1)).alias("months_active"),
    ).where(F.col("months_active") >= MIN_ACTIVE_MONTHS)


def _direction_balance(table: FlowTable) -> DataFrame:
    rows = table.rows(dedup=True).withColumn("period", period(table.time, "monthly"))
    months = with_keys(rows, "period", table.roles.require("sign")).groupBy("period").agg(
        table.volume_of(1).alias("receipts"),
        F.abs(table.volume_of(-1)).alias("deliveries"),
    )
    return months.withColumn("net_flow", F.col("receipts") - F.col("deliveries"))


def _sides(
    table: FlowTable,
    cutoff: dt.date | str,
    metric: str,
    grain: str,
    filters: Mapping[str, Any] | None,
) -> DataFrame:
    if grain.lower() not in ("daily", "weekly", "monthly"):
        raise ValueError(f"unknown time grain '{grain}'; use daily, weekly or monthly")
    rows = apply_filters(table, table.rows(dedup=True), filters).withColumns({
        "side": F.when(before(table, cutoff), "before").otherwise("after"),
        "period": period(table.time, grain),
    })
    periods = with_keys(rows, "period").groupBy("side", "period").agg(
        period_metric(table, metric).cast("double").alias("value"),
        F.count(F.lit(1)).alias("row_count"),
        F.to_date(F.min(table.time)).alias("first_day"),
        F.to_date(F.max(table.time)).alias("last_day"),
    )
    return periods.groupBy("side").agg(
        F.avg("value").alias("mean_value"),
        F.var_samp("value").alias("variance"),
        F.count(F.lit(1)).alias("periods"),
        F.sum("row_count").alias("row_count"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
    )


# The windows below run over periods of a whole table: at most one row per month or quarter,
# whatever the size of the table, so a single task is enough for them.
def _growth(column: str) -> Column:
    in_time_order = Window.partitionBy(F.lit(0)).orderBy("period")
    return percent_change(F.col(column), F.lag(column).over(in_time_order))


def _numbered_from_end(periods: DataFrame, key: str) -> DataFrame:
    latest_first = Window.partitionBy(F.lit(0)).orderBy(F.col(key).desc())
    return periods.withColumn("from_end", F.row_number().over(latest_first))


def _last(periods: DataFrame, last: int | None) -> DataFrame:
    if last is None:
        return periods
    return periods.orderBy(F.col("period").desc()).limit(last)


def _first_by(order: Column, key: str) -> Column:
    return F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, key))


def _where(position: str, column: str) -> Column:
    return F.max(F.when(F.col(position) == 1, F.col(column)))
