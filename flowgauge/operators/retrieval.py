"""Totals, rankings, net flows, time series and year comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.functions.buckets import period, report_bucket
from flowgauge.functions.metrics import aggregate, metric_name, percent_change, total
from flowgauge.functions.predicates import apply_filters, direction_sign, in_years
from flowgauge.functions.quantiles import exact_quantiles
from flowgauge.table import FlowTable, with_keys


def total_volume(table: FlowTable, year: int) -> DataFrame:
    """Volume of a year, with the number of distinct rows in the year and in the table."""
    chosen, rows = in_years(table, year), table.rows(dedup=True)
    size = F.count(F.lit(1))
    if table.distinct is not None:
        # Only the year is read; the size of the whole copy is known from file footers.
        return rows.where(chosen).agg(
            F.lit(int(year)).alias("year"),
            total(table.measure).alias("total_volume"),
            size.alias("rows_after"),
        ).withColumn("rows_before", rows.agg(size).scalar())
    return rows.agg(
        F.lit(int(year)).alias("year"),
        total(F.when(chosen, table.measure)).alias("total_volume"),
        F.count_if(chosen).alias("rows_after"),
        size.alias("rows_before"),
    )


def unique_count(
    table: FlowTable, column: str = "pipeline", *, approximate: bool = False
) -> DataFrame:
    """Number of distinct values; ``approximate`` estimates it from a sketch."""
    column = table.column(column)
    count = F.approx_count_distinct(column) if approximate else F.count_distinct(F.col(column))
    return table.raw.agg(count.alias("unique_count"))


def top_by_activity(table: FlowTable, by: str = "region", limit: int | None = 1) -> DataFrame:
    """Groups with the most rows."""
    by = table.column(by)
    counts = with_keys(table.raw, by).groupBy(by).agg(
        F.count(F.lit(1)).alias("activity_count")
    )
    return _ranked(counts, F.col("activity_count"), [by], limit)


def top_by_volume(table: FlowTable, by: str = "pipeline", limit: int | None = 10) -> DataFrame:
    by = table.column(by)
    totals = with_keys(table.rows(dedup=True), by).groupBy(by).agg(
        total(table.measure).alias("total_volume")
    )
    return _ranked(totals, F.col("total_volume"), [by], limit)


def row_counts(table: FlowTable, filters: Filters = None, *, dedup: bool = False) -> DataFrame:
    """One row: rows of the table, and those that pass the filters (``dedup``: without exact
    duplicates). Says how much an analysis with these filters rests on."""
    size = table.raw.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    chosen = apply_filters(table, table.rows(dedup=dedup), filters)
    return chosen.agg(F.count(F.lit(1)).alias("rows_after")).withColumn("rows_before", size)


def average_quantity(table: FlowTable, *, approximate: bool = False) -> DataFrame:
    """Mean and median of the quantity per transaction; ``approximate`` takes the median from a
    sketch instead of the exact one."""
    rows = table.rows(dedup=True)
    if approximate:
        mean = F.avg(table.measure).alias("avg_quantity")
        return rows.agg(mean, F.percentile_approx(table.measure, 0.5).alias("median_quantity"))
    return exact_quantiles(rows, table.measure, [0.5], mean=True).select(
        F.col("mean").alias("avg_quantity"), F.col("q0").alias("median_quantity"))


def direction_counts(table: FlowTable) -> DataFrame:
    """Rows per direction."""
    sign = table.roles.require("sign")
    return with_keys(table.raw, sign).groupBy(sign).agg(F.count(F.lit(1)).alias("row_count"))


def net_flows(
    table: FlowTable, year: int, by: str = "pipeline", limit: int | None = 20
) -> DataFrame:
    """Receipts minus deliveries per group in a year, largest source first."""
    by = table.column(by)
    flows = _net_by(table, year, by)
    return _ranked(flows, F.col("net_flow"), [by], limit)


def net_flow_sources_and_sinks(
    table: FlowTable, year: int, by: str = "pipeline", limit: int = 5
) -> DataFrame:
    """Both ends of the net flow ranking. Groups with a positive net flow are sources,
    groups with a negative one sinks; each side is ranked from its own end."""
    by = table.column(by)
    flows = _net_by(table, year, by)
    ends = []
    for role, order, side in (
        ("source", F.col("net_flow").desc(), F.col("net_flow") > 0),
        ("sink", F.col("net_flow").asc(), F.col("net_flow") < 0),
    ):
        # The limit comes first, so the numbering below only ever sees that many rows.
        end = flows.where(side).orderBy(order, by).limit(limit)
        position = F.row_number().over(Window.partitionBy(F.lit(role)).orderBy(order, by))
        ends.append(end.select(F.lit(role).alias("role"), position.alias("position"),
                               by, "net_flow"))
    return ends[0].unionByName(ends[1])


def top_locations(
    table: FlowTable,
    year: int,
    transaction_type: str | None = None,
    *,
    by: str = "location",
    metric: str = "sum",
    limit: int | None = 10,
) -> DataFrame:
    """Top groups by ``sum``, ``mean``, ``count`` or ``average_daily`` in a year, for one
    direction or both. Counts look at all rows, volumes at distinct rows."""
    by = table.column(by)
    metric = metric_name(metric, ("sum", "mean", "count", "average_daily"))
    chosen = in_years(table, year)
    if transaction_type is not None:
        chosen = chosen & (table.sign == direction_sign(transaction_type))
    rows = with_keys(table.rows(dedup=metric != "count").where(chosen), by)
    if metric == "average_daily":
        values = _average_daily(table, rows, by)
    else:
        values = rows.groupBy(by).agg(aggregate(table, metric).alias("value"))
    return _ranked(values, F.col("value"), [by], limit)


def top_locations_per_direction(
    table: FlowTable, year: int, by: str = "location", limit: int = 10
) -> DataFrame:
    """Top groups by average daily volume, for receipts and for deliveries."""
    by = table.column(by)
    sign = table.roles.require("sign")
    rows = with_keys(table.rows(dedup=True).where(in_years(table, year)), by)
    values = _average_daily(table, rows.where(table.sign.isin(1, -1)), sign, by)
    window = Window.partitionBy(sign).orderBy(F.col("value").desc(), by)
    return values.withColumn("position", F.row_number().over(window)).where(
        F.col("position") <= limit
    )


def aggregate_dimensions(
    table: FlowTable,
    year: int,
    by: Sequence[str] = (),
    *,
    time_period: str | None = None,
    metric: str = "sum",
    limit: int | None = 20,
) -> DataFrame:
    """Metric per time bucket and any number of columns in a year, largest first."""
    by = [table.column(c) for c in by]
    metric = metric_name(metric, ("sum", "mean", "count"))
    rows = table.rows(dedup=metric != "count").where(in_years(table, year))
    keys = list(by)
    if time_period is not None:
        rows = rows.withColumn("time_period", report_bucket(table.time, time_period))
        keys = ["time_period", *keys]
    values = with_keys(rows, *keys).groupBy(*keys).agg(aggregate(table, metric).alias("value"))
    return _ranked(values, F.col("value"), keys, limit)


def filter_and_rank(
    table: FlowTable,
    filters: Mapping[str, Any] | None,
    by: str,
    *,
    metric: str = "sum",
    limit: int | None = 10,
) -> DataFrame:
    """Top groups by ``sum``, ``mean`` or ``count`` among the rows that pass the filters."""
    by = table.column(by)
    metric = metric_name(metric, ("sum", "mean", "count"))
    rows = apply_filters(table, table.rows(dedup=metric != "count"), filters)
    values = with_keys(rows, by).groupBy(by).agg(aggregate(table, metric).alias("value"))
    return _ranked(values, F.col("value"), [by], limit)


def time_series(
    table: FlowTable,
    filters: Mapping[str, Any] | None = None,
    *,
    grain: str = "daily",
    metric: str = "sum",
) -> DataFrame:
    """Metric per period that has rows; gaps are not filled."""
    metric = metric_name(metric, ("sum", "net_flow", "mean", "count"))
    rows = apply_filters(table, table.rows(dedup=True), filters)
    return with_keys(rows.withColumn("period", period(table.time, grain)), "period").groupBy(
        "period"
    ).agg(aggregate(table, metric).alias("value"))


def time_series_peaks(series: DataFrame, limit: int = 10) -> DataFrame:
    """The periods of a series with the largest values."""
    return _ranked(series, F.col("value"), ["period"], limit)


def time_series_summary(series: DataFrame) -> DataFrame:
    """One row: number of periods, mean, extremes and range of a series."""
    return series.agg(
        F.count(F.lit(1)).alias("periods"),
        F.avg("value").alias("mean_value"),
        F.max("value").alias("max_value"),
        F.min("value").alias("min_value"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
    )


def compare_years(
    table: FlowTable,
    first_year: int,
    last_year: int,
    by: str = "pipeline",
    *,
    metric: str = "sum",
) -> DataFrame:
    """Per group and year: ``sum`` or ``percentage_share`` (of the year's whole volume) and
    the change from the year before - percent for sums, points for shares.

    Years with rows and groups with rows are combined, with 0 where a pair has none. The
    change is null in the first year and after a 0.
    """
    by = table.column(by)
    metric = metric_name(metric, ("sum", "percentage_share"))
    years = list(range(int(first_year), int(last_year) + 1))
    rows = table.rows(dedup=True).where(in_years(table, first_year, last_year))

    # One sum per group and year, folded into a zero-filled row per group. Rows without a group
    # count for the whole of a year but form no group themselves; ``grouped`` marks them after
    # the aggregate, so that both uses of it share one shuffle.
    sums = rows.groupBy(by, F.year(table.time).alias("year")).agg(
        total(table.measure).alias("volume"), F.count(F.lit(1)).alias("row_count")
    )
    # At most one entry per year of the range.
    folded = sums.groupBy(by).agg(
        F.max(F.col(by).isNotNull()).alias("grouped"),
        F.map_from_entries(F.collect_list(F.struct("year", F.struct("volume", "row_count")))).alias("of"),
    )
    cells = folded.select(by, "grouped", "of", F.explode(F.array(*map(F.lit, years))).alias("year"))
    cells = cells.select(
        by, "grouped", "year",
        F.coalesce(F.col("of")[F.col("year")]["volume"], F.lit(0.0)).alias("volume"),
        F.coalesce(F.col("of")[F.col("year")]["row_count"], F.lit(0)).alias("row_count"),
    )
    of_year = cells.groupBy("year").agg(
        F.sum("volume").alias("whole"),
        F.sum(F.when(F.col("grouped"), F.col("row_count"))).alias("present"),
    )
    # One row per year of the range, so this side is always small.
    matrix = cells.where("grouped").join(F.broadcast(of_year.where("present > 0")), "year")
    share = F.try_divide(F.col("volume"), F.col("whole")) * 100
    value = F.col("volume") if metric == "sum" else share
    valued = matrix.select("year", by, value.alias("value"))
    previous = F.lag("value").over(Window.partitionBy(by).orderBy("year"))
    change = (
        percent_change(F.col("value"), previous)
        if metric == "sum"
        else F.col("value") - previous
    )
    return valued.withColumn("yoy_change", change)


def compare_years_totals(comparison: DataFrame) -> DataFrame:
    """Total per year of a ``compare_years`` result."""
    return comparison.groupBy("year").agg(F.sum("value").alias("total"))


def _net_by(table: FlowTable, year: int, by: str) -> DataFrame:
    rows = with_keys(table.rows(dedup=True).where(in_years(table, year)), by)
    return rows.groupBy(by).agg(total(table.net).alias("net_flow"))


def _average_daily(table: FlowTable, rows: DataFrame, *keys: str) -> DataFrame:
    """Mean over the days that have rows of the sum per day."""
    daily = with_keys(rows.withColumn("day", F.to_date(table.time)), "day").groupBy(
        *keys, "day"
    ).agg(total(table.measure).alias("volume"))
    return daily.groupBy(*keys).agg(F.avg("volume").alias("value"))


def _ranked(
    df: DataFrame, value: Column, keys: Sequence[str], limit: int | None
) -> DataFrame:
    """The top ``limit`` by value, ties by key; without a limit all rows, in no order."""
    if limit is None:
        return df
    return df.orderBy(value.desc(), *keys).limit(limit)
