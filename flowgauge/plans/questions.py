"""Compositions: concentration, quantile buckets, seasonal contrasts, effects of a new
partner, and spikes that go along with drops elsewhere."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.functions import stats
from flowgauge.functions.buckets import SEASONS
from flowgauge.functions.metrics import percent_change, total
from flowgauge.functions.predicates import apply_filters, direction_sign
from flowgauge.functions.quantiles import exact_quantiles
from flowgauge.operators.anomaly import (
    ROLLING_DAYS,
    anomaly_rolling,
    rolling_change,
)
from flowgauge.operators.near_join import near_join
from flowgauge.table import FlowTable, with_keys

Filters = Mapping[str, Any] | None


def concentration(
    table: FlowTable, over: str = "subregion", *, filters: Filters = None,
    transaction_type: str = "deliveries",
) -> DataFrame:
    """One row: Herfindahl-Hirschman index of the volume over groups, e.g. of one pipeline's
    deliveries over counties. No row when there is no volume."""
    over = table.column(over)
    rows = _of_direction(table, table.rows(dedup=True), transaction_type)
    groups = with_keys(apply_filters(table, rows, filters), over).groupBy(over).agg(
        total(table.measure).alias("volume")
    )
    volume = F.col("volume")
    index = groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum(volume).alias("total_volume"),
        F.try_divide(F.sum(volume * volume), F.sum(volume) * F.sum(volume)).alias("hhi"),
    ).where(F.col("hhi").isNotNull())
    return index.withColumn("level", stats.label_below(F.col("hhi"), stats.HHI_BANDS, "High"))


def quantile_buckets(
    table: FlowTable, by: str = "region", *, transaction_type: str = "deliveries",
    filters: Filters = None,
) -> DataFrame:
    """Groups split into low, medium and high by the exact thirds of their total volume."""
    by = table.column(by)
    rows = apply_filters(
        table, _of_direction(table, table.rows(dedup=True), transaction_type), filters
    )
    totals = with_keys(rows, by).groupBy(by).agg(total(table.measure).alias("total_volume"))
    thirds = exact_quantiles(totals, F.col("total_volume"), [1 / 3, 2 / 3]).select(F.struct("q0", "q1")).scalar()
    volume = F.col("total_volume")
    return totals.withColumn("thirds", thirds).withColumn(
        "bucket",
        F.when(volume <= F.col("thirds.q0"), "low")
        .when(volume <= F.col("thirds.q1"), "medium")
        .otherwise("high"),
    ).drop("thirds")


def winter_vs_summer(
    table: FlowTable, by: str = "region", *, transaction_type: str = "deliveries",
    filters: Filters = None,
) -> DataFrame:
    """Mean transaction per group in winter and in summer, and how far winter lies above."""
    by = table.column(by)
    rows = apply_filters(
        table, _of_direction(table, table.rows(dedup=True), transaction_type), filters
    )
    means = with_keys(_winter_or_summer(table, rows), by).groupBy(by).agg(
        F.avg(F.when(F.col("season") == "Winter", table.measure)).alias("winter_mean"),
        F.avg(F.when(F.col("season") == "Summer", table.measure)).alias("summer_mean"),
    )
    return means.withColumn(
        "difference_pct", percent_change(F.col("winter_mean"), F.col("summer_mean"))
    )


def winter_summer_ttest(
    table: FlowTable, by: str = "region", *, transaction_type: str = "deliveries",
    filters: Filters = None,
) -> DataFrame:
    """Per group: two-sided t-test of the daily volumes of winter against those of summer."""
    by = table.column(by)
    rows = apply_filters(
        table, _of_direction(table, table.rows(dedup=True), transaction_type), filters
    )
    rows = _winter_or_summer(table, rows).withColumn("day", F.to_date(table.time))
    daily = with_keys(rows, by, "day").groupBy(by, "season", "day").agg(
        total(table.measure).alias("volume")
    )

    def side(season: str) -> list[Column]:
        volume = F.when(F.col("season") == season, F.col("volume"))
        name = season.lower()
        return [
            F.count(volume).alias(f"{name}_days"),
            F.avg(volume).alias(f"{name}_mean"),
            F.var_samp(volume).alias(f"{name}_variance"),
        ]

    sides = daily.groupBy(by).agg(*side("Winter"), *side("Summer"))
    n1, m1, v1 = (F.col(f"winter_{c}") for c in ("days", "mean", "variance"))
    n2, m2, v2 = (F.col(f"summer_{c}") for c in ("days", "mean", "variance"))
    enough = (n1 > 1) & (n2 > 1)
    tested = sides.select(
        by, "winter_days", "winter_mean", "summer_days", "summer_mean",
        enough.alias("enough"),
        F.when(enough, stats.student_t(n1, m1, v1, n2, m2, v2)).alias("t_statistic"),
        (n1 + n2 - 2).alias("degrees_of_freedom"),
    ).withColumn(
        "p_value", stats.p_value(F.col("t_statistic"), F.col("degrees_of_freedom"))
    )
    return tested.withColumn(
        "significance", stats.significance(F.col("enough"), F.col("p_value"))
    ).drop("enough")


def partner_start_effect(
    table: FlowTable, category: str, *, partner: str = "partner", by: str = "region",
    days: int = ROLLING_DAYS, filters: Filters = None,
) -> DataFrame:
    """For each partner that began trading with a region in a category: the region's mean
    daily net flow in the ``days`` before the first day and in as many from it on. Starts
    without a full window before them are left out.

    The means around every day of a region come from windows over its daily rows; a start
    then looks up its own day, so no range of days is ever joined.
    """
    by, partner = table.column(by), table.column(partner)
    rows = with_keys(
        apply_filters(table, table.rows(dedup=True), filters)
        .withColumn("day", F.to_date(table.time)),
        by, "day",
    )
    starts = with_keys(
        rows.where(F.col(table.roles.require("category")) == category), partner
    ).groupBy(by, partner).agg(F.min("day").alias("start_day"))

    daily = rows.groupBy(by, "day").agg(total(table.net).alias("net_flow"))
    in_days = Window.partitionBy(by).orderBy(F.unix_date("day"))
    around = daily.select(
        by,
        F.col("day").alias("start_day"),
        F.avg("net_flow").over(in_days.rangeBetween(-days, -1)).alias("mean_before"),
        F.avg("net_flow").over(in_days.rangeBetween(0, days - 1)).alias("mean_after"),
        F.min("day").over(Window.partitionBy(by)).alias("first_day"),
    )
    full_window = F.date_sub("start_day", days) >= F.col("first_day")
    change = F.col("mean_after") - F.col("mean_before")
    return starts.join(around, [by, "start_day"]).where(full_window).select(
        by, partner, "start_day", "mean_before", "mean_after",
        change.alias("change"), (change > 0).alias("increased"),
    )


def spike_codrop_cases(
    table: FlowTable, category: str, *, spike_by: str = "location", days: int = ROLLING_DAYS,
    z_threshold: float = 3.0, drop_pct: float = 30.0, cases: int = 3, filters: Filters = None,
    within_days: int = 0,
) -> DataFrame:
    """The strongest spikes in a category with another pipeline of the same region that dropped by
    more than ``drop_pct`` percent on the day or up to ``within_days`` days around it, each with all
    those drops and the distance in days.

    Spikes are first thinned to those with a drop at all and cut to the wanted number; only
    these few are paired with drops.
    """
    pipeline, region = table.roles.require("pipeline"), table.roles.require("region")
    keys = list(dict.fromkeys([table.column(spike_by), pipeline, region]))
    in_category = {**(filters or {}), table.roles.require("category"): category}
    spikes = anomaly_rolling(
        table, keys, days=days, threshold=z_threshold, filters=in_category
    ).select(*keys, "day", F.col("quantity").alias("spike_quantity"), "zscore")

    changes, _ = rolling_change(table, [pipeline, region], days=days, filters=filters)
    drops = changes.where(F.col("pct_change") < -drop_pct).select(
        F.col(region).alias("drop_region"), F.col("day").alias("drop_day"),
        F.col(pipeline).alias("drop_pipeline"),
        F.col("quantity").alias("drop_quantity"), "pct_change",
    )
    strongest_first = [F.col("zscore").desc(), *keys, "day"]
    # Another pipeline has dropped there if the first or the last of the dropped ones is another:
    # one row per region and day meets the spikes.
    dropped = drops.groupBy("drop_region", "drop_day").agg(
        F.min("drop_pipeline").alias("first_drop"), F.max("drop_pipeline").alias("last_drop")
    )
    others = (F.col(pipeline) != F.col("first_drop")) | (F.col(pipeline) != F.col("last_drop"))
    around = {
        "on": [(region, "drop_region")], "days": ("day", "drop_day"),
        "before": within_days, "after": within_days,
    }
    chosen = near_join(spikes, dropped, extra=others, how="left_semi", **around).orderBy(
        *strongest_first
    ).limit(cases)
    numbered = chosen.withColumn(
        "case_no",
        F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*strongest_first)),
    )
    elsewhere = F.col(pipeline) != F.col("drop_pipeline")
    paired = near_join(numbered, drops, extra=elsewhere, **around)
    if not within_days:
        return paired.drop("drop_region", "drop_day")
    return paired.withColumn("days_apart", F.datediff("drop_day", "day")).drop("drop_region")


def _of_direction(table: FlowTable, rows: DataFrame, transaction_type: str) -> DataFrame:
    return rows.where(table.sign == direction_sign(transaction_type))


def _winter_or_summer(table: FlowTable, rows: DataFrame) -> DataFrame:
    month = F.month(table.time)
    label = F.when(month.isin(*SEASONS["Winter"]), "Winter").when(
        month.isin(*SEASONS["Summer"]), "Summer"
    )
    return rows.withColumn("season", label).where(F.col("season").isNotNull())
