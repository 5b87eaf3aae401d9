"""Metric names -> aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowgauge.functions.sketches import distinct_sketch
from flowgauge.table import FlowTable

_SYNONYMS = {"average": "mean"}


def metric_name(name: str, allowed: tuple[str, ...]) -> str:
    found = _SYNONYMS.get(name.lower(), name.lower())
    if found not in allowed:
        raise ValueError(f"unknown metric '{name}'; use one of {', '.join(allowed)}")
    return found


def total(value: Column) -> Column:
    """Sum in which a group without any value is 0, not null."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def aggregate(table: FlowTable, metric: str) -> Column:
    """``sum``, ``mean``, ``count`` (rows) or ``net_flow`` of a group."""
    if metric == "sum":
        return total(table.measure)
    if metric == "mean":
        return F.avg(table.measure)
    if metric == "count":
        return F.count(F.lit(1))
    if metric == "net_flow":
        return total(table.net)
    raise ValueError(f"unknown metric '{metric}'")


def period_metric(table: FlowTable, metric: str, approximate: bool = False) -> Column:
    """Per-period metric of the correlation and before/after analyses; with ``approximate`` numbers
    of distinct values are estimates from sketches (``sketches.relative_error``)."""
    distinct_of = {
        "active_locations": "location",
        "unique_locations": "location",
        "unique_pipelines": "pipeline",
        "unique_entities": "partner",
    }
    if metric in distinct_of:
        column = F.col(table.roles.require(distinct_of[metric]))
        if approximate:
            return F.hll_sketch_estimate(distinct_sketch(column))
        return F.count_distinct(column)
    plain = {"volume": "sum", "transaction_count": "count", "average_quantity": "mean"}
    if metric in plain:
        return aggregate(table, plain[metric])
    known = ", ".join([*plain, *distinct_of])
    raise ValueError(f"unknown metric '{metric}'; use one of {known}")


def percent_change(value: Column, previous: Column) -> Column:
    """100 * (value / previous - 1); null when there is no previous value or it is 0."""
    return (F.try_divide(value.cast("double"), previous.cast("double")) - 1) * 100
