"""Filter dictionaries -> one predicate column.

Recognised names: ``year``, ``years`` (first, last), ``month``, ``season``,
``transaction_type``, any column, and the aliases of ``schema.COLUMN_ALIASES``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgauge.functions.buckets import season_months
from flowgauge.table import FlowTable

# Names of the two directions and their sign.
DIRECTIONS = {"receipts": 1, "deliveries": -1}


def direction_sign(name: str | int) -> int:
    """Sign of a direction given by name or as the sign itself."""
    if name in DIRECTIONS.values():
        return int(name)
    if str(name).lower() not in DIRECTIONS:
        raise ValueError(f"unknown transaction type '{name}'; use receipts or deliveries")
    return DIRECTIONS[str(name).lower()]


def in_years(table: FlowTable, first: int, last: int | None = None) -> Column:
    """Half-open range on the raw time column, so it reaches the Parquet reader (a
    predicate on ``year(time)`` would not)."""
    start = dt.date(int(first), 1, 1)
    end = dt.date(int(first if last is None else last) + 1, 1, 1)
    return _between_days(table, table.roles.time, start, end)


def before(table: FlowTable, cutoff: dt.date | str) -> Column:
    return table.time < _moment(table, table.roles.time, cutoff)


def predicate(table: FlowTable, filters: Mapping[str, Any] | None) -> Column | None:
    """All filters joined by AND; ``None`` when there are none."""
    terms = [_term(table, name, value) for name, value in (filters or {}).items()]
    return reduce(and_, terms) if terms else None


def apply_filters(
    table: FlowTable, rows: DataFrame, filters: Mapping[str, Any] | None
) -> DataFrame:
    condition = predicate(table, filters)
    return rows if condition is None else rows.where(condition)


def _term(table: FlowTable, name: str, value: Any) -> Column:
    key = name.lower()
    if value is None:
        raise ValueError(f"filter '{name}' has no value")
    if name not in table.raw.columns:
        if key == "year":
            return in_years(table, int(value))
        if key == "years":
            first, last = value
            return in_years(table, int(first), int(last))
        if key == "month":
            return F.month(table.time) == int(value)
        if key == "season":
            return F.month(table.time).isin(*season_months(value))
        if key == "transaction_type":
            return table.sign == direction_sign(value)
    column = table.column(name)
    kind = table.data_type(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        if isinstance(value, str) and len(value.strip()) <= 10:
            value = dt.date.fromisoformat(value.strip())
        if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
            return _between_days(table, column, value, value + dt.timedelta(days=1))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(column) == _moment(table, column, value)
    # The literal takes the kind of the column: a cast on the column would not reach the scan.
    if isinstance(kind, T.StringType):
        value = str(value)
    elif isinstance(kind, T.NumericType) and isinstance(value, str):
        value = float(value)
    return F.col(column) == F.lit(value)


def _between_days(table: FlowTable, column: str, start: dt.date, end: dt.date) -> Column:
    value = F.col(column)
    return (value >= _moment(table, column, start)) & (value < _moment(table, column, end))


def _moment(table: FlowTable, column: str, value: dt.date | str) -> Column:
    """A literal of the column's own type, so that the comparison needs no cast on the
    column. Text that is no date raises here, not in a running job."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value.strip())
    return F.lit(value.isoformat(sep=" ") if isinstance(value, dt.datetime)
                 else value.isoformat()).cast(table.data_type(column))
