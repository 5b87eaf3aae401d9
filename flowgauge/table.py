"""A fact table together with its column roles: the input of every analysis."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgauge.schema import COLUMN_ALIASES, FlowSchema

_TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


@dataclass(frozen=True)
class FlowTable:
    """``raw`` holds every row. ``distinct``, if given, is a copy of it that is already free
    of exact duplicates (see ``sources.write_distinct``), so that volume analyses need not
    shuffle whole rows again."""

    raw: DataFrame
    roles: FlowSchema = field(default_factory=FlowSchema)
    distinct: DataFrame | None = None

    def __post_init__(self) -> None:
        types = {f.name: f.dataType for f in self.raw.schema.fields}
        absent = sorted(c for c in self.roles.mapped().values() if c not in types)
        if absent:
            raise ValueError(f"mapped columns missing from the table: {', '.join(absent)}")
        if not isinstance(types[self.roles.time], _TIME_TYPES):
            raise ValueError(f"'{self.roles.time}' must be a date or timestamp column")
        if not isinstance(types[self.roles.measure], T.NumericType):
            raise ValueError(f"'{self.roles.measure}' must be a numeric column")
        if self.distinct is not None and set(self.distinct.dtypes) != set(self.raw.dtypes):
            raise ValueError("the distinct copy must have the columns and types of the table")

    def rows(self, dedup: bool) -> DataFrame:
        """The rows an analysis reads: all of them, or each distinct row once.

        The duplicate rule compares whole rows, so it comes before any projection; filters
        on the result still move below it and into the scan.
        """
        if not dedup:
            return self.raw
        return self.raw.dropDuplicates() if self.distinct is None else self.distinct

    def column(self, name: str) -> str:
        """Resolve a column name, alias or role; unknown names raise."""
        if name in self.raw.columns:
            return name
        role = COLUMN_ALIASES.get(name.lower(), name.lower())
        mapped = self.roles.mapped()
        if role in mapped:
            return mapped[role]
        raise ValueError(f"unknown column '{name}'; available: {', '.join(self.raw.columns)}")

    def data_type(self, column: str) -> T.DataType:
        return self.raw.schema[column].dataType

    @property
    def time(self) -> Column:
        return F.col(self.roles.time)

    @property
    def measure(self) -> Column:
        """The measure with NaN read as missing, as a double."""
        column = F.col(self.roles.measure).cast("double")
        if isinstance(self.data_type(self.roles.measure), (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(column), column)
        return column

    @property
    def sign(self) -> Column:
        return F.col(self.roles.require("sign"))

    @property
    def net(self) -> Column:
        """Signed volume: receipts count up, deliveries count down."""
        return self.measure * self.sign

    def volume_of(self, direction: int) -> Column:
        """Total volume of the rows with the given sign; 0 when there is none."""
        return F.coalesce(F.sum(F.when(self.sign == direction, self.measure)), F.lit(0.0))


#: Rows that a task of a stored table groups, about, where it is dealt out before grouping.
TASK_ROWS = 500_000


def in_small_tasks(table: FlowTable, rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` of a stored table dealt out by ``keys``, for groupings by keys that hardly repeat: a
    split of well compressed files holds millions of rows, and a task would keep nearly all of them.
    A table without a distinct copy is left as it is; what it is grouped from comes out of a shuffle,
    and counting it would run its whole plan."""
    if table.distinct is None:
        return rows
    tasks = table.raw.count() // TASK_ROWS  # from the footers
    return rows if tasks < 2 else rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), *keys)


def missing(table: FlowTable, column: str, *, empty_is_missing: bool = False) -> Column:
    """Null, or NaN in a float column; on request also the empty string in a string column."""
    value = F.col(column)
    kind = table.data_type(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    if empty_is_missing and isinstance(kind, T.StringType):
        return value.isNull() | (value == "")
    return value.isNull()


def with_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Drop rows in which a grouping key is missing (such rows belong to no group)."""
    for key in keys:
        present = F.col(key).isNotNull()
        if isinstance(rows.schema[key].dataType, (T.DoubleType, T.FloatType)):
            present = present & ~F.isnan(key)
        rows = rows.where(present)
    return rows
