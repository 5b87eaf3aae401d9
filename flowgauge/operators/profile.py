"""What is in the table: columns, gaps, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgauge.table import FlowTable, missing, with_keys


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, T.StringType):
        return "categorical"
    return "other"


def profile_columns(table: FlowTable) -> DataFrame:
    """Per column: type, kind, number and share (percent, 2 decimals) of missing values."""
    fields = table.raw.schema.fields
    counted = table.raw.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(*[F.count_if(missing(table, f.name)) for f in fields]).alias("missing"),
    )
    facts = F.array(*[
        F.struct(
            F.lit(f.name).alias("name"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit(_kind(f.dataType)).alias("kind"),
            F.col("missing")[i].alias("missing_count"),
        )
        for i, f in enumerate(fields)
    ])
    return counted.select("rows", F.inline(facts)).select(
        "name", "dtype", "kind", "missing_count",
        F.bround(F.try_divide(F.col("missing_count") * 100.0, F.col("rows")), 2)
        .alias("missing_pct"),
    )


def profile_shape(table: FlowTable) -> DataFrame:
    """One row: rows, columns, surplus duplicate rows, numbers of numeric and text columns."""
    kinds = [_kind(f.dataType) for f in table.raw.schema.fields]
    return _rows_and_duplicates(table).select(
        "row_count",
        F.lit(len(kinds)).alias("column_count"),
        "duplicate_count",
        F.lit(kinds.count("numeric")).alias("numeric_count"),
        F.lit(kinds.count("categorical")).alias("categorical_count"),
    )


def _rows_and_duplicates(table: FlowTable) -> DataFrame:
    rows = F.count(F.lit(1))
    if table.distinct is not None:
        # Two counts from file footers instead of a shuffle of whole rows.
        kept = table.distinct.agg(rows).scalar()
        return table.raw.agg(rows.alias("row_count")).withColumn(
            "duplicate_count", F.col("row_count") - kept
        )
    copies = table.raw.groupBy(*table.raw.columns).agg(rows.alias("__copies"))
    return copies.agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicate_count"),
    )


def distinct_values(table: FlowTable, column: str) -> DataFrame:
    """The non-null values of a column, e.g. the categories a rule check may name."""
    column = table.column(column)
    return with_keys(table.raw.select(column), column).distinct()


def null_share(table: FlowTable, columns: Sequence[str], by: str) -> DataFrame:
    """Per group: number of rows and, per column, the percentage of missing values."""
    by = table.column(by)
    columns = [table.column(c) for c in columns]
    return with_keys(table.raw, by).groupBy(by).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[
            (F.avg(missing(table, c).cast("double")) * 100).alias(f"{c}_missing_pct")
            for c in columns
        ],
    )
