"""Parquet source and preparation of a flow table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgauge.schema import FlowSchema
from flowgauge.sources.files import data_files, state_of
from flowgauge.table import FlowTable


def read_flow_table(
    spark: SparkSession,
    path: str,
    roles: FlowSchema | None = None,
    *,
    distinct_path: str | None = None,
    schema: str | T.StructType | None = None,
) -> FlowTable:
    """Read a Parquet fact table; ``distinct_path`` names a copy made by ``write_distinct``,
    which must still fit: if files (names, sizes or times), rows or types of the table are others
    than when the copy was made, this raises. A given ``schema`` saves the job that reads it from the files."""
    raw = _read(spark, path, schema)
    if not distinct_path:
        return as_flow_table(raw, roles)
    made_from = spark.read.parquet(_record_path(distinct_path)).first().asDict()
    now = _described(raw)
    changed = sorted(k for k in now if now[k] != made_from.get(k))
    if changed:
        raise ValueError(
            f"the distinct copy at {distinct_path} was made from another state of the table "
            f"({', '.join(changed)} changed); write it again"
        )
    return as_flow_table(raw, roles, distinct=_read(spark, distinct_path, schema))


def _record_path(distinct_path: str) -> str:
    return f"{distinct_path.rstrip('/')}.made-from"


def _described(raw: DataFrame) -> dict[str, str | int]:
    """What tells one state of a table from another: its files with names, sizes and times, rows
    (from the footers of Parquet files) and types."""
    names = raw.inputFiles()
    files, state = state_of(data_files(raw.sparkSession, names)) if names else (0, "")
    return {
        "files": files,
        "file_states": state,
        "row_count": raw.count(),
        "types": ", ".join(f"{name} {kind}" for name, kind in sorted(raw.dtypes)),
    }


def _read(spark: SparkSession, path: str, schema: str | T.StructType | None) -> DataFrame:
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def as_flow_table(
    df: DataFrame, roles: FlowSchema | None = None, *, distinct: DataFrame | None = None
) -> FlowTable:
    """Check the mapped columns and parse the time column if it is text."""
    roles = roles or FlowSchema()
    return FlowTable(
        _with_parsed_time(df, roles),
        roles,
        None if distinct is None else _with_parsed_time(distinct, roles),
    )


def _with_parsed_time(df: DataFrame, roles: FlowSchema) -> DataFrame:
    if roles.time in df.columns and isinstance(df.schema[roles.time].dataType, T.StringType):
        return df.withColumn(roles.time, F.to_timestamp(roles.time))
    return df


def table_size(table: FlowTable) -> DataFrame:
    """One row: number of rows and columns. The columns were checked when the table was made."""
    return table.raw.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "column_count", F.lit(len(table.raw.columns))
    )


def write_distinct(table: FlowTable, path: str, *, files: int | None = None) -> FlowTable:
    """Write the rows without exact duplicates to ``path``, once, and return a table whose
    volume analyses read that copy instead of removing duplicates again on each call.

    Files are ranged by time, so that a year filter skips files. The row hash as second key
    splits a day that holds a large share of all rows over several files. A record beside the
    copy says what it was made from.
    """
    spark = table.raw.sparkSession
    keys = [F.col(table.roles.time), F.xxhash64(*table.raw.columns)]
    rows = table.raw.dropDuplicates()
    ranged = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    ranged.sortWithinPartitions(table.roles.time).write.mode("errorifexists").parquet(path)
    spark.createDataFrame([Row(**_described(table.raw))]).coalesce(1).write.parquet(_record_path(path))
    return FlowTable(table.raw, table.roles, spark.read.parquet(path))
