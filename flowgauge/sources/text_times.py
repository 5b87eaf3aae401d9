"""Time columns that are text: good rows go on, rows whose text is no time are kept apart."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgauge.schema import FlowSchema
from flowgauge.table import FlowTable

#: Name of the folder column that tells quarantined rows from good ones.
_APART = "__quarantined"


def parsed_time(text: Column, formats: Sequence[str] = ()) -> Column:
    """The time that ``text`` states, by ISO 8601 or else by the first of ``formats`` that fits;
    null if there is none. Blank text is a missing time."""
    tries = [text.try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


@dataclass(frozen=True)
class ParsedTimes:
    """``table``: rows with a time or without one; ``quarantine``: rows, as they came, whose text is
    no time; ``counts``: rows, parsed, missing and failed, taken while the two were written."""

    table: FlowTable
    quarantine: DataFrame
    counts: dict[str, int]


def parse_times(
    df: DataFrame, folder: str, roles: FlowSchema | None = None, *, formats: Sequence[str] = ()
) -> ParsedTimes:
    """Parse the text column with the role time. One pass without a shuffle writes good and bad
    rows side by side to ``folder``, which must not exist, and counts them.

    Null and blank texts are missing times, which no analysis by time counts, and are not
    quarantined. A column that is a time already has nothing to quarantine.
    """
    roles = roles or FlowSchema()
    if roles.time not in df.columns:
        raise ValueError(f"mapped columns missing from the table: {roles.time}")
    text = F.col(roles.time)
    is_text = isinstance(df.schema[roles.time].dataType, T.StringType)
    time = parsed_time(text, formats) if is_text else text
    absent = text.isNull() | (F.trim(text) == "") if is_text else text.isNull()
    read = df.withColumn("__time", time).withColumn(_APART, ~absent & F.col("__time").isNull())
    seen = Observation()
    read = read.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count("__time").alias("parsed"),
        F.count_if(absent).alias("missing"), F.count_if(_APART).alias("failed"))
    read.write.mode("errorifexists").partitionBy(_APART).parquet(folder)
    written = df.sparkSession.read.schema(read.schema).parquet(folder)
    good = written.where(~F.col(_APART)).withColumn(roles.time, F.col("__time")).select(df.columns)
    bad = written.where(F.col(_APART)).select(df.columns)
    return ParsedTimes(FlowTable(good, roles), bad, dict(seen.get))
