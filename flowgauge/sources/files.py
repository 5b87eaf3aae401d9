"""Which files a table consists of, listed by Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def data_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, size, modified): one row per data file below ``paths``, sub-folders included. Only
    the listing is read, not the files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.load(paths if isinstance(paths, str) else list(paths)).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    )


def state_of(files: DataFrame) -> tuple[int, str]:
    """Number of files and one number for names, sizes and times, independent of their order."""
    row = files.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("path", "size", "modified").cast("decimal(38,0)")).cast("string").alias("state"),
    ).first()
    return row.n, row.state or ""
