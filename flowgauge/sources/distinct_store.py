"""A distinct copy that grows with its table.

The store keeps, in batches, the distinct rows and beside them a ledger of their fingerprints in hash
buckets. When files are added to the table, only these are read; their rows are named by fingerprint,
these names alone are compared with the ledger in the buckets they fall into, and the rows that are new are
appended: whole rows are shuffled once a batch. A batch counts from the moment its commit is written: a job
that dies leaves files that nobody reads.

Folders of a store: rows/<batch> (the columns of the table, ranged by time),
prints/<batch>/bucket=<b> (fingerprints), files/<batch> (source files), commits (one row per batch).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgauge.schema import FlowSchema
from flowgauge.session import cut_lineage
from flowgauge.sources.files import data_files
from flowgauge.sources.flow_table import as_flow_table
from flowgauge.table import FlowTable

#: Name of the fingerprint column in the store.
PRINT = "__print"
_KNOWN = "__known"
#: Rows of a range, about: so many fit into the memory of a task, however large the batch.
RANGE_ROWS = 300_000
_COMMIT = ("batch_no long, batch string, buckets int, columns string, files long, rows_read long, "
           "rows_new long, buckets_touched long")
_FILES = "path string, size long, modified timestamp"


def fingerprint(df: DataFrame) -> Column:
    """16 bytes of the SHA-256 of a row: equal for rows that ``dropDuplicates`` takes as equal
    (null equals null, NaN equals NaN, 0.0 equals -0.0), whatever the order of the columns."""
    parts = []
    for name in sorted(df.columns):
        text = _text_of(F.col(f"`{name}`"), df.schema[name].dataType)
        # Length first, so that neighbouring values can't run into each other.
        parts.append(F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.substring(F.sha2(F.concat(*parts).cast("binary"), 256), 1, 32))


def _text_of(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (value + F.lit(0.0).cast(kind)).cast("string")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")  # not by the time zone of the session
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.when(value.isNotNull(), F.to_json(F.struct(_zeros_alike(value, kind).alias("v"))))
    return value.cast("string")


def _zeros_alike(value: Column, kind: T.DataType) -> Column:
    """0.0 for -0.0 inside arrays, structs and maps; maps as their entries in order."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value + F.lit(0.0).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _zeros_alike(item, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [_zeros_alike(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return F.array_sort(_zeros_alike(F.map_entries(value), T.ArrayType(entry)))
    return value


@dataclass(frozen=True)
class DistinctStore:
    """The distinct rows of the Parquet table at ``table_path``, kept at ``path``. ``buckets`` is
    set by the first batch and stays; a bucket should hold some millions of fingerprints."""

    spark: SparkSession
    table_path: str
    path: str
    roles: FlowSchema = FlowSchema()
    schema: str | T.StructType | None = None
    buckets: int = 64

    # -- what is there -----------------------------------------------------------------------

    def log(self) -> DataFrame:
        """One row per batch: number, files, rows read, rows that were new, buckets compared."""
        return self._commits().select(
            "batch_no", "files", "rows_read", "rows_new", "buckets_touched")

    def rows(self) -> DataFrame:
        """The distinct rows of all batches, with the columns of the table."""
        return self._rows(self._committed())

    def table(self) -> FlowTable:
        """The table with this copy. Raises if files came or went since the last batch."""
        commits = self._committed()
        new, changed = self._difference(commits)
        if new or changed:
            raise ValueError(f"{self.table_path} has other files than the store at {self.path}; call grow()")
        return as_flow_table(self._raw(), self.roles, distinct=self._rows(commits))

    # -- growing -----------------------------------------------------------------------------

    def grow(self) -> FlowTable:
        """Take in the files that came since the last batch and return the table with its copy.

        Only those files are read, and of the ledger only the buckets their rows fall into. While
        the batch is small, the ledger is filtered where it lies; nothing of it is shuffled. Files
        that were replaced or removed can't be taken back out: that raises, and the store has to be
        made anew.
        """
        commits = self._committed()
        new, changed = self._difference(commits)
        if changed:
            names = ", ".join(r.path for r in changed[:3])
            raise ValueError(f"files were replaced or removed ({names}); write a new store")
        if new:
            commits = [*commits, self._append(new, commits)]
        return as_flow_table(self._raw(), self.roles, distinct=self._rows(commits))

    def _append(self, files: list[Row], commits: list[Row]) -> Row:
        buckets = commits[0].buckets if commits else self.buckets
        read = self._raw([f.path for f in files])
        columns = _ddl(read.schema)
        if commits and commits[0].columns != columns:
            raise ValueError(f"the new files have other columns or types than the store at {self.path}")
        rows_read, touched, known = read.count(), buckets, None
        if commits:
            time = F.col(self.roles.time)
            names = cut_lineage(read.select(time, fingerprint(read).alias(PRINT))).withColumn("bucket", _bucket(buckets))
            numbers = [r.bucket for r in names.select("bucket").distinct().collect()]  # at most `buckets`
            ledger = self._read("prints", f"`{PRINT}` binary, bucket int", commits)
            known = ledger.where(F.col("bucket").isin(numbers)).join(names, ["bucket", PRINT]).drop("bucket")
            known, touched = cut_lineage(known.distinct()), len(numbers)
        batch = uuid.uuid4().hex
        target = f"{self.path}/rows/{batch}"
        self._first_of_each(read, known, 1 + rows_read // RANGE_ROWS).write.parquet(target)
        appended = self.spark.read.schema(read.schema).parquet(target)
        names = appended.select(fingerprint(appended).alias(PRINT)).withColumn("bucket", _bucket(buckets))
        names.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/prints/{batch}")
        self.spark.createDataFrame(files, _FILES).coalesce(1).write.parquet(f"{self.path}/files/{batch}")
        commit = Row(
            batch_no=len(commits), batch=batch, buckets=buckets, columns=columns, files=len(files),
            rows_read=rows_read, rows_new=appended.count(), buckets_touched=touched)
        self.spark.createDataFrame([commit], _COMMIT).coalesce(1).write.mode("append").parquet(
            f"{self.path}/commits")
        return commit

    def _first_of_each(self, read: DataFrame, known: DataFrame | None, ranges: int) -> DataFrame:
        """One of each kind of rows that is not known, ranged by time. Equal rows have one time and one
        fingerprint, and known names come with both, so all of a kind meet in one range. There copies
        are dropped as they come, so that a row with any number of them takes no more memory."""
        columns, keys = read.columns, [self.roles.time, PRINT]
        rows = read.withColumns({PRINT: fingerprint(read), _KNOWN: F.lit(False)})
        if known is not None:
            rows = rows.unionByName(known.withColumn(_KNOWN, F.lit(True)), allowMissingColumns=True)
        rows = rows.repartitionByRange(ranges, *keys).dropDuplicates()
        if known is not None:
            rows = rows.withColumn(_KNOWN, F.max(_KNOWN).over(Window.partitionBy(*keys))).where(~F.col(_KNOWN))
        return rows.select(columns).sortWithinPartitions(self.roles.time)

    # -- parts -------------------------------------------------------------------------------

    def _raw(self, names: list[str] | None = None) -> DataFrame:
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        if names is None:
            return reader.parquet(self.table_path)
        return reader.option("basePath", self.table_path).parquet(*names)

    def _rows(self, commits: list[Row]) -> DataFrame:
        raw = self._raw()
        return self._read("rows", _ddl(raw.schema), commits)

    def _commits(self) -> DataFrame:
        if not _exists(self.spark, f"{self.path}/commits"):
            return self.spark.createDataFrame([], _COMMIT)
        return self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits")

    def _committed(self) -> list[Row]:
        return self._commits().orderBy("batch_no").collect()

    def _read(self, part: str, schema: str, commits: list[Row]) -> DataFrame:
        """All committed batches of a part; no rows before the first."""
        paths = [f"{self.path}/{part}/{c.batch}" for c in commits]
        if not paths:
            return self.spark.createDataFrame([], schema)
        if part != "prints":
            return self.spark.read.schema(schema).parquet(*paths)
        # Each batch is a folder with its own buckets; their common column comes from the names.
        by_batch = [self.spark.read.schema(schema).option("basePath", p).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, by_batch)

    def _difference(self, commits: list[Row]) -> tuple[list[Row], list[Row]]:
        """Files that are not in the store yet; files of the store that are gone or have changed.
        Only these come to the driver, which has to name the ones that are read."""
        now = data_files(self.spark, self.table_path)
        if not commits:
            return now.collect(), []
        taken = self._read("files", _FILES, commits)
        changed = taken.join(now, ["path", "size", "modified"], "left_anti").limit(3).collect()
        return now.join(taken, "path", "left_anti").collect(), changed


def _bucket(buckets: int) -> Column:
    """By the first four bytes of the fingerprint."""
    return F.pmod(F.conv(F.hex(F.substring(PRINT, 1, 4)), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _exists(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
