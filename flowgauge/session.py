"""Session-level helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application for checkpoints and intermediate tables, deleted when the
    application ends.

    It lies in the one the session names in ``spark.checkpoint.dir``. Where it names none, a
    local session gets a temporary one; on a cluster that would not be shared, so it raises.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="flowgauge-"))
    folder = context.getCheckpointDir()
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read on from there, so that an
    iterative job neither recomputes its input nor depends on executors living on."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
