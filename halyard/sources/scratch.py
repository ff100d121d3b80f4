"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from halyard.session import checkpoint_ready

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (``spark.checkpoint.dir``)."""
    checkpoint_ready(spark)
    return str(spark.sparkContext.getCheckpointDir())


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_written(df: DataFrame) -> None:
    """Delete a table that ``written`` made and nothing reads any more."""
    path = getattr(df, "halyard_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written.remove((df.sparkSession, path))


def drop_written_through(spark: SparkSession) -> None:
    """Delete all tables written through this session object, such as that of one micro-batch."""
    for session, path in [entry for entry in _written if entry[0] is spark]:
        _delete(session, path)
        _written.remove((session, path))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once as Parquet under the shared folder and read it back.

    Unlike ``checkpoint()`` this computes the frame once and later readers
    prune columns. The shuffles behind the table go when it is written: nothing
    reads them again. Tables still there when the process ends are deleted then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.halyard_path = path
    _written.append((spark, path))
    return out


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its folder is its own concern
            continue
