"""Check every arriving micro-batch for drift against a reference table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from halyard.operators.drift import Profile, drift_against, drift_summary, profile_of
from halyard.sources.scratch import drop_written_through, written


def watch_drift(
    stream: DataFrame,
    reference: DataFrame | None,
    dataset: str,
    folder: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Write one report and one summary per batch under ``folder``.

    The reference is counted once, into ``folder``/reference; a batch is compared with
    those counts and the reference is not read again. Without a reference the counts that are
    there are used. A batch replaces its own partition only, so a batch replayed after a
    failure leaves the same files; what it writes on the way goes when it ends.
    """
    profile = f"{folder}/reference"
    if reference is not None:
        profile_of(reference).write(profile)

    def check(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        report = f"{folder}/report/batch_id={batch_id}"
        try:
            rows = written(batch, "drift-batch")
            drift_against(Profile.read(spark, profile), dataset, rows).write.mode("overwrite").parquet(report)
        finally:
            drop_written_through(spark)
        summary = drift_summary(spark.read.parquet(report))
        summary.withColumn("checked_at", F.current_timestamp()).write.mode("overwrite").parquet(
            f"{folder}/log/batch_id={batch_id}"
        )

    writer = stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
