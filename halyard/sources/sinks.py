"""Writing tables, schemas, manifests and append-only logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators.union import stacked
from halyard.sources.tables import path_exists


def write_table(df: DataFrame, folder: str, name: str, partition_by: list[str] | None = None) -> str:
    """Replace one table. Facts may be laid out by a column (month) for pruning."""
    path = f"{folder}/{name}.parquet"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def append_log(df: DataFrame, path: str) -> None:
    """Append rows, creating the log on first use."""
    df.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def schema_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table and column: its position and type."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, position, column, dtype)
        for name, df in tables.items()
        for position, (column, dtype) in enumerate(df.dtypes)
    ]
    return spark.createDataFrame(rows, "dataset string, position int, column string, dtype string")


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row and column count per table, one pass over each."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("dataset"), "row_count", F.lit(len(df.columns)).cast("long").alias("column_count")
        )
        for name, df in tables.items()
    ]
    return stacked(counts)


def json_records(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, still distributed."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("record"))
