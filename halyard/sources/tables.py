"""Declared schemas and table readers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAR = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


class StarTables:
    """The star tables under one folder, read with declared schemas (no inference job)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in STAR:
            raise AttributeError(name)
        return self.spark.read.schema(STAR[name]).parquet(f"{self.folder}/{name}.parquet")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system the path belongs to (local, HDFS, object store)."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_table(spark: SparkSession, folder: str, name: str, schema: str | T.StructType | None = None) -> DataFrame:
    """One table by name, Parquet if there, else CSV with a header; an error when neither is."""
    parquet, csv = f"{folder}/{name}.parquet", f"{folder}/{name}.csv"
    if path_exists(spark, parquet):
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(parquet)
    if path_exists(spark, csv):
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return reader.csv(csv)
    raise FileNotFoundError(f"no table {name!r} under {folder}")


def read_tables(
    spark: SparkSession, folder: str, names: Iterable[str], views: bool = False
) -> dict[str, DataFrame]:
    """Several tables; with ``views`` each is also registered for SQL."""
    tables = {name: read_table(spark, folder, name) for name in names}
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def read_with_fallback(spark: SparkSession, folders: Sequence[str], name: str, schema: str) -> DataFrame:
    """The first folder that has the table, else an empty frame of the schema."""
    for folder in folders:
        try:
            return read_table(spark, folder, name, schema)
        except FileNotFoundError:
            continue
    return spark.createDataFrame([], schema)


DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy-MM", "dd/MM/yyyy", "yyyy/MM/dd")


def lenient_timestamp(c: Column | str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Text in any of the formats to a timestamp, null when none fits."""
    text = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parse_date_columns(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Text columns holding dates become timestamps, bad values null.

    Without ``columns`` a column is taken by name: it ends in ``date`` or ``_at``.
    """
    wanted = None if columns is None else set(columns)

    def is_date(name: str) -> bool:
        return name in wanted if wanted is not None else name.endswith(("date", "_at"))

    return df.select(
        *[
            lenient_timestamp(f.name).alias(f.name)
            if isinstance(f.dataType, T.StringType) and is_date(f.name)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def read_month_series(df: DataFrame, column: str) -> DataFrame:
    """A month column in mixed formats parsed, rows in month order."""
    return parse_date_columns(df, [column]).orderBy(column)


def records_frame(json_rows: DataFrame, column: str, schema: str) -> DataFrame:
    """A batch of JSON objects (one per row) to typed columns."""
    return json_rows.select(F.from_json(column, schema).alias("record")).select("record.*")
