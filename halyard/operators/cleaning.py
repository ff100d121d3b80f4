"""Cleaning and standardisation. Every step is a projection except the de-duplication."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.functions import bounded
from halyard.operators.describe import numeric_columns
from halyard.operators.union import stacked
from halyard.sources.sinks import write_table
from halyard.sources.tables import parse_date_columns

# fixed values: columns parsed as dates, and money columns that cannot be negative
DATE_COLUMNS = [
    "signup_date", "start_date", "end_date", "order_date", "hire_date", "snapshot_date", "operating_date",
    "recent_last_order",
]
MONEY_COLUMNS = [
    "unit_cost", "list_price", "order_amount", "budget", "revenue", "gross_margin", "opex", "ebitda", "cash_balance",
    "debt_balance", "inventory_value", "annual_revenue", "salary", "contract_value",
]
SERIES_ORDER = {
    "orders": "order_date",
    "finance_monthly": "order_month",
    "operations_daily": "operating_date",
    "inventory_snapshots": "snapshot_date",
}


def standard_names(df: DataFrame) -> DataFrame:
    """Trimmed lower-case names with underscores."""
    return df.toDF(*[c.strip().lower().replace(" ", "_").replace("-", "_") for c in df.columns])


def fill_text(df: DataFrame, filler: str = "Unknown") -> DataFrame:
    """Every text column: missing becomes the filler, then trimmed."""
    return df.select(
        *[
            F.trim(F.coalesce(f.name, F.lit(filler))).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def range_for(name: str) -> tuple[float | None, float | None] | None:
    """The allowed range a column's name implies."""
    if name.endswith("_score"):
        return 0.0, 100.0
    if name.endswith("_rate"):
        return 0.0, 1.0
    if name.endswith("_days") or name in MONEY_COLUMNS:
        return 0.0, None
    return None


def clip_ranges(df: DataFrame) -> DataFrame:
    """Numbers clipped to the range of their name, types kept; missing stays missing."""
    kinds = dict(df.dtypes)
    numbers = set(numeric_columns(df))

    def clipped(name: str):
        limits = range_for(name) if name in numbers else None
        return F.col(name) if limits is None else bounded(name, *limits).cast(kinds[name]).alias(name)

    return df.select(*[clipped(c) for c in df.columns])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Identical rows once, nulls being equal; equal rows meet map-side first."""
    return df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    """How many rows the de-duplication removes."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return copies.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows_removed"))


def time_ordered(df: DataFrame, column: str) -> DataFrame:
    """Rows in time order within each partition; no value is filled and nothing is shuffled.

    Readers that need the whole order sort by it themselves (windows, folds and series do).
    """
    return df.sortWithinPartitions(column) if column in df.columns else df


def clean_table(df: DataFrame, name: str) -> DataFrame:
    """Names, dates, text, ranges, duplicates, and time order for the series tables."""
    named = standard_names(df)
    projected = clip_ranges(fill_text(parse_date_columns(named, DATE_COLUMNS)))
    distinct = drop_duplicates(projected)
    return time_ordered(distinct, SERIES_ORDER[name]) if name in SERIES_ORDER else distinct


def _size(df: DataFrame, rows: str, nulls: str) -> DataFrame:
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias(rows), F.coalesce(F.sum(missing), F.lit(0)).alias(nulls))


def cleaning_summary(name: str, raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows and missing values before and after, one aggregate per side."""
    before = _size(standard_names(raw), "input_rows", "null_count_before")
    after = _size(cleaned, "output_rows", "null_count_after").agg(F.first(F.struct("*"))).scalar()
    return before.select(
        F.lit(name).alias("table_name"),
        "input_rows",
        after["output_rows"].alias("output_rows"),
        "null_count_before",
        after["null_count_after"].alias("null_count_after"),
        (F.col("input_rows") - after["output_rows"]).alias("duplicate_rows_removed"),
    )


def clean_all(tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Clean and write every table; the summary reads the written files, not the plans again."""
    summaries = []
    for name, raw in tables.items():
        path = write_table(clean_table(raw, name), folder, name)
        summaries.append(cleaning_summary(name, raw, raw.sparkSession.read.parquet(path)))
    summary = stacked(summaries)
    write_table(summary, folder, "data_cleaning_summary")
    return summary
