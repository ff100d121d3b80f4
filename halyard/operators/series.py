"""Features of one ordered monthly series.

These windows have no partition key, so the frame must be at month grain: one
row per month, never order grain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halyard.functions import cyclical, safe_div
from halyard.operators.trailing import trailing_expressions

FINANCE_COLUMNS = ["revenue", "gross_margin", "order_count", "ebitda", "cash_balance", "debt_balance", "dscr"]


def series_features(
    months: DataFrame,
    order: str,
    columns: Sequence[str],
    lags: Sequence[int] = (1, 2, 3, 6),
    windows: Sequence[int] = (3, 6),
    spread: bool = True,
) -> DataFrame:
    base = W.orderBy(order)
    named = trailing_expressions(base, [c for c in columns if c in months.columns], lags, windows, spread)
    return months.select("*", *[e.alias(n) for n, e in named.items()])


def growth(months: DataFrame, order: str, column: str, name: str) -> DataFrame:
    """Relative change against the previous month, null on a zero base."""
    before = F.lag(column).over(W.orderBy(order))
    return months.withColumn(name, safe_div(F.col(column) - before, before))


def lead_target(months: DataFrame, order: str, column: str, name: str, horizon: int = 1) -> DataFrame:
    return months.withColumn(name, F.lead(column, horizon).over(W.orderBy(order)))


def running_sum(months: DataFrame, order: str, column: str, name: str) -> DataFrame:
    frame = W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return months.withColumn(name, F.sum(column).over(frame))


def row_position(months: DataFrame, order: str, name: str = "month_index") -> DataFrame:
    return months.withColumn(name, (F.row_number().over(W.orderBy(order)) - 1).cast("long"))


def ranked_list(df: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """1..n over a short list (selected features)."""
    return df.withColumn(name, F.row_number().over(W.orderBy(order)))


def time_parts(months: DataFrame, order: str) -> DataFrame:
    """Month, quarter and year of a ``yyyy-MM`` text with their cycle positions."""
    month = F.substring(order, 6, 2).cast("int")
    quarter = F.ceil(month / F.lit(3.0)).cast("int")
    month_sin, month_cos = cyclical(month, 12)
    quarter_sin, quarter_cos = cyclical(quarter, 4)
    return months.select(
        "*",
        month.alias("month"),
        quarter.alias("quarter"),
        F.substring(order, 1, 4).cast("int").alias("year"),
        month_sin.alias("month_sin"),
        month_cos.alias("month_cos"),
        quarter_sin.alias("quarter_sin"),
        quarter_cos.alias("quarter_cos"),
    )


def finance_ratios(months: DataFrame, order: str) -> DataFrame:
    grown = growth(months, order, "revenue", "revenue_growth_rate")
    return grown.select(
        "*",
        safe_div("gross_margin", "revenue").alias("margin_rate"),
        safe_div("cash_balance", "debt_balance").alias("liquidity_ratio"),
    )


def supervised_months(finance: DataFrame, horizon: int = 1, order: str = "order_month") -> DataFrame:
    """Time parts, lags, trailing statistics, ratios and the lead target.

    The last month keeps its row with a null target: it is the one to score.
    """
    timed = time_parts(finance, order)
    trailed = series_features(timed, order, FINANCE_COLUMNS)
    return lead_target(finance_ratios(trailed, order), order, "revenue", "target_revenue", horizon)
