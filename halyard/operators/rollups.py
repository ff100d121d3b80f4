"""Aggregations: every group-by is a partial/final hash aggregate, dimensions join after it.

Sums of money are rounded half up to four digits once per group, which removes
the trace of the order in which partitions were added up.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halyard.functions import bounded, half_up, month_text, quarter_text, safe_div, whole_days, zero_if_none
from halyard.operators.union import stacked
from halyard.sources.sinks import manifest


def money(c: Column | str) -> Column:
    """Sum of money per group."""
    return half_up(F.sum(c), 4)


def mean_money(c: str) -> Column:
    """Mean over the non-null values of a money column."""
    return safe_div(money(c), F.count(c))


def rows() -> Column:
    return F.count(F.lit(1))


def matching(condition: Column) -> Column:
    return F.count_if(condition)


def fill_numbers(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Defaults for the named columns in one projection."""
    return df.select(
        *[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in df.columns]
    )


# ---------------------------------------------------------------- customers


def customer_orders(orders: DataFrame) -> DataFrame:
    """Per-customer order roll-up with recency and status rates."""
    latest = orders.agg(F.max("order_date")).scalar()
    rolled = orders.groupBy("customer_id").agg(
        rows().alias("total_orders"),
        money("order_amount").alias("total_revenue"),
        mean_money("order_amount").alias("average_order_value"),
        mean_money("discount_rate").alias("average_discount_rate"),
        F.avg("shipping_days").alias("average_shipping_days"),
        F.max("order_date").alias("last_order_date"),
        matching(F.col("order_status") == "Completed").alias("completed_orders"),
        matching(F.col("order_status") == "Cancelled").alias("cancelled_orders"),
    )
    return rolled.select(
        "*",
        whole_days(latest, "last_order_date").alias("recency_days"),
        (F.col("completed_orders") / F.col("total_orders")).alias("completion_rate"),
        (F.col("cancelled_orders") / F.col("total_orders")).alias("cancellation_rate"),
    )


CUSTOMER_DEFAULTS = {
    "total_orders": 0,
    "total_revenue": 0.0,
    "average_order_value": 0.0,
    "average_discount_rate": 0.0,
    "average_shipping_days": 0.0,
    "completed_orders": 0,
    "cancelled_orders": 0,
    "recency_days": 999,
    "completion_rate": 0.0,
    "cancellation_rate": 0.0,
}


def with_customer_orders(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Every customer, with the roll-up or its defaults."""
    joined = customers.join(customer_orders(orders), "customer_id", "left")
    return fill_numbers(joined, CUSTOMER_DEFAULTS)


def customer_kpis(customers: DataFrame, orders: DataFrame, window_days: int = 180, growth: float = 1.08) -> DataFrame:
    """All-time and recent roll-up in one pass over the orders.

    ``growth`` turns recent revenue into the 90-day target.
    """
    latest = orders.agg(F.max("order_date")).scalar()
    recent = F.col("order_date") >= F.timestamp_add("DAY", F.lit(-window_days), latest)
    flagged = orders.withColumn("is_recent", recent)

    def when_recent(c: str) -> Column:
        return F.when(F.col("is_recent"), F.col(c))

    rolled = flagged.groupBy("customer_id").agg(
        rows().alias("total_orders"),
        money("order_amount").alias("total_revenue"),
        money("gross_margin").alias("total_margin"),
        matching(F.col("is_recent")).alias("recent_order_count"),
        half_up(F.sum(when_recent("order_amount")), 4).alias("recent_revenue"),
        safe_div(half_up(F.sum(when_recent("discount_rate")), 4), F.count(when_recent("discount_rate"))).alias(
            "recent_avg_discount"
        ),
        F.avg(when_recent("shipping_days")).alias("recent_avg_shipping_days"),
        F.max(when_recent("order_date")).alias("recent_last_order"),
    )
    joined = customers.join(rolled, "customer_id", "left")
    filled = fill_numbers(
        joined,
        {
            "recent_order_count": 0,
            "recent_revenue": 0.0,
            "recent_avg_discount": 0.0,
            "recent_avg_shipping_days": 0.0,
        },
    )
    since = F.coalesce(whole_days(latest, "recent_last_order"), F.lit(999).cast("long"))
    return filled.withColumn("days_since_last_order", since).select(
        "*",
        half_up(F.col("total_orders") / F.greatest(F.col("days_since_last_order"), F.lit(1)), 4).alias("order_velocity"),
        half_up(F.col("recent_revenue") * F.lit(growth), 2).alias("revenue_90d_target"),
    )


# ---------------------------------------------------------------- sales


def month_start() -> Column:
    """The month as a date: cheap to group by, text is made once per group."""
    return F.trunc(F.col("order_date").cast("date"), "month").alias("month_start")


def monthly_revenue(orders: DataFrame) -> DataFrame:
    months = orders.groupBy(month_start()).agg(
        money("order_amount").alias("revenue"),
        rows().alias("order_count"),
        money("gross_margin").alias("gross_margin"),
    )
    return months.select(
        month_text("month_start").alias("order_month"),
        "revenue",
        "order_count",
        "gross_margin",
        zero_if_none(safe_div("revenue", "order_count")).alias("average_order_value"),
    )


def product_summary(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Roll up first, then fetch the names: the join sees one row per product."""
    rolled = orders.groupBy("product_id").agg(
        rows().alias("total_orders"),
        money("order_amount").alias("total_revenue"),
        mean_money("discount_rate").alias("average_discount_rate"),
        money("gross_margin").alias("total_margin"),
    )
    named = rolled.join(products.select("product_id", "product_name", "category", "subcategory"), "product_id", "left")
    return named.select("*", zero_if_none(safe_div("total_margin", "total_revenue")).alias("margin_rate_realized"))


def region_segment_summary(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders are rolled up per customer before the join, so one heavy customer
    crosses the join as one row and distinct customers become a plain count."""
    per_customer = orders.groupBy("customer_id").agg(
        F.sum("order_amount").alias("amount"), rows().alias("order_rows")
    )
    joined = per_customer.join(customers.select("customer_id", "region", "segment"), "customer_id", "left")
    rolled = joined.groupBy("region", "segment").agg(
        money("amount").alias("revenue"),
        F.sum("order_rows").alias("orders"),
        F.count("customer_id").alias("customers"),
    )
    return rolled.select("*", zero_if_none(safe_div("revenue", "customers")).alias("revenue_per_customer"))


def seasonal_summary(orders: DataFrame) -> DataFrame:
    months = orders.groupBy(month_start()).agg(money("order_amount").alias("revenue"), rows().alias("orders"))
    return months.select(
        quarter_text("month_start").alias("quarter"),
        F.date_format("month_start", "MMMM").alias("month"),
        "revenue",
        "orders",
    )


def segment_insight(kpis: DataFrame) -> DataFrame:
    return kpis.groupBy("segment").agg(
        F.count("customer_id").alias("customers"),
        money("recent_revenue").alias("revenue"),
        mean_money("recent_revenue").alias("average_revenue"),
        mean_money("order_velocity").alias("average_order_velocity"),
        mean_money("revenue_90d_target").alias("average_revenue_target"),
        zero_if_none(F.avg("churn_flag")).alias("churn_rate"),
        F.avg("days_since_last_order").alias("average_days_since_last_order"),
    )


def business_kpis(finance: DataFrame, operations: DataFrame, kpis: DataFrame, proxy: Column) -> DataFrame:
    """Seven means from three tables as (kpi, value) rows.

    ``proxy`` is the customer value expression over the KPI table.
    """
    parts = [
        finance.agg(
            F.avg("revenue").alias("avg_monthly_revenue"),
            F.avg("gross_margin").alias("avg_gross_margin"),
            F.avg("ebitda").alias("avg_ebitda"),
        ),
        operations.agg(
            F.avg("on_time_delivery_rate").alias("avg_on_time_delivery_rate"),
            F.avg("fulfillment_rate").alias("avg_fulfillment_rate"),
        ),
        kpis.agg(F.avg("churn_flag").alias("customer_churn_rate"), F.avg(proxy).alias("avg_customer_value_proxy")),
    ]
    long = [p.unpivot([], p.columns, "kpi", "value") for p in parts]
    return stacked(long)


def category_seasonality(orders: DataFrame) -> DataFrame:
    """Month-of-year demand against a twelfth of the category total."""
    monthly = orders.groupBy("category", F.month("order_date").alias("month_of_year")).agg(
        F.sum("quantity").alias("quantity")
    )
    # at most twelve rows per category reach this window
    average = F.sum("quantity").over(W.partitionBy("category")) / F.lit(12.0)
    return monthly.select("*", average.alias("quantity_avg")).select(
        "*",
        (F.col("quantity") / F.when(F.col("quantity_avg") == 0, 1.0).otherwise(F.col("quantity_avg"))).alias(
            "seasonal_index"
        ),
    )


# ---------------------------------------------------------------- finance

def monthly_finance(
    orders: DataFrame,
    opex_ratio: Column,
    opening_cash: float = 2_000_000.0,
    opening_debt: float = 1_250_000.0,
    monthly_repayment: float = 5_000.0,
) -> DataFrame:
    """Profit and loss, cash and debt per month.

    ``opex_ratio`` may use ``month_no``. The windows run over months only.
    """
    months = (
        orders.groupBy("order_month")
        .agg(
            money("order_amount").alias("revenue"),
            money("gross_margin").alias("gross_margin"),
            rows().alias("order_count"),
        )
        .withColumn("month_no", F.substring("order_month", 6, 2).cast("int"))
    )
    costed = months.select(
        "order_month",
        "revenue",
        "gross_margin",
        "order_count",
        half_up(F.col("revenue") - F.col("gross_margin"), 2).alias("cogs"),
        half_up(F.col("revenue") * opex_ratio, 2).alias("opex"),
    ).withColumn("ebitda", half_up(F.col("gross_margin") - F.col("opex"), 2))
    by_month = W.orderBy("order_month")
    running = F.sum("ebitda").over(by_month.rowsBetween(W.unboundedPreceding, W.currentRow))
    return costed.select(
        "*",
        half_up(F.lit(opening_cash) + running, 2).alias("cash_balance"),
        (F.lit(opening_debt) - (F.row_number().over(by_month) - 1) * F.lit(monthly_repayment)).alias("debt_balance"),
        half_up(bounded(F.col("ebitda") / F.greatest(F.col("opex"), F.lit(1.0)), 0.5, 5.0), 3).alias("dscr"),
    )


def executive_overview(finance: DataFrame, customers: DataFrame, forecast: DataFrame) -> DataFrame:
    """Headline totals in one row; the other two tables enter as scalar subqueries."""
    return finance.agg(
        money("revenue").alias("total_revenue"),
        F.sum("order_count").alias("total_orders"),
        (money("gross_margin") / F.greatest(money("revenue"), F.lit(1.0))).alias("average_gross_margin_rate"),
    ).select(
        "*",
        customers.agg(F.count(F.lit(1))).scalar().alias("customers"),
        F.coalesce(
            forecast.agg(F.max_by("predicted_next_month_revenue", "forecast_month")).scalar(), F.lit(0.0)
        ).alias("revenue_forecast_next_month"),
    )


def operations_cards(operations: DataFrame) -> DataFrame:
    return operations.agg(
        F.avg("on_time_delivery_rate").alias("mean_on_time"),
        F.avg("fulfillment_rate").alias("mean_fulfillment"),
        F.sum("incident_count").alias("incidents"),
        F.sum("throughput_units").alias("throughput"),
    )


def customer_cards(customers: DataFrame) -> DataFrame:
    """Count per segment beside the means over all customers."""
    per_segment = customers.groupBy("segment").agg(
        rows().alias("customers"),
        F.sum("engagement_score").alias("engagement_sum"),
        F.sum("customer_health_score").alias("health_sum"),
    )
    everyone = W.partitionBy()  # one row per segment
    return per_segment.select(
        "segment",
        "customers",
        (F.sum("engagement_sum").over(everyone) / F.sum("customers").over(everyone)).alias("mean_engagement"),
        (F.sum("health_sum").over(everyone) / F.sum("customers").over(everyone)).alias("mean_health"),
    )


def sales_cards(finance: DataFrame) -> DataFrame:
    return finance.agg(F.sum("order_count").alias("total_orders"), mean_money("revenue").alias("mean_monthly_revenue"))


def latest_finance(finance: DataFrame) -> DataFrame:
    """Cash, debt and cover of the last month, without a sort."""
    return finance.agg(
        F.max("order_month").alias("order_month"),
        *[F.max_by(c, "order_month").alias(c) for c in ("cash_balance", "debt_balance", "dscr")],
    )


def churn_and_trend(predictions: DataFrame, forecast: DataFrame) -> DataFrame:
    """Predicted-churn count and share, and the forecast trend in percent."""
    trend = forecast.agg(
        F.max_by(
            safe_div(
                F.col("predicted_next_month_revenue") - F.col("actual_current_month_revenue"),
                "actual_current_month_revenue",
            )
            * F.lit(100.0),
            "forecast_month",
        )
    ).scalar()
    return predictions.agg(
        F.sum("predicted_churn").cast("long").alias("churn_customers"),
        rows().alias("customers"),
    ).select("*", safe_div("churn_customers", "customers").alias("churn_share"), trend.alias("revenue_trend_pct"))


# ---------------------------------------------------------------- demand


def product_month_demand(orders: DataFrame) -> DataFrame:
    return orders.groupBy("product_id", "order_month").agg(
        F.sum("quantity").alias("quantity_sold"),
        money("order_amount").alias("revenue_generated"),
        rows().alias("order_count"),
    )


def prediction_stats(predictions: DataFrame) -> DataFrame:
    """Mean and spread of predicted demand; one prediction has spread 1."""
    return predictions.groupBy("product_id").agg(
        mean_money("predicted_demand").alias("avg_predicted_demand"),
        F.coalesce(F.stddev_samp("predicted_demand"), F.lit(1.0)).alias("std_predicted_demand"),
    )


# ---------------------------------------------------------------- distributions


def group_target(df: DataFrame, column: str, target: str) -> DataFrame:
    return df.groupBy(column).agg(F.avg(target).alias("target_mean"), F.count(target).alias("target_count"))


def relative_frequency(df: DataFrame, column: str) -> DataFrame:
    """Share of rows per value, missing values being a value of their own."""
    counts = df.groupBy(column).agg(rows().alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.select(column, "n", (F.col("n") / total).alias("share"))


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins between minimum and maximum; the maximum falls in the last bin."""
    limits = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    low, high = limits["low"], limits["high"]
    width = (high - low) / F.lit(float(bins))
    position = F.coalesce(F.floor(F.try_divide(F.col(column) - low, width)), F.lit(0))
    placed = df.where(F.col(column).isNotNull()).select(
        F.least(position, F.lit(bins - 1)).cast("int").alias("bin")
    )
    return placed.groupBy("bin").agg(rows().alias("n")).select(
        "bin", "n", half_up(low + F.col("bin") * width, 4).alias("bin_start")
    )


def missing_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Missing count and percent per table and column, one pass per table."""
    parts = []
    for name, df in tables.items():
        counts = df.agg(
            rows().alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
        )
        long = counts.unpivot("__rows", df.columns, "column_name", "missing_count")
        parts.append(
            long.select(
                F.lit(name).alias("table_name"),
                "column_name",
                "missing_count",
                half_up(F.col("missing_count") / F.greatest(F.col("__rows"), F.lit(1)) * F.lit(100.0), 4).alias(
                    "missing_pct"
                ),
            )
        )
    return stacked(parts)


def table_overview(tables: Mapping[str, DataFrame]) -> DataFrame:
    return manifest(tables).orderBy(F.desc("row_count"), "dataset")
