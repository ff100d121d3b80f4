"""Named business metrics as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions import half_up, safe_div, weighted, whole_days, zero_if_none

# fixed values: score weights and churn limits
VALUE_WEIGHTS = {"engagement": 0.35, "log_revenue": 0.35, "completion": 20.0, "cancellation": 10.0}
ACTIVITY_WEIGHTS = {"engagement": 0.40, "health": 0.35, "retention": 0.25}
KPI_PROXY = (0.40, 0.35, 0.25)
EXPLORATION_PROXY = (0.45, 0.35, 0.20)
VELOCITY_SCALE = 100_000.0
CHURN_RECENCY_DAYS = 180
CHURN_CANCELLATION = 0.12


def customer_value_score() -> Column:
    w = VALUE_WEIGHTS
    return half_up(
        F.lit(w["engagement"]) * F.col("engagement_score")
        + F.lit(w["log_revenue"]) * F.log1p("total_revenue")
        + F.lit(w["completion"]) * F.col("completion_rate")
        - F.lit(w["cancellation"]) * F.col("cancellation_rate"),
        2,
    )


def churn_target() -> Column:
    late = F.col("recency_days") > CHURN_RECENCY_DAYS
    return (late | (F.col("cancellation_rate") > CHURN_CANCELLATION)).cast("int")


def activity_score() -> Column:
    w = ACTIVITY_WEIGHTS
    return (
        F.lit(w["engagement"]) * F.col("engagement_score")
        + F.lit(w["health"]) * F.col("customer_health_score")
        + F.lit(w["retention"]) * (F.lit(100.0) - F.col("churn_risk_score"))
    )


def value_proxy(weights: tuple[float, float, float] = KPI_PROXY) -> Column:
    """Weighted recent revenue, 90-day target and order velocity; missing counts as zero."""
    recent, target, velocity = weights
    return (
        F.lit(recent) * zero_if_none("recent_revenue")
        + F.lit(target) * zero_if_none("revenue_90d_target")
        + F.lit(velocity) * zero_if_none("order_velocity") * F.lit(VELOCITY_SCALE)
    )


def lifetime_ratio() -> Column:
    return safe_div("total_revenue", "annual_revenue")


def campaign_metrics(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.coalesce(whole_days("end_date", "start_date"), F.lit(0)).alias("campaign_duration_days"),
        safe_div("budget", "leads_generated").alias("cost_per_lead"),
        safe_div("attributed_revenue", "budget").alias("revenue_per_budget"),
    )


def inventory_utilization() -> Column:
    return safe_div("reserved_units", "on_hand_units")


def employee_metrics(df: DataFrame, as_of: Column) -> DataFrame:
    return df.select(
        "*",
        F.coalesce(whole_days(as_of, "hire_date"), F.lit(0)).alias("tenure_days"),
        safe_div("salary", "performance_score").alias("salary_performance_ratio"),
    )


def order_velocity() -> Column:
    return half_up(F.col("total_orders") / F.greatest(F.col("days_since_last_order"), F.lit(1)), 4)


def margin_breakdown(df: DataFrame, margin_rate: Column | str = "margin_rate") -> DataFrame:
    """Gross, net, cost and margin per order line."""
    rate = F.col(margin_rate) if isinstance(margin_rate, str) else margin_rate
    gross = F.col("quantity") * F.col("unit_price")
    net = gross * (F.lit(1.0) - F.col("discount_rate"))
    cost = net * (F.lit(1.0) - rate)
    return df.select(
        "*",
        gross.alias("gross_amount"),
        net.alias("net_amount"),
        cost.alias("cost_amount"),
        (net - cost).alias("margin_amount"),
    )


def scored(weights: dict[str, float]) -> Column:
    return weighted(weights)
