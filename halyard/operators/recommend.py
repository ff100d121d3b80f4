"""Recommendations from predictions, stock and forecast, by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions import half_up, safe_div
from halyard.operators.selection import top_k
from halyard.operators.union import stacked

# fixed values: limits and texts of the rules
CHURN_LIMIT = 0.6
STOCKOUT_LIMIT = 0.65
FORECAST_SHARE = 0.95
TOP = 10
CHURN_TEXT = {
    "insight": "Customer %s has a critical churn probability of %.1f%%.",
    "cause": "Declining engagement score combined with elevated order cancellation rates.",
    "advice": "Initiate direct VIP outreach to Customer %s with a 15%% contract renewal discount.",
    "impact": "High Customer Retention",
    "benefit": "15 days",
}
STOCK_TEXT = {
    "insight": "Product %s (%s) has a high stockout risk score of %.1f%%.",
    "cause": "Monthly sales forecast exceeds lead time supply rate.",
    "advice": "Trigger immediate procurement order of %d units for Product %s.",
    "impact": "Inventory Availability & Sales Continuity",
    "benefit": "10 days",
}
REVENUE_TEXT = {
    "insight": "Next month revenue is forecasted to drop by %.1f%% to $%s.",
    "cause": "Seasonal lag in marketing campaign conversions and pipeline velocity.",
    "advice": "Boost Google Ads and Social media marketing spend by 15% to target Enterprise client segments.",
    "impact": "Revenue Stabilisation",
    "benefit": "30 days",
}
DEFAULT_TEXT = {
    "insight": "Enterprise customer loyalty is stable, but partner sales channels are experiencing a 5% drop.",
    "cause": "Partner commission changes implemented last quarter.",
    "advice": "Review and adjust the partner incentive bonus program to restore pipeline growth.",
    "impact": "Partner pipeline recovery",
    "benefit": "45 days",
}


def _record(
    df: DataFrame, text: dict[str, str], insight: Column, advice: Column, confidence: Column, priority: str, roi: float
) -> DataFrame:
    return df.select(
        insight.alias("business_insight"),
        F.lit(text["cause"]).alias("root_cause"),
        advice.alias("recommendation"),
        confidence.cast("double").alias("confidence"),
        F.lit(text["impact"]).alias("expected_impact"),
        F.lit(priority).alias("priority"),
        F.lit(roi).alias("estimated_roi"),
        F.lit(text["benefit"]).alias("estimated_time_to_benefit"),
    )


def churn_advice(predictions: DataFrame) -> DataFrame:
    likely = predictions.where(F.col("churn_probability") > CHURN_LIMIT)
    top = top_k(likely, [F.desc("churn_probability"), F.asc("customer_id")], TOP)
    p, who = F.col("churn_probability"), F.col("customer_id").cast("string")
    return _record(
        top,
        CHURN_TEXT,
        F.format_string(CHURN_TEXT["insight"], who, p * 100),
        F.format_string(CHURN_TEXT["advice"], who),
        half_up(p, 2),
        "High",
        320.0,
    )


def latest_stock_risk(inventory: DataFrame) -> DataFrame:
    """The stock-out risk of each product's last snapshot."""
    return inventory.groupBy("product_id").agg(
        F.max_by("stockout_risk", F.struct("snapshot_date", "warehouse_id")).alias("stockout_risk")
    )


def stockout_advice(requirements: DataFrame, risk: DataFrame) -> DataFrame:
    """Requirements joined with the latest risk; the ten riskiest products."""
    risky = requirements.join(risk.where(F.col("stockout_risk") > STOCKOUT_LIMIT), "product_id")
    top = top_k(risky, [F.desc("stockout_risk"), F.asc("product_id")], TOP)
    what, p = F.col("product_id").cast("string"), F.col("stockout_risk")
    return _record(
        top,
        STOCK_TEXT,
        F.format_string(STOCK_TEXT["insight"], what, F.col("category"), p * 100),
        F.format_string(STOCK_TEXT["advice"], F.col("reorder_point").cast("long"), what),
        half_up(p, 2),
        "High",
        180.0,
    )


def revenue_advice(forecast: DataFrame) -> DataFrame:
    """One row when the latest forecast falls short of the actual by more than five percent."""
    last = forecast.agg(
        F.max_by("predicted_next_month_revenue", "forecast_month").alias("predicted"),
        F.max_by("actual_current_month_revenue", "forecast_month").alias("actual"),
    )
    short = last.where(F.col("predicted") < F.col("actual") * FORECAST_SHARE)
    drop = safe_div(F.col("actual") - F.col("predicted"), "actual") * F.lit(100.0)
    return _record(
        short,
        REVENUE_TEXT,
        F.format_string(REVENUE_TEXT["insight"], drop, F.format_number("predicted", 2)),
        F.lit(REVENUE_TEXT["advice"]),
        F.lit(0.88),
        "Critical",
        240.0,
    )


def recommendations(parts: list[DataFrame]) -> DataFrame:
    """All advice, or the default row when there is none.

    The sources are evaluated once: their few rows (ten customers, ten products and a
    forecast at most) become one array, and an empty array the default row.
    """
    found = stacked(parts)
    one = found.sparkSession.range(1)
    fallback = _record(
        one, DEFAULT_TEXT, F.lit(DEFAULT_TEXT["insight"]), F.lit(DEFAULT_TEXT["advice"]), F.lit(0.80), "Medium", 150.0
    )
    default = fallback.select(F.array(F.struct(*found.columns))).scalar()
    rows = found.agg(F.collect_list(F.struct(*found.columns)).alias("rows"))
    return rows.select(F.inline(F.when(F.size("rows") > 0, F.col("rows")).otherwise(default.cast(rows.schema["rows"].dataType))))
