"""Deterministic derivations: calendar, cost breakdown, stock, pay, funnel, risk mix, propensity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions import bounded, half_up, ladder, safe_div, zero_if_none
from halyard.operators.joins import lookup

# fixed values
EXPENSE_SHARES = {"shipping_cost": 0.30, "marketing_cost": 0.20, "operating_cost": 0.50}
TAX_RATE = 0.10
BONUS_RATES = {"Intern": 0.0, "Software Engineer": 0.05, "Senior Engineer": 0.10, "Manager": 0.15, "Director": 0.25}
RISK_WEIGHTS = {"customer_risk": 0.5, "financial_risk": 0.3, "operational_risk": 0.2}
SEGMENT_WEIGHTS = {"Enterprise": 2.2, "Mid-Market": 1.2, "SMB": 0.7}


def date_spine(bounds: DataFrame, first: str, last: str, step: str = "day", name: str = "date") -> DataFrame:
    """Each day or month start between two dates of every row of ``bounds``."""
    start = F.date_trunc(step, F.col(first)).cast("date")
    moves = F.sequence(start, F.col(last).cast("date"), F.expr(f"interval 1 {step}"))
    return bounds.select(F.explode(moves).alias(name))


def calendar(spine: DataFrame, column: str = "date") -> DataFrame:
    day = F.col(column)
    return spine.select(
        column,
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.weekofyear(day).alias("week"),
        F.weekday(day).alias("weekday"),
        (F.weekday(day) >= 5).alias("weekend"),
        F.quarter(day).alias("financial_quarter"),
    )


def cost_breakdown(payments: DataFrame, orders: DataFrame, margin: Column) -> DataFrame:
    """Each payment of a dated order split into expense, tax and cost kinds."""
    rows = payments.join(orders, "order_id").where(F.col("order_date").isNotNull())
    revenue = F.col("payment_value")
    priced = rows.select("*", (revenue * (F.lit(1.0) - margin)).alias("__expense"))
    expense = F.col("__expense")
    costs = {name: expense * F.lit(share) for name, share in EXPENSE_SHARES.items()}
    gross = revenue - (costs["shipping_cost"] + costs["operating_cost"])
    return priced.select(
        "order_id",
        "customer_id",
        half_up(revenue, 2).alias("revenue"),
        half_up(expense, 2).alias("expense"),
        half_up(revenue - expense, 2).alias("profit"),
        half_up(revenue * F.lit(TAX_RATE), 2).alias("tax"),
        *[half_up(cost, 2).alias(name) for name, cost in costs.items()],
        half_up(zero_if_none(safe_div(gross, revenue)), 4).alias("gross_margin"),
        half_up(zero_if_none(safe_div(revenue - expense, revenue)), 4).alias("net_margin"),
    )


def stock_levels(stock: DataFrame) -> DataFrame:
    """Minimum and reorder level from the maximum, and the risk of running out."""
    top = F.col("maximum_stock")
    return stock.select(
        "*",
        F.floor(top * F.lit(0.1)).cast("long").alias("minimum_stock"),
        F.floor(top * F.lit(0.2)).cast("long").alias("reorder_level"),
        half_up(F.lit(1.0) - F.col("current_stock") / (top + 1), 4).alias("stockout_risk"),
    )


def compensation(staff: DataFrame, rates: Mapping[str, float] = BONUS_RATES) -> DataFrame:
    return staff.select("*", half_up(F.col("salary") * lookup("designation", rates, 0.0), 2).alias("bonus"))


def funnel_rates(campaigns: DataFrame) -> DataFrame:
    return campaigns.withColumn(
        "conversion_rate", half_up(zero_if_none(safe_div("conversions", "clicks")), 4)
    )


def warehouse_efficiency(inventory: DataFrame, operations: DataFrame) -> DataFrame:
    """Mean stock-out risk of the warehouse beside the efficiency of each of its days."""
    risk = inventory.groupBy("warehouse_id").agg(F.avg("stockout_risk").alias("mean_stockout_risk"))
    efficiency = (
        F.lit(1.0) - F.col("downtime_minutes") / F.lit(1000.0) - F.col("incident_count") / F.lit(10.0)
    )
    return operations.join(risk, "warehouse_id", "left").select(
        "operating_date",
        "warehouse_id",
        F.coalesce("mean_stockout_risk", F.lit(0.5)).alias("mean_stockout_risk"),
        half_up(efficiency, 4).alias("efficiency_score"),
    )


def composite_risk(risks: DataFrame) -> DataFrame:
    overall = None
    for name, weight in RISK_WEIGHTS.items():
        term = F.col(name) * F.lit(weight)
        overall = term if overall is None else overall + term
    return risks.select(
        "*",
        half_up(overall, 4).alias("overall_risk"),
        ladder([(overall > 0.7, "High"), (overall > 0.4, "Medium")], "Low").alias("risk_category"),
    )


def executive_months(orders: DataFrame, margin: Column) -> DataFrame:
    """Revenue, profit, orders, customers and margins per month on real orders.

    Orders are rolled up per (month, customer) first, so customers are counted,
    not de-duplicated per month.
    """
    per_customer = orders.groupBy("order_month", "customer_id").agg(
        F.sum("order_amount").alias("amount"), F.count(F.lit(1)).alias("n")
    )
    months = per_customer.groupBy("order_month").agg(
        half_up(F.sum("amount"), 4).alias("revenue"),
        F.sum("n").alias("orders"),
        F.count(F.lit(1)).alias("customers"),
    )
    return months.select(
        F.col("order_month").alias("month"),
        half_up("revenue", 2).alias("revenue"),
        half_up(F.col("revenue") * margin, 2).alias("profit"),
        "orders",
        "customers",
        half_up(F.col("revenue") / F.col("orders"), 2).alias("average_order_value"),
        half_up(margin + F.lit(0.05), 4).alias("operating_margin"),
        half_up(margin, 4).alias("net_margin"),
    )


def order_propensity(customers: DataFrame, weights: Mapping[str, float] = SEGMENT_WEIGHTS) -> DataFrame:
    """Share of the total propensity per customer."""
    health = bounded(F.col("customer_health_score") / F.lit(100.0), 0.25, 1.0)
    revenue = bounded(F.log1p("annual_revenue") / F.lit(25.0), 0.35, 1.35)
    weighed = customers.select(
        "customer_id", (lookup("segment", weights, 0.0) * health * revenue).alias("propensity")
    )
    total = weighed.agg(F.sum("propensity")).scalar()
    return weighed.select("customer_id", "propensity", (F.col("propensity") / total).alias("share"))
