"""Demand panel, model comparison, forecasts and stock requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halyard.functions import half_up
from halyard.operators.joins import dense_facts, distinct_list, with_dimension
from halyard.operators.rollups import fill_numbers, prediction_stats, product_month_demand
from halyard.operators.trailing import trailing_expressions

FEATURES = [
    "quantity_sold", "revenue_generated", "order_count", "demand_lag_1", "demand_lag_2", "demand_lag_3",
    "demand_roll_mean_3", "demand_roll_std_3", "demand_roll_mean_6", "demand_roll_std_6",
]

# fixed values: defaults and the service-level factor of the stock rule
LEAD_TIME_DEFAULT = 14
DEMAND_DEFAULTS = {"avg_predicted_demand": 10.0, "std_predicted_demand": 2.0}
SERVICE_FACTOR = 1.65


def product_months(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Every product in every observed month, demand zero where nothing was sold."""
    keys = products.select("product_id", "category", "subcategory")
    zeros = {"quantity_sold": 0, "revenue_generated": 0.0, "order_count": 0}
    return dense_facts(keys, product_month_demand(orders), "product_id", distinct_list(orders, "order_month"), "order_month", zeros)


def demand_windows(panel: DataFrame) -> DataFrame:
    """Lags, trailing statistics and next month's demand; a product has one row per month."""
    base = W.partitionBy("product_id").orderBy("order_month")
    named = trailing_expressions(base, ["quantity_sold"], (1, 2, 3), (3, 6))
    return panel.select(
        "*",
        *[e.alias(n.replace("quantity_sold", "demand")) for n, e in named.items()],
        F.lead("quantity_sold").over(base).alias("target_demand"),
    )


def demand_dataset(orders: DataFrame, products: DataFrame) -> DataFrame:
    """The panel with features and target, rows lacking either left out."""
    return demand_windows(product_months(orders, products)).dropna(subset=["target_demand", "demand_lag_3"])


def inventory_requirements(products: DataFrame, suppliers: DataFrame, predictions: DataFrame) -> DataFrame:
    """Safety stock, reorder point and target level per product."""
    sourced = with_dimension(products, suppliers, "supplier_id", ["lead_time_days"])
    joined = sourced.join(prediction_stats(predictions), "product_id", "left")
    filled = fill_numbers(joined, {"lead_time_days": LEAD_TIME_DEFAULT, **DEMAND_DEFAULTS})
    months = F.col("lead_time_days") / F.lit(30.0)
    safety = half_up(F.lit(SERVICE_FACTOR) * F.col("std_predicted_demand") * F.sqrt(months), 2)
    daily = F.col("avg_predicted_demand") / F.lit(30.0)
    return (
        filled.select("*", safety.alias("safety_stock"))
        .select("*", half_up(daily * F.col("lead_time_days") + F.col("safety_stock"), 2).alias("reorder_point"))
        .select(
            "*", half_up(F.col("reorder_point") + F.col("avg_predicted_demand"), 2).alias("optimal_inventory_target")
        )
    )
