"""Joins of facts and dimensions, dense grids, lookups and membership.

No broadcast hint is given: the planner compares the size of the side with its
threshold, and adaptive execution splits a skewed partition of the fact side.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_dimension(fact: DataFrame, dimension: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join with only the wanted columns of the dimension."""
    return fact.join(dimension.select(key, *columns), key, "left")


def with_suffix(left: DataFrame, right: DataFrame, key: str, suffix: str) -> DataFrame:
    """Left join in which a column both sides carry gets the suffix on the right."""
    taken = set(left.columns)
    renamed = right.select(
        key, *[F.col(c).alias(f"{c}{suffix}" if c in taken else c) for c in right.columns if c != key]
    )
    return left.join(renamed, key, "left")


CUSTOMER_SIDE = [
    "customer_id", "annual_revenue", "engagement_score", "customer_health_score", "churn_risk_score", "churn_flag",
    "segment", "region",
]
PRODUCT_SIDE = ["product_id", "unit_cost", "list_price", "margin_rate", "demand_score", "category"]
KPI_SIDE = [
    "customer_id", "total_orders", "total_revenue", "recent_order_count", "recent_revenue", "recent_avg_discount",
    "recent_avg_shipping_days", "days_since_last_order", "order_velocity", "revenue_90d_target",
]


def analysis_frame(orders: DataFrame, customers: DataFrame, products: DataFrame, kpis: DataFrame) -> DataFrame:
    """Orders beside their customer, product and KPI columns.

    Customers and their KPIs meet first, at customer grain, so the orders cross
    one join per key and adaptive execution is free to split a heavy customer.
    """
    people = with_suffix(customers.select(*CUSTOMER_SIDE), kpis.select(*KPI_SIDE), "customer_id", "_kpi")
    joined = with_suffix(orders, people, "customer_id", "_customer")
    return with_suffix(joined, products.select(*PRODUCT_SIDE), "product_id", "_product")


def distinct_list(df: DataFrame, column: str) -> Column:
    """The distinct values of a column as one sorted array, a scalar subquery.

    For periods and other columns whose distinct values are few by nature.
    """
    return df.select(column).distinct().agg(F.array_sort(F.collect_list(column))).scalar()


def dense_grid(keys: DataFrame, periods: Column, period: str) -> DataFrame:
    """Every key with every period, by exploding the period list: no join at all."""
    return keys.select("*", F.explode(periods).alias(period))


def complete_grid(grid: DataFrame, facts: DataFrame, on: list[str], fill: Mapping[str, object]) -> DataFrame:
    """Facts on the grid, defaults where there are none."""
    joined = grid.join(facts, on, "left")
    return joined.select(
        *[F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in joined.columns]
    )


def dense_facts(keys: DataFrame, facts: DataFrame, key: str, periods: Column, period: str, fill: Mapping[str, object]) -> DataFrame:
    """``complete_grid`` of ``dense_grid``, where the facts have one row a key and period.

    The facts of a key travel as one row and meet it before its periods are written out: the grid itself is never
    shuffled nor sorted for a join, and lies by key for what follows.
    """
    values = [c for c in facts.columns if c not in (key, period)]
    of_key = facts.where(F.col(period).isNotNull()).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct(period, F.struct(*values)))).alias("__facts")
    )
    grid = keys.join(of_key, key, "left").select("*", F.explode(periods).alias(period))
    placed = grid.withColumn("__fact", F.try_element_at("__facts", F.col(period)))
    named = [F.col("__fact")[c] for c in values]
    return placed.select(
        key, period, *[c for c in keys.columns if c != key],
        *[(F.coalesce(v, F.lit(fill[c])) if c in fill else v).alias(c) for c, v in zip(values, named)],
    )


def lookup(c: Column | str, mapping: Mapping[object, object], default: object = None) -> Column:
    """A small literal mapping applied per row."""
    pairs = [F.lit(v) for item in mapping.items() for v in item]
    found = F.try_element_at(F.create_map(*pairs), F.col(c) if isinstance(c, str) else c)
    return found if default is None else F.coalesce(found, F.lit(default))


def members(df: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    return df.join(others.select(F.col(other_key).alias(key)), key, "left_semi")


def non_members(df: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    return df.join(others.select(F.col(other_key).alias(key)), key, "left_anti")
