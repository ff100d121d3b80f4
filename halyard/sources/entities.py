"""Business entities as views over the star tables.

Each function returns a lazy frame with the business column names, so every
operator can run on real rows. ``catalog/views.py`` holds the same bindings as
SQL text for the result checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions import half_up, month_text, whole_days
from halyard.operators.rollups import customer_kpis as roll_customer_kpis
from halyard.operators.rollups import monthly_finance
from halyard.sources.tables import StarTables


def _spread(key: Column, factor: int, steps: int, scale: float) -> Column:
    """A repeatable value in [0, steps/scale) from a key."""
    return (key * F.lit(factor) % F.lit(steps)) / F.lit(scale)


def _days_after(base: str, days: Column) -> Column:
    return F.timestamp_add("DAY", days.cast("int"), F.expr(f"timestamp_ntz'{base}'"))


def customers(t: StarTables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("c_custkey")
    return t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("industry"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("country"),
        _days_after("1990-01-01 00:00:00", key % 1800).alias("signup_date"),
        (F.lit(10) + key % 490).cast("long").alias("employee_count"),
        F.col("c_acctbal").alias("annual_revenue"),
        _spread(key, 37, 1001, 10.0).alias("engagement_score"),
        _spread(key, 53, 1001, 10.0).alias("customer_health_score"),
        _spread(key, 71, 1001, 10.0).alias("churn_risk_score"),
        F.when(_spread(key, 71, 1001, 10.0) > 60, 1).otherwise(0).alias("churn_flag"),
    )


def products(t: StarTables) -> DataFrame:
    listed = F.col("p_retailprice") + F.col("p_size") * F.lit(10.0)
    return t.part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"),
        (F.col("p_partkey") % 110).alias("supplier_id"),
        F.col("p_retailprice").alias("unit_cost"),
        listed.alias("list_price"),
        (F.lit(1.0) - F.col("p_retailprice") / listed).alias("margin_rate"),
        (F.col("p_size") * F.lit(2.0)).alias("demand_score"),
        F.when(F.col("p_size") < 10, "Launch").when(F.col("p_size") < 40, "Mature").otherwise("Decline").alias(
            "lifecycle_stage"
        ),
        (F.col("p_size") % 2).cast("int").alias("is_active"),
    )


def suppliers(t: StarTables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    return t.supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        key.alias("supplier_id"),
        F.col("s_name").alias("supplier_name"),
        F.concat(F.lit("Type"), (key % 3).cast("string")).alias("supplier_type"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("country"),
        (F.lit(7) + key % 39).cast("long").alias("lead_time_days"),
        _spread(key, 29, 1001, 10.0).alias("reliability_score"),
        F.col("s_acctbal").alias("contract_value"),
    )


def employees(t: StarTables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    return t.supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        key.alias("employee_id"),
        F.col("s_name").alias("employee_name"),
        F.concat(F.lit("D"), (key % 6).cast("string")).alias("department"),
        F.concat(F.lit("L"), (key % 5).cast("string")).alias("level"),
        F.col("r_name").alias("region"),
        _days_after("2015-01-01 00:00:00", key % 3000).alias("hire_date"),
        F.col("s_acctbal").alias("salary"),
        _spread(key, 41, 101, 1.0).alias("performance_score"),
        F.when(key > 0, F.floor(key / F.lit(10.0)).cast("long")).alias("manager_id"),
        (key % 2).cast("int").alias("is_active"),
    )


def campaigns(t: StarTables) -> DataFrame:
    """Event users as campaigns: their views, clicks and purchases form the funnel."""

    def hits(kind: str) -> Column:
        return F.sum(F.when(F.col("event_type") == kind, 1).otherwise(0)).cast("long")

    key = F.col("user_id")
    funnel = t.events.groupBy("user_id").agg(
        F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("start_date"),
        F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("end_date"),
        hits("signup").alias("leads_generated"),
        hits("view").alias("impressions"),
        hits("click").alias("clicks"),
        hits("purchase").alias("conversions"),
        half_up(F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)), 4).alias(
            "attributed_revenue"
        ),
    )
    return funnel.select(
        key.alias("campaign_id"),
        F.concat(F.lit("Campaign "), key.cast("string")).alias("campaign_name"),
        F.concat(F.lit("CH"), (key % 4).cast("string")).alias("channel"),
        F.concat(F.lit("SEG"), (key % 5).cast("string")).alias("target_segment"),
        "start_date",
        "end_date",
        (F.lit(1000) + key % 50 * 100).cast("long").alias("budget"),
        "leads_generated",
        "impressions",
        "clicks",
        "conversions",
        F.coalesce(F.try_divide(F.col("conversions").cast("double"), F.col("clicks").cast("double")), F.lit(0.0)).alias(
            "conversion_rate"
        ),
        "attributed_revenue",
    )


def _status(flag: Column, returned: Column) -> Column:
    return (
        F.when(flag == "F", "Completed")
        .when(flag == "O", "Shipped")
        .when(returned == "R", "Returned")
        .otherwise("Cancelled")
    )


def order_lines(t: StarTables, product: bool = True) -> DataFrame:
    """Line grain. ``product=False`` leaves out the product join, category and margin."""
    amount = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    heads = t.orders.withColumn("o_month", month_text("o_orderdate"))  # once per order, not per line
    rows = t.lineitem.join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
    extra = []
    if product:
        rows = rows.join(t.part.select("p_partkey", "p_type", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
        extra = [
            F.col("p_type").alias("category"),
            (amount - F.col("l_quantity") * F.col("p_retailprice")).alias("gross_margin"),
        ]
    return rows.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias(
            "order_id"
        ),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_suppkey").alias("warehouse_key"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        (F.col("o_custkey") % 150).alias("campaign_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderpriority").alias("sales_channel"),
        _status(F.col("o_orderstatus"), F.col("l_returnflag")).alias("order_status"),
        F.col("l_quantity").cast("long").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_discount").alias("discount_rate"),
        amount.alias("order_amount"),
        whole_days("l_shipdate", "o_orderdate").alias("shipping_days"),
        *extra,
        F.col("o_month").alias("order_month"),
    )


LINE_ORDER = ["order_date", "order_key", "line_number", "product_id", "warehouse_key"]


def order_heads(t: StarTables) -> DataFrame:
    """Order grain: one row per order."""
    key = F.col("o_orderkey")
    return t.orders.select(
        key.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderpriority").alias("sales_channel"),
        F.when(F.col("o_orderstatus") == "F", "Completed")
        .when(F.col("o_orderstatus") == "O", "Shipped")
        .otherwise("Cancelled")
        .alias("order_status"),
        F.col("o_totalprice").alias("order_amount"),
        _spread(key, 7, 11, 100.0).alias("discount_rate"),
        (key * 13 % 30).alias("shipping_days"),
        (F.col("o_totalprice") * _spread(key, 3, 40, 100.0)).alias("gross_margin"),
    )


HEAD_ORDER = ["order_date", "order_id"]


def inventory(t: StarTables) -> DataFrame:
    """Monthly stock movements per warehouse and product. Rows are grouped by date
    and number; the text and the timestamp are made once per group."""
    return (
        t.lineitem.groupBy(
            F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month_start"),
            (F.col("l_suppkey") % 8).alias("warehouse_no"),
            F.col("l_partkey").alias("product_id"),
        )
        .agg(
            F.sum("l_quantity").cast("long").alias("on_hand_units"),
            F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
            .cast("long")
            .alias("reserved_units"),
            half_up(F.sum("l_extendedprice"), 4).alias("inventory_value"),
        )
        .select(
            F.col("month_start").cast("timestamp_ntz").alias("snapshot_date"),
            F.concat(F.lit("W"), F.col("warehouse_no").cast("string")).alias("warehouse_id"),
            "product_id",
            "on_hand_units",
            "reserved_units",
            (F.col("on_hand_units") * F.lit(0.2)).alias("reorder_point"),
            (F.col("reserved_units") / F.col("on_hand_units")).alias("stockout_risk"),
            "inventory_value",
        )
    )


def finance(t: StarTables) -> DataFrame:
    """Monthly finance with a cost ratio that varies by month of year."""
    return monthly_finance(order_lines(t), opex_ratio=F.lit(0.18) + F.col("month_no") % 9 * F.lit(0.02))


def operations(t: StarTables) -> DataFrame:
    errors = F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).cast("long")
    signups = F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).cast("long")
    daily = t.events.groupBy(
        F.col("ts").cast("date").alias("day"), (F.col("user_id") % 8).alias("warehouse_no")
    ).agg(
        F.count(F.lit(1)).alias("throughput_units"),
        errors.alias("incident_count"),
        signups.alias("late_count"),
        half_up(F.sum("value"), 4).alias("labor_minutes"),
    )
    return daily.select(
        F.col("day").cast("timestamp_ntz").alias("operating_date"),
        F.concat(F.lit("W"), F.col("warehouse_no").cast("string")).alias("warehouse_id"),
        "throughput_units",
        (F.lit(1.0) - F.col("incident_count") / F.col("throughput_units")).alias("on_time_delivery_rate"),
        (F.lit(1.0) - F.col("late_count") / F.col("throughput_units")).alias("fulfillment_rate"),
        "incident_count",
        (F.col("labor_minutes") / F.lit(60.0)).alias("labor_hours"),
        (F.col("incident_count") * 13).alias("downtime_minutes"),
    )


def customer_kpis(t: StarTables) -> DataFrame:
    return roll_customer_kpis(customers(t), order_heads(t))
