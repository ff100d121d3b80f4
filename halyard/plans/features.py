"""Feature tables: joins first, windows once, encodings and scalings as projections."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions import safe_div
from halyard.operators import metrics as M
from halyard.operators.describe import numeric_columns
from halyard.operators.encoding import encode, one_hot, ordinal, scale, with_date_features
from halyard.operators.joins import with_dimension, with_suffix
from halyard.operators.rollups import with_customer_orders
from halyard.operators.series import row_position, series_features
from halyard.operators.trailing import HOT_ROWS, extended_customer_orders, trailing_features
from halyard.sources.scratch import written
from halyard.sources.sinks import manifest, schema_rows, write_table

# fixed values: order status levels and the scaled columns of each table
STATUS_LEVELS = ["Cancelled", "Returned", "Shipped", "Completed"]
CUSTOMER_SCALED = ["annual_revenue", "total_revenue", "average_order_value", "customer_activity_score"]
SALES_SCALED = ["order_amount", "discount_rate", "unit_price", "annual_revenue", "margin_rate"]
FINANCE_SCALED = ["revenue", "gross_margin", "ebitda", "cash_balance", "debt_balance"]
MARKETING_SCALED = ["budget", "leads_generated", "conversion_rate", "attributed_revenue", "cost_per_lead"]
INVENTORY_SCALED = ["on_hand_units", "reserved_units", "reorder_point", "inventory_value", "stockout_risk"]
EMPLOYEE_SCALED = ["salary", "performance_score", "tenure_days"]
KPI_SCALED = ["total_orders", "total_revenue", "recent_revenue", "days_since_last_order", "customer_value_proxy"]

SELECTION_TARGET = "churn_flag"

Categories = Mapping[str, list[str]]


def _hot(df: DataFrame, columns: list[str], given: Categories | None) -> DataFrame:
    return one_hot(df, {c: given[c] for c in columns} if given else columns)


def _stored(df: DataFrame) -> DataFrame:
    """Written once before the fits that each read some of its columns."""
    return written(df, "features")


def _with_rows(fact: DataFrame, dimension: DataFrame, key: str, columns: list[str], more: str) -> DataFrame:
    """Left join that keeps one row a fact: the columns of its key's row, and all rows of a key with several in ``more``."""
    rows = F.collect_list(F.struct(*columns))
    of_key = dimension.groupBy(key).agg(rows.alias(more))
    flat = of_key.select(key, *[F.get(more, F.lit(0))[c].alias(c) for c in columns], F.when(F.size(more) > 1, F.col(more)).alias(more))
    return fact.join(flat, key, "left").select(*fact.columns, *columns, more)


def _all_rows(df: DataFrame, columns: list[str], more: str) -> DataFrame:
    """What a plain left join gives instead of ``_with_rows``."""
    kept = [c for c in df.columns if c not in (*columns, more)]
    out = df.select(*kept, F.explode(F.coalesce(F.col(more), F.array(F.struct(*columns)))).alias(more))
    return out.select(*kept, *[F.col(more)[c].alias(c) for c in columns])


def basic_customer_features(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers with their order roll-up, value score and churn target."""
    return with_customer_orders(customers, orders).select(
        "*", M.customer_value_score().alias("customer_value_score"), M.churn_target().alias("churn_target")
    )


def customer_features(
    customers: DataFrame,
    orders: DataFrame,
    kpis: DataFrame,
    order: list[str],
    categories: Categories | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per customer. Orders are rolled up before any join."""
    rolled = extended_customer_orders(orders, order, hot_rows)
    joined = with_suffix(customers.join(rolled, "customer_id", "left"), kpis, "customer_id", "_kpi")
    dated = with_date_features(with_date_features(joined, "signup_date", "signup"), "last_order_date", "last_order")
    scored = _stored(
        dated.select(
            "*",
            M.lifetime_ratio().alias("customer_lifetime_revenue_ratio"),
            M.activity_score().alias("customer_activity_score"),
        )
    )
    groups = ["segment", "industry", "region"]
    hot = _hot(encode(scored, frequency=groups), groups, categories)
    return scale(scale(hot, CUSTOMER_SCALED, "standard", fit_on=scored), CUSTOMER_SCALED, "robust", fit_on=scored)


def sales_features(
    orders: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    order: list[str],
    categories: Categories | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per order line.

    The lines meet their product while they are narrow, a line staying one row, and are written once: the windows and
    the fits read that table. The windows place the lines by customer, whose join then needs no shuffle of them.
    """
    columns, more = ["order_amount", "discount_rate"], "__goods"
    people, goods = ["segment", "industry", "region", "annual_revenue"], ["subcategory", "unit_cost", "list_price", "margin_rate"]
    lines = _stored(_with_rows(orders, products, "product_id", goods, more))
    trailed = trailing_features(lines, "customer_id", order, columns, (1, 2), (3, 7), hot_rows=hot_rows)
    whole = _all_rows(with_dimension(trailed, customers, "customer_id", people), goods, more)
    joined = whole.select("product_id", *[c for c in whole.columns if c != "product_id"])
    # the fits read only what they need of the written lines
    with_people = with_dimension(lines.select(*orders.columns), customers, "customer_id", ["segment"])
    coded = encode(
        with_date_features(joined, "order_date", "order"),
        frequency=["sales_channel", "order_status", "category", "segment"],
        target=["sales_channel", "category", "segment"],
        target_column="order_amount",
        fit_on=with_people,
    )
    ranked = ordinal(coded, {"order_status": STATUS_LEVELS})
    hot = _hot(ranked, ["sales_channel", "category", "segment"], categories)
    out = scale(hot, SALES_SCALED[:3], "minmax", fit_on=lines)
    buyers = with_dimension(lines.select("customer_id").distinct(), customers, "customer_id", ["annual_revenue"])
    out = scale(out, ["annual_revenue"], "minmax", fit_on=buyers)
    return scale(out, ["margin_rate"], "minmax", fit_on=_all_rows(lines.select(*goods, more), goods, more))


def finance_features(finance: DataFrame) -> DataFrame:
    """One row per month; lags run over the month order."""
    columns = ["revenue", "gross_margin", "ebitda", "cash_balance"]
    indexed = row_position(finance, "order_month")
    trailed = series_features(indexed, "order_month", columns, (1, 2), (2, 3))
    return scale(trailed, FINANCE_SCALED, "robust", fit_on=finance)


def marketing_features(campaigns: DataFrame, categories: Categories | None = None) -> DataFrame:
    measured = _stored(M.campaign_metrics(with_date_features(campaigns, "start_date", "campaign_start")))
    groups = ["channel", "target_segment"]
    coded = encode(measured, frequency=groups, target=groups, target_column="attributed_revenue")
    return scale(_hot(coded, groups, categories), MARKETING_SCALED, "standard", fit_on=measured)


def inventory_features(
    inventory: DataFrame, products: DataFrame, categories: Categories | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per snapshot, warehouse and product."""
    facts = ["category", "subcategory", "unit_cost", "list_price", "margin_rate"]
    columns = ["on_hand_units", "reserved_units", "stockout_risk"]
    trailed = trailing_features(
        inventory, "product_id", ["snapshot_date", "warehouse_id"], columns, (1, 2, 3), (3, 6), hot_rows=hot_rows
    )
    joined = with_dimension(trailed, products, "product_id", facts)
    used = joined.select("*", M.inventory_utilization().alias("inventory_utilization"))
    groups = ["warehouse_id", "category", "subcategory"]
    coded = encode(
        with_date_features(used, "snapshot_date", "snapshot"),
        frequency=groups,
        fit_on=with_dimension(inventory, products, "product_id", ["category", "subcategory"]),
    )
    return scale(_hot(coded, groups, categories), INVENTORY_SCALED, "minmax", fit_on=inventory)


def employee_features(employees: DataFrame, as_of: Column, categories: Categories | None = None) -> DataFrame:
    measured = M.employee_metrics(with_date_features(employees, "hire_date", "hire"), as_of)
    groups = ["department", "level", "region"]
    hot = _hot(encode(measured, frequency=groups), groups, categories)
    return scale(hot, EMPLOYEE_SCALED, "robust", fit_on=measured)


def kpi_features(kpis: DataFrame) -> DataFrame:
    dated = with_date_features(with_date_features(kpis, "signup_date", "signup"), "recent_last_order", "recent_order")
    measured = _stored(
        dated.select(
            "*",
            safe_div("recent_revenue", "annual_revenue").alias("recent_revenue_ratio"),
            M.value_proxy().alias("customer_value_proxy"),
        )
    )
    return scale(encode(measured, frequency=["segment", "industry", "region"]), KPI_SCALED, "standard", fit_on=measured)


def feature_package(tables: Mapping[str, DataFrame], as_of: Column, order: list[str]) -> dict[str, DataFrame]:
    """All seven feature tables of a table set; ``order`` is a total order of a customer's orders."""
    return {
        "customer_features": customer_features(tables["customers"], tables["orders"], tables["customer_kpis"], order),
        "sales_features": sales_features(tables["orders"], tables["customers"], tables["products"], order),
        "finance_features": finance_features(tables["finance_monthly"]),
        "marketing_features": marketing_features(tables["marketing_campaigns"]),
        "inventory_features": inventory_features(tables["inventory_snapshots"], tables["products"]),
        "employee_features": employee_features(tables["employees"], as_of),
        "kpi_features": kpi_features(tables["customer_kpis"]),
    }


def write_package(
    package: Mapping[str, DataFrame], folder: str, trees: tuple[int, int] = (150, 250), step: int = 1
) -> DataFrame:
    """Write the tables, their schema rows, the selection report of the customer table and the manifest.

    The manifest counts the written files. ``trees`` and ``step`` are the cost of the selection.
    """
    from halyard.plans.selecting import selection_report

    spark = next(iter(package.values())).sparkSession
    saved = {name: spark.read.parquet(write_table(df, folder, name)) for name, df in package.items()}
    write_table(schema_rows(package), folder, "feature_schema")
    customers = saved["customer_features"]
    numeric = [c for c in numeric_columns(customers) if c not in ("customer_id", SELECTION_TARGET)]
    report = selection_report(customers, numeric, SELECTION_TARGET, "customer_features", trees=trees, step=step)
    saved["feature_selection_report"] = spark.read.parquet(write_table(report, folder, "feature_selection_report"))
    summary = manifest(saved)
    write_table(summary, folder, "feature_manifest")
    return summary
