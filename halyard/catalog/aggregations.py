"""Roll-ups (survey A1-A26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.catalog.registry import query
from halyard.catalog.tables import COLUMNS, SQL_NAMES, entity_tables
from halyard.catalog.views import days, hu, mean_money, money, sql
from halyard.functions import half_up
from halyard.operators import rollups as R
from halyard.operators.metrics import EXPLORATION_PROXY, value_proxy
from halyard.operators.describe import correlation_pairs, describe_all
from halyard.operators.trailing import extended_customer_orders
from halyard.sources import entities as E

CUSTOMER_ORDERS = f"""
 select customer_id, count(*) as total_orders, {money("order_amount")} as total_revenue,
   {mean_money("order_amount")} as average_order_value, {mean_money("discount_rate")} as average_discount_rate,
   avg(shipping_days) as average_shipping_days, max(order_date) as last_order_date,
   count(*) filter (order_status = 'Completed') as completed_orders,
   count(*) filter (order_status = 'Cancelled') as cancelled_orders,
   {days("(select max(order_date) from order_lines)", "max(order_date)")} as recency_days,
   count(*) filter (order_status = 'Completed')/cast(count(*) as double) as completion_rate,
   count(*) filter (order_status = 'Cancelled')/cast(count(*) as double) as cancellation_rate
 from order_lines group by customer_id"""


def day_text(df, *columns):
    """Timestamps as ISO text, the same in every engine."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


@query(
    "a1_customer_order_rollup",
    sql("select * replace (strftime(last_order_date, '%Y-%m-%d') as last_order_date) from rolled", rolled=CUSTOMER_ORDERS),
)
def _(t):
    return day_text(R.customer_orders(E.order_lines(t, product=False)), "last_order_date")


TRAILING_MEANS = """
 select customer_id, order_amount, discount_rate, shipping_days, order_date,
   lag(order_amount, 1) over w as l1,
   avg(order_amount) over (partition by customer_id order by order_date, order_id rows between 3 preceding and 1 preceding) as m3,
   avg(order_amount) over (partition by customer_id order by order_date, order_id rows between 5 preceding and 1 preceding) as m5
 from order_heads window w as (partition by customer_id order by order_date, order_id)"""


@query(
    "a2_customer_order_rollup_extended",
    sql(
        f"""select customer_id, count(*) as total_orders, {money("order_amount")} as total_revenue,
          {mean_money("order_amount")} as average_order_value, {mean_money("discount_rate")} as average_discount_rate,
          avg(shipping_days) as average_shipping_days, max(order_amount) as max_order_value,
          min(order_amount) as min_order_value, {hu("stddev_samp(order_amount)", 3)} as revenue_std,
          strftime(max(order_date), '%Y-%m-%d') as last_order_date, strftime(min(order_date), '%Y-%m-%d') as first_order_date,
          {mean_money("l1")} as order_amount_lag_1,
          {hu("avg(m3)", 3)} as order_amount_roll_mean_3,
          {hu("avg(m5)", 3)} as order_amount_roll_mean_5,
          {money("order_amount")}/count(*) as revenue_per_order,
          {days("max(order_date)", "min(order_date)")} as customer_tenure_days,
          {days("(select max(order_date) from order_heads)", "max(order_date)")} as days_since_last_order
        from looked_back group by customer_id""",
        looked_back=TRAILING_MEANS,
    ),
)
def _(t):
    out = extended_customer_orders(E.order_heads(t), E.HEAD_ORDER)
    rounded = {c: half_up(c, 3) for c in ("revenue_std", "order_amount_roll_mean_3", "order_amount_roll_mean_5")}
    return day_text(out, "last_order_date", "first_order_date").withColumns(rounded)


MONTHLY = sql(
    f"""select order_month, {money("order_amount")} as revenue, count(*) as order_count,
      {money("gross_margin")} as gross_margin, {money("order_amount")}/count(*) as average_order_value
    from order_lines group by order_month"""
)


@query("a3_monthly_revenue", MONTHLY)
def monthly_revenue(t):
    return R.monthly_revenue(E.order_lines(t))


PRODUCT_SUMMARY = f"""
 select product_id, product_name, category, subcategory, total_orders, total_revenue, average_discount_rate, total_margin,
   coalesce(total_margin/nullif(total_revenue, 0), 0e0) as margin_rate_realized
 from (select product_id, count(*) as total_orders, {money("order_amount")} as total_revenue,
     {mean_money("discount_rate")} as average_discount_rate, {money("gross_margin")} as total_margin
   from order_lines group by product_id)
 left join (select product_id, product_name, category, subcategory from products) using (product_id)"""


@query("a4_product_summary", sql(PRODUCT_SUMMARY))
def _(t):
    return R.product_summary(E.order_lines(t), E.products(t))


@query(
    "a5_region_segment_summary",
    sql(
        f"""select region, segment, {money("order_amount")} as revenue, count(*) as orders,
          count(distinct customer_id) as customers, {money("order_amount")}/count(distinct customer_id) as revenue_per_customer
        from order_lines left join (select customer_id, region, segment from customers) using (customer_id)
        group by region, segment"""
    ),
)
def _(t):
    return R.region_segment_summary(E.customers(t), E.order_lines(t, product=False))


@query(
    "a6_seasonal_summary",
    sql(
        f"""select year(order_date) || '-Q' || quarter(order_date) as quarter, strftime(order_date, '%B') as month,
          {money("order_amount")} as revenue, count(*) as orders from order_lines group by 1, 2"""
    ),
)
def _(t):
    return R.seasonal_summary(E.order_lines(t, product=False))


@query(
    "a7_segment_insight",
    sql(
        f"""select segment, count(*) as customers, {money("recent_revenue")} as revenue,
          {mean_money("recent_revenue")} as average_revenue, {mean_money("order_velocity")} as average_order_velocity,
          {mean_money("revenue_90d_target")} as average_revenue_target, avg(churn_flag) as churn_rate,
          avg(days_since_last_order) as average_days_since_last_order
        from customer_kpis group by segment"""
    ),
)
def _(t):
    return R.segment_insight(E.customer_kpis(t))


@query(
    "a8_business_kpis",
    sql(
        f"""select kpi, {hu("value", 3)} as value from (
          select 'avg_monthly_revenue' as kpi, avg(revenue) as value from finance
          union all select 'avg_gross_margin', avg(gross_margin) from finance
          union all select 'avg_ebitda', avg(ebitda) from finance
          union all select 'avg_on_time_delivery_rate', avg(on_time_delivery_rate) from operations
          union all select 'avg_fulfillment_rate', avg(fulfillment_rate) from operations
          union all select 'customer_churn_rate', avg(churn_flag) from customer_kpis
          union all select 'avg_customer_value_proxy', avg(0.45e0*coalesce(recent_revenue, 0e0)
            + 0.35e0*coalesce(revenue_90d_target, 0e0) + 0.2e0*coalesce(order_velocity, 0e0)*100000e0) from customer_kpis)"""
    ),
)
def _(t):
    out = R.business_kpis(E.finance(t), E.operations(t), E.customer_kpis(t), value_proxy(EXPLORATION_PROXY))
    return out.select("kpi", half_up("value", 3).alias("value"))


@query(
    "a9_product_month_demand",
    sql(
        f"""select product_id, order_month, cast(sum(quantity) as bigint) as quantity_sold,
          {money("order_amount")} as revenue_generated, count(*) as order_count
        from order_lines group by product_id, order_month"""
    ),
)
def _(t):
    return R.product_month_demand(E.order_lines(t, product=False))


SEASONALITY = """
 select category, month_of_year, quantity, quantity_avg,
   quantity/case when quantity_avg = 0 then 1e0 else quantity_avg end as seasonal_index
 from (select category, cast(month(order_date) as integer) as month_of_year, cast(sum(quantity) as bigint) as quantity
       from order_lines group by 1, 2)
 join (select category, sum(quantity)/12e0 as quantity_avg from order_lines group by 1) using (category)"""


@query("a10_category_seasonality", sql(SEASONALITY))
def _(t):
    return R.category_seasonality(E.order_lines(t))


@query(
    "a11_prediction_stats",
    sql(
        f"""select product_id, {hu(mean_money("predicted_demand"), 6)} as avg_predicted_demand,
          {hu("coalesce(stddev_samp(predicted_demand), 1e0)", 6)} as std_predicted_demand
        from (select product_id, 0.8e0*quantity_sold + 5e0 as predicted_demand from
          (select product_id, order_month, sum(quantity) as quantity_sold from order_lines group by all))
        group by product_id"""
    ),
)
def _(t):
    demand = R.product_month_demand(E.order_lines(t, product=False))
    predicted = demand.select("product_id", (F.lit(0.8) * F.col("quantity_sold") + F.lit(5.0)).alias("predicted_demand"))
    return R.prediction_stats(predicted).select(
        "product_id",
        half_up("avg_predicted_demand", 6).alias("avg_predicted_demand"),
        half_up("std_predicted_demand", 6).alias("std_predicted_demand"),
    )


@query("a12_finance_monthly", sql("select * from finance"))
def _(t):
    return E.finance(t)


@query(
    "a13_customer_kpis",
    sql(
        """select * replace (strftime(signup_date, '%Y-%m-%d') as signup_date,
          strftime(recent_last_order, '%Y-%m-%d') as recent_last_order) from customer_kpis"""
    ),
)
def _(t):
    return day_text(E.customer_kpis(t), "signup_date", "recent_last_order")


@query(
    "a14_group_target",
    sql("select segment, avg(churn_flag) as target_mean, count(churn_flag) as target_count from customers group by segment"),
)
def _(t):
    return R.group_target(E.customers(t), "segment", "churn_flag")


@query(
    "a15_relative_frequency",
    sql(
        """select recent_last_month, count(*) as n, count(*)/(select count(*) from customer_kpis)::double as share
        from (select strftime(recent_last_order, '%Y-%m') as recent_last_month from customer_kpis) group by 1"""
    ),
)
def _(t):
    kpis = E.customer_kpis(t).select(F.date_format("recent_last_order", "yyyy-MM").alias("recent_last_month"))
    return R.relative_frequency(kpis, "recent_last_month")


DESCRIBE_NUMBERS = ["quantity", "unit_price", "discount_rate", "order_amount", "shipping_days", "gross_margin"]
DESCRIBE_TEXTS = ["sales_channel", "order_status", "category", "order_month"]


def _describe_sql():
    parts = [
        f"""select '{c}' as column_name, count({c}) as count, null::bigint as unique, null::varchar as top, null::bigint as freq,
          {hu(f"avg({c})", 4)} as mean, {hu(f"stddev_samp({c})", 4)} as std, {hu(f"min({c})", 4)} as min,
          {hu(f"quantile_cont({c}::double, 0.25)", 4)} as q25, {hu(f"quantile_cont({c}::double, 0.5)", 4)} as q50,
          {hu(f"quantile_cont({c}::double, 0.75)", 4)} as q75, {hu(f"max({c})", 4)} as max from order_lines"""
        for c in DESCRIBE_NUMBERS
    ] + [
        f"""select '{c}', sum(n)::bigint, count(*), arg_max(v, (n, v)), max(n), null, null, null, null, null, null, null
        from (select {c} as v, count(*) as n from order_lines where {c} is not null group by 1)"""
        for c in DESCRIBE_TEXTS
    ]
    return " union all ".join(parts)


@query("a16_describe_all", sql(_describe_sql()))
def _(t):
    lines = E.order_lines(t).select(*DESCRIBE_NUMBERS, *DESCRIBE_TEXTS)
    out = describe_all(lines)
    return out.withColumns({c: half_up(c, 4) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")})


def _missing_profile_sql(name, column):
    missing = f"count(*) - count({column})"
    return f"""select '{name}' as table_name, '{column}' as column_name, {missing} as missing_count,
      {hu(f"({missing})/cast(greatest(count(*), 1) as double)*100e0", 4)} as missing_pct from {SQL_NAMES.get(name, name)}"""


@query("a17_missing_profile", sql(" union all ".join(_missing_profile_sql(n, c) for n, columns in COLUMNS.items() for c in columns)))
def _(t):
    return R.missing_profile(entity_tables(t))


CORRELATED = ["annual_revenue", "engagement_score", "customer_health_score", "churn_risk_score", "recent_revenue", "order_velocity"]


@query(
    "a18_correlation_pairs",
    sql(
        " union all ".join(
            f"select '{a}' as column_a, '{b}' as column_b, {hu(f'corr({a}, {b})', 8)} as correlation from customer_kpis"
            for i, a in enumerate(CORRELATED)
            for b in CORRELATED[i + 1 :]
        )
    ),
)
def _(t):
    out = correlation_pairs(E.customer_kpis(t), CORRELATED)
    return out.withColumn("correlation", half_up("correlation", 8))


FORECAST = """
 select order_month as forecast_month, 1.02e0*revenue as predicted_next_month_revenue, revenue as actual_current_month_revenue
 from finance order by order_month desc limit 1"""


def naive_forecast(t):
    last = E.finance(t).orderBy(F.desc("order_month")).limit(1)
    return last.select(
        F.col("order_month").alias("forecast_month"),
        (F.lit(1.02) * F.col("revenue")).alias("predicted_next_month_revenue"),
        F.col("revenue").alias("actual_current_month_revenue"),
    )


@query(
    "a19_executive_overview",
    sql(
        f"""select {money("revenue")} as total_revenue, cast(sum(order_count) as bigint) as total_orders,
          {money("gross_margin")}/greatest({money("revenue")}, 1e0) as average_gross_margin_rate,
          (select count(*) from customers) as customers,
          (select predicted_next_month_revenue from forecast) as revenue_forecast_next_month from finance""",
        forecast=FORECAST,
    ),
)
def _(t):
    return R.executive_overview(E.finance(t), E.customers(t), naive_forecast(t))


@query(
    "a20_operations_cards",
    sql(
        f"""select {hu("avg(on_time_delivery_rate)", 8)} as mean_on_time, {hu("avg(fulfillment_rate)", 8)} as mean_fulfillment,
          cast(sum(incident_count) as bigint) as incidents, cast(sum(throughput_units) as bigint) as throughput from operations"""
    ),
)
def _(t):
    return R.operations_cards(E.operations(t)).withColumns(
        {c: half_up(c, 8) for c in ("mean_on_time", "mean_fulfillment")}
    )


@query(
    "a21_customer_cards",
    sql(
        f"""select segment, count(*) as customers, (select {hu("avg(engagement_score)", 6)} from customers) as mean_engagement,
          (select {hu("avg(customer_health_score)", 6)} from customers) as mean_health from customers group by segment"""
    ),
)
def _(t):
    return R.customer_cards(E.customers(t)).withColumns(
        {c: half_up(c, 6) for c in ("mean_engagement", "mean_health")}
    )


@query(
    "a22_sales_cards",
    sql(f"select cast(sum(order_count) as bigint) as total_orders, {mean_money('revenue')} as mean_monthly_revenue from finance"),
)
def _(t):
    return R.sales_cards(E.finance(t))


@query(
    "a23_table_overview",
    sql(
        " union all ".join(
            f"select '{n}' as dataset, count(*) as row_count, {len(c)}::bigint as column_count from {SQL_NAMES.get(n, n)}"
            for n, c in COLUMNS.items()
        )
    ),
)
def _(t):
    return R.table_overview(entity_tables(t))


@query(
    "a24_latest_finance",
    sql("select order_month, cash_balance, debt_balance, dscr from finance order by order_month desc limit 1"),
)
def _(t):
    return R.latest_finance(E.finance(t))


@query(
    "a25_churn_and_trend",
    sql(
        """select cast(sum(churn_flag) as bigint) as churn_customers, count(*) as customers,
          sum(churn_flag)/count(*)::double as churn_share,
          (select (predicted_next_month_revenue - actual_current_month_revenue)/actual_current_month_revenue*100e0
           from forecast) as revenue_trend_pct from customers""",
        forecast=FORECAST,
    ),
)
def _(t):
    predictions = E.customers(t).select("customer_id", F.col("churn_flag").alias("predicted_churn"))
    return R.churn_and_trend(predictions, naive_forecast(t))


@query(
    "a26_order_amount_histogram",
    sql(
        f"""select cast(least(coalesce(floor((order_amount - lo)/nullif((hi - lo)/40e0, 0)), 0), 39) as integer) as bin,
          count(*) as n, {hu("any_value(lo) + any_value(least(coalesce(floor((order_amount - lo)/nullif((hi - lo)/40e0, 0)), 0), 39))*((any_value(hi) - any_value(lo))/40e0)", 4)} as bin_start
        from order_lines, (select min(order_amount) as lo, max(order_amount) as hi from order_lines) group by 1"""
    ),
)
def _(t):
    return R.histogram(E.order_lines(t, product=False), "order_amount", 40)
