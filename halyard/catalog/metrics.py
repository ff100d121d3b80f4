"""Named metrics (survey M1-M13) and deterministic derivations (G1-G10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.catalog.aggregations import CUSTOMER_ORDERS
from halyard.catalog.registry import query
from halyard.catalog.views import days, hu, sql
from halyard.functions import cyclical, half_up
from halyard.operators import derivations as G
from halyard.operators import metrics as M
from halyard.operators import rollups as R
from halyard.operators import series as Y
from halyard.sources import entities as E

CUSTOMER_TABLE = """
 select c.customer_id, segment, region, engagement_score, coalesce(total_orders, 0) as total_orders,
   coalesce(total_revenue, 0e0) as total_revenue, coalesce(recency_days, 999) as recency_days,
   coalesce(completion_rate, 0e0) as completion_rate, coalesce(cancellation_rate, 0e0) as cancellation_rate
 from customers c left join rolled using (customer_id)"""


def customer_table(t):
    return R.with_customer_orders(E.customers(t), E.order_lines(t, product=False))


@query(
    "m1_customer_value_score",
    sql(
        f"""select customer_id, {hu('0.35e0*engagement_score + 0.35e0*ln(1e0 + total_revenue) + 20e0*completion_rate - 10e0*cancellation_rate', 2)}
          as customer_value_score from customer_table""",
        rolled=CUSTOMER_ORDERS,
        customer_table=CUSTOMER_TABLE,
    ),
)
def _(t):
    return customer_table(t).select("customer_id", M.customer_value_score().alias("customer_value_score"))


@query(
    "m2_churn_target",
    sql(
        "select customer_id, (recency_days > 180 or cancellation_rate > 0.12e0)::int as churn_target from customer_table",
        rolled=CUSTOMER_ORDERS,
        customer_table=CUSTOMER_TABLE,
    ),
)
def _(t):
    return customer_table(t).select("customer_id", M.churn_target().alias("churn_target"))


@query(
    "e22_basic_customer_features",
    sql(
        f"""select customer_id, segment, total_orders, total_revenue, recency_days, completion_rate, cancellation_rate,
          {hu('0.35e0*engagement_score + 0.35e0*ln(1e0 + total_revenue) + 20e0*completion_rate - 10e0*cancellation_rate', 2)} as customer_value_score,
          (recency_days > 180 or cancellation_rate > 0.12e0)::int as churn_target from customer_table""",
        rolled=CUSTOMER_ORDERS,
        customer_table=CUSTOMER_TABLE,
    ),
)
def _(t):
    from halyard.plans.features import basic_customer_features

    return basic_customer_features(E.order_lines(t, product=False), E.customers(t)).select(
        "customer_id segment total_orders total_revenue recency_days completion_rate cancellation_rate "
        "customer_value_score churn_target".split()
    )


@query(
    "m3_activity_score",
    sql("select customer_id, 0.4e0*engagement_score + 0.35e0*customer_health_score + 0.25e0*(100e0 - churn_risk_score) as customer_activity_score from customers"),
)
def _(t):
    return E.customers(t).select("customer_id", M.activity_score().alias("customer_activity_score"))


@query("m4_lifetime_ratio", sql("select customer_id, total_revenue/nullif(annual_revenue, 0) as ratio from customer_kpis"))
def _(t):
    return E.customer_kpis(t).select("customer_id", M.lifetime_ratio().alias("ratio"))


def _proxy_sql(a, b, c):
    return sql(f"select customer_id, {a}*coalesce(recent_revenue, 0e0) + {b}*coalesce(revenue_90d_target, 0e0) + {c}*coalesce(order_velocity, 0e0)*100000e0 as proxy from customer_kpis")


@query("m5_kpi_value_proxy", _proxy_sql("0.4e0", "0.35e0", "0.25e0"))
def _(t):
    return E.customer_kpis(t).select("customer_id", M.value_proxy().alias("proxy"))


@query("m6_exploration_value_proxy", _proxy_sql("0.45e0", "0.35e0", "0.2e0"))
def _(t):
    return E.customer_kpis(t).select("customer_id", M.value_proxy(M.EXPLORATION_PROXY).alias("proxy"))


@query(
    "m7_campaign_metrics",
    sql(
        f"""select campaign_id, coalesce({days('end_date', 'start_date')}, 0) as campaign_duration_days,
          budget/nullif(leads_generated, 0)::double as cost_per_lead, attributed_revenue/nullif(budget, 0) as revenue_per_budget from campaigns"""
    ),
)
def _(t):
    return M.campaign_metrics(E.campaigns(t)).select("campaign_id", "campaign_duration_days", "cost_per_lead", "revenue_per_budget")


@query(
    "m8_inventory_utilization",
    sql("select strftime(snapshot_date, '%Y-%m') as month, warehouse_id, product_id, reserved_units/nullif(on_hand_units, 0)::double as utilization from inventory"),
)
def _(t):
    return E.inventory(t).select(
        F.date_format("snapshot_date", "yyyy-MM").alias("month"), "warehouse_id", "product_id", M.inventory_utilization().alias("utilization")
    )


AS_OF = "2026-01-01"


def as_of():
    return F.expr(f"timestamp_ntz'{AS_OF} 00:00:00'")


@query(
    "m9_employee_metrics",
    sql(f"select employee_id, coalesce({days(f'''timestamp '{AS_OF}' ''', 'hire_date')}, 0) as tenure_days, salary/nullif(performance_score, 0) as salary_performance_ratio from employees"),
)
def _(t):
    return M.employee_metrics(E.employees(t), as_of()).select("employee_id", "tenure_days", "salary_performance_ratio")


@query(
    "m10_finance_ratios",
    sql(
        """select order_month, gross_margin/nullif(revenue, 0) as margin_rate, cash_balance/nullif(debt_balance, 0) as liquidity_ratio,
          (revenue - lag(revenue) over (order by order_month))/nullif(lag(revenue) over (order by order_month), 0) as revenue_growth_rate from finance"""
    ),
)
def _(t):
    return Y.finance_ratios(E.finance(t), "order_month").select("order_month", "margin_rate", "liquidity_ratio", "revenue_growth_rate")


@query(
    "m11_cyclical_time",
    sql(
        f"""select event_id, {hu('sin(2*pi()*month(ts)/12e0)', 6)} as month_sin, {hu('cos(2*pi()*month(ts)/12e0)', 6)} as month_cos,
          {hu('sin(2*pi()*quarter(ts)/4e0)', 6)} as quarter_sin, {hu('cos(2*pi()*quarter(ts)/4e0)', 6)} as quarter_cos from events"""
    ),
)
def _(t):
    month, quarter = cyclical(F.month("ts"), 12), cyclical(F.quarter("ts"), 4)
    names = ["month_sin", "month_cos", "quarter_sin", "quarter_cos"]
    return t.events.select("event_id", *[half_up(e, 6).alias(n) for e, n in zip([*month, *quarter], names)])


@query(
    "m12_order_velocity",
    sql(f"select customer_id, {hu('total_orders/greatest(days_since_last_order, 1)::double', 4)} as velocity from customer_kpis"),
)
def _(t):
    return E.customer_kpis(t).select("customer_id", M.order_velocity().alias("velocity"))


@query(
    "m13_margin_breakdown",
    sql(
        """select order_id, quantity*unit_price as gross_amount, quantity*unit_price*(1e0 - discount_rate) as net_amount,
          quantity*unit_price*(1e0 - discount_rate)*(1e0 - 0.3e0) as cost_amount,
          quantity*unit_price*(1e0 - discount_rate) - quantity*unit_price*(1e0 - discount_rate)*(1e0 - 0.3e0) as margin_amount from order_lines"""
    ),
)
def _(t):
    out = M.margin_breakdown(E.order_lines(t, product=False), F.lit(0.3))
    return out.select("order_id", "gross_amount", "net_amount", "cost_amount", "margin_amount")


# ---------------------------------------------------------------- derivations


@query(
    "g1_calendar",
    sql(
        """select strftime(d, '%Y-%m-%d') as date, year(d)::int as year, quarter(d)::int as quarter, month(d)::int as month, week(d)::int as week,
          (isodow(d) - 1)::int as weekday, isodow(d) >= 6 as weekend, quarter(d)::int as financial_quarter
        from (select unnest(generate_series((select min(order_date) from order_heads), (select max(order_date) from order_heads), interval 1 day)) as d)"""
    ),
)
def _(t):
    spine = G.date_spine(E.order_heads(t).agg(F.min("order_date").alias("a"), F.max("order_date").alias("b")), "a", "b")
    return G.calendar(spine).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "g2_cost_breakdown",
    sql(
        f"""select order_id, customer_id, {hu('v', 2)} as revenue, {hu('e', 2)} as expense, {hu('v - e', 2)} as profit, {hu('v*0.1e0', 2)} as tax,
          {hu('e*0.3e0', 2)} as shipping_cost, {hu('e*0.2e0', 2)} as marketing_cost, {hu('e*0.5e0', 2)} as operating_cost,
          {hu('coalesce((v - (e*0.3e0 + e*0.5e0))/nullif(v, 0), 0)', 4)} as gross_margin, {hu('coalesce((v - e)/nullif(v, 0), 0)', 4)} as net_margin
        from (select order_id, customer_id, order_amount as v, order_amount*(1e0 - (0.2e0 + discount_rate)) as e from order_heads)"""
    ),
)
def _(t):
    heads = E.order_heads(t)
    payments = heads.select("order_id", F.col("order_amount").alias("payment_value"), "discount_rate")
    return G.cost_breakdown(payments, heads.select("order_id", "customer_id", "order_date"), F.lit(0.2) + F.col("discount_rate"))


@query(
    "g3_stock_levels",
    sql(
        f"""select product_id, current_stock, maximum_stock, floor(maximum_stock*0.1e0)::bigint as minimum_stock,
          floor(maximum_stock*0.2e0)::bigint as reorder_level, {hu('1e0 - current_stock/(maximum_stock + 1)::double', 4)} as stockout_risk
        from (select product_id, sum(on_hand_units - reserved_units)::bigint as current_stock, sum(on_hand_units)::bigint as maximum_stock from inventory group by 1)"""
    ),
)
def _(t):
    stock = E.inventory(t).groupBy("product_id").agg(
        F.sum(F.col("on_hand_units") - F.col("reserved_units")).alias("current_stock"), F.sum("on_hand_units").alias("maximum_stock")
    )
    return G.stock_levels(stock)


DESIGNATIONS = list(G.BONUS_RATES)


@query(
    "g4_compensation",
    sql(
        "select employee_id, salary, "
        + hu("salary*case level " + " ".join(f"when 'L{i}' then {G.BONUS_RATES[d]}e0" for i, d in enumerate(DESIGNATIONS)) + " end", 2)
        + " as bonus from employees"
    ),
)
def _(t):
    titles = F.array(*[F.lit(d) for d in DESIGNATIONS])
    staff = E.employees(t).withColumn("designation", F.element_at(titles, F.substring("level", 2, 1).cast("int") + 1))
    return G.compensation(staff).select("employee_id", "salary", "bonus")


@query(
    "g5_marketing_funnel",
    sql(f"select campaign_id, impressions, clicks, conversions, {hu('coalesce(conversions/nullif(clicks, 0)::double, 0)', 4)} as conversion_rate from campaigns"),
)
def _(t):
    return G.funnel_rates(E.campaigns(t)).select("campaign_id", "impressions", "clicks", "conversions", "conversion_rate")


@query(
    "g6_warehouse_efficiency",
    sql(
        f"""select strftime(operating_date, '%Y-%m-%d') as operating_date, warehouse_id, {hu('coalesce(r, 0.5e0)', 8)} as mean_stockout_risk,
          {hu('1e0 - downtime_minutes/1000e0 - incident_count/10e0', 4)} as efficiency_score
        from operations left join (select warehouse_id, avg(stockout_risk) as r from inventory group by 1) using (warehouse_id)"""
    ),
)
def _(t):
    out = G.warehouse_efficiency(E.inventory(t), E.operations(t))
    return out.withColumns(
        {"mean_stockout_risk": half_up("mean_stockout_risk", 8), "operating_date": F.date_format("operating_date", "yyyy-MM-dd")}
    )


RISK_MIX = "churn_risk_score/100e0*0.5e0 + (1e0 - customer_health_score/101e0)*0.3e0 + engagement_score/100e0*0.2e0"


@query(
    "g7_composite_risk",
    sql(
        f"""select customer_id, {hu(RISK_MIX, 4)} as overall_risk,
          case when {RISK_MIX} > 0.7e0 then 'High' when {RISK_MIX} > 0.4e0 then 'Medium' else 'Low' end as risk_category from customers"""
    ),
)
def _(t):
    risks = E.customers(t).select(
        "customer_id",
        (F.col("churn_risk_score") / 100.0).alias("customer_risk"),
        (F.lit(1.0) - F.col("customer_health_score") / 101.0).alias("financial_risk"),
        (F.col("engagement_score") / 100.0).alias("operational_risk"),
    )
    return G.composite_risk(risks).select("customer_id", "overall_risk", "risk_category")


@query(
    "g8_executive_months",
    sql(
        f"""select order_month as month, {hu('revenue', 2)} as revenue, {hu('revenue*(0.15e0 + (m % 4)*0.05e0)', 2)} as profit, orders, customers,
          {hu('revenue/orders', 2)} as average_order_value, {hu('0.15e0 + (m % 4)*0.05e0 + 0.05e0', 4)} as operating_margin,
          {hu('0.15e0 + (m % 4)*0.05e0', 4)} as net_margin
        from (select order_month, cast(substr(order_month, 6, 2) as integer) as m, {hu('sum(order_amount)', 4)} as revenue, count(*) as orders,
          count(distinct customer_id) as customers from order_lines group by 1, 2)"""
    ),
)
def _(t):
    margin = F.lit(0.15) + F.substring("order_month", 6, 2).cast("int") % 4 * F.lit(0.05)
    return G.executive_months(E.order_lines(t, product=False), margin)


SEGMENT_WEIGHTS = {"BUILDING": 2.2, "MACHINERY": 1.2, "HOUSEHOLD": 0.7}


@query(
    "g9_order_propensity",
    sql(
        f"""select customer_id, {hu('p', 8)} as propensity, {hu('p/(select sum(p) from weighed)', 8)} as share from weighed""",
        weighed="""select customer_id, case segment when 'BUILDING' then 2.2e0 when 'MACHINERY' then 1.2e0 when 'HOUSEHOLD' then 0.7e0 else 0e0 end
          * least(greatest(customer_health_score/100e0, 0.25e0), 1e0)
          * least(greatest(ln(1e0 + greatest(annual_revenue, 0e0))/25e0, 0.35e0), 1.35e0) as p from customers""",
    ),
)
def _(t):
    customers = E.customers(t).withColumn("annual_revenue", F.greatest("annual_revenue", F.lit(0.0)))
    return G.order_propensity(customers, SEGMENT_WEIGHTS).withColumns({c: half_up(c, 8) for c in ("propensity", "share")})


@query(
    "g10_month_spine",
    sql(
        """select strftime(d, '%Y-%m-%d') as date from (select unnest(generate_series(date_trunc('month', (select min(l_shipdate) from lineitem)),
          (select max(l_shipdate) from lineitem), interval 1 month)) as d)"""
    ),
)
def _(t):
    bounds = t.lineitem.agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    return G.date_spine(bounds, "a", "b", "month").select(F.date_format("date", "yyyy-MM-dd").alias("date"))
