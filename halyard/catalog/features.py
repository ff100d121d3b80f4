"""Encoders, scalers and feature tables (survey E1-E10, E15-E24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.catalog.aggregations import day_text
from halyard.catalog.metrics import AS_OF, as_of
from halyard.catalog.registry import query
from halyard.catalog.relational import PARTS_SQL
from halyard.catalog.views import days, hu, sql
from halyard.catalog.windows import BY_CUSTOMER, lag_sql, mean_sql, std_sql
from halyard.functions import half_up
from halyard.operators import encoding as N
from halyard.operators.describe import correlated_columns
from halyard.plans import features as X
from halyard.sources import entities as E

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
NATIONS = [f"NATION_{i}" for i in range(25)]
CHANNELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
WAREHOUSES = [f"W{i}" for i in range(8)]


# SQL pieces


def frequency_sql(*columns):
    return [f"count(*) over (partition by {c})/cast(count(*) over () as double) as {c}_frequency" for c in columns]


def target_sql(target, *columns):
    mean = f"{hu(f'sum({target}) over ()', 4)}/count({target}) over ()"
    out = []
    for c in columns:
        n, s = f"count({target}) over (partition by {c})", hu(f"sum({target}) over (partition by {c})", 4)
        out.append(hu(f"(({s})/({n})*({n}) + ({mean})*10e0)/(({n}) + 10e0)", 4) + f" as {c}_target_encoded")
    return out


def one_hot_sql(**columns):
    return [
        f"""case when coalesce({c}, 'Unknown') = '{v}' then 1e0 else 0e0 end as "{c}_{v}\""""
        for c, values in columns.items()
        for v in values
    ]


def scale_sql(method, columns, source):
    out = []
    for c in columns:
        x = f"coalesce(cast({c} as double), 0e0)"
        if method == "standard":
            parts = f"avg({x}) over ()", f"stddev_pop({x}) over ()"
        elif method == "minmax":
            parts = f"min({x}) over ()", f"(max({x}) over () - min({x}) over ())"
        else:
            parts = (
                f"(select quantile_cont({x}, 0.5) from {source})",
                f"(select quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) from {source})",
            )
        out.append(hu(f"({x} - {parts[0]})/coalesce(nullif({parts[1]}, 0), 1e0)", 6) + f" as {c}_{method}_scaled")
    return out


def tidy(df, **digits):
    """Rounded derived columns, dates as text."""
    out = df.withColumns(
        {c: half_up(c, 6) for c in df.columns if c.endswith("_scaled")}
        | {c: half_up(c, 4) for c in df.columns if "_roll_" in c or c.endswith("_target_encoded")}
        | {c: half_up(c, n) for c, n in digits.items()}
    )
    return day_text(out, *[c for c, kind in out.dtypes if kind.startswith("timestamp")])


def parts_sql(column, prefix):
    return PARTS_SQL.format(d=column, p=prefix)


# ---------------------------------------------------------------- single operators


@query("e1_date_features", sql(f"select order_id, {parts_sql('order_date', 'order')} from order_heads"))
def _(t):
    return N.with_date_features(E.order_heads(t).select("order_id", "order_date"), "order_date", "order").drop("order_date")


@query("e2_one_hot", sql(f"select customer_id, {', '.join(one_hot_sql(segment=SEGMENTS, region=REGIONS))} from customers"))
def _(t):
    return N.one_hot(E.customers(t).select("customer_id", "segment", "region"), ["segment", "region"], keep_source=False)


@query(
    "e2_one_hot_many_values",
    sql("select customer_id, 1e0 as indicators, (select count(distinct signup_date) from customers) as columns from customers"),
)
def _(t):
    """A column of more than a thousand values, all of them read from the data."""
    days = E.customers(t).select("customer_id", F.date_format("signup_date", "yyyy-MM-dd").alias("day"))
    out = N.one_hot(days, ["day"], keep_source=False)
    made = out.columns[1:]
    total = F.aggregate(F.array(*[F.col(f"`{c}`") for c in made]), F.lit(0.0), lambda s, x: s + x)
    return out.select("customer_id", total.alias("indicators"), F.lit(len(made)).cast("long").alias("columns"))


@query(
    "e2_indicator_rows",
    sql(
        " union all ".join(
            f"select customer_id, '{c}' as column_name, {v} as value from customers"
            for c, v in (("segment", "segment"), ("region", "region"), ("day", "strftime(signup_date, '%Y-%m-%d')"))
        )
    ),
)
def _(t):
    people = E.customers(t).withColumn("day", F.date_format("signup_date", "yyyy-MM-dd"))
    return N.indicator_rows(people, "customer_id", ["segment", "region", "day"])


ONE_HOT_WORDS = """select *, row_number() over (order by column_name, value) - 1 as i from (
  select distinct 'segment' as column_name, segment as value from customers union select distinct 'day', strftime(signup_date, '%Y-%m-%d') from customers)"""


@query(
    "e2_one_hot_sparse",
    sql(
        """select customer_id, (select count(*) from words) as size, least(a.i, b.i) as first_index, greatest(a.i, b.i) as second_index, 2e0 as total from customers
        join words a on a.column_name = 'segment' and a.value = segment join words b on b.column_name = 'day' and b.value = strftime(signup_date, '%Y-%m-%d')""",
        words=ONE_HOT_WORDS,
    ),
)
def _(t):
    """One sparse vector a customer over all values of two columns, none of them on the driver."""
    people = E.customers(t).select("customer_id", "segment", F.date_format("signup_date", "yyyy-MM-dd").alias("day"))
    out = N.one_hot_sparse(people, "customer_id", ["segment", "day"])
    return out.select(
        "customer_id",
        "size",
        F.get("indices", F.lit(0)).alias("first_index"),
        F.get("indices", F.lit(1)).alias("second_index"),
        F.aggregate("values", F.lit(0.0), lambda s, x: s + x).alias("total"),
    )


OUT_OF_FOLD = """case when coalesce(s.n, 0) - coalesce(o.n, 0) > 0
  then (coalesce(s.total, 0) - coalesce(o.total, 0) + m.mean*10e0)/(s.n - coalesce(o.n, 0) + 10e0) else m.mean end"""


@query(
    "e5_out_of_fold_encoding",
    sql(
        f"""select c.customer_id, {hu(OUT_OF_FOLD, 8)} as region_target_encoded
        from folded c left join (select region, sum(n) as n, sum(total) as total from by_fold where region is not null group by region) s on s.region = c.region
          left join by_fold o on o.region = c.region and o.fold = c.fold
          join (select f.fold, sum(b.total)/sum(b.n) as mean from (select distinct fold from folded) f join by_fold b on b.fold <> f.fold group by f.fold) m on m.fold = c.fold""",
        folded="select customer_id, region, churn_flag::double as y, customer_id % 5 as fold from customers",
        by_fold="select region, fold, count(y) as n, sum(y) as total from folded group by region, fold",
    ),
)
def _(t):
    people = E.customers(t).select("customer_id", "region", "churn_flag")
    out = N.out_of_fold(people, "customer_id", ["region"], "churn_flag", fold=F.pmod(F.col("customer_id"), F.lit(5)))
    return out.select("customer_id", half_up("region_target_encoded", 8).alias("region_target_encoded"))


@query(
    "e3_ordinal",
    sql("select order_id, case order_status when 'Cancelled' then 0e0 when 'Shipped' then 1e0 else -1e0 end as order_status_ordinal from order_lines"),
)
def _(t):
    lines = E.order_lines(t, product=False).select("order_id", "order_status")
    return N.ordinal(lines, {"order_status": ["Cancelled", "Shipped"]}, keep_source=False)


@query("e4_frequency", sql(f"select customer_id, {', '.join(frequency_sql('segment', 'industry', 'last_month'))} from k",
                           k="select customer_id, segment, industry, strftime(recent_last_order, '%Y-%m') as last_month from customer_kpis"))
def _(t):
    kpis = E.customer_kpis(t).select("customer_id", "segment", "industry", F.date_format("recent_last_order", "yyyy-MM").alias("last_month"))
    return N.encode(kpis, frequency=["segment", "industry", "last_month"]).drop("segment", "industry", "last_month")


E5 = sql(f"select order_id, {', '.join(target_sql('order_amount', 'sales_channel', 'category'))} from order_lines")


@query("e5_target", E5)
def _(t):
    lines = E.order_lines(t).select("order_id", "sales_channel", "category", "order_amount")
    out = N.encode(lines, target=["sales_channel", "category"], target_column="order_amount")
    return tidy(out).select("order_id", "sales_channel_target_encoded", "category_target_encoded")


@query("e5_target_many_categories", E5)
def _(t):
    """The same result through the distributed join, as when there are too many categories to broadcast."""
    lines = E.order_lines(t).select("order_id", "sales_channel", "category", "order_amount")
    out = N.encode(lines, target=["sales_channel", "category"], target_column="order_amount", limit=3)
    return tidy(out).select("order_id", "sales_channel_target_encoded", "category_target_encoded")


SCALED = ["order_amount", "discount_rate", "shipping_days"]


def _scaled(method):
    def build(t):
        lines = E.order_lines(t, product=False).select("order_id", *SCALED)
        return tidy(N.scale(lines, SCALED, method)).drop(*SCALED)

    text = f"select order_id, {', '.join(scale_sql(method, SCALED, 'order_lines'))} from order_lines"
    return query(f"e{ {'standard': 6, 'minmax': 7, 'robust': 8}[method] }_scale_{method}", sql(text))(build)


for _method in ("standard", "minmax", "robust"):
    _scaled(_method)


@query(
    "e8_exact_quantiles_bracketed",
    sql(
        " union all ".join(
            f"select '{c}' as column_name, {p} as probability, {hu(f'quantile_cont({c}::double, {p})', 6)} as quantile from order_lines"
            for c in SCALED
            for p in ("0.1e0", "0.5e0", "0.99e0")
        )
    ),
)
def _(t):
    """Quantiles by bracketing, from a coarse first pass."""
    from halyard.operators.ordered import exact_quantiles

    probabilities = [0.1, 0.5, 0.99]
    lines = E.order_lines(t, product=False).select(*SCALED)
    found = exact_quantiles(lines, SCALED, probabilities, accuracy=1000)
    rows = [(c, p, q) for c, values in found.items() for p, q in zip(probabilities, values)]
    out = t.spark.createDataFrame(rows, "column_name string, probability double, quantile double")
    return out.withColumn("quantile", half_up("quantile", 6))


SPARSE = "select order_amount as full_column, case when order_id < 50 then discount_rate*1e2 + order_id end as sparse_column from order_heads"


@query(
    "e8_quantiles_full_and_sparse",
    sql(
        " union all ".join(
            f"select '{c}' as column_name, {p} as probability, {hu(f'quantile_cont({c}::double, {p})', 6)} as quantile from sparse"
            for c in ("full_column", "sparse_column")
            for p in ("0.25e0", "0.5e0", "0.75e0")
        ),
        sparse=SPARSE,
    ),
)
def _(t):
    from halyard.operators.ordered import exact_quantiles

    probabilities = [0.25, 0.5, 0.75]
    few = F.when(F.col("order_id") < 50, F.col("discount_rate") * F.lit(1e2) + F.col("order_id"))
    heads = E.order_heads(t).select(F.col("order_amount").alias("full_column"), few.alias("sparse_column"))
    found = exact_quantiles(heads, heads.columns, probabilities, accuracy=100)
    rows = [(c, p, q) for c, values in found.items() for p, q in zip(probabilities, values)]
    out = t.spark.createDataFrame(rows, "column_name string, probability double, quantile double")
    return out.withColumn("quantile", half_up("quantile", 6))


FILTERED = ["unit_cost", "list_price", "margin_rate", "demand_score"]


@query(
    "e9_correlation_filter",
    sql(
        "select b as dropped from ("
        + " union all ".join(
            f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from products"
            for i, a in enumerate(FILTERED)
            for b in FILTERED[i + 1 :]
        )
        + ") where abs(r) > 0.9 group by b"
    ),
)
def _(t):
    dropped = correlated_columns(E.products(t), 0.9, FILTERED)
    return t.spark.createDataFrame([(c,) for c in dropped], "dropped string")


@query(
    "e10_target_kind",
    sql(
        """select 'churn_flag' as column_name, count(*) >= 0 as is_class from customers union all
        select 'segment', count(*) >= 0 from customers union all
        select 'annual_revenue', count(distinct annual_revenue) <= 10 from customers union all
        select 'churn_rate_band', count(distinct round(churn_risk_score/50)) <= 10 from customers"""
    ),
)
def _(t):
    from halyard.plans.selecting import target_kinds

    customers = E.customers(t).withColumn("churn_rate_band", F.rint(F.col("churn_risk_score") / 50.0))
    return target_kinds(customers, ["churn_flag", "segment", "annual_revenue", "churn_rate_band"])


# ---------------------------------------------------------------- feature tables

ROLLED = f"""
 select customer_id, count(*) as total_orders, {hu("sum(order_amount)", 4)} as total_revenue,
  {hu("sum(order_amount)", 4)}/count(*) as average_order_value, {hu("sum(discount_rate)", 4)}/count(*) as average_discount_rate,
  avg(shipping_days) as average_shipping_days, max(order_amount) as max_order_value, min(order_amount) as min_order_value,
  stddev_samp(order_amount) as revenue_std, max(order_date) as last_order_date, min(order_date) as first_order_date,
  {hu("sum(l1)", 4)}/nullif(count(l1), 0) as order_amount_lag_1, avg(m3) as order_amount_roll_mean_3, avg(m5) as order_amount_roll_mean_5,
  {hu("sum(order_amount)", 4)}/count(*) as revenue_per_order, {days("max(order_date)", "min(order_date)")} as customer_tenure_days,
  {days("(select max(order_date) from order_heads)", "max(order_date)")} as days_since_last_order
 from (select *, lag(order_amount, 1) over ({BY_CUSTOMER}) as l1,
   avg(order_amount) over ({BY_CUSTOMER} rows between 3 preceding and 1 preceding) as m3,
   avg(order_amount) over ({BY_CUSTOMER} rows between 5 preceding and 1 preceding) as m5 from order_heads) group by customer_id"""

CUSTOMER_BASE = f"""
 select c.*, r.* exclude (customer_id), k.total_orders as total_orders_kpi, k.total_revenue as total_revenue_kpi,
  k.total_margin, k.recent_order_count, k.recent_revenue, k.recent_avg_discount, k.recent_avg_shipping_days, k.recent_last_order,
  k.days_since_last_order as days_since_last_order_kpi, k.order_velocity, k.revenue_90d_target,
  r.total_revenue/nullif(c.annual_revenue, 0) as customer_lifetime_revenue_ratio,
  0.4e0*c.engagement_score + 0.35e0*c.customer_health_score + 0.25e0*(100e0 - c.churn_risk_score) as customer_activity_score
 from customers c left join rolled r using (customer_id) left join customer_kpis k using (customer_id)"""

CUSTOMER_GROUPS = {"segment": SEGMENTS, "industry": NATIONS, "region": REGIONS}
CARRIED = [
    "customer_name", "segment", "industry", "region", "country", "signup_date", "employee_count", "annual_revenue",
    "engagement_score", "customer_health_score", "churn_risk_score", "churn_flag",
]


def customer_feature_table(t, **kw):
    return X.customer_features(
        E.customers(t), E.order_heads(t), E.customer_kpis(t), E.HEAD_ORDER, categories=CUSTOMER_GROUPS, **kw
    )


@query(
    "e15_customer_features",
    sql(
        f"""select * replace (strftime(signup_date, '%Y-%m-%d') as signup_date, strftime(last_order_date, '%Y-%m-%d') as last_order_date,
          strftime(first_order_date, '%Y-%m-%d') as first_order_date, strftime(recent_last_order, '%Y-%m-%d') as recent_last_order,
          {hu('revenue_std', 3)} as revenue_std, {hu('order_amount_roll_mean_3', 3)} as order_amount_roll_mean_3,
          {hu('order_amount_roll_mean_5', 3)} as order_amount_roll_mean_5),
          {parts_sql('base.signup_date', 'signup')}, {parts_sql('base.last_order_date', 'last_order')},
          {', '.join(frequency_sql('segment', 'industry', 'region') + one_hot_sql(**CUSTOMER_GROUPS)
                     + scale_sql('standard', X.CUSTOMER_SCALED, 'base') + scale_sql('robust', X.CUSTOMER_SCALED, 'base'))}
        from base""",
        rolled=ROLLED,
        base=CUSTOMER_BASE,
    ),
)
def _(t):
    out = customer_feature_table(t).drop(*[f"{c}_kpi" for c in CARRIED])
    return tidy(out, revenue_std=3, order_amount_roll_mean_3=3, order_amount_roll_mean_5=3)


SALES_BASE = """
 select o.* exclude (order_month), p.subcategory, p.unit_cost, p.list_price, p.margin_rate, c.segment, c.industry, c.region, c.annual_revenue
 from order_lines o left join products p using (product_id) left join customers c using (customer_id)"""
# the order of the lines, then all other columns, so that only rows equal in every column are tied
LINE_TIES = [
    "order_id", "campaign_id", "sales_channel", "order_status", "quantity", "unit_price", "discount_rate", "order_amount",
    "shipping_days", "category", "gross_margin", "order_month",
]
BY_LINE = "partition by customer_id order by " + ", ".join(f"{c} nulls first" for c in [*E.LINE_ORDER, *LINE_TIES])
SALES_GROUPS = {"sales_channel": CHANNELS, "category": TYPES, "segment": SEGMENTS}


@query(
    "e16_sales_features",
    sql(
        f"""select * replace (strftime(order_date, '%Y-%m-%d') as order_date), {parts_sql('base.order_date', 'order')}, {', '.join(
          frequency_sql('sales_channel', 'order_status', 'category', 'segment') + target_sql('order_amount', 'sales_channel', 'category', 'segment')
          + ["case order_status when 'Cancelled' then 0e0 when 'Returned' then 1e0 when 'Shipped' then 2e0 when 'Completed' then 3e0 else -1e0 end as order_status_ordinal"]
          + one_hot_sql(**SALES_GROUPS) + lag_sql(['order_amount', 'discount_rate'], (1, 2), BY_LINE)
          + mean_sql(['order_amount', 'discount_rate'], (3, 7), BY_LINE) + std_sql(['order_amount', 'discount_rate'], (3, 7), BY_LINE)
          + scale_sql('minmax', X.SALES_SCALED, 'base'))} from base""",
        base=SALES_BASE,
    ),
)
def _(t):
    return tidy(
        X.sales_features(E.order_lines(t), E.customers(t), E.products(t), E.LINE_ORDER, categories=SALES_GROUPS)
    )


MONTHS = "order by order_month"


@query(
    "e17_finance_features",
    sql(
        f"""select *, row_number() over ({MONTHS}) - 1 as month_index, {', '.join(
          lag_sql(['revenue', 'gross_margin', 'ebitda', 'cash_balance'], (1, 2), MONTHS)
          + mean_sql(['revenue', 'gross_margin', 'ebitda', 'cash_balance'], (2, 3), MONTHS, 2)
          + std_sql(['revenue', 'gross_margin', 'ebitda', 'cash_balance'], (2, 3), MONTHS, 2)
          + scale_sql('robust', X.FINANCE_SCALED, 'finance'))} from finance"""
    ),
)
def _(t):
    out = X.finance_features(E.finance(t))
    return tidy(out, **{c: 2 for c in out.columns if "_roll_" in c})


MARKETING_GROUPS = {"channel": [f"CH{i}" for i in range(4)], "target_segment": [f"SEG{i}" for i in range(5)]}


@query(
    "e18_marketing_features",
    sql(
        f"""select * replace (strftime(start_date, '%Y-%m-%d') as start_date, strftime(end_date, '%Y-%m-%d') as end_date),
          {parts_sql('base.start_date', 'campaign_start')}, {', '.join(
            frequency_sql('channel', 'target_segment') + target_sql('attributed_revenue', 'channel', 'target_segment')
            + one_hot_sql(**MARKETING_GROUPS) + scale_sql('standard', X.MARKETING_SCALED, 'base'))} from base""",
        base=f"""select *, coalesce({days('end_date', 'start_date')}, 0) as campaign_duration_days,
          budget/nullif(leads_generated, 0)::double as cost_per_lead, attributed_revenue/nullif(budget, 0) as revenue_per_budget from campaigns""",
    ),
)
def _(t):
    return tidy(X.marketing_features(E.campaigns(t), MARKETING_GROUPS))


BY_STOCK = "partition by product_id order by snapshot_date, warehouse_id"
STOCK_COLUMNS = ["on_hand_units", "reserved_units", "stockout_risk"]
INVENTORY_GROUPS = {"warehouse_id": WAREHOUSES, "category": TYPES, "subcategory": BRANDS}


@query(
    "e19_inventory_features",
    sql(
        f"""select * replace (strftime(snapshot_date, '%Y-%m-%d') as snapshot_date), {parts_sql('base.snapshot_date', 'snapshot')}, {', '.join(
          ['reserved_units/nullif(on_hand_units, 0)::double as inventory_utilization'] + lag_sql(STOCK_COLUMNS, (1, 2, 3), BY_STOCK)
          + mean_sql(STOCK_COLUMNS, (3, 6), BY_STOCK) + std_sql(STOCK_COLUMNS, (3, 6), BY_STOCK)
          + frequency_sql('warehouse_id', 'category', 'subcategory') + one_hot_sql(**INVENTORY_GROUPS)
          + scale_sql('minmax', X.INVENTORY_SCALED, 'base'))} from base""",
        base="""select i.*, p.category, p.subcategory, p.unit_cost, p.list_price, p.margin_rate
          from inventory i left join products p using (product_id)""",
    ),
)
def _(t):
    return tidy(X.inventory_features(E.inventory(t), E.products(t), INVENTORY_GROUPS))


EMPLOYEE_GROUPS = {"department": [f"D{i}" for i in range(6)], "level": [f"L{i}" for i in range(5)], "region": REGIONS}


@query(
    "e20_employee_features",
    sql(
        f"""select * replace (strftime(hire_date, '%Y-%m-%d') as hire_date), {parts_sql('base.hire_date', 'hire')}, {', '.join(
          frequency_sql('department', 'level', 'region') + one_hot_sql(**EMPLOYEE_GROUPS) + scale_sql('robust', X.EMPLOYEE_SCALED, 'base'))} from base""",
        base=f"""select *, coalesce({days(f'''timestamp '{AS_OF}' ''', 'hire_date')}, 0) as tenure_days,
          salary/nullif(performance_score, 0) as salary_performance_ratio from employees""",
    ),
)
def _(t):
    return tidy(X.employee_features(E.employees(t), as_of(), EMPLOYEE_GROUPS))


@query(
    "e21_kpi_features",
    sql(
        f"""select * replace (strftime(signup_date, '%Y-%m-%d') as signup_date, strftime(recent_last_order, '%Y-%m-%d') as recent_last_order),
          {parts_sql('base.signup_date', 'signup')}, {parts_sql('base.recent_last_order', 'recent_order')}, {', '.join(
            frequency_sql('segment', 'industry', 'region') + scale_sql('standard', X.KPI_SCALED, 'base'))} from base""",
        base="""select *, recent_revenue/nullif(annual_revenue, 0) as recent_revenue_ratio, 0.4e0*coalesce(recent_revenue, 0e0)
          + 0.35e0*coalesce(revenue_90d_target, 0e0) + 0.25e0*coalesce(order_velocity, 0e0)*100000e0 as customer_value_proxy from customer_kpis""",
    ),
)
def _(t):
    return tidy(X.kpi_features(E.customer_kpis(t)))


@query(
    "e24_analysis_correlations",
    sql(
        " union all ".join(
            f"select '{a}' as column_a, '{b}' as column_b, {hu(f'corr({a}, {b})', 7)} as correlation from frame"
            for i, a in enumerate(["order_amount", "annual_revenue", "list_price", "order_velocity"])
            for b in ["order_amount", "annual_revenue", "list_price", "order_velocity"][i + 1 :]
        ),
        frame="""select o.order_amount, c.annual_revenue, p.list_price, k.order_velocity from order_lines o
          left join customers c using (customer_id) left join products p using (product_id) left join customer_kpis k using (customer_id)""",
    ),
)
def _(t):
    from halyard.operators.describe import correlation_pairs
    from halyard.operators.joins import analysis_frame

    frame = analysis_frame(E.order_lines(t), E.customers(t), E.products(t), E.customer_kpis(t))
    out = correlation_pairs(frame, ["order_amount", "annual_revenue", "list_price", "order_velocity"])
    return out.withColumn("correlation", half_up("correlation", 7))


