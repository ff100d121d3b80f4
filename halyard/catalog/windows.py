"""Windows (survey W1-W13) and the frames built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.catalog.registry import query
from halyard.catalog.views import hu, sql
from halyard.functions import half_up
from halyard.operators import rollups as R
from halyard.operators import selection as P
from halyard.operators import series as Y
from halyard.operators.trailing import trailing_features
from halyard.plans import demand as D
from halyard.sources import entities as E

HEAD_COLUMNS = ["order_amount", "discount_rate", "shipping_days"]


def lag_sql(columns, lags, over):
    return [f"lag({c}, {k}) over ({over}) as {c}_lag_{k}" for c in columns for k in lags]


def mean_sql(columns, windows, over, digits=4, name="{c}_roll_mean_{k}"):
    return [
        f"{hu(f'avg({c}) over ({over} rows between {k} preceding and 1 preceding)', digits)} as {name.format(c=c, k=k)}"
        for c in columns
        for k in windows
    ]


def std_sql(columns, windows, over, digits=4, name="{c}_roll_std_{k}"):
    return [
        f"{hu(f'stddev_samp({c}) over ({over} rows between {k} preceding and 1 preceding)', digits)} as {name.format(c=c, k=k)}"
        for c in columns
        for k in windows
    ]


def rounded(df, digits=4, part="_roll_"):
    return df.withColumns({c: half_up(c, digits) for c in df.columns if part in c})


BY_CUSTOMER = "partition by customer_id order by order_date, order_id"


def head_features(t, lags=(), windows=(), **kw):
    heads = E.order_heads(t).select("order_id", "customer_id", "order_date", *HEAD_COLUMNS)
    return trailing_features(heads, "customer_id", E.HEAD_ORDER, HEAD_COLUMNS, lags, windows, **kw)


@query("w1_grouped_lags", sql(f"select order_id, {', '.join(lag_sql(HEAD_COLUMNS, (1, 2, 3), BY_CUSTOMER))} from order_heads"))
def _(t):
    return head_features(t, lags=(1, 2, 3)).drop("customer_id", "order_date", *HEAD_COLUMNS)


@query("w2_grouped_trailing_mean", sql(f"select order_id, {', '.join(mean_sql(HEAD_COLUMNS, (3, 5), BY_CUSTOMER))} from order_heads"))
def _(t):
    return rounded(head_features(t, windows=(3, 5), spread=False)).drop("customer_id", "order_date", *HEAD_COLUMNS)


W3 = sql(f"select order_id, {', '.join(std_sql(HEAD_COLUMNS, (3, 5), BY_CUSTOMER))} from order_heads")


@query("w3_grouped_trailing_std", W3)
def _(t):
    out = rounded(head_features(t, windows=(3, 5)))
    return out.select("order_id", *[c for c in out.columns if "_roll_std_" in c])


@query("w3_hot_key_slices", W3)
def _(t):
    """The same result when every customer above five orders is cut into slices."""
    out = rounded(head_features(t, windows=(3, 5), hot_rows=5))
    return out.select("order_id", *[c for c in out.columns if "_roll_std_" in c])


@query(
    "w3_hot_null_key",
    sql(
        f"select order_id, {', '.join(lag_sql(HEAD_COLUMNS, (1,), BY_CUSTOMER) + std_sql(HEAD_COLUMNS, (3,), BY_CUSTOMER))} from some_heads",
        some_heads="select * replace (case when order_id % 3 > 0 then customer_id end as customer_id) from order_heads",
    ),
)
def _(t):
    """A third of the orders has no customer; the null key is cut into slices like any hot key."""
    heads = E.order_heads(t).withColumn("customer_id", F.when(F.col("order_id") % 3 > 0, F.col("customer_id")))
    out = rounded(trailing_features(heads, "customer_id", E.HEAD_ORDER, HEAD_COLUMNS, (1,), (3,), hot_rows=200))
    return out.select("order_id", *[c for c in out.columns if "_roll_std_" in c or "_lag_" in c])


SERIES_COLUMNS = Y.FINANCE_COLUMNS
BY_MONTH = "order by order_month"


@query("w4_series_lags", sql(f"select order_month, {', '.join(lag_sql(SERIES_COLUMNS, (1, 2, 3, 6), BY_MONTH))} from finance"))
def _(t):
    return Y.series_features(E.finance(t), "order_month", SERIES_COLUMNS, windows=()).select(
        "order_month", *[f"{c}_lag_{k}" for c in SERIES_COLUMNS for k in (1, 2, 3, 6)]
    )


@query(
    "w5_series_trailing",
    sql(
        f"""select order_month, {', '.join(mean_sql(SERIES_COLUMNS, (3, 6), BY_MONTH, 3))},
        {', '.join(std_sql(SERIES_COLUMNS, (3, 6), BY_MONTH, 3))} from finance"""
    ),
)
def _(t):
    out = rounded(Y.series_features(E.finance(t), "order_month", SERIES_COLUMNS, lags=()), 3)
    return out.select("order_month", *[c for c in out.columns if "_roll_" in c])


@query("w6_lead_target", sql("select * from (select order_month, lead(revenue) over (order by order_month) as target_revenue from finance) where target_revenue is not null"))
def _(t):
    led = Y.lead_target(E.finance(t), "order_month", "revenue", "target_revenue")
    return led.dropna(subset=["target_revenue"]).select("order_month", "target_revenue")


PANEL = """
 select product_id, category, subcategory, order_month, coalesce(quantity_sold, 0) as quantity_sold,
   coalesce(revenue_generated, 0e0) as revenue_generated, coalesce(order_count, 0) as order_count
 from (select * from (select product_id, category, subcategory from products) cross join (select distinct order_month from order_lines))
 left join (select product_id, order_month, cast(sum(quantity) as bigint) as quantity_sold,
     (floor(sum(order_amount)*1e4+0.5e0)/1e4) as revenue_generated, count(*) as order_count from order_lines group by 1, 2)
   using (product_id, order_month)"""
BY_PRODUCT = "partition by product_id order by order_month"


@query("w7_grouped_lead", sql(f"select product_id, order_month, quantity_sold, lead(quantity_sold) over ({BY_PRODUCT}) as target_demand from panel", panel=PANEL))
def _(t):
    panel = D.product_months(E.order_lines(t, product=False), E.products(t))
    return D.demand_windows(panel).select("product_id", "order_month", "quantity_sold", "target_demand")


DEMAND_LAGS = [f"lag(quantity_sold, {k}) over ({BY_PRODUCT}) as demand_lag_{k}" for k in (1, 2, 3)]
DEMAND_ROLLS = mean_sql(["quantity_sold"], (3, 6), BY_PRODUCT, 4, "demand_roll_mean_{k}") + std_sql(
    ["quantity_sold"], (3, 6), BY_PRODUCT, 4, "demand_roll_std_{k}"
)


@query(
    "w8_demand_lags_and_rolls",
    sql(f"select product_id, order_month, {', '.join(DEMAND_LAGS + DEMAND_ROLLS)} from panel", panel=PANEL),
)
def _(t):
    out = rounded(D.demand_windows(D.product_months(E.order_lines(t, product=False), E.products(t))))
    return out.select("product_id", "order_month", *[c for c in out.columns if c.startswith("demand_")])


@query(
    "w9_period_growth",
    sql("select order_month, (revenue - lag(revenue) over (order by order_month))/nullif(lag(revenue) over (order by order_month), 0) as growth from finance"),
)
def _(t):
    return Y.growth(E.finance(t), "order_month", "revenue", "growth").select("order_month", "growth")


@query(
    "w10_running_sum",
    sql(f"select order_month, {hu('sum(ebitda) over (order by order_month rows unbounded preceding)', 2)} as cumulative_ebitda from finance"),
)
def _(t):
    out = Y.running_sum(E.finance(t), "order_month", "ebitda", "cumulative_ebitda")
    return out.select("order_month", half_up("cumulative_ebitda", 2).alias("cumulative_ebitda"))


@query("w11_row_position", sql("select order_month, row_number() over (order by order_month) - 1 as month_index from finance"))
def _(t):
    return Y.row_position(E.finance(t), "order_month").select("order_month", "month_index")


@query(
    "w12_rank_of_list",
    sql("select subcategory, cast(row_number() over (order by n desc, subcategory) as integer) as rank from (select subcategory, count(*) as n from products group by 1)"),
)
def _(t):
    counts = E.products(t).groupBy(F.col("subcategory").alias("name")).agg(R.rows().alias("n"))
    return P.positions(counts, [F.desc("n"), F.asc("name")]).select(F.col("name").alias("subcategory"), F.col("place").alias("rank"))


@query(
    "w13_group_total_beside_row",
    sql(
        """select category, order_month, revenue, revenue/total as share from
          (select category, order_month, sum(quantity)::bigint as revenue from order_lines group by 1, 2)
          join (select category, sum(quantity)::bigint as total from order_lines group by 1) using (category)"""
    ),
)
def _(t):
    from pyspark.sql import Window as W

    monthly = E.order_lines(t).groupBy("category", "order_month").agg(F.sum("quantity").alias("revenue"))
    # one row per month and category: the window never sees order rows
    total = F.sum("revenue").over(W.partitionBy("category"))
    return monthly.select("*", (F.col("revenue") / total).alias("share"))


# ---------------------------------------------------------------- frames for the models


@query(
    "l1_supervised_months",
    sql(
        f"""select order_month, revenue, {hu('sin(2*pi()*m/12e0)', 6)} as month_sin, {hu('cos(2*pi()*m/12e0)', 6)} as month_cos,
          {hu('sin(2*pi()*ceil(m/3e0)/4e0)', 6)} as quarter_sin, {hu('cos(2*pi()*ceil(m/3e0)/4e0)', 6)} as quarter_cos,
          gross_margin/nullif(revenue, 0) as margin_rate, cash_balance/nullif(debt_balance, 0) as liquidity_ratio,
          lag(dscr, 6) over (order by order_month) as dscr_lag_6,
          {hu('avg(order_count) over (order by order_month rows between 6 preceding and 1 preceding)', 4)} as order_count_roll_mean_6,
          lead(revenue) over (order by order_month) as target_revenue
        from (select *, cast(substr(order_month, 6, 2) as integer) as m from finance)"""
    ),
)
def _(t):
    frame = Y.supervised_months(E.finance(t))
    cycles = {c: half_up(c, 6) for c in ("month_sin", "month_cos", "quarter_sin", "quarter_cos")}
    return frame.withColumns({**cycles, "order_count_roll_mean_6": half_up("order_count_roll_mean_6", 4)}).select(
        "order_month", "revenue", *cycles, "margin_rate", "liquidity_ratio", "dscr_lag_6", "order_count_roll_mean_6", "target_revenue"
    )


DEMAND_SET = f"""
 select product_id, order_month, quantity_sold, revenue_generated, order_count, {', '.join(DEMAND_LAGS + DEMAND_ROLLS)},
   lead(quantity_sold) over ({BY_PRODUCT}) as target_demand from panel"""


@query(
    "l15_demand_dataset",
    sql("select * from dataset where target_demand is not null and demand_lag_3 is not null", panel=PANEL, dataset=DEMAND_SET),
)
def _(t):
    data = D.demand_dataset(E.order_lines(t, product=False), E.products(t))
    return rounded(data).select("product_id", "order_month", *D.FEATURES, "target_demand")


NAIVE_DEMAND = "select product_id, order_month, 0.8e0*quantity_sold + 5e0 as predicted_demand from panel"
REQUIREMENTS = f"""
 select *, {hu('reorder_point + avg_predicted_demand', 2)} as optimal_inventory_target from (
  select *, {hu('avg_predicted_demand/30e0*lead_time_days + safety_stock', 2)} as reorder_point from (
   select *, {hu('1.65e0*std_predicted_demand*sqrt(lead_time_days/30e0)', 2)} as safety_stock from (
    select product_id, category, coalesce(lead_time_days, 14) as lead_time_days, coalesce(m, 10e0) as avg_predicted_demand,
      coalesce(s, 2e0) as std_predicted_demand
    from products left join (select supplier_id, lead_time_days from suppliers) using (supplier_id)
    left join (select product_id, {hu('sum(predicted_demand)', 4)}/count(*) as m, coalesce(stddev_samp(predicted_demand), 1e0) as s
      from naive_demand group by 1) using (product_id))))"""


def naive_demand(t):
    panel = D.product_months(E.order_lines(t, product=False), E.products(t))
    return panel.select("product_id", "order_month", (F.lit(0.8) * F.col("quantity_sold") + F.lit(5.0)).alias("predicted_demand"))


@query(
    "l17_inventory_requirements",
    sql(
        "select product_id, category, lead_time_days, safety_stock, reorder_point, optimal_inventory_target from requirements",
        panel=PANEL,
        naive_demand=NAIVE_DEMAND,
        requirements=REQUIREMENTS,
    ),
)
def _(t):
    found = D.inventory_requirements(E.products(t), E.suppliers(t), naive_demand(t))
    return found.select("product_id", "category", "lead_time_days", "safety_stock", "reorder_point", "optimal_inventory_target")
