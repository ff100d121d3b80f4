"""Sources, joins, sorts, set operations, projections and scalar families (survey S, J, T, U, P, F, Z)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from halyard.catalog.aggregations import FORECAST, PRODUCT_SUMMARY, day_text, naive_forecast
from halyard.catalog.registry import query
from halyard.catalog.views import days, hu, money, sql
from halyard.functions import bounded, calendar_parts, half_up, ladder, month_text, quarter_text, safe_div, weighted, whole_days
from halyard.operators import joins as J
from halyard.operators import rollups as R
from halyard.operators import selection as P
from halyard.session import checkpoint_ready
from halyard.sources import entities as E
from halyard.sources import sinks
from halyard.sources import tables as S

# ---------------------------------------------------------------- sources and sinks


@query("s1_table_scan", "select o_orderstatus, count(*) as n, min(o_orderkey) as low, max(o_orderkey) as high from orders group by 1")
def _(t):
    df = S.read_table(t.spark, t.folder, "orders", S.STAR["orders"])
    return df.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")
    )


@query(
    "s2_table_set_scan",
    "select r_name, count(*) as nations from nation join region on n_regionkey = r_regionkey group by 1",
)
def _(t):
    tables = S.read_tables(t.spark, t.folder, ["nation", "region"])
    joined = tables["nation"].join(tables["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("nations"))


@query("s4_date_detection", sql("select order_id, strftime(order_date, '%Y-%m-%d') as order_date, order_status from order_heads"))
def _(t):
    text = E.order_heads(t).select("order_id", F.date_format("order_date", "yyyy-MM-dd").alias("order_date"), "order_status")
    return day_text(S.parse_date_columns(text), "order_date")


@query(
    "s6_month_series_scan",
    sql("select order_month || '-01' as order_month, revenue from finance"),
)
def _(t):
    month = F.col("order_month")
    mixed = F.when(F.substring(month, 6, 2).cast("int") % 2 == 0, month).otherwise(F.concat(month, F.lit("-01")))
    finance = E.finance(t).select(mixed.alias("order_month"), "revenue")
    return day_text(S.read_month_series(finance, "order_month"), "order_month")


@query("s7_scan_with_fallback", "select count(*) as n, (select count(*) from nation where 1 = 0) as missing from nation")
def _(t):
    found = S.read_with_fallback(t.spark, [f"{t.folder}/nowhere", t.folder], "nation", S.STAR["nation"])
    absent = S.read_with_fallback(t.spark, [f"{t.folder}/nowhere"], "nation", S.STAR["nation"])
    return found.agg(F.count(F.lit(1)).alias("n")).select("n", absent.agg(F.count(F.lit(1))).scalar().alias("missing"))


@query("s8_records_to_frame", "select cast(props->>'$.k' as bigint) as k, count(*) as n, sum(event_id)::bigint as ids from events group by 1")
def _(t):
    payload = t.events.select(F.to_json(F.struct("event_id", F.from_json("props", "k bigint").alias("props"))).alias("body"))
    rows = S.records_frame(payload, "body", "event_id bigint, props struct<k: bigint>")
    return rows.groupBy("props.k").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


COLUMN_TYPES = {"nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
                "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                           ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]}


@query(
    "s10_schema_rows",
    " union all ".join(
        f"select '{name}' as dataset, {i} as position, '{c}' as column, '{kind}' as dtype, count({c}) as filled from {name}"
        for name, columns in COLUMN_TYPES.items()
        for i, (c, kind) in enumerate(columns)
    ),
)
def _(t):
    """The schema list beside how many rows fill each column."""
    tables = {"nation": t.nation, "orders": t.orders}
    filled = None
    for name, df in tables.items():
        counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "filled")
        counts = counts.withColumn("dataset", F.lit(name))
        filled = counts if filled is None else filled.unionByName(counts)
    return sinks.schema_rows(tables).join(filled, ["dataset", "column"])


def scratch_folder(t):
    """A folder of this run's own under the checkpoint folder, which all executors share."""
    checkpoint_ready(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


@query("s9_table_sink", sql("select order_month, order_id, order_amount from (select strftime(order_date, '%Y-%m') as order_month, order_id, order_amount from order_heads)"))
def _(t):
    """Written by month, read back."""
    heads = E.order_heads(t).select("order_id", "order_amount", month_text("order_date").alias("order_month"))
    spread = heads.repartition("order_month")  # one file per month, not one per task and month
    path = sinks.write_table(spread, scratch_folder(t), "orders", ["order_month"])
    return t.spark.read.schema("order_id bigint, order_amount double, order_month string").parquet(path)


@query("s12_append_log", "select event_type as name, 2*count(*) as n from events group by 1")
def _(t):
    """The same counts appended twice, then added up."""
    path = f"{scratch_folder(t)}/log"
    counts = t.events.groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    for _ in range(2):
        sinks.append_log(counts, path)
    return sinks.read_log(t.spark, path, "name string, n bigint").groupBy("name").agg(F.sum("n").alias("n"))


@query(
    "s11_manifest",
    sql(
        "select 'customers' as dataset, (select count(*) from customers) as row_count, 13::bigint as column_count"
        " union all select 'inventory', (select count(*) from inventory), 8"
    ),
)
def _(t):
    return sinks.manifest({"customers": E.customers(t), "inventory": E.inventory(t)})


@query(
    "s13_json_records",
    sql("select '{\"customer_id\":' || customer_id || ',\"segment\":\"' || segment || '\",\"churn_flag\":' || churn_flag || '}' as record from customers"),
)
def _(t):
    return sinks.json_records(E.customers(t).select("customer_id", "segment", "churn_flag"))


# ---------------------------------------------------------------- joins


@query(
    "j1_fact_to_dimension",
    sql(f"select category, subcategory, count(*) as n, {money('order_amount')} as revenue from"
        " (select product_id, order_amount from order_lines) left join (select product_id, category, subcategory from products)"
        " using (product_id) group by 1, 2"),
)
def _(t):
    joined = J.with_dimension(E.order_lines(t, product=False), E.products(t), "product_id", ["category", "subcategory"])
    return joined.groupBy("category", "subcategory").agg(R.rows().alias("n"), R.money("order_amount").alias("revenue"))


RECENT_COMPLETED = f"""
 select customer_id, count(*) as total_orders, {money("order_amount")} as total_revenue from order_heads
 where order_status = 'Completed' and order_date >= (select max(order_date) from order_heads) - interval 180 days group by 1"""


@query(
    "j2_dimension_with_defaults",
    sql(
        """select customer_id, coalesce(total_orders, 0) as total_orders, coalesce(total_revenue, 0e0) as total_revenue
        from customers left join recent using (customer_id)""",
        recent=RECENT_COMPLETED,
    ),
)
def _(t):
    heads = E.order_heads(t)
    cutoff = F.timestamp_add("DAY", F.lit(-180), heads.agg(F.max("order_date")).scalar())
    recent = heads.where((F.col("order_status") == "Completed") & (F.col("order_date") >= cutoff))
    rolled = recent.groupBy("customer_id").agg(R.rows().alias("total_orders"), R.money("order_amount").alias("total_revenue"))
    joined = E.customers(t).select("customer_id").join(rolled, "customer_id", "left")
    return R.fill_numbers(joined, {"total_orders": 0, "total_revenue": 0.0})


ANALYSIS = """
 select o.order_id, o.customer_id, o.product_id, o.category, p.category as category_product, c.segment, c.annual_revenue,
   k.total_orders, k.total_revenue, o.order_amount, p.list_price
 from order_lines o left join customers c using (customer_id) left join products p using (product_id)
 left join customer_kpis k using (customer_id)"""


@query("j3_analysis_frame", sql(ANALYSIS))
def _(t):
    frame = J.analysis_frame(E.order_lines(t), E.customers(t), E.products(t), E.customer_kpis(t))
    return frame.select(
        "order_id customer_id product_id category category_product segment annual_revenue "
        "total_orders total_revenue order_amount list_price".split()
    )


@query(
    "j4_join_of_aggregates",
    sql(
        f"""select order_month, revenue, gross_margin, order_count from
          (select order_month, {money("order_amount")} as revenue from order_lines group by 1)
          join (select order_month, {money("gross_margin")} as gross_margin from order_lines group by 1) using (order_month)
          join (select order_month, count(*) as order_count from order_lines group by 1) using (order_month)"""
    ),
)
def _(t):
    return R.monthly_revenue(E.order_lines(t)).drop("average_order_value")


@query(
    "j5_dense_grid",
    sql("select order_month, count(*) as products, sum(product_id)::bigint as ids from products, (select distinct order_month from order_lines) group by 1"),
)
def _(t):
    months = J.distinct_list(E.order_lines(t, product=False), "order_month")
    grid = J.dense_grid(E.products(t).select("product_id"), months, "order_month")
    return grid.groupBy("order_month").agg(R.rows().alias("products"), F.sum("product_id").alias("ids"))


@query(
    "j6_grid_completion",
    sql(
        """select product_id, order_month, coalesce(quantity_sold, 0) as quantity_sold
        from (select * from (select product_id from products) cross join (select distinct order_month from order_lines))
        left join (select product_id, order_month, cast(sum(quantity) as bigint) as quantity_sold from order_lines group by 1, 2)
          using (product_id, order_month)"""
    ),
)
def _(t):
    from halyard.plans.demand import product_months

    return product_months(E.order_lines(t, product=False), E.products(t)).select("product_id", "order_month", "quantity_sold")


@query(
    "j7_members",
    sql(
        """select 'in' as side, count(*) as n, sum(supplier_id)::bigint as ids from products where supplier_id in (select supplier_id from suppliers)
        union all select 'out', count(*), coalesce(sum(supplier_id), 0)::bigint from products where supplier_id not in (select supplier_id from suppliers)"""
    ),
)
def _(t):
    products, suppliers = E.products(t), E.suppliers(t)

    def side(name, df):
        return df.agg(R.rows().alias("n"), F.coalesce(F.sum("supplier_id"), F.lit(0)).alias("ids")).select(F.lit(name).alias("side"), "n", "ids")

    return side("in", J.members(products, "supplier_id", suppliers, "supplier_id")).unionByName(
        side("out", J.non_members(products, "supplier_id", suppliers, "supplier_id"))
    )


PRIORITY = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3}


@query(
    "j8_lookup_by_map",
    sql(
        """select case sales_channel when '1-URGENT' then 5 when '2-HIGH' then 4 when '3-MEDIUM' then 3 else 0 end as weight,
          count(*) as n from order_heads group by 1"""
    ),
)
def _(t):
    return E.order_heads(t).groupBy(J.lookup("sales_channel", PRIORITY, 0).alias("weight")).agg(R.rows().alias("n"))


@query("j9_latest_beside_forecast", sql("select * from forecast", forecast=FORECAST))
def _(t):
    finance = E.finance(t)
    return finance.agg(
        F.max("order_month").alias("forecast_month"),
        F.max_by("revenue", "order_month").alias("actual_current_month_revenue"),
    ).select("*", naive_forecast(t).select("predicted_next_month_revenue").scalar().alias("predicted_next_month_revenue"))


# ---------------------------------------------------------------- sorts and top-k


@query(
    "t1_mixed_sort",
    sql(f"select table_name, missing_count, row_number() over (order by missing_count desc, table_name) as place from"
        " (select segment as table_name, count(*) filter (annual_revenue < 0) as missing_count from customers group by 1)"),
)
def _(t):
    from pyspark.sql import Window as W

    rolled = E.customers(t).groupBy(F.col("segment").alias("table_name")).agg(
        F.count_if(F.col("annual_revenue") < 0).alias("missing_count")
    )
    order = [F.desc("missing_count"), F.asc("table_name")]
    return rolled.withColumn("place", F.row_number().over(W.orderBy(*order))).orderBy(*order)


@query("t2_top_products", sql(f"select * from ({PRODUCT_SUMMARY}) order by total_revenue desc, product_id limit 15"))
def _(t):
    return P.top_k(R.product_summary(E.order_lines(t), E.products(t)), [F.desc("total_revenue"), F.asc("product_id")], 15)


@query("t3_head_rows", sql("select customer_id, segment, industry, region, annual_revenue from customers order by customer_id limit 500"))
def _(t):
    wanted = ["customer_id", "segment", "industry", "region", "annual_revenue", "not_there"]
    return P.top_k(P.existing(E.customers(t), wanted), [F.asc("customer_id")], 500)


LATEST_OPERATIONS = "select strftime(operating_date, '%Y-%m-%d') as operating_date, warehouse_id, throughput_units, incident_count from operations"


@query("t4_tail_rows", sql(f"{LATEST_OPERATIONS} order by operating_date desc, warehouse_id limit 200"))
def _(t):
    rows = E.operations(t).select("operating_date", "warehouse_id", "throughput_units", "incident_count")
    return day_text(P.top_k(rows, [F.desc("operating_date"), F.asc("warehouse_id")], 200), "operating_date")


@query("t5_last_row_scalar", sql("select arg_max(revenue, order_month) as revenue, max(order_month) as order_month from finance"))
def _(t):
    return E.finance(t).agg(F.max_by("revenue", "order_month").alias("revenue"), F.max("order_month").alias("order_month"))


@query(
    "t6_sort_by_magnitude",
    sql("select order_id, gross_margin from order_lines order by abs(gross_margin) desc, order_id limit 20"),
)
def _(t):
    return P.top_k(E.order_lines(t).select("order_id", "gross_margin"), [F.desc(F.abs("gross_margin")), F.asc("order_id")], 20)


NAIVE_ERRORS = """
 select 'last_value' as model_name, avg(abs(target - l1)) as mae from s union all
 select 'mean_3', avg(abs(target - m3)) from s union all select 'mean_6', avg(abs(target - m6)) from s"""
NAIVE_SERIES = """
 select revenue as target, lag(revenue) over w as l1,
  avg(revenue) over (order by order_month rows between 3 preceding and 1 preceding) as m3,
  avg(revenue) over (order by order_month rows between 6 preceding and 1 preceding) as m6 from finance window w as (order by order_month)"""


@query(
    "t7_best_model",
    sql(f"select model_name, {hu('mae', 2)} as mae from ({NAIVE_ERRORS}) order by 2, 1 limit 1", s=NAIVE_SERIES),
)
def _(t):
    from halyard.operators.series import series_features

    series = series_features(E.finance(t), "order_month", ["revenue"], (1,), (3, 6), spread=False)
    rules = {"last_value": "revenue_lag_1", "mean_3": "revenue_roll_mean_3", "mean_6": "revenue_roll_mean_6"}
    errors = series.agg(*[F.avg(F.abs(F.col("revenue") - F.col(c))).alias(n) for n, c in rules.items()])
    table = errors.unpivot([], list(rules), "model_name", "mae").withColumn("mae", half_up("mae", 2))
    return P.best(table, [F.asc("mae"), F.asc("model_name")])


# ---------------------------------------------------------------- set operations


@query(
    "u1_append_rows",
    sql("select 'order' as source, order_id as id, order_amount as amount, null::varchar as kind from order_heads"
        " union all select 'event', event_id, value, event_type from events"),
)
def _(t):
    old = E.order_heads(t).select(F.lit("order").alias("source"), F.col("order_id").alias("id"), F.col("order_amount").alias("amount"))
    new = t.events.select(F.lit("event").alias("source"), F.col("event_id").alias("id"), F.col("value").alias("amount"), F.col("event_type").alias("kind"))
    return P.append(old, new)


@query(
    "u2_add_columns",
    sql("select order_id, order_amount*2e0 as twice, order_amount/3e0 as third, discount_rate > 0.05 as discounted from order_heads"),
)
def _(t):
    return E.order_heads(t).select("order_id", "order_amount", "discount_rate").withColumns(
        {
            "twice": F.col("order_amount") * 2.0,
            "third": F.col("order_amount") / 3.0,
            "discounted": F.col("discount_rate") > 0.05,
        }
    ).drop("order_amount", "discount_rate")


@query("u3_unexpected_values", sql("select distinct supplier_id as value from products except select supplier_id from suppliers"))
def _(t):
    return P.unexpected_values(E.suppliers(t), E.products(t), "supplier_id")


@query(
    "u4_ordered_union",
    sql(
        """select name, cast(row_number() over (order by list_no, place) as integer) as place from (
          select name, list_no, place, row_number() over (partition by name order by list_no, place) as seen from lists)
        where seen = 1""",
        lists="""
          select *, row_number() over (partition by list_no order by v desc, name) as place from (
            select 1 as list_no, category as name, sum(order_amount) as v from order_lines group by 2
            union all select 2, sales_channel, sum(order_amount) from order_lines group by 2
            union all select 3, category, count(*) from order_lines group by 2)""",
    ),
)
def _(t):
    lines = E.order_lines(t)

    def ranking(column, measure):
        return lines.groupBy(F.col(column).alias("name")).agg(measure.alias("v")).orderBy(F.desc("v"), "name")

    lists = [
        P.positions(ranking("category", F.sum("order_amount")), [F.desc("v"), F.asc("name")]),
        P.positions(ranking("sales_channel", F.sum("order_amount")), [F.desc("v"), F.asc("name")]),
        P.positions(ranking("category", R.rows().cast("double")), [F.desc("v"), F.asc("name")]),
    ]
    return P.ordered_union(lists)


@query("u5_distinct_values", sql("select distinct category, order_month from order_lines"))
def _(t):
    return E.order_lines(t).select("category", "order_month").distinct()


# ---------------------------------------------------------------- projections and filters


@query("p1_column_pruning", sql("select customer_id, region from customers"))
def _(t):
    return E.customers(t).select("customer_id", "region")


@query("p2_tolerant_projection", sql("select product_id, category from products"))
def _(t):
    return P.existing(E.products(t), ["product_id", "category", "colour"])


@query("p3_feature_list_projection", sql("select product_id, unit_cost, 0 as promised_days, list_price from products"))
def _(t):
    products = E.products(t)
    return P.aligned(products, ["unit_cost", "promised_days", "list_price"], keep=["product_id"])


@query("p4_select_by_type", sql("select supplier_id, lead_time_days, reliability_score, contract_value from suppliers"))
def _(t):
    return P.numbers_only(E.suppliers(t))


@query("p5_threshold_filter", sql("select order_id, order_amount from order_lines where discount_rate > 0.05 and order_amount > 60000"))
def _(t):
    lines = E.order_lines(t, product=False).where((F.col("discount_rate") > 0.05) & (F.col("order_amount") > 60000))
    return lines.select("order_id", "order_amount")


@query("p6_drop_missing", sql("select customer_id, strftime(recent_last_order, '%Y-%m-%d') as recent_last_order from customer_kpis where recent_last_order is not null"))
def _(t):
    kept = E.customer_kpis(t).dropna(subset=["recent_last_order"])
    return day_text(kept.select("customer_id", "recent_last_order"), "recent_last_order")


@query("p7_impute", sql("select employee_id, coalesce(manager_id, -1) as manager_id, salary from employees"))
def _(t):
    return R.fill_numbers(E.employees(t).select("employee_id", "manager_id", "salary"), {"manager_id": -1, "salary": 0.0})


@query("p8_default_column", sql("select order_month, dscr, 100000e0 as credit_line from finance"))
def _(t):
    finance = E.finance(t).select("order_month", "dscr")
    return finance.select("order_month", P.column_or(finance, "dscr", 2.0).alias("dscr"), P.column_or(finance, "credit_line", 1e5).alias("credit_line"))


# ---------------------------------------------------------------- scalar families


@query(
    "f1_text_functions",
    sql("select product_id, lower(trim('  ' || product_name || ' ')) as name, replace(category, 'A', '_') as code, cast(product_id as varchar) as id_text from products"),
)
def _(t):
    return E.products(t).select(
        "product_id",
        F.lower(F.trim(F.concat(F.lit("  "), "product_name", F.lit(" ")))).alias("name"),
        F.replace("category", F.lit("A"), F.lit("_")).alias("code"),
        F.col("product_id").cast("string").alias("id_text"),
    )


@query(
    "f2_formatted_text",
    sql(
        """select 'CUS-' || lpad(cast(customer_id as varchar), 6, '0') as code,
          printf('%.1f%%', churn_risk_score) as risk_text, format('${:,.2f}', annual_revenue) as revenue_text from customers"""
    ),
)
def _(t):
    return E.customers(t).select(
        F.concat(F.lit("CUS-"), F.lpad(F.col("customer_id").cast("string"), 6, "0")).alias("code"),
        F.format_string("%.1f%%", "churn_risk_score").alias("risk_text"),
        F.concat(F.lit("$"), F.format_number("annual_revenue", 2)).alias("revenue_text"),
    )


@query("f3_contains", sql("select product_id, contains(product_name, 'ring') as is_ring from products"))
def _(t):
    return E.products(t).select("product_id", F.contains("product_name", F.lit("ring")).alias("is_ring"))


@query("f4_date_parsing", sql("select order_id, strftime(order_date, '%Y-%m-%d') as parsed from order_heads"))
def _(t):
    text = F.when(F.col("order_status") == "Completed", F.date_format("order_date", "yyyy/MM/dd")).otherwise(
        F.date_format("order_date", "dd/MM/yyyy")
    )
    return E.order_heads(t).select("order_id", F.date_format(S.lenient_timestamp(text), "yyyy-MM-dd").alias("parsed"))


PARTS_SQL = """
 cast(coalesce(year({d}), 0) as integer) as {p}_year, cast(coalesce(month({d}), 0) as integer) as {p}_month,
 cast(coalesce(quarter({d}), 0) as integer) as {p}_quarter, cast(coalesce(isodow({d}) - 1, 0) as integer) as {p}_dayofweek,
 cast(coalesce(day({d}), 0) as integer) as {p}_day, coalesce(day({d}) = 1, false)::int as {p}_is_month_start,
 coalesce(cast({d} as date) = last_day({d}), false)::int as {p}_is_month_end"""


@query("f5_date_parts", sql(f"select customer_id, {PARTS_SQL.format(d='recent_last_order', p='last')} from customer_kpis"))
def _(t):
    parts = calendar_parts("recent_last_order", "last")
    return E.customer_kpis(t).select("customer_id", *[e.alias(n) for n, e in parts.items()])


@query("f6_month_edges", sql("select strftime(ts, '%Y-%m-%d') as day, (day(ts) = 1)::int as starts, (cast(ts as date) = last_day(ts))::int as ends, count(*) as n from events group by all"))
def _(t):
    parts = calendar_parts("ts", "d")
    return t.events.groupBy(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), parts["d_is_month_start"].alias("starts"), parts["d_is_month_end"].alias("ends")
    ).agg(R.rows().alias("n"))


@query(
    "f7_date_formats",
    sql("select order_id, strftime(order_date, '%Y-%m') as month, strftime(order_date, '%B') as month_name, year(order_date) || '-Q' || quarter(order_date) as quarter from order_heads"),
)
def _(t):
    return E.order_heads(t).select(
        "order_id",
        month_text("order_date").alias("month"),
        F.date_format("order_date", "MMMM").alias("month_name"),
        quarter_text("order_date").alias("quarter"),
    )


@query(
    "f8_date_arithmetic",
    sql(
        f"""select event_id, {days("timestamp '2024-02-01'", "ts")} as age_days,
          strftime(ts - interval 180 days, '%Y-%m-%d') as half_year_before from events"""
    ),
)
def _(t):
    return t.events.select(
        "event_id",
        whole_days(F.expr("timestamp_ntz'2024-02-01 00:00:00'"), "ts").alias("age_days"),
        F.date_format(F.timestamp_add("DAY", F.lit(-180), "ts"), "yyyy-MM-dd").alias("half_year_before"),
    )


@query(
    "f9_math",
    sql(f"select order_id, {hu('ln(1e0 + order_amount)', 6)} as log_amount, sqrt(order_amount) as root, abs(gross_margin) as size, {hu('gross_margin', 2)} as rounded from order_lines"),
)
def _(t):
    return E.order_lines(t).select(
        "order_id",
        half_up(F.log1p("order_amount"), 6).alias("log_amount"),
        F.sqrt("order_amount").alias("root"),
        F.abs("gross_margin").alias("size"),
        half_up("gross_margin", 2).alias("rounded"),
    )


@query(
    "f10_clip",
    sql("select order_id, least(greatest(shipping_days, 0), 365) as days, greatest(gross_margin, 1e0) as margin from order_lines"),
)
def _(t):
    return E.order_lines(t).select(
        "order_id", bounded("shipping_days", 0, 365).alias("days"), F.greatest("gross_margin", F.lit(1.0)).alias("margin")
    )


@query(
    "f11_safe_division",
    sql("select campaign_id, attributed_revenue/nullif(leads_generated - 12, 0) as per_lead, coalesce(clicks/nullif(conversions - 12, 0)::double, 0) as ratio from campaigns"),
)
def _(t):
    return E.campaigns(t).select(
        "campaign_id",
        safe_div("attributed_revenue", F.col("leads_generated") - 12).alias("per_lead"),
        F.coalesce(safe_div("clicks", F.col("conversions") - 12), F.lit(0.0)).alias("ratio"),
    )


@query(
    "f12_threshold_ladder",
    sql("select order_id, case when order_amount > 80000 then 'High' when order_amount > 30000 then 'Medium' else 'Low' end as size from order_lines"),
)
def _(t):
    size = ladder([(F.col("order_amount") > 80000, "High"), (F.col("order_amount") > 30000, "Medium")], "Low")
    return E.order_lines(t, product=False).select("order_id", size.alias("size"))


@query(
    "f13_weighted_score",
    sql("select customer_id, 0.5e0*engagement_score + 0.3e0*customer_health_score + 0.2e0*churn_risk_score as score from customers"),
)
def _(t):
    weights = {"engagement_score": 0.5, "customer_health_score": 0.3, "churn_risk_score": 0.2}
    return E.customers(t).select("customer_id", weighted(weights).alias("score"))


@query(
    "f14_null_handling",
    sql("select employee_id, manager_id is null as is_top, coalesce(manager_id, 0) as manager, nullif(performance_score, 0) as rated,"
        " case when performance_score > 0 then salary/performance_score end as finite_ratio from employees"),
)
def _(t):
    ratio = F.col("salary") / F.when(F.col("performance_score") == 0, F.lit(float("nan"))).otherwise(F.col("performance_score"))
    return E.employees(t).select(
        "employee_id",
        F.col("manager_id").isNull().alias("is_top"),
        F.coalesce("manager_id", F.lit(0)).alias("manager"),
        F.nullif("performance_score", F.lit(0.0)).alias("rated"),
        F.when(~F.isnan(ratio), ratio).alias("finite_ratio"),
    )


@query("f15_json", "select event_id, cast(props->>'$.k' as bigint) as k, '{\"k\":' || (props->>'$.k') || ',\"type\":\"' || event_type || '\"}' as body from events")
def _(t):
    k = F.from_json("props", "k bigint")["k"]
    return t.events.select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("body"))


@query(
    "f16_arrays_and_maps",
    sql(
        """select customer_id, segment in ('BUILDING', 'MACHINERY') as is_heavy, len(list_distinct([industry, country, region])) as places,
          engagement_score + customer_health_score as total from customers"""
    ),
)
def _(t):
    scores = F.map_from_arrays(
        F.array(F.lit("engagement"), F.lit("health")), F.array("engagement_score", "customer_health_score")
    )
    return E.customers(t).select(
        "customer_id",
        F.array_contains(F.array(F.lit("BUILDING"), F.lit("MACHINERY")), F.col("segment")).alias("is_heavy"),
        F.size(F.array_distinct(F.array("industry", "country", "region"))).cast("long").alias("places"),
        (scores["engagement"] + scores["health"]).alias("total"),
    )


@query(
    "z1_conditional_count",
    sql("select sales_channel, count(*) filter (order_status = 'Completed') as completed, count(*) filter (order_status = 'Cancelled') as cancelled from order_heads group by 1"),
)
def _(t):
    return E.order_heads(t).groupBy("sales_channel").agg(
        R.matching(F.col("order_status") == "Completed").alias("completed"),
        R.matching(F.col("order_status") == "Cancelled").alias("cancelled"),
    )


