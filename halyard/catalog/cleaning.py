"""Cleaning (survey C1-C8) and validation (V1-V9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.catalog.aggregations import day_text
from halyard.catalog.registry import query
from halyard.catalog.tables import COLUMNS, SQL_NAMES, cleaned_sql, entity_tables, missing_sql
from halyard.catalog.views import hu, money, sql

from halyard.operators import cleaning as C
from halyard.operators import quality as Q
from halyard.operators import quality_rules as rules
from halyard.operators.rollups import money as money_sum
from halyard.operators.union import stacked
from halyard.sources import entities as E
from halyard.sources.tables import parse_date_columns

MESSY = {"customer_id": " Customer-ID ", "order_amount": "Order Amount", "order_date": "ORDER-DATE", "order_status": "Order Status "}


@query(
    "c1_standard_names",
    sql(f"select customer_id, order_status, {money('order_amount')} as order_amount, strftime(max(order_date), '%Y-%m-%d') as order_date"
        " from order_heads group by 1, 2"),
)
def _(t):
    messy = E.order_heads(t).select(*[F.col(c).alias(m) for c, m in MESSY.items()])
    clean = C.standard_names(messy)
    return day_text(
        clean.groupBy("customer_id", "order_status").agg(
            money_sum("order_amount").alias("order_amount"), F.max("order_date").alias("order_date")
        ),
        "order_date",
    )


# dates as text in three layouts, one of them never valid, chosen by the order status
@query(
    "c2_coerce_dates",
    sql(
        """select order_id, case when order_status <> 'Cancelled' then strftime(order_date, '%Y-%m-%d') end as order_date
        from order_heads"""
    ),
)
def _(t):
    text = (
        F.when(F.col("order_status") == "Completed", F.date_format("order_date", "yyyy-MM-dd"))
        .when(F.col("order_status") == "Shipped", F.date_format("order_date", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.concat(F.lit("on "), F.date_format("order_date", "MMM d")))
    )
    raw = E.order_heads(t).select("order_id", text.alias("order_date"))
    return day_text(parse_date_columns(raw, C.DATE_COLUMNS), "order_date")


@query(
    "c3_fill_text",
    sql("select customer_id, coalesce(trim(case when churn_flag = 0 then '  ' || segment || ' ' end), 'Unknown') as segment,"
        " region from customers"),
)
def _(t):
    raw = E.customers(t).select(
        "customer_id",
        F.when(F.col("churn_flag") == 0, F.concat(F.lit("  "), "segment", F.lit(" "))).alias("segment"),
        "region",
    )
    return C.fill_text(raw)


@query(
    "c4_clip_ranges",
    sql(
        f"""select order_id, shipping_rate, shipping_score, order_amount, gross_margin, lead_days from (
          select order_id, least(greatest(shipping_days/10e0, 0), 1) as shipping_rate,
            least(greatest(shipping_days/1e0, 0), 100) as shipping_score, greatest(order_amount, 0) as order_amount,
            greatest(gross_margin, 0) as gross_margin,
            case when shipping_days is not null then greatest(shipping_days, 0) end as lead_days from order_lines)"""
    ),
)
def _(t):
    raw = E.order_lines(t).select(
        "order_id",
        (F.col("shipping_days") / F.lit(10.0)).alias("shipping_rate"),
        (F.col("shipping_days") / F.lit(1.0)).alias("shipping_score"),
        "order_amount",
        "gross_margin",
        F.col("shipping_days").alias("lead_days"),
    )
    return C.clip_ranges(raw)


EVENT_DAYS = "select user_id, event_type, strftime(ts, '%Y-%m-%d') as day from events"


def event_days(t):
    return t.events.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("c5_drop_duplicates", f"select distinct * from ({EVENT_DAYS})")
def _(t):
    return C.drop_duplicates(event_days(t))


@query(
    "c5_duplicate_count",
    f"select (select count(*) from ({EVENT_DAYS})) - (select count(*) from (select distinct * from ({EVENT_DAYS})))"
    " as duplicate_rows_removed",
)
def _(t):
    return C.duplicate_count(event_days(t))


@query("c6_time_ordered", sql("select order_id, strftime(order_date, '%Y-%m-%d') as order_date, order_amount from order_heads"))
def _(t):
    heads = E.order_heads(t).select("order_id", "order_date", "order_amount")
    return C.time_ordered(heads, "order_date").select(
        "order_id", F.date_format("order_date", "yyyy-MM-dd").alias("order_date"), "order_amount"
    )


RAW_ORDERS = """
 select customer_id as "Customer-ID", strftime(order_date, '%Y-%m') as "Order Month",
   case when order_status <> 'Cancelled' then order_status end as "Order-Status",
   case when discount_rate < 0.05e0 then shipping_days - 10 end as "Lead_Days",
   discount_rate*20e0 as "Discount_Rate" from order_heads"""

CLEAN_ORDERS = f"""
 select distinct "Customer-ID" as customer_id, "Order Month" as order_month, coalesce("Order-Status", 'Unknown') as order_status,
   case when "Lead_Days" is not null then greatest("Lead_Days", 0) end as lead_days,
   least(greatest("Discount_Rate", 0e0), 1e0) as discount_rate from ({RAW_ORDERS})"""


def raw_orders(t):
    return E.order_heads(t).select(
        F.col("customer_id").alias("Customer-ID"),
        F.date_format("order_date", "yyyy-MM").alias("Order Month"),
        F.when(F.col("order_status") != "Cancelled", F.col("order_status")).alias("Order-Status"),
        F.when(F.col("discount_rate") < 0.05, F.col("shipping_days") - 10).alias("Lead_Days"),
        (F.col("discount_rate") * F.lit(20.0)).alias("Discount_Rate"),
    )


@query("c7_clean_table", sql(CLEAN_ORDERS))
def _(t):
    return C.clean_table(raw_orders(t), "order_heads")


SUMMARY_SQL = """
 select '{name}' as table_name, (select count(*) from {raw}) as input_rows, (select count(*) from {clean}) as output_rows,
   (select cast({nulls_before} as bigint) from {raw}) as null_count_before,
   (select cast({nulls_after} as bigint) from {clean}) as null_count_after,
   (select count(*) from {raw}) - (select count(*) from {clean}) as duplicate_rows_removed"""


@query(
    "c7_cleaning_summary",
    sql(
        SUMMARY_SQL.format(
            name="orders",
            raw="raw_orders",
            clean="clean_orders",
            nulls_before="""sum(("Order-Status" is null)::int + ("Lead_Days" is null)::int)""",
            nulls_after="sum((lead_days is null)::int)",
        ),
        raw_orders=RAW_ORDERS,
        clean_orders=CLEAN_ORDERS,
    ),
)
def _(t):
    raw = raw_orders(t)
    return C.cleaning_summary("orders", raw, C.clean_table(raw, "orders"))


def _cleaned_sql(name):
    view = SQL_NAMES.get(name, name)
    clean = f"select distinct {', '.join(cleaned_sql(name, c) for c in COLUMNS[name])} from {view}"
    size = f"select count(*) as n, coalesce(sum({missing_sql(name)}), 0)::bigint as missing from"
    return f"""select '{name}' as table_name, a.n as input_rows, b.n as output_rows, a.missing as null_count_before,
      b.missing as null_count_after, a.n - b.n as duplicate_rows_removed from ({size} {view}) a cross join ({size} ({clean})) b"""


@query("c8_clean_all", sql(" union all ".join(map(_cleaned_sql, COLUMNS))))
def _(t):
    return stacked([C.cleaning_summary(name, raw, C.clean_table(raw, name)) for name, raw in entity_tables(t).items()])


# ---------------------------------------------------------------- validation

# columns the entity views do not carry; their range checks are skipped
CHECK = "select '{table}' as table_name, '{check}' as check_name, cast({failed} as bigint) as failed_records {rest}"


def _required_sql(name):
    return CHECK.format(table=name, check="required_columns", failed=0, rest="")


def _pk_sql(name, key):
    view = SQL_NAMES.get(name, name)
    return CHECK.format(
        table=name, check="primary_key_uniqueness", failed=f"count(*) - count(distinct {key})", rest=f"from {view}"
    )


def _fk_sql(name, key, parent, parent_key):
    return CHECK.format(
        table=name,
        check=f"foreign_key_{key}_to_{parent}",
        failed="count(*)",
        rest=f"from {SQL_NAMES.get(name, name)} f where not exists (select 1 from {SQL_NAMES.get(parent, parent)} p"
        f" where p.{parent_key} = f.{key})",
    )


def _range_sql(name, column, low, high):
    outside = " or ".join(
        [f"{column} < {low}"] * (low is not None) + [f"{column} > {high}"] * (high is not None)
    ) or "false"
    return CHECK.format(
        table=name, check=f"range_{column}", failed=f"count(*) filter ({outside})", rest=f"from {SQL_NAMES.get(name, name)}"
    )


def _rows_sql(name, minimum):
    return CHECK.format(
        table=name,
        check="minimum_row_count",
        failed=f"greatest({minimum} - count(*), 0)",
        rest=f"from {SQL_NAMES.get(name, name)}",
    )


def _report_sql():
    parts = []
    for name in rules.REQUIRED_COLUMNS:
        parts.append(_required_sql(name))
        if name in rules.PRIMARY_KEYS:
            parts.append(_pk_sql(name, rules.PRIMARY_KEYS[name]))
        parts.append(_rows_sql(name, rules.MINIMUM_ROWS[name]))
        parts += [_range_sql(name, c, *limits) for c, limits in rules.NUMERIC_RANGES[name].items()]
    parts += [_fk_sql(*rule) for rule in rules.FOREIGN_KEYS]
    return " union all ".join(parts)


REPORT_SQL = f"""
 select table_name, check_name, case when failed_records = 0 then 'pass' else 'fail' end as status,
   failed_records = 0 as passed, failed_records from ({_report_sql()})"""


def report(t):
    return Q.validate(entity_tables(t))


@query(
    "v1_required_columns",
    sql(
        "select 'customers' as table_name, 'required_columns' as check_name, 'pass' as status, 0::bigint as failed_records"
        " union all select 'orders', 'required_columns', 'fail', 3"
        " union all select 'customers', check_name, case when failed_records = 0 then 'pass' else 'fail' end, failed_records"
        f" from ({_rows_sql('customers', 10_000)})"
        " union all select 'orders', check_name, case when failed_records = 0 then 'pass' else 'fail' end, failed_records"
        f" from ({_rows_sql('orders', 100_000).replace('order_lines', 'order_heads')})"
    ),
)
def _(t):
    """Columns and row counts together: the first needs names only, the second reads the table."""
    customers, heads = E.customers(t), t.orders.withColumnsRenamed({"o_orderkey": "order_id"})
    parts = [
        Q.required_columns(customers, "customers", rules.REQUIRED_COLUMNS["customers"]),
        Q.required_columns(heads, "orders", ["order_id", "customer_id", "product_id", "quantity"]),
        Q.counts_and_ranges(customers, "customers", rules.MINIMUM_ROWS["customers"], {}),
        Q.counts_and_ranges(heads, "orders", rules.MINIMUM_ROWS["orders"], {}),
    ]
    return stacked(parts).drop("passed", "message")


@query(
    "v2_primary_key",
    sql(
        "select table_name, check_name, failed_records from ("
        + " union all ".join([_pk_sql("orders", "order_key"), *[_pk_sql(*rule) for rule in rules.PRIMARY_KEYS.items()]])
        + ")"
    ),
)
def _(t):
    tables = entity_tables(t)
    parts = [Q.primary_key(tables["orders"], "orders", "order_key")]
    parts += [Q.primary_key(tables[name], name, key) for name, key in rules.PRIMARY_KEYS.items()]
    return stacked(parts).select("table_name", "check_name", "failed_records")


@query("v3_foreign_keys", sql(" union all ".join(_fk_sql(*rule) for rule in rules.FOREIGN_KEYS)))
def _(t):
    tables = entity_tables(t)
    parts = [
        Q.foreign_key(tables[name], name, key, tables[parent], parent, parent_key)
        for name, key, parent, parent_key in rules.FOREIGN_KEYS
    ]
    return stacked(parts).select("table_name", "check_name", "failed_records")


@query(
    "v4_numeric_ranges",
    sql(
        " union all ".join(_range_sql("orders", c, *limits) for c, limits in rules.NUMERIC_RANGES["orders"].items())
        + " union all select 'orders', 'range_refund', 0"
    ),
)
def _(t):
    ranges = {**rules.NUMERIC_RANGES["orders"], "refund": (0, None)}
    found = Q.counts_and_ranges(E.order_lines(t), "orders", None, ranges)
    return found.select("table_name", "check_name", "failed_records")


@query(
    "v5_minimum_rows",
    sql(" union all ".join(_rows_sql(n, rules.MINIMUM_ROWS[n]) for n in COLUMNS)),
)
def _(t):
    tables = entity_tables(t)
    parts = [Q.counts_and_ranges(df, name, rules.MINIMUM_ROWS[name], {}) for name, df in tables.items()]
    return stacked(parts).select("table_name", "check_name", "failed_records")


@query("v6_validation_report", sql(REPORT_SQL))
def _(t):
    return report(t).drop("message")


@query(
    "v7_report_summary",
    sql(
        f"""select count(distinct table_name) as checked_tables, count(*) as total_checks,
          count(*) filter (passed) as passed_checks, count(*) filter (not passed) as failed_checks,
          {hu("avg(passed::int)", 4)} as pass_rate from ({REPORT_SQL})"""
    ),
)
def _(t):
    return Q.summarise(report(t))


@query(
    "v8_quality_score",
    sql(f"select {hu('''avg((status = 'pass')::int)*100e0''', 2)} as quality_score from ({REPORT_SQL})"),
)
def _(t):
    return Q.quality_score(report(t))


@query(
    "v9_status_counts",
    sql(
        f"""select s.status, count(r.status) as checks from (values ('pass'), ('fail'), ('skip')) s(status)
        left join ({REPORT_SQL}) r on r.status = s.status group by 1"""
    ),
)
def _(t):
    return Q.status_counts(report(t))


@query("v9_failures", sql(f"select * from ({REPORT_SQL}) where status = 'fail'"))
def _(t):
    return Q.failures(report(t)).drop("message")


