"""The entity views of ``sources/entities.py`` as SQL text, for the result checks."""

from __future__ import annotations

import re


def hu(x: str, digits: int) -> str:
    """Round half up, as ``functions.half_up`` does."""
    scale = f"1e{digits}"
    return f"(floor(cast({x} as double)*{scale}+0.5e0)/{scale})"


def money(x: str) -> str:
    return hu(f"sum({x})", 4)


def days(later: str, earlier: str) -> str:
    return f"cast(floor(date_diff('microsecond', {earlier}, {later})/86400000000e0) as bigint)"


def mean_money(x: str) -> str:
    return f"{money(x)}/nullif(count({x}),0)"


VIEWS = {
    "customers": """
      select c_custkey as customer_id, c_name as customer_name, c_mktsegment as segment, n_name as industry,
        r_name as region, n_name as country,
        timestamp '1990-01-01' + to_days(cast(c_custkey % 1800 as integer)) as signup_date,
        cast(10 + c_custkey % 490 as bigint) as employee_count, c_acctbal as annual_revenue,
        (c_custkey*37 % 1001)/10e0 as engagement_score, (c_custkey*53 % 1001)/10e0 as customer_health_score,
        (c_custkey*71 % 1001)/10e0 as churn_risk_score,
        case when (c_custkey*71 % 1001)/10e0 > 60 then 1 else 0 end as churn_flag
      from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "products": """
      select p_partkey as product_id, p_name as product_name, p_type as category, p_brand as subcategory,
        p_partkey % 110 as supplier_id, p_retailprice as unit_cost, p_retailprice + p_size*10e0 as list_price,
        1e0 - p_retailprice/(p_retailprice + p_size*10e0) as margin_rate, p_size*2e0 as demand_score,
        case when p_size < 10 then 'Launch' when p_size < 40 then 'Mature' else 'Decline' end as lifecycle_stage,
        cast(p_size % 2 as integer) as is_active
      from part""",
    "suppliers": """
      select s_suppkey as supplier_id, s_name as supplier_name, 'Type' || (s_suppkey % 3) as supplier_type,
        r_name as region, n_name as country, cast(7 + s_suppkey % 39 as bigint) as lead_time_days,
        (s_suppkey*29 % 1001)/10e0 as reliability_score, s_acctbal as contract_value
      from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "employees": """
      select s_suppkey as employee_id, s_name as employee_name, 'D' || (s_suppkey % 6) as department,
        'L' || (s_suppkey % 5) as level, r_name as region,
        timestamp '2015-01-01' + to_days(cast(s_suppkey % 3000 as integer)) as hire_date, s_acctbal as salary,
        (s_suppkey*41 % 101)/1e0 as performance_score,
        case when s_suppkey > 0 then cast(floor(s_suppkey/10e0) as bigint) end as manager_id,
        cast(s_suppkey % 2 as integer) as is_active
      from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "campaigns": f"""
      select user_id as campaign_id, 'Campaign ' || user_id as campaign_name, 'CH' || (user_id % 4) as channel,
        'SEG' || (user_id % 5) as target_segment, cast(date_trunc('day', min(ts)) as timestamp) as start_date,
        cast(date_trunc('day', max(ts)) as timestamp) as end_date,
        cast(1000 + user_id % 50 * 100 as bigint) as budget,
        count(*) filter (event_type = 'signup') as leads_generated,
        count(*) filter (event_type = 'view') as impressions,
        count(*) filter (event_type = 'click') as clicks,
        count(*) filter (event_type = 'purchase') as conversions,
        coalesce(count(*) filter (event_type = 'purchase')/nullif(cast(count(*) filter (event_type = 'click') as double),0),0e0)
          as conversion_rate,
        {money("case when event_type = 'purchase' then value else 0e0 end")} as attributed_revenue
      from events group by user_id""",
    "order_lines": f"""
      select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as order_id,
        l_orderkey as order_key, l_linenumber as line_number, l_suppkey as warehouse_key, o_custkey as customer_id,
        l_partkey as product_id, o_custkey % 150 as campaign_id, o_orderdate as order_date,
        o_orderpriority as sales_channel,
        case when o_orderstatus = 'F' then 'Completed' when o_orderstatus = 'O' then 'Shipped'
          when l_returnflag = 'R' then 'Returned' else 'Cancelled' end as order_status,
        cast(l_quantity as bigint) as quantity, l_extendedprice/l_quantity as unit_price,
        l_discount as discount_rate, l_extendedprice*(1e0-l_discount) as order_amount,
        {days("l_shipdate", "o_orderdate")} as shipping_days, p_type as category,
        l_extendedprice*(1e0-l_discount) - l_quantity*p_retailprice as gross_margin,
        strftime(o_orderdate, '%Y-%m') as order_month
      from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "order_heads": """
      select o_orderkey as order_id, o_custkey as customer_id, o_orderdate as order_date,
        o_orderpriority as sales_channel,
        case when o_orderstatus = 'F' then 'Completed' when o_orderstatus = 'O' then 'Shipped' else 'Cancelled' end
          as order_status,
        o_totalprice as order_amount, (o_orderkey*7 % 11)/100e0 as discount_rate, o_orderkey*13 % 30 as shipping_days,
        o_totalprice*((o_orderkey*3 % 40)/100e0) as gross_margin
      from orders""",
    "inventory": f"""
      select *, on_hand_units*0.2e0 as reorder_point, reserved_units/cast(on_hand_units as double) as stockout_risk
      from (select cast(date_trunc('month', l_shipdate) as timestamp) as snapshot_date, 'W' || (l_suppkey % 8) as warehouse_id,
          l_partkey as product_id, cast(sum(l_quantity) as bigint) as on_hand_units,
          cast(sum(case when l_returnflag = 'R' then l_quantity else 0 end) as bigint) as reserved_units,
          {money("l_extendedprice")} as inventory_value
        from lineitem group by 1, 2, 3)""",
    "finance_costed": f"""
      select *, {hu("gross_margin - opex", 2)} as ebitda from (
        select *, {hu("revenue - gross_margin", 2)} as cogs,
          {hu("revenue * (0.18e0 + (cast(substr(order_month, 6, 2) as integer) % 9) * 0.02e0)", 2)} as opex
        from (select order_month, {money("order_amount")} as revenue, {money("gross_margin")} as gross_margin,
                count(*) as order_count
              from order_lines group by order_month))""",
    "finance": f"""
      select order_month, revenue, gross_margin, order_count, cogs, opex, ebitda,
        {hu("2000000e0 + sum(ebitda) over (order by order_month rows unbounded preceding)", 2)} as cash_balance,
        1250000e0 - (row_number() over (order by order_month) - 1)*5000e0 as debt_balance,
        {hu("least(greatest(ebitda/greatest(opex, 1e0), 0.5e0), 5e0)", 3)} as dscr
      from finance_costed""",
    "operations": f"""
      select operating_date, warehouse_id, throughput_units,
        1e0 - incident_count/cast(throughput_units as double) as on_time_delivery_rate,
        1e0 - late_count/cast(throughput_units as double) as fulfillment_rate, incident_count,
        labor_minutes/60e0 as labor_hours, incident_count*13 as downtime_minutes
      from (select cast(date_trunc('day', ts) as timestamp) as operating_date, 'W' || (user_id % 8) as warehouse_id,
          count(*) as throughput_units, count(*) filter (event_type = 'error') as incident_count,
          count(*) filter (event_type = 'signup') as late_count, {money("value")} as labor_minutes
        from events group by 1, 2)""",
    "customer_kpis": f"""
      select *, {hu("total_orders/cast(greatest(days_since_last_order, 1) as double)", 4)} as order_velocity,
        {hu("recent_revenue*1.08e0", 2)} as revenue_90d_target
      from (select c.*, total_orders, total_revenue, total_margin, coalesce(recent_order_count, 0) as recent_order_count,
          coalesce(recent_revenue, 0e0) as recent_revenue, coalesce(recent_avg_discount, 0e0) as recent_avg_discount,
          coalesce(recent_avg_shipping_days, 0e0) as recent_avg_shipping_days, recent_last_order,
          coalesce({days("(select max(order_date) from order_heads)", "recent_last_order")}, 999) as days_since_last_order
        from customers c left join (
          select customer_id, count(*) as total_orders, {money("order_amount")} as total_revenue,
            {money("gross_margin")} as total_margin, count(*) filter (r) as recent_order_count,
            {money("case when r then order_amount end")} as recent_revenue,
            {mean_money("case when r then discount_rate end")} as recent_avg_discount,
            avg(case when r then shipping_days end) as recent_avg_shipping_days,
            max(case when r then order_date end) as recent_last_order
          from (select *, order_date >= (select max(order_date) from order_heads) - interval 180 days as r from order_heads)
          group by customer_id) k using (customer_id))""",
}


def sql(body: str, **extra: str) -> str:
    """``body`` with the views it mentions in front; ``extra`` adds views of its own."""
    views = {**VIEWS, **extra}
    wanted: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name, view in views.items():
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                todo.append(view)
    used = [f"{name} as ({view})" for name, view in views.items() if name in wanted]
    return ("with " + ",\n".join(used) + "\n" if used else "") + body
