"""Rule-based analytics: metrics, risk, segments, drift, recommendations (survey L11-L12, L18-L22, L25-L26, L31, D, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.catalog.aggregations import FORECAST, naive_forecast
from halyard.catalog.registry import query
from halyard.catalog.views import hu, sql
from halyard.catalog.windows import NAIVE_DEMAND, PANEL, REQUIREMENTS, naive_demand
from halyard.functions import half_up
from halyard.operators import drift as D
from halyard.operators import metrics as M
from halyard.operators import recommend as A
from halyard.operators import scoring as Z
from halyard.operators.encoding import scale
from halyard.operators.ordered import area_under_curve, roc_points
from halyard.plans import demand
from halyard.plans import training as T
from halyard.sources import entities as E

# ---------------------------------------------------------------- splits

POSITIONS = """
 select customer_id, churn_flag, row_number() over (partition by churn_flag order by md5('42:' || customer_id), customer_id) - 1 as position
 from customers"""


@query("l4_stratified_folds", sql("select customer_id, churn_flag, (position % 5)::int as fold from positions", positions=POSITIONS))
def _(t):
    return T.stratified_folds(E.customers(t).select("customer_id", "churn_flag"), "customer_id", "churn_flag", 5)


SOME_LABELS = "select customer_id, case when customer_id % 7 > 0 then churn_flag end as churn_flag from customers"
SOME_POSITIONS = POSITIONS.replace("from customers", "from some_labels")


def some_labels(t):
    """Customers of whom one in seven has no label."""
    return E.customers(t).select("customer_id", F.when(F.col("customer_id") % 7 > 0, F.col("churn_flag")).alias("churn_flag"))


@query(
    "l4_folds_with_missing_labels",
    sql(
        "select customer_id, churn_flag, (position % 5)::int as fold from positions",
        some_labels=SOME_LABELS,
        positions=SOME_POSITIONS,
    ),
)
def _(t):
    return T.stratified_folds(some_labels(t), "customer_id", "churn_flag", 5)


@query(
    "l5_holdout_with_missing_labels",
    sql(
        "select customer_id, churn_flag, position % 5 = 0 as is_test from positions",
        some_labels=SOME_LABELS,
        positions=SOME_POSITIONS,
    ),
)
def _(t):
    return T.holdout(some_labels(t), "customer_id", "churn_flag")


@query(
    "l6_weights_with_missing_labels",
    sql(
        """select customer_id, churn_flag, case when churn_flag is not null then
          count(churn_flag) over ()/(2e0*count(*) over (partition by churn_flag)) end as weight from some_labels""",
        some_labels=SOME_LABELS,
    ),
)
def _(t):
    return T.with_class_weights(some_labels(t), "churn_flag")


@query(
    "l5_holdout_split",
    sql(
        """select order_id, (row_number() over (order by md5('42:' || order_id), order_id) - 1) % 5 = 0 as is_test from order_heads"""
    ),
)
def _(t):
    return T.holdout(E.order_heads(t).select("order_id"), "order_id")


@query(
    "l3_time_folds",
    sql(
        """select order_month, fold, case when i < n - (6 - fold)*(n // 6) then 'train' else 'test' end as part from (
          select order_month, row_number() over (order by order_month) - 1 as i, count(*) over () as n from finance), (select unnest([1, 2, 3, 4, 5]) as fold)
        where i < n - (6 - fold)*(n // 6) + n // 6"""
    ),
)
def _(t):
    return T.time_folds(E.finance(t).select("order_month"), "order_month", 5)


@query(
    "l6_class_weights",
    sql("select churn_flag, count(*) as n, (select count(*) from customers)/(2e0*count(*)) as weight from customers group by 1"),
)
def _(t):
    weighed = T.with_class_weights(E.customers(t).select("customer_id", "churn_flag"), "churn_flag")
    return weighed.groupBy("churn_flag").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))


@query(
    "l2_feature_columns",
    sql(
        " union all ".join(
            f"select '{c}' as feature, count({c}) as filled from customers"
            for c in ("employee_count", "annual_revenue", "engagement_score", "customer_health_score", "churn_risk_score")
        )
    ),
)
def _(t):
    customers = E.customers(t)
    names = T.feature_columns(customers, excluded=["customer_id", "churn_flag"])
    return customers.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "feature", "filled")


# ---------------------------------------------------------------- metrics


@query(
    "l11_regression_metrics",
    sql(
        f"""select {hu('avg(abs(a - p))', 5)} as mae, {hu('sqrt(avg((a - p)*(a - p)))', 5)} as rmse,
          {hu('1e0 - sum((a - p)*(a - p))/sum((a - m)*(a - m))', 8)} as r2
        from (select order_amount as a, quantity*1400e0 as p from order_lines), (select avg(order_amount) as m from order_lines)"""
    ),
)
def _(t):
    scored = E.order_lines(t, product=False).select("order_amount", (F.col("quantity") * F.lit(1400.0)).alias("predicted"))
    out = Z.regression_metrics(scored, "order_amount", "predicted")
    return out.select(half_up("mae", 5).alias("mae"), half_up("rmse", 5).alias("rmse"), half_up("r2", 8).alias("r2"))


SCORED = "select customer_id, churn_flag as label, floor(engagement_score/5e0) as score, (floor(engagement_score/5e0) > 8)::int as predicted from customers"


def scored_customers(t):
    score = F.floor(F.col("engagement_score") / 5.0).cast("double")
    return E.customers(t).select(
        "customer_id", F.col("churn_flag").alias("label"), score.alias("score"), (score > 8).cast("int").alias("predicted")
    )


AUC_SQL = """
 select sum(case when label = 1 then r end) as rank_sum, count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from (
   select label, rank() over (order by score) + (count(*) over (partition by score) - 1)/2e0 as r from scored)"""


@query(
    "l12_classification_metrics",
    sql(
        f"""select (tp + tn)/(tp + tn + fp + fn)::double as accuracy, coalesce(tp/nullif(tp + fp, 0)::double, 0) as precision,
          coalesce(tp/nullif(tp + fn, 0)::double, 0) as recall, coalesce(2e0*tp/nullif(2*tp + fp + fn, 0), 0) as f1,
          (select {hu('(rank_sum - p*(p + 1)/2e0)/(p*n::double)', 10)} from ({AUC_SQL})) as roc_auc
        from (select count(*) filter (label = 1 and predicted = 1) as tp, count(*) filter (label = 0 and predicted = 1) as fp,
          count(*) filter (label = 1 and predicted = 0) as fn, count(*) filter (label = 0 and predicted = 0) as tn from scored)""",
        scored=SCORED,
    ),
)
def _(t):
    out = Z.classification_metrics(scored_customers(t), "label", "predicted", "score")
    return out.withColumn("roc_auc", half_up("roc_auc", 10))


@query(
    "l12_auc_over_orders",
    sql(
        f"select {hu('(rank_sum - p*(p + 1)/2e0)/(p*n::double)', 10)} as roc_auc from ({AUC_SQL})",
        scored="select (order_status = 'Completed')::int as label, order_amount as score from order_heads",
    ),
)
def _(t):
    scored = E.order_heads(t).select((F.col("order_status") == "Completed").cast("int").alias("label"), "order_amount")
    return area_under_curve(scored, "label", "order_amount").select(half_up("roc_auc", 10).alias("roc_auc"))


@query(
    "l31_roc_points",
    sql(
        """select score as threshold, sum(n) over w/(select count(*) from scored where label = 0)::double as fpr,
          sum(p) over w/(select count(*) from scored where label = 1)::double as tpr
        from (select score, count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from scored group by 1) window w as (order by score desc)""",
        scored=SCORED,
    ),
)
def _(t):
    return roc_points(scored_customers(t), "label", "score")


@query(
    "l31_confusion_matrix",
    sql("select label as actual, predicted, count(*) as n from scored group by 1, 2", scored=SCORED),
)
def _(t):
    return Z.confusion(scored_customers(t), "label", "predicted")


# ---------------------------------------------------------------- risk


@query(
    "l18_financial_risk",
    sql(
        """select order_month, case when dscr < 1.15e0 or cash_balance < 0.15e0*greatest(debt_balance, 1) then 2
          when dscr < 1.5e0 or cash_balance < 0.4e0*greatest(debt_balance, 1) then 1 else 0 end as risk from finance"""
    ),
)
def _(t):
    return E.finance(t).select("order_month", Z.financial_risk().alias("risk"))


@query(
    "l19_operational_risk",
    sql(
        """select strftime(snapshot_date, '%Y-%m') as month, warehouse_id, product_id, case when stockout_risk > 0.65e0 or u > 0.8e0 then 2
          when stockout_risk > 0.35e0 or u > 0.5e0 then 1 else 0 end as risk
        from (select *, reserved_units/nullif(on_hand_units, 0)::double as u from inventory)"""
    ),
)
def _(t):
    used = E.inventory(t).withColumn("inventory_utilization", M.inventory_utilization())
    return used.select(F.date_format("snapshot_date", "yyyy-MM").alias("month"), "warehouse_id", "product_id", Z.operational_risk().alias("risk"))


CUSTOMER_RISK = """
 select customer_id, segment, region, case when churn_risk_score > 70 or days_since_last_order > 180 then 2
   when churn_risk_score > 40 or days_since_last_order > 90 then 1 else 0 end as risk from customer_kpis"""


@query("l20_customer_risk", sql(CUSTOMER_RISK))
def _(t):
    kpis = E.customer_kpis(t).withColumn("recency_days", F.col("days_since_last_order"))
    return kpis.select("customer_id", "segment", "region", Z.customer_risk().alias("risk"))


PROBABILITIES = """
 select customer_id, a/(a + b + c) as p1, b/(a + b + c) as p2, c/(a + b + c) as p3 from (
  select customer_id, engagement_score + 1e0 as a, customer_health_score + 1e0 as b, churn_risk_score + 1e0 as c from customers)"""


@query(
    "l22_risk_scoring",
    sql(
        f"""select customer_id, {hu('p2*50e0 + p3*100e0', 2)} as risk_score, case when p2*50e0 + p3*100e0 >= 70 then 'High'
          when p2*50e0 + p3*100e0 >= 35 then 'Medium' else 'Low' end as risk_category, {hu('greatest(p1, p2, p3)', 4)} as risk_confidence from probabilities""",
        probabilities=PROBABILITIES,
    ),
)
def _(t):
    a, b, c = (F.col(x) + F.lit(1.0) for x in ("engagement_score", "customer_health_score", "churn_risk_score"))
    total = a + b + c
    probabilities = E.customers(t).select("customer_id", F.array(a / total, b / total, c / total).alias("probability"))
    return Z.risk_scores(probabilities, "probability").drop("probability")


# ---------------------------------------------------------------- segments

POINTS = f"""
 select segment, (annual_revenue - avg(annual_revenue) over ())/stddev_pop(annual_revenue) over () as x,
   (engagement_score - avg(engagement_score) over ())/stddev_pop(engagement_score) over () as y from customers"""


def scaled_points(t):
    points = scale(E.customers(t).select("segment", "annual_revenue", "engagement_score"), ["annual_revenue", "engagement_score"])
    return points.select("segment", F.col("annual_revenue_standard_scaled").alias("x"), F.col("engagement_score_standard_scaled").alias("y"))


@query(
    "l25_cluster_profile",
    sql(
        f"""select segment, count(*) as members, {hu('avg(sqrt((x - cx)*(x - cx) + (y - cy)*(y - cy)))', 6)} as spread, {hu('any_value(cx)', 6)} as x, {hu('any_value(cy)', 6)} as y
        from points join (select segment, avg(x) as cx, avg(y) as cy from points group by 1) using (segment) group by 1""",
        points=POINTS,
    ),
)
def _(t):
    return Z.cluster_profile(scaled_points(t), "segment", ["x", "y"]).withColumns({c: half_up(c, 6) for c in ("spread", "x", "y")})


@query(
    "l25_davies_bouldin",
    sql(
        f"""select {hu('avg(worst)', 4)} as davies_bouldin from (select a.segment, max((a.s + b.s)/sqrt((a.cx - b.cx)*(a.cx - b.cx) + (a.cy - b.cy)*(a.cy - b.cy))) as worst
          from profile a, profile b where a.segment <> b.segment group by 1)""",
        points=POINTS,
        profile="""select segment, avg(sqrt((x - cx)*(x - cx) + (y - cy)*(y - cy))) as s, any_value(cx) as cx, any_value(cy) as cy
          from points join (select segment, avg(x) as cx, avg(y) as cy from points group by 1) using (segment) group by 1""",
    ),
)
def _(t):
    value = Z.davies_bouldin(scaled_points(t), "segment", ["x", "y"])
    return t.spark.createDataFrame([(value,)], "davies_bouldin double").select(half_up("davies_bouldin", 4).alias("davies_bouldin"))


CENTROIDS = """
 select (row_number() over (order by industry) - 1)::int as cluster_id, avg(x)*9e0 as rev, avg(y)*9e0 as act, avg(z)*9e0 as val from (
  select industry, (annual_revenue - avg(annual_revenue) over ())/stddev_pop(annual_revenue) over () as x,
    (engagement_score - avg(engagement_score) over ())/stddev_pop(engagement_score) over () as y,
    (total_revenue - avg(total_revenue) over ())/stddev_pop(total_revenue) over () as z from customer_kpis) group by industry"""


@query(
    "l26_personas",
    sql(
        """select cluster_id, case when seen = 1 then name else name || ' (Group ' || (cluster_id + 1) || ')' end as persona from (
          select *, row_number() over (partition by name order by cluster_id) as seen from (
            select cluster_id, case when rev > 0.5e0 and act > 0.5e0 then 'Enterprise Champions' when val > 0.2e0 and act < -0.3e0 then 'At-Risk High-Value'
              when rev < -0.2e0 and act > 0.4e0 then 'Active Growth SMB' else 'Stable Mid-Market' end as name from centroids))""",
        centroids=CENTROIDS,
    ),
)
def _(t):
    from pyspark.sql import Window as W

    columns = ["annual_revenue", "engagement_score", "total_revenue"]
    scaled = scale(E.customer_kpis(t).select("industry", *columns), columns)
    centres = scaled.groupBy("industry").agg(
        (F.avg("annual_revenue_standard_scaled") * 9.0).alias("annual_revenue_standard_scaled"),
        (F.avg("engagement_score_standard_scaled") * 9.0).alias("customer_activity_score_standard_scaled"),
        (F.avg("total_revenue_standard_scaled") * 9.0).alias("total_revenue_standard_scaled"),
    )
    numbered = centres.withColumn("cluster_id", F.row_number().over(W.orderBy("industry")) - 1)
    return Z.personas(numbered).select("cluster_id", "persona")


# ---------------------------------------------------------------- drift

DRIFTED = ["order_amount", "discount_rate", "shipping_days", "quantity"]
SPLIT_MONTH = "1999-01"


def two_sides(t, *columns):
    lines = E.order_lines(t).select("order_month", *columns)
    return (
        lines.where(F.col("order_month") < SPLIT_MONTH).drop("order_month"),
        lines.where(F.col("order_month") >= SPLIT_MONTH).drop("order_month"),
    )


REF, INC = (f"(select * from order_lines where order_month {op} '{SPLIT_MONTH}')" for op in ("<", ">="))


@query(
    "d1_schema_check",
    sql(
        f"""select 'order_amount' as column_name, false as missing, count(order_amount) as filled, count(*) as incoming_rows from {INC} i
        union all select 'refund', true, 0, count(*) from {INC} i union all select 'quantity', false, count(quantity), count(*) from {INC} i"""
    ),
)
def _(t):
    _, incoming = two_sides(t, "order_amount", "quantity")
    return D.schema_check(["order_amount", "refund", "quantity"], incoming)


@query(
    "d2_range_check",
    sql(
        " union all ".join(
            f"""select '{c}' as column_name, r.a::double as ref_min, r.b::double as ref_max, i.a::double as inc_min, i.b::double as inc_max, i.a < r.a or i.b > r.b as out_of_bounds
            from (select min({c}) as a, max({c}) as b from {REF} x) r, (select min({c}) as a, max({c}) as b from {INC} x) i"""
            for c in DRIFTED
        )
    ),
)
def _(t):
    return D.range_check(*two_sides(t, *DRIFTED), DRIFTED)


KS_SQL = " union all ".join(
    f"""select '{c}' as column_name, any_value(rn) as ref_rows, any_value(n) as inc_rows, max(abs(r/rn::double - i/n::double)) as statistic from (
      select sum(case when s = 0 then k else 0 end) over w as r, sum(case when s = 1 then k else 0 end) over w as i, rn, n
      from (select v, s, count(*) as k from (select {c} as v, 0 as s from {REF} x union all select {c}, 1 from {INC} x) group by 1, 2),
        (select count({c}) as rn from {REF} x), (select count({c}) as n from {INC} x) window w as (order by v))"""
    for c in DRIFTED
)
SERIES = "+".join(f"({'2e0' if k % 2 else '-2e0'}*exp(-2e0*{k}*{k}*x*x))" for k in range(1, 101))
# samples of at most 10,000 rows: all lattice paths, a diagonal a step; the last entry is the share that reaches the gap
KS_EXACT = f"""(with recursive ks as materialized ({KS_SQL}),
  small as (select column_name, least(ref_rows, inc_rows) as n, greatest(ref_rows, inc_rows) as m, round(statistic*ref_rows*inc_rows)::bigint as k
    from ks where greatest(ref_rows, inc_rows) <= 10000),
  walk as (select column_name, n, m, k, 0::bigint as s, list_transform(range(0, n + 1), lambda i: case when i = 0 and k = 0 then 1e0 else 0e0 end) as q from small
    union all select column_name, n, m, k, s + 1, list_transform(range(0, n + 1), lambda i: case when i > s + 1 or s + 1 - i > m then 0e0
      when abs(i*m - (s + 1 - i)*n) >= k then 1e0 else (q[i + 1]*(s + 1 - i) + coalesce(q[i], 0e0)*i)/(s + 1) end) from walk where s < n + m)
  select ks.*, sqrt(ref_rows*inc_rows/(ref_rows + inc_rows)::double)*statistic as x, case when w.q is not null then least(w.q[w.n + 1], 1e0) end as exact
  from ks left join walk w on w.column_name = ks.column_name and w.s = w.n + w.m)"""
P_SQL = f"coalesce(exact, least(greatest(case when x < 0.2e0 then 1e0 else {SERIES} end, 0e0), 1e0))"


@query(
    "d3_two_sample_distance",
    sql(
        f"""select column_name, ref_rows, inc_rows, {hu('statistic', 10)} as statistic, {hu(P_SQL, 6)} as p_value, {P_SQL} < 0.05e0 as drift_detected
        from {KS_EXACT}"""
    ),
)
def _(t):
    out = D.distance_check(*two_sides(t, *DRIFTED), DRIFTED)
    return out.withColumns({"statistic": half_up("statistic", 10), "p_value": half_up("p_value", 6)})


@query(
    "d4_mean_deviation",
    sql(
        " union all ".join(
            f"""select '{c}' as column_name, {hu('r.m', 4)} as ref_mean, {hu('i.m', 4)} as inc_mean, abs(r.m - i.m) > 2e0*r.s and r.s > 0 as drift_detected
            from (select avg({c}) as m, stddev_samp({c}) as s from {REF} x) r, (select avg({c}) as m from {INC} x) i"""
            for c in DRIFTED
        )
    ),
)
def _(t):
    out = D.mean_deviation(*two_sides(t, *DRIFTED), DRIFTED)
    return out.withColumns({c: half_up(c, 4) for c in ("ref_mean", "inc_mean")})


@query(
    "d5_unexpected_categories",
    sql(f"select 'order_month' as column_name, order_month as value from (select order_month from {INC} x except select order_month from {REF} y)"),
)
def _(t):
    lines = E.order_lines(t).select("order_month", "category", F.col("order_month").alias("m"))
    return D.category_check(lines.where(F.col("m") < SPLIT_MONTH), lines.where(F.col("m") >= SPLIT_MONTH), ["order_month", "category"])


@query(
    "d6_drift_report",
    sql(
        f"""select 'orders' as dataset, column_name, 'distance' as check_name, {hu('statistic', 10)} as statistic, {hu(P_SQL, 6)} as p_value,
          null::varchar as detail, {P_SQL} < 0.05e0 as flagged from {KS_EXACT}
        union all """
        + " union all ".join(
            f"""select 'orders', '{c}', 'range', null, null, null, i.a < r.a or i.b > r.b
            from (select min({c}) as a, max({c}) as b from {REF} x) r, (select min({c}) as a, max({c}) as b from {INC} x) i"""
            for c in DRIFTED
        )
        + " union all "
        + " union all ".join(f"select 'orders', '{c}', 'schema', null, null, null, false" for c in [*DRIFTED, "category"])
    ),
)
def _(t):
    out = D.drift_report("orders", *two_sides(t, *DRIFTED, "category"))
    return out.withColumns({"statistic": half_up("statistic", 10), "p_value": half_up("p_value", 6)})


@query(
    "d6_drift_summary",
    sql(
        f"""select 'orders' as dataset, true as schema_valid, bool_or({P_SQL} < 0.05e0) as drift_detected, count(*) as num_features_checked
        from {KS_EXACT}"""
    ),
)
def _(t):
    return D.drift_summary(D.drift_report("orders", *two_sides(t, *DRIFTED, "category")))


# ---------------------------------------------------------------- recommendations


def churn_guess(t):
    return E.customers(t).select("customer_id", (F.col("churn_risk_score") / 100.0).alias("churn_probability"))


R1 = """
 select 'Customer ' || customer_id || ' has a critical churn probability of ' || printf('%.1f', p*100) || '%.' as business_insight,
  'Declining engagement score combined with elevated order cancellation rates.' as root_cause,
  'Initiate direct VIP outreach to Customer ' || customer_id || ' with a 15% contract renewal discount.' as recommendation,
  (floor(p*1e2+0.5e0)/1e2) as confidence, 'High Customer Retention' as expected_impact, 'High' as priority, 320e0 as estimated_roi, '15 days' as estimated_time_to_benefit
 from (select customer_id, churn_risk_score/100e0 as p from customers) where p > 0.6e0 order by p desc, customer_id limit 10"""
R2 = """
 select 'Product ' || product_id || ' (' || category || ') has a high stockout risk score of ' || printf('%.1f', r*100) || '%.' as business_insight,
  'Monthly sales forecast exceeds lead time supply rate.' as root_cause,
  'Trigger immediate procurement order of ' || floor(reorder_point)::bigint || ' units for Product ' || product_id || '.' as recommendation,
  (floor(r*1e2+0.5e0)/1e2) as confidence, 'Inventory Availability & Sales Continuity' as expected_impact, 'High' as priority, 180e0 as estimated_roi, '10 days' as estimated_time_to_benefit
 from requirements join (select product_id, arg_max(stockout_risk, (snapshot_date, warehouse_id)) as r from inventory group by 1) using (product_id)
 where r > 0.65e0 order by r desc, product_id limit 10"""
R3 = """
 select 'Next month revenue is forecasted to drop by ' || printf('%.1f', (a - p)/a*100e0) || '% to $' || format('{:,.2f}', p) || '.' as business_insight,
  'Seasonal lag in marketing campaign conversions and pipeline velocity.' as root_cause,
  'Boost Google Ads and Social media marketing spend by 15% to target Enterprise client segments.' as recommendation,
  0.88e0 as confidence, 'Revenue Stabilisation' as expected_impact, 'Critical' as priority, 240e0 as estimated_roi, '30 days' as estimated_time_to_benefit
 from (select actual_current_month_revenue as a, actual_current_month_revenue*0.9e0 as p from forecast) where p < a*0.95e0"""
DEFAULT = """
 select 'Enterprise customer loyalty is stable, but partner sales channels are experiencing a 5% drop.' as business_insight,
  'Partner commission changes implemented last quarter.' as root_cause,
  'Review and adjust the partner incentive bonus program to restore pipeline growth.' as recommendation,
  0.8e0 as confidence, 'Partner pipeline recovery' as expected_impact, 'Medium' as priority, 150e0 as estimated_roi, '45 days' as estimated_time_to_benefit"""


def stock_advice(t):
    needs = demand.inventory_requirements(E.products(t), E.suppliers(t), naive_demand(t))
    return A.stockout_advice(needs, A.latest_stock_risk(E.inventory(t)))


def falling_forecast(t):
    return naive_forecast(t).withColumn("predicted_next_month_revenue", F.col("actual_current_month_revenue") * F.lit(0.9))


@query("r1_churn_advice", sql(R1))
def _(t):
    return A.churn_advice(churn_guess(t))


STOCK_VIEWS = {"panel": PANEL, "naive_demand": NAIVE_DEMAND, "requirements": REQUIREMENTS}


@query("r2_stockout_advice", sql(R2, **STOCK_VIEWS))
def _(t):
    return stock_advice(t)


@query("r3_revenue_advice", sql(R3, forecast=FORECAST))
def _(t):
    return A.revenue_advice(falling_forecast(t))


@query("r4_recommendations", sql(f"select * from ({R1}) union all select * from ({R2}) union all select * from ({R3})", forecast=FORECAST, **STOCK_VIEWS))
def _(t):
    return A.recommendations([A.churn_advice(churn_guess(t)), stock_advice(t), A.revenue_advice(falling_forecast(t))])


@query("r4_default_recommendation", sql(f"{DEFAULT} where not exists (select 1 from customers where churn_risk_score > 1000)"))
def _(t):
    """No customer is above the limit and the forecast rises: only the default remains."""
    calm = churn_guess(t).withColumn("churn_probability", F.col("churn_probability") / 10.0)
    return A.recommendations([A.churn_advice(calm), A.revenue_advice(naive_forecast(t))])


