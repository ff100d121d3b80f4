"""Spark ML jobs and attribution (survey E11-E14, L7-L10, L13-L16, L21, L23-L24, L27-L30, L32, X1-X2).

All jobs run at their full size: the jobs' own default budgets, and ``T.Budget()`` where a query calls the
parts of a job. Classification reads the features of the churn job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halyard.catalog.features import customer_feature_table
from halyard.catalog.registry import query
from halyard.catalog.tables import COLUMNS, entity_tables
from halyard.catalog.views import hu, sql
from halyard.catalog.windows import DEMAND_SET, PANEL
from halyard.functions import half_up
from halyard.operators import attribution as B
from halyard.operators.information import neighbour_information
from halyard.operators.union import stacked
from halyard.plans import jobs as J
from halyard.plans import selecting as S
from halyard.plans import training as T
from halyard.plans.features import SELECTION_TARGET, finance_features, inventory_features
from halyard.plans.registry import ModelRegistry, leaderboard
from halyard.plans.together import together
from halyard.session import checkpoint_ready
from halyard.sources import entities as E
from halyard.sources.sinks import write_table

FULL = T.Budget()
LABELLED = "label is not null"


def scratch_registry(t) -> ModelRegistry:
    """A registry of its own under the checkpoint folder, which all executors share."""
    checkpoint_ready(t.spark)
    return ModelRegistry(t.spark, f"{t.spark.sparkContext.getCheckpointDir()}/registry-{uuid.uuid4().hex}")


def selection_table(t):
    """The customer feature table, written once, and the features that the package selects from."""
    table = T.stored(customer_feature_table(t))
    return table, T.feature_columns(table, ["customer_id", SELECTION_TARGET])


# few-valued features make the bins exact: every value is its own bin
FEW = ["total_orders_band", "engagement_band"]


@query(
    "e11_mutual_information",
    sql(
        " union all ".join(
            f"""select '{c}' as feature, {hu('greatest(sum(n/total::double*ln(n*total/(nb*nt)::double)), 0)', 8)} as information from (
              select n, sum(n) over () as total, sum(n) over (partition by b) as nb, sum(n) over (partition by c) as nt
              from (select {c} as b, churn_flag as c, count(*) as n from bands group by 1, 2))"""
            for c in FEW
        ),
        bands="select churn_flag, floor(total_orders/8e0) as total_orders_band, floor(engagement_score/25e0) as engagement_band from customer_kpis",
    ),
)
def _(t):
    bands = E.customer_kpis(t).select(
        "churn_flag",
        F.floor(F.col("total_orders") / 8.0).alias("total_orders_band"),
        F.floor(F.col("engagement_score") / 25.0).alias("engagement_band"),
    )
    return S.mutual_information(bands, FEW, "churn_flag", bins=2000).withColumn("information", half_up("information", 8))


MEASURED = ["engagement_score", "total_orders", "days_since_last_order"]


def psi(n: str) -> str:
    """Digamma of a whole number by its series, as ``operators.information``."""
    x = f"({n} + 8e0)"
    series = f"ln{x} - 0.5e0/{x} - 1e0/(12e0*{x}*{x}) + 1e0/(120e0*{x}**4) - 1e0/(252e0*{x}**6)"
    return f"({series} - list_sum(list_transform(range(8), lambda i: 1e0/({n} + i))))"


INFORMATION = f"greatest({psi('count(*)')} + avg({psi('used')}) - avg({psi('size')}) - avg({psi('m')}), 0)"


@query(
    "e11_neighbour_information",
    sql(
        f"""select f as feature, {hu(INFORMATION, 8)} as information from (select r.f, r.used, r.size,
          (select count(*) from long u where u.f = r.f and (u.v > r.v - r.radius and u.v < r.v + r.radius or r.radius = 0 and u.v = r.v)) as m from radii r) group by f""",
        long=" union all ".join(f"select '{c}' as f, customer_id, churn_flag as c, coalesce({c}, 0)::double as v from customer_kpis" for c in MEASURED),
        gaps="""select a.f, a.customer_id, a.v, abs(a.v - b.v) as gap, row_number() over (partition by a.f, a.customer_id order by abs(a.v - b.v)) as place,
          count(*) over (partition by a.f, a.customer_id) + 1 as size from long a join long b on a.f = b.f and a.c = b.c and a.customer_id <> b.customer_id""",
        radii="select f, customer_id, v, gap as radius, size, least(3, size - 1) as used from gaps where place = least(3, size - 1)",
    ),
)
def _(t):
    """By the third neighbour of the same class; customers without a class take no part."""
    kpis = E.customer_kpis(t).select("churn_flag", *MEASURED)
    return neighbour_information(kpis, MEASURED, "churn_flag").withColumn("information", half_up("information", 8))


@query("e12_recursive_elimination")
def _(t):
    table, features = selection_table(t)
    left = S.eliminated(table, features, SELECTION_TARGET, 10)
    return t.spark.createDataFrame([(c,) for c in left], "feature string")


@query("e13_tree_importance")
def _(t):
    table, features = selection_table(t)
    return S.tree_importance(table, features, SELECTION_TARGET)


@query(
    "e13_importance_rows",
    sql(
        """select 'planted_constant' as feature, count(*) > 0 as sound from customers union all select 'planted_noise', count(*) > 0 from customers
        union all select 'planted_signal', count(*) > 0 from customers union all select 'shares', count(*) > 0 from customers"""
    ),
)
def _(t):
    """Columns of known worth beside the table's own: a constant weighs nothing, a noisy copy of the target most, noise little; shares add up to one."""
    table, features = selection_table(t)
    draw = F.abs(F.xxhash64("customer_id")) % 1000
    planted = table.select(
        "*",
        F.lit(1.0).alias("planted_constant"),
        F.when(draw < 50, 1 - F.col(SELECTION_TARGET)).otherwise(F.col(SELECTION_TARGET)).cast("double").alias("planted_signal"),
        (F.abs(F.xxhash64("customer_id", F.lit("noise"))) % 1000).cast("double").alias("planted_noise"),
    )
    # columns that the target is made of would outweigh the copy
    kept = [c for c in features if c not in J.CHURN_LEAKS]
    found = S.tree_importance(planted, [*kept, "planted_constant", "planted_signal", "planted_noise"], SELECTION_TARGET)
    most = F.max("importance").over(W.partitionBy())
    judged = found.select("feature", "importance", most.alias("most"))
    sound = (
        F.when(F.col("feature") == "planted_constant", F.col("importance") == 0.0)
        .when(F.col("feature") == "planted_signal", F.col("importance") == F.col("most"))
        .when(F.col("feature") == "planted_noise", F.col("importance") < 0.1 * F.col("most"))
    )
    shares = found.agg(F.lit("shares").alias("feature"), (F.abs(F.sum("importance") - 1.0) < 1e-9).alias("sound"))
    return judged.where(F.col("feature").startswith("planted_")).select("feature", sound.alias("sound")).union(shares)


@query("e14_selection_report")
def _(t):
    table, features = selection_table(t)
    return S.selection_report(table, features, SELECTION_TARGET, "customer_features")


# columns of the seven tables on the star's categories
FEATURE_WIDTHS = {
    "customer_features": ("customers", 114),
    "sales_features": ("order_lines", 73),
    "finance_features": ("finance", 40),
    "marketing_features": ("campaigns", 41),
    "inventory_features": ("inventory", 89),
    "employee_features": ("employees", 41),
    "kpi_features": ("customer_kpis", 48),
}


@query(
    "e23_feature_package",
    sql(
        " union all ".join(
            f"select '{name}' as dataset, count(*) as row_count, {width}::bigint as column_count, true as sound from {view}"
            for name, (view, width) in FEATURE_WIDTHS.items()
        )
        + " union all select 'feature_selection_report', null, 4, true"
    ),
)
def _(t):
    """All seven feature tables and the selection report, written and counted by the manifest.

    Three selections of ten features give ten to thirty rows.

    The entities are written first: every fit below then reads files instead of
    joining the star again.
    """
    from halyard.catalog.metrics import as_of
    from halyard.catalog.relational import scratch_folder
    from halyard.plans.features import feature_package, write_package

    folder = scratch_folder(t)
    tables = {name: t.spark.read.parquet(write_table(df, folder, name)) for name, df in entity_tables(t).items()}
    counted = write_package(feature_package(tables, as_of(), E.LINE_ORDER), f"{folder}/features")
    report = F.col("dataset") == "feature_selection_report"
    return counted.select(
        "dataset",
        F.when(~report, F.col("row_count")).alias("row_count"),
        "column_count",
        (~report | F.col("row_count").between(10, 30)).alias("sound"),
    )


# rows and columns of the exploration's frames on the star; the analysis frame has 30 numeric columns
EXPLORED = {
    "summary_statistics": ("17", 12),
    "missing_values": (str(sum(map(len, COLUMNS.values()))), 4),
    "correlation": ("30*29//2", 3),
    "monthly_revenue": ("(select count(distinct order_month) from order_lines)", 5),
    "products": ("(select count(*) from products)", 9),
    "regions": ("(select count(*) from (select distinct region, segment from customers))", 6),
    "seasonal": ("(select count(distinct order_month) from order_lines)", 4),
    "segmentation": ("(select count(distinct segment) from customers)", 8),
    "kpi_summary": ("7", 2),
}


@query(
    "a16_exploration_manifest",
    sql(
        " union all ".join(
            f"select '{name}' as dataset, cast({rows} as bigint) as row_count, {width}::bigint as column_count"
            for name, (rows, width) in EXPLORED.items()
        )
    ),
)
def _(t):
    """The exploration package, written and counted."""
    from halyard.catalog.relational import scratch_folder
    from halyard.plans.pipeline import write_exploration

    folder = scratch_folder(t)
    tables = {name: t.spark.read.parquet(write_table(df, folder, name)) for name, df in entity_tables(t).items()}
    return write_exploration(tables, f"{folder}/exploration")


@query("l7_regression_candidates")
def _(t):
    """Forest and boosted trees on the months, judged on the months after those they are fitted on."""
    from halyard.operators.series import supervised_months

    candidates = T.regression_candidates(FULL)
    frame = supervised_months(E.finance(t)).dropna(subset=["target_revenue"])
    features = T.feature_columns(frame, ["order_month", "target_revenue"])
    rows = T.stored(T.assembled(frame.withColumn("label", F.col("target_revenue").cast("double")), features, ["order_month", "label"]))
    found = T.fold_metrics("regression", candidates, T.expanding_folds(rows, "order_month", FULL.folds))
    return J._table(t.spark, "regression", T.best_regression(found))


def churn_rows(t):
    """All customers, weighted, and the features of the churn job; customers without a label are explained, not trained on."""
    table = customer_feature_table(t)
    features = T.feature_columns(table, ["customer_id", *J.CHURN_LEAKS])
    rows = T.assembled(table.withColumn("label", F.col("churn_flag").cast("double")), features, ["customer_id", "label"])
    return T.stored(T.with_positive_weight(rows, "label"), "customer_id"), features


@query("l8_classification_candidates")
def _(t):
    """Forest and boosted trees fitted on four fifths of the customers, judged on the others."""
    candidates = T.classification_candidates(FULL)
    split = T.one_split(T.holdout(churn_rows(t)[0].where(LABELLED), "customer_id", "label"), "customer_id")
    return J._table(t.spark, "classification", T.best_classification(T.fold_metrics("classification", candidates, split)))


def churn_folds(t):
    return T.held_out_folds(T.stratified_folds(churn_rows(t)[0].where(LABELLED), "customer_id", "label", FULL.folds), "customer_id", FULL.folds)


@query("l9_random_search")
def _(t):
    trials, log = T.random_trials("classification", FULL), []
    J.compared("classification", [], trials, churn_folds(t), log)
    return J.experiment_log(t.spark, log[: len(trials)])


@query("l10_model_comparison")
def _(t):
    candidates = T.classification_candidates(FULL)
    return J._table(t.spark, "classification", J.compared("classification", candidates, [], churn_folds(t), [])[0])


@query("l13_revenue_forecast")
def _(t):
    return J.train_revenue(E.finance(t), scratch_registry(t)).results["forecast"]


@query("l14_churn_predictions")
def _(t):
    return J.train_churn(customer_feature_table(t), scratch_registry(t)).results["predictions"]


def demand_outcome(t):
    return J.train_demand(E.order_lines(t), E.products(t), E.suppliers(t), scratch_registry(t))


@query("l16_demand_forecasts")
def _(t):
    return demand_outcome(t).results["forecasts"]


@query(
    "l16_forecast_rows",
    sql(
        """select product_id, order_month, target_demand, true as sound from dataset
        where target_demand is not null and demand_lag_3 is not null""",
        panel=PANEL,
        dataset=DEMAND_SET,
    ),
)
def _(t):
    """Every panel row once, with its target and a prediction."""
    return demand_outcome(t).results["forecasts"].select(
        "product_id",
        "order_month",
        F.col("target_demand").cast("long").alias("target_demand"),
        F.col("predicted_demand").isNotNull().alias("sound"),
    )


@query("l16_stock_requirements")
def _(t):
    return demand_outcome(t).results["requirements"]


def risk_frame(t, name):
    """The feature table that a risk job reads in a training run."""
    if name == "financial_risk_model":
        return finance_features(E.finance(t))
    if name == "operational_risk_model":
        return J.keyed_snapshots(inventory_features(E.inventory(t), E.products(t)))
    return customer_feature_table(t).withColumn("recency_days", F.col("days_since_last_order"))


def risk_outcome(t, name, registry):
    return J.train_risk(name, risk_frame(t, name), registry)


@query("l21_risk_training")
def _(t):
    registry = scratch_registry(t)
    return stacked([o.comparison for o in together(t.spark, [lambda n=name: risk_outcome(t, n, registry) for name in J.RISK_JOBS])])


@query("l23_customer_risk_report")
def _(t):
    return risk_outcome(t, "customer_risk_model", scratch_registry(t)).results["scores"]


@query("l24_customer_segments")
def _(t):
    return J.segment_customers(customer_feature_table(t), scratch_registry(t)).results["segments"]


@query("l24_segment_quality")
def _(t):
    return J.segment_customers(customer_feature_table(t), scratch_registry(t)).comparison


@query("l27_projection")
def _(t):
    return J.segment_customers(customer_feature_table(t), scratch_registry(t)).results["segments"].select("customer_id", "pca_x", "pca_y")


@query("l28_batch_scoring")
def _(t):
    """Train, then score a frame that lacks one feature (taken as zero)."""
    registry = scratch_registry(t)
    customers = T.stored(risk_frame(t, "customer_risk_model"))
    J.train_risk("customer_risk_model", customers, registry)
    return registry.predict("customer_risk_model", customers.drop("employee_count"), ["customer_id"]).select("customer_id", "prediction", "score")


def filled_registry(t):
    """Three linear fits on real tables, one of them registered twice."""
    from pyspark.ml.regression import LinearRegression

    registry = scratch_registry(t)
    # written once: every fit and the count read the months, not the order lines behind them
    months = T.stored(T.assembled(E.finance(t).withColumn("label", F.col("revenue")), ["order_count", "opex"], ["label"]))
    model = LinearRegression(featuresCol=T.VECTOR, maxIter=3, solver="normal").fit(months)
    n = float(months.count())
    registry.register("monthly", model, {"mae": n + 1, "rmse": 3.0}, ["order_count", "opex"], "linear", "first")
    registry.register("monthly", model, {"mae": n, "rmse": 2.0}, ["order_count", "opex"], "linear", "second")
    registry.register("weekly", model, {"mae": n / 2}, ["order_count", "opex"], "linear", "other")
    registry.register("classes", model, {"f1": 0.5, "accuracy": 0.75}, ["order_count", "opex"], "forest", "classes")
    registry.register("groups", model, {"silhouette": 0.25}, ["order_count"], "kmeans", "groups")
    return registry


@query(
    "l29_model_registry",
    sql(
        """select 'monthly' as name, 'second' as description, count(*)::double as mae, 2::bigint as features from finance
        union all select 'weekly', 'other', count(*)/2e0, 2 from finance union all select 'classes', 'classes', null, 2 from finance having count(*) > 0
        union all select 'groups', 'groups', null, 1 from finance having count(*) > 0"""
    ),
)
def _(t):
    return filled_registry(t).models().select(
        "name", "description", F.try_element_at("metrics", F.lit("mae")).alias("mae"), F.size("feature_names").cast("long").alias("features")
    )


@query(
    "l30_leaderboard",
    sql(
        """select 'regression' as board, 'weekly' as name, 'linear' as algorithm, count(*)/2e0 as mae, null::double as rmse, null::double as f1 from finance
        union all select 'regression', 'monthly', 'linear', count(*), 2e0, null from finance
        union all select 'classification', 'classes', 'forest', null, null, 0.5e0 from finance having count(*) > 0
        union all select 'classification', 'groups', 'kmeans', null, null, null from finance having count(*) > 0"""
    ),
)
def _(t):
    return leaderboard(filled_registry(t).models()).select("board", "name", "algorithm", "mae", "rmse", "f1")


@query("l32_feature_importance")
def _(t):
    rows, features = churn_rows(t)
    model = T.classification_candidates(T.Budget(trees=150))[0].build().fit(rows.where(LABELLED))
    return T.importances(model, features, t.spark, top=15)


def explained(t):
    rows, features = churn_rows(t)
    model = T.classification_candidates(FULL)[0].build().fit(rows.where(LABELLED))
    return B.attributions(model, rows, "customer_id", T.VECTOR, features)


@query("x1_global_attribution")
def _(t):
    return B.global_importance(explained(t))


@query("x2_local_attribution")
def _(t):
    return B.local_explanation(explained(t))




@query("x2_additivity", sql("select customer_id, true as adds_up from customers"))
def _(t):
    """Base value plus all contributions gives the model's probability for every row."""
    rows, features = churn_rows(t)
    model = T.classification_candidates(FULL)[0].build().fit(rows.where(LABELLED))
    long = B.attributions(model, rows, "customer_id", T.VECTOR, features).where(F.col("class_id") == 1)
    total = long.groupBy("customer_id").agg((F.max("base_value") + F.sum("attribution")).alias("total"))
    scores = T.scored(model, rows).select("customer_id", "score")
    return total.join(scores, "customer_id").select(
        "customer_id", (F.abs(F.col("total") - F.col("score")) < 1e-9).alias("adds_up")
    )


@query(
    "l14_churn_prediction_rows",
    sql(
        """select customer_id, churn_flag as actual_churn, position % 5 = 0 as is_test, true as sound from (select customer_id, churn_flag,
          row_number() over (partition by churn_flag order by md5('42:' || customer_id), customer_id) - 1 as position from customers)"""
    ),
)
def _(t):
    """Every customer once, label and split as given, probability and class in agreement."""
    found = J.train_churn(customer_feature_table(t), scratch_registry(t))
    p = F.col("churn_probability")
    sound = p.between(0.0, 1.0) & ((p > 0.5) == (F.col("predicted_churn") == 1))
    return found.results["predictions"].select("customer_id", "actual_churn", "is_test", sound.alias("sound"))


@query(
    "l23_risk_report_rows",
    sql("select customer_id, segment, region, true as sound from customers"),
)
def _(t):
    """Every customer once with segment and region; score, category and confidence in agreement."""
    scores = risk_outcome(t, "customer_risk_model", scratch_registry(t)).results["scores"]
    level = F.when(F.col("risk_score") >= 70, "High").when(F.col("risk_score") >= 35, "Medium").otherwise("Low")
    near_limit = (F.abs(F.col("risk_score") - 70) < 0.01) | (F.abs(F.col("risk_score") - 35) < 0.01)
    sound = F.col("risk_score").between(0, 100) & F.col("confidence").between(0.33, 1.0) & ((level == F.col("risk_category")) | near_limit)
    return scores.select("customer_id", "segment", "region", sound.alias("sound"))


@query(
    "l24_segment_rows",
    sql("select customer_id, annual_revenue, true as sound from customers"),
)
def _(t):
    """Every customer once, one persona per cluster and one cluster per persona."""
    segments = J.segment_customers(customer_feature_table(t), scratch_registry(t)).results["segments"]
    pairs = segments.groupBy("cluster_id").agg(F.count_distinct("persona").alias("names"))
    names = segments.agg(F.count_distinct("persona") == F.count_distinct("cluster_id")).scalar()
    return segments.join(pairs, "cluster_id").select(
        "customer_id", "annual_revenue", ((F.col("names") == 1) & names & F.col("cluster_id").between(0, 3)).alias("sound")
    )
