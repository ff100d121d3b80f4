"""Training jobs: revenue, churn, demand, risk and segmentation.

Each job reads a feature frame, trains Spark ML candidates, compares them,
registers the best and returns lazy result frames.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators.boosting import Spec
from halyard.operators.describe import numeric_columns
from halyard.operators.encoding import scale
from halyard.operators.rollups import category_seasonality
from halyard.operators.scoring import (
    customer_risk,
    davies_bouldin,
    financial_risk,
    operational_risk,
    personas,
    risk_scores,
)
from halyard.operators.series import supervised_months
from halyard.plans import training as T
from halyard.plans.boosted import BoostedTrees
from halyard.plans.demand import FEATURES as DEMAND_FEATURES
from halyard.plans.demand import demand_dataset, inventory_requirements
from halyard.plans.forests import forest
from halyard.plans.registry import ModelRegistry
from halyard.plans.together import together

METRIC_SCHEMA = {
    "regression": "model_name string, mae double, rmse double, r2 double",
    "classification": "model_name string, accuracy double, precision double, recall double, f1 double, roc_auc double",
}


@dataclass
class Outcome:
    comparison: DataFrame
    model: Model
    features: list[str]
    metrics: dict[str, float]
    results: dict[str, DataFrame]


def _table(spark: SparkSession, kind: str, rows: list[dict]) -> DataFrame:
    schema = METRIC_SCHEMA[kind]
    names = [part.split()[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


RANKS = {"regression": T.best_regression, "classification": T.best_classification}


def compared(
    kind: str, candidates: list[T.Candidate], trials: list[T.Candidate], folds: T.Folds, log: list[dict], balanced: bool = False
) -> tuple[list[dict], list[T.Candidate]]:
    """Candidates by their fold metrics, best first; the best trial joins them as ``boosted_tuned``.

    Trials and candidates are fitted and judged together, each once.
    """
    rank = RANKS[kind]
    rows = T.fold_metrics(kind, [*candidates, *trials], folds, balanced)
    for candidate, row in zip([*trials, *candidates], [*rows[len(candidates) :], *rows[: len(candidates)]]):
        log.append({"parameters": dict(candidate.params), **row})
    own, tried = rows[: len(candidates)], rows[len(candidates) :]
    if trials:
        best = rank(tried)[0]
        chosen = next(c for c in trials if c.name == best["model_name"])
        candidates = [*candidates, T.Candidate("boosted_tuned", chosen.build, chosen.params, chosen.spec)]
        own = [*own, {**best, "model_name": "boosted_tuned"}]
        log.append({"parameters": dict(chosen.params), **own[-1]})
    return rank(own), candidates


def experiment_log(spark: SparkSession, log: list[dict]) -> DataFrame:
    """Every trial and candidate with its parameters as JSON, for the append-only log."""
    metrics = [c for c in ("mae", "rmse", "r2", "accuracy", "precision", "recall", "f1", "roc_auc") if c in log[0]]
    schema = "model_name string, parameters map<string,string>, " + ", ".join(f"{m} double" for m in metrics)
    rows = [
        (r["model_name"], {k: str(v) for k, v in r["parameters"].items()}, *[r[m] for m in metrics]) for r in log
    ]
    return spark.createDataFrame(rows, schema).withColumn("parameters", F.to_json("parameters"))


# ---------------------------------------------------------------- revenue


def train_revenue(finance: DataFrame, registry: ModelRegistry, budget: T.Budget = T.Budget()) -> Outcome:
    """Compare on expanding folds, refit the best on all months, forecast the month after the last."""
    spark = finance.sparkSession
    frame = T.stored(supervised_months(finance))
    features = T.feature_columns(frame, ["order_month", "target_revenue"])
    vectors = T.stored(
        T.assembled(
            frame.select("*", F.col("target_revenue").cast("double").alias("label")),
            features,
            ["order_month", "revenue", "label"],
        )
    )
    known = vectors.where(F.col("label").isNotNull())
    splits = min(budget.folds, max(known.count() - 1, 2))
    folds = T.expanding_folds(known, "order_month", splits)

    log: list[dict] = []
    candidates, trials = T.regression_candidates(budget), T.random_trials("regression", budget)
    ranked, candidates = compared("regression", candidates, trials, folds, log)
    best = next(c for c in candidates if c.name == ranked[0]["model_name"])
    model = best.build().fit(known)
    metrics = {m: ranked[0][m] for m in ("mae", "rmse", "r2")}
    registry.register("revenue_forecast_model", model, metrics, features, best.name, "Monthly revenue forecast")

    last = vectors.where(F.col("label").isNull())
    forecast = T.scored(model, last).select(
        F.col("order_month").alias("forecast_month"),
        F.col("prediction").alias("predicted_next_month_revenue"),
        F.col("revenue").alias("actual_current_month_revenue"),
        F.lit(best.name).alias("model_name"),
    )
    return Outcome(
        _table(spark, "regression", ranked), model, features, metrics, {"forecast": forecast, "log": experiment_log(spark, log)}
    )


# ---------------------------------------------------------------- churn

# the label is a threshold on the first of these, the others are built from it
CHURN_LEAKS = [
    "churn_risk_score",
    "churn_flag",
    "churn_target",
    "customer_activity_score",
    "customer_activity_score_standard_scaled",
    "customer_activity_score_robust_scaled",
    "churn_risk_score_kpi",
    "churn_flag_kpi",
]


def train_churn(
    features_table: DataFrame, registry: ModelRegistry, budget: T.Budget = T.Budget(trees=150, rounds=150, trials=10)
) -> Outcome:
    """Hold-out split, stratified folds on the training part, hold-out metrics of the best.

    Customers without a label are scored but neither trained on nor judged.
    """
    spark = features_table.sparkSession
    features = T.feature_columns(features_table, ["customer_id", *CHURN_LEAKS])
    labelled = features_table.select("*", F.col("churn_flag").cast("double").alias("label"))
    vectors = T.assembled(labelled, features, ["customer_id", "label"])
    split = T.stored(T.holdout(vectors, "customer_id", "label"), "customer_id")
    known = split.where(F.col("label").isNotNull())
    train = T.stored(T.stratified_folds(known.where(~F.col("is_test")), "customer_id", "label", budget.folds))
    folds = T.held_out_folds(train, "customer_id", budget.folds)
    train = T.with_positive_weight(train, "label")

    log: list[dict] = []
    candidates, trials = T.classification_candidates(budget), T.random_trials("classification", budget)
    ranked, candidates = compared("classification", candidates, trials, folds, log, balanced=True)
    best = next(c for c in candidates if c.name == ranked[0]["model_name"])
    model = best.build().fit(train)
    metrics = T.CLASSIFICATION[0](model, known.where("is_test"))
    registry.register("churn_prediction_model", model, metrics, features, best.name, "Customer churn probability")
    predictions = T.scored(model, split).select(
        "customer_id",
        F.col("label").cast("int").alias("actual_churn"),
        F.col("prediction").cast("int").alias("predicted_churn"),
        F.col("score").alias("churn_probability"),
        "is_test",
    )
    return Outcome(
        _table(spark, "classification", ranked),
        model,
        features,
        metrics,
        {"predictions": predictions, "vectors": split, "log": experiment_log(spark, log)},
    )


# ---------------------------------------------------------------- demand


def boosting(rows: DataFrame, rounds: int, depth: int, rate: float, key: str) -> GBTRegressor | BoostedTrees:
    """The boosted learner of a regression: Spark's, or on large tables one whose rows are binned once; the same rounds, depth and rate."""
    if rows.count() < T.SPREAD_ROWS:
        return GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=rate, featuresCol=T.VECTOR, labelCol="label", seed=T.SEED)
    return BoostedTrees(Spec(False, rounds, depth, rate, l2=0.0), T.VECTOR, key)


def train_demand(
    orders: DataFrame,
    products: DataFrame,
    suppliers: DataFrame,
    registry: ModelRegistry,
    budget: T.Budget = T.Budget(trees=100, rounds=120),
) -> Outcome:
    """Two candidates on an 80/20 split of the panel, then forecasts, seasonality and stock needs."""
    spark = orders.sparkSession
    panel = demand_dataset(orders, products).select(
        "*", F.concat_ws("|", F.col("product_id").cast("string"), "order_month").alias("panel_key")
    )
    vectors = T.assembled(
        panel.select("*", F.col("target_demand").cast("double").alias("label")),
        DEMAND_FEATURES,
        ["panel_key", "product_id", "order_month", "label"],
    )
    split = T.stored(T.holdout(vectors, "panel_key"), "panel_key")
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    candidates = [
        T.Candidate(
            "random_forest",
            lambda: forest(train, False, budget.trees, min(8, budget.depth), "panel_key"),
        ),
        T.Candidate(
            "gradient_boosting",
            lambda: boosting(train, budget.rounds, min(5, budget.depth), 0.08, "panel_key"),
        ),
    ]
    # side by side: boosting is a chain of short jobs that leaves cores to the forest
    fitted = together(spark, [lambda c=c: c.build().fit(train) for c in candidates])
    models = {c.name: model for c, model in zip(candidates, fitted)}
    rows = [{"model_name": name, **T.REGRESSION[0](model, test)} for name, model in models.items()]
    ranked = T.best_regression(rows)
    best = ranked[0]
    model = models[best["model_name"]]
    metrics = {m: best[m] for m in ("mae", "rmse", "r2")}
    registry.register("demand_forecast_model", model, metrics, DEMAND_FEATURES, best["model_name"], "Monthly demand")
    forecasts = T.scored(model, split).select(
        "product_id", "order_month", F.col("label").alias("target_demand"), F.col("prediction").alias("predicted_demand")
    )
    return Outcome(
        _table(spark, "regression", ranked),
        model,
        DEMAND_FEATURES,
        metrics,
        {
            "forecasts": forecasts,
            "requirements": inventory_requirements(products, suppliers, forecasts),
            "seasonality": category_seasonality(orders),
        },
    )


# ---------------------------------------------------------------- risk


# model: row key, rule, and the columns the rule reads
RISK_JOBS: dict[str, tuple[str, Callable[[], Column], list[str]]] = {
    "financial_risk_model": ("order_month", financial_risk, ["dscr", "cash_balance", "debt_balance"]),
    "operational_risk_model": ("snapshot_key", operational_risk, ["stockout_risk", "inventory_utilization"]),
    "customer_risk_model": ("customer_id", customer_risk, ["churn_risk_score", "recency_days"]),
}

# columns by what they are computed from under another name; suffixes (lags, scalings, encodings) need no entry
MADE_OF = {
    "recency_days": ["days_since_last_order"],
    "days_since_last_order": ["recency_days"],
    "churn_flag": ["churn_risk_score"],
    "churn_target": ["recency_days"],
    "customer_activity_score": ["churn_risk_score"],
    "order_velocity": ["days_since_last_order"],
    "customer_value_proxy": ["order_velocity"],
    "inventory_utilization": ["on_hand_units", "reserved_units"],
    "stockout_risk": ["on_hand_units", "reserved_units"],
}


def made_from(columns: Sequence[str], roots: Sequence[str]) -> list[str]:
    """The columns among ``columns`` that are one of the roots or computed from one.

    A name that is another name plus a suffix (``_lag_1``, ``_minmax_scaled``, ``_kpi``) is
    computed from it; ``MADE_OF`` names the rest. Both are followed to the end.
    """
    known = set(roots)

    def derived(name: str) -> bool:
        return any(name == r or name.startswith(f"{r}_") for r in known)

    while True:
        more = {made for made, sources in MADE_OF.items() if made not in known and any(map(derived, sources))}
        if not more:
            return [c for c in columns if derived(c)]
        known |= more


def keyed_snapshots(inventory: DataFrame) -> DataFrame:
    """Snapshots with one text key out of date, warehouse and product."""
    day = F.date_format("snapshot_date", "yyyy-MM-dd")
    parts = [day, F.col("warehouse_id").cast("string"), F.col("product_id").cast("string")]
    return inventory.withColumn("snapshot_key", F.concat_ws("|", *parts))


def train_risk(
    name: str, frame: DataFrame, registry: ModelRegistry, budget: T.Budget = T.Budget(trees=100)
) -> Outcome:
    """A class-balanced forest on a rule label; accuracy on a hold-out fifth.

    What the rule reads, and every column computed from it, is left out: the
    forest cannot just repeat the rule.
    """
    key, rule, read = RISK_JOBS[name]
    label = rule()
    spark = frame.sparkSession
    labelled = frame.select("*", label.cast("double").alias("label"))
    features = T.feature_columns(labelled, [key, "label", *made_from(labelled.columns, read)])
    vectors = T.assembled(labelled, features, [key, "label", *[c for c in ("segment", "region") if c in frame.columns]])
    split = T.stored(T.holdout(vectors, key, "label"), key)
    train = T.with_class_weights(split.where(~F.col("is_test") & F.col("label").isNotNull()), "label")
    model = forest(train, True, budget.trees, budget.depth, key).fit(train)
    hit = (F.col("prediction") == F.col("label")).cast("double")
    judged = model.transform(split)
    row = judged.groupBy("is_test").agg(F.avg(hit).alias("accuracy")).collect()
    found = {("accuracy" if r.is_test else "train_accuracy"): r.accuracy for r in row}
    registry.register(name, model, found, features, "random_forest_classification", name.replace("_", " "))
    with_array = judged.withColumn("probabilities", vector_to_array("probability"))
    scores = risk_scores(with_array, "probabilities").select(
        key,
        *[c for c in ("segment", "region") if c in judged.columns],
        "risk_score",
        "risk_category",
        F.col("risk_confidence").alias("confidence"),
    )
    comparison = spark.createDataFrame(
        [(name, found.get("accuracy"), found.get("train_accuracy"))],
        "model_name string, accuracy double, train_accuracy double",
    )
    return Outcome(comparison, model, features, found, {"scores": scores, "vectors": split})


# ---------------------------------------------------------------- segmentation

SEGMENT_COLUMNS = ["annual_revenue", "total_revenue", "average_order_value", "customer_activity_score"]


def segment_customers(
    features_table: DataFrame, registry: ModelRegistry, clusters: int = 4, starts: int = 10
) -> Outcome:
    """K-means from several seeds (lowest cost wins), quality, personas and a 2-D projection."""
    spark = features_table.sparkSession
    scaled = [f"{c}_standard_scaled" for c in SEGMENT_COLUMNS]
    missing = [c for c, s in zip(SEGMENT_COLUMNS, scaled) if s not in features_table.columns]
    frame = scale(features_table, missing, "standard") if missing else features_table
    used = [c for c in scaled if c in numeric_columns(frame)]
    carried = ["customer_id", "annual_revenue", "customer_activity_score"]
    filled = frame.select(*carried, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in used])
    vectors = T.stored(T.assembled(filled, used, [*carried, *used]))
    fits = together(spark, [lambda i=i: KMeans(k=clusters, seed=T.SEED + i, featuresCol=T.VECTOR).fit(vectors) for i in range(starts)])
    model = min(fits, key=lambda m: m.summary.trainingCost)
    labelled = model.transform(vectors).withColumnRenamed("prediction", "cluster_id")
    metrics = {
        "silhouette": ClusteringEvaluator(featuresCol=T.VECTOR, predictionCol="cluster_id").evaluate(labelled),
        "davies_bouldin": davies_bouldin(labelled, "cluster_id", used),
    }
    centres = [(i, *map(float, c)) for i, c in enumerate(model.clusterCenters())]
    named = personas(spark.createDataFrame(centres, "cluster_id int, " + ", ".join(f"{c} double" for c in used)))
    projected = PCA(k=2, inputCol=T.VECTOR, outputCol="__pca").fit(vectors).transform(labelled)
    plane = vector_to_array("__pca")
    segments = projected.join(F.broadcast(named.select("cluster_id", "persona")), "cluster_id").select(
        "customer_id",
        "cluster_id",
        "persona",
        plane[0].alias("pca_x"),
        plane[1].alias("pca_y"),
        "annual_revenue",
        "customer_activity_score",
    )
    registry.register("customer_segmentation_model", model, metrics, used, "kmeans_clustering", "Customer segments")
    quality = spark.createDataFrame(
        [("kmeans", metrics["silhouette"], metrics["davies_bouldin"])],
        "model_name string, silhouette double, davies_bouldin double",
    )
    return Outcome(quality, model, used, metrics, {"segments": segments, "personas": named})
