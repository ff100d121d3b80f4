"""Model quality and scores from predictions, as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halyard.functions import half_up, ladder, safe_div, zero_if_none
from halyard.operators.ordered import area_under_curve, same_keys

# fixed values: risk limits
SCORE_LEVELS = [(70.0, "High"), (35.0, "Medium")]


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE and R2 in one pass, plus the mean as a scalar for the total variation."""
    mean = df.agg(F.avg(actual)).scalar()
    error = F.col(actual) - F.col(predicted)
    sums = df.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.sum(error * error).alias("residual"),
        F.sum((F.col(actual) - mean) * (F.col(actual) - mean)).alias("variation"),
    )
    return sums.select(
        "mae", F.sqrt("mse").alias("rmse"), (F.lit(1.0) - safe_div("residual", "variation")).alias("r2")
    )


def regression_metrics_by(df: DataFrame, by: list[str], actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE and R2 of every group in one pass."""
    error = F.col(actual) - F.col(predicted)
    sums = df.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.sum(error * error).alias("residual"),
        (F.var_pop(actual) * F.count(actual)).alias("variation"),
    )
    return sums.select(*by, "mae", F.sqrt("mse").alias("rmse"), (F.lit(1.0) - safe_div("residual", "variation")).alias("r2"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Count per (label, prediction), zero where a pair does not occur."""
    cells = [(a, p) for a in (0, 1) for p in (0, 1)]
    wide = df.agg(
        *[F.count_if((F.col(label) == a) & (F.col(predicted) == p)).alias(f"{a}{p}") for a, p in cells]
    )
    long = wide.unpivot([], [f"{a}{p}" for a, p in cells], "cell", "n")
    return long.select(
        F.substring("cell", 1, 1).cast("int").alias("actual"), F.substring("cell", 2, 1).cast("int").alias("predicted"), "n"
    )


def _cells(label: str, predicted: str) -> list[Column]:
    pairs = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    return [F.count_if((F.col(label) == a) & (F.col(predicted) == p)).alias(n) for n, (a, p) in pairs.items()]


def _shares() -> list[Column]:
    tp = F.col("tp").cast("double")
    return [
        safe_div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"),
        zero_if_none(safe_div(tp, F.col("tp") + F.col("fp"))).alias("precision"),
        zero_if_none(safe_div(tp, F.col("tp") + F.col("fn"))).alias("recall"),
        zero_if_none(safe_div(tp * 2.0, F.col("tp") * 2 + F.col("fp") + F.col("fn"))).alias("f1"),
    ]


def classification_metrics(df: DataFrame, label: str, predicted: str, score: str) -> DataFrame:
    """Accuracy, precision, recall, F1 (zero when undefined) and the ROC area."""
    return df.agg(*_cells(label, predicted)).select(*_shares(), area_under_curve(df, label, score).scalar().alias("roc_auc"))


def classification_metrics_by(df: DataFrame, by: list[str], label: str, predicted: str, score: str) -> DataFrame:
    """The same of every group: one aggregate and one running total, however many groups."""
    counts = df.groupBy(*by).agg(*_cells(label, predicted))
    areas = area_under_curve(df, label, score, by)
    joined = counts.join(areas, same_keys(counts, areas, by)).drop(*[areas[c] for c in by])
    return joined.select(*by, *_shares(), "roc_auc")


# ---------------------------------------------------------------- risk


def financial_risk() -> Column:
    """0 low, 1 medium, 2 high from debt cover and cash against debt."""
    debt = F.greatest(F.col("debt_balance"), F.lit(1.0))
    cash, cover = F.col("cash_balance"), F.col("dscr")
    return ladder(
        [((cover < 1.15) | (cash < F.lit(0.15) * debt), 2), ((cover < 1.5) | (cash < F.lit(0.40) * debt), 1)], 0
    )


def operational_risk() -> Column:
    risk, used = F.col("stockout_risk"), F.col("inventory_utilization")
    return ladder([((risk > 0.65) | (used > 0.8), 2), ((risk > 0.35) | (used > 0.5), 1)], 0)


def customer_risk() -> Column:
    """``recency_days`` is the days since the last order."""
    churn, recency = F.col("churn_risk_score"), F.col("recency_days")
    return ladder([((churn > 70) | (recency > 180), 2), ((churn > 40) | (recency > 90), 1)], 0)


def risk_scores(df: DataFrame, probability: str) -> DataFrame:
    """Score, category and confidence from an array of class probabilities (low, medium, high).

    A class the model never saw has no entry and counts as zero.
    """

    def p(i: int) -> Column:
        return F.coalesce(F.try_element_at(probability, F.lit(i)), F.lit(0.0))

    score = p(2) * F.lit(50.0) + p(3) * F.lit(100.0)
    return df.select(
        "*",
        half_up(score, 2).alias("risk_score"),
        ladder([(score >= limit, name) for limit, name in SCORE_LEVELS], "Low").alias("risk_category"),
        half_up(F.array_max(probability), 4).alias("risk_confidence"),
    )


# ---------------------------------------------------------------- segments


def cluster_profile(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """Centroid and mean distance to it, one row per cluster, in two aggregates."""
    centres = df.groupBy(cluster).agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    distance = F.sqrt(sum((F.col(c) - F.col(f"__{c}")) * (F.col(c) - F.col(f"__{c}")) for c in columns))
    # one row per cluster: without the hint every row would first be shuffled by its cluster
    return (
        df.join(F.broadcast(centres), cluster)
        .groupBy(cluster)
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.avg(distance).alias("spread"),
            *[F.first(f"__{c}").alias(c) for c in columns],
        )
    )


def davies_bouldin(df: DataFrame, cluster: str, columns: list[str]) -> float:
    """Mean over clusters of the worst (spread + spread) / distance; k rows reach the driver."""
    rows = cluster_profile(df, cluster, columns).collect()
    if len(rows) < 2:
        return 0.0

    def ratio(a, b) -> float:
        gap = math.dist([a[c] for c in columns], [b[c] for c in columns])
        return (a.spread + b.spread) / gap if gap else math.inf

    return sum(max(ratio(a, b) for b in rows if b[cluster] != a[cluster]) for a in rows) / len(rows)


def personas(centroids: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Name per cluster from its scaled centroid; a repeated name gets its group number."""
    revenue = F.coalesce("annual_revenue_standard_scaled", F.lit(0.0))
    total = F.coalesce("total_revenue_standard_scaled", F.lit(0.0))
    activity = F.coalesce("customer_activity_score_standard_scaled", F.lit(0.0))
    name = ladder(
        [
            ((revenue > 0.5) & (activity > 0.5), "Enterprise Champions"),
            ((total > 0.2) & (activity < -0.3), "At-Risk High-Value"),
            ((revenue < -0.2) & (activity > 0.4), "Active Growth SMB"),
        ],
        "Stable Mid-Market",
    )
    named = centroids.withColumn("__name", name)
    # one row per cluster
    seen = F.row_number().over(W.partitionBy("__name").orderBy(cluster))
    group = F.concat("__name", F.lit(" (Group "), (F.col(cluster) + 1).cast("string"), F.lit(")"))
    return named.withColumn("__seen", seen).select(
        *centroids.columns, F.when(F.col("__seen") == 1, F.col("__name")).otherwise(group).alias("persona")
    )
