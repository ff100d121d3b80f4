"""Splits, weights, candidates, search, comparison: the parts every training job shares."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halyard.operators.boosting import Spec
from halyard.operators.describe import numeric_columns
from halyard.operators.ordered import hash_positions
from halyard.operators.scoring import classification_metrics, classification_metrics_by, regression_metrics, regression_metrics_by
from halyard.plans import boosted
from halyard.plans.together import together
from halyard.sources.scratch import drop_written, written

SEED = 42
VECTOR = "__features"
SPREAD_ROWS = 1 << 18

# ---------------------------------------------------------------- columns and splits


def feature_columns(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    """Numeric columns that are not excluded, in frame order."""
    left_out = set(excluded)
    return [c for c in numeric_columns(df) if c not in left_out]


def assembled(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Kept columns and one vector of the features, missing values as zero."""
    filled = df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__{c}") for c in features])
    out = VectorAssembler(inputCols=[f"__{c}" for c in features], outputCol=VECTOR).transform(filled)
    return out.select(*keep, VECTOR)


def time_folds(months: DataFrame, order: str, splits: int) -> DataFrame:
    """Expanding windows over an ordered monthly series: each row once per fold it is in.

    The last ``splits`` blocks of n // (splits + 1) rows are the test parts.
    """
    numbered = months.select(
        "*",
        (F.row_number().over(W.orderBy(order)) - 1).alias("__i"),
        F.count(F.lit(1)).over(W.partitionBy()).alias("__n"),
    ).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(splits))))
    size = F.floor(F.col("__n") / F.lit(splits + 1))
    start = F.col("__n") - (F.lit(splits + 1) - F.col("fold")) * size
    part = F.when(F.col("__i") < start, "train").when(F.col("__i") < start + size, "test")
    return numbered.withColumn("part", part).where(F.col("part").isNotNull()).drop("__i", "__n")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = SEED) -> DataFrame:
    """``fold`` 0..folds-1, equally large within each class, by hash order of the key."""
    placed = hash_positions(df, key, [label], seed)
    return placed.withColumn("fold", (F.col("position") % folds).cast("int")).drop("position")


def holdout(df: DataFrame, key: str, label: str | None = None, one_in: int = 5, seed: int = SEED) -> DataFrame:
    """``is_test`` for one row in five, per class when a label is given."""
    placed = hash_positions(df, key, [label] if label else [], seed)
    return placed.withColumn("is_test", F.col("position") % one_in == 0).drop("position")


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    """``weight`` = rows / (classes * rows of the class), null without a label; one row per class reaches the driver."""
    labelled = df.where(F.col(label).isNotNull())
    counts = {r[label]: r["n"] for r in labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return df.withColumn("weight", F.lit(None).cast("double"))
    total = sum(counts.values())
    pairs = [F.lit(v) for k, n in counts.items() for v in (k, total / (len(counts) * n))]
    return df.withColumn("weight", F.try_element_at(F.create_map(*pairs), F.col(label)))


def with_positive_weight(df: DataFrame, label: str) -> DataFrame:
    """``weight`` = negatives / positives on the positive class, one on the other."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    return df.withColumn("weight", F.when(F.col(label) == 1, float(counts.n / max(counts.p, 1))).otherwise(1.0))


# ---------------------------------------------------------------- candidates


@dataclass(frozen=True)
class Budget:
    """How much training a job may spend. The defaults are the full runs."""

    trees: int = 250
    rounds: int = 250
    depth: int = 8
    trials: int = 12
    folds: int = 5


@dataclass
class Candidate:
    """An estimator of Spark ML, or an ensemble of ``plans.boosted`` by its ``spec``."""

    name: str
    build: Callable[[], object]
    params: Mapping[str, object] = field(default_factory=dict)
    spec: Spec | None = None


def _boosted(name: str, spec: Spec, params: Mapping[str, object] | None = None) -> Candidate:
    return Candidate(name, lambda: boosted.BoostedTrees(spec, VECTOR), params or {}, spec)


def regression_candidates(budget: Budget) -> list[Candidate]:
    """A forest and two boosted ensembles."""
    common = {"featuresCol": VECTOR, "labelCol": "label", "seed": SEED}
    return [
        Candidate(
            "random_forest",
            lambda: RandomForestRegressor(numTrees=budget.trees, maxDepth=budget.depth, minInstancesPerNode=2, **common),
        ),
        _boosted("gradient_boosting", Spec(False, budget.rounds, 3, 0.05)),
        _boosted("boosted_subsample", Spec(False, int(budget.rounds * 1.2), 4, 0.05, 0.9, 0.9)),
    ]


def classification_candidates(budget: Budget) -> list[Candidate]:
    common = {"featuresCol": VECTOR, "labelCol": "label", "weightCol": "weight", "seed": SEED}
    return [
        Candidate("random_forest", lambda: RandomForestClassifier(numTrees=budget.trees, maxDepth=budget.depth, **common)),
        _boosted("gradient_boosting", Spec(True, budget.rounds, 5, 0.1)),
    ]


# fixed values: search ranges
SEARCH = {
    "regression": {"rounds": (150, 450), "depth": (2, 6), "rate": (0.01, 0.15), "gain": (0.0, 1.0)},
    "classification": {"rounds": (100, 300), "depth": (3, 7), "rate": (0.01, 0.20), "gain": (0.0, 0.0)},
}
#: The rounds of a full budget; a smaller one shortens the drawn rounds in proportion, a larger one leaves the ranges.
FULL_ROUNDS = {"regression": 250, "classification": 150}
SHARE = (0.7, 1.0)


def random_trials(kind: str, budget: Budget, seed: int = SEED) -> list[Candidate]:
    """Seeded random draws over the boosted ensemble's ranges; the rate is drawn on a log scale."""
    ranges = SEARCH[kind]
    shallow, deep = ranges["depth"]
    draw = random.Random(seed)
    trials = []
    for i in range(budget.trials):
        params = {
            "rounds": max(2, int(draw.randint(*ranges["rounds"]) * min(1.0, budget.rounds / FULL_ROUNDS[kind]))),
            "depth": draw.randint(shallow, max(shallow, min(deep, budget.depth))),
            "rate": math.exp(draw.uniform(*map(math.log, ranges["rate"]))),
            "rows_share": draw.uniform(*SHARE),
            "columns_share": draw.uniform(*SHARE),
            "least_weight": float(draw.randint(1, 6)),
            "least_gain": draw.uniform(*ranges["gain"]),
        }
        trials.append(_boosted(f"trial_{i + 1}", Spec(kind == "classification", seed=seed + i, **params), params))
    return trials


# ---------------------------------------------------------------- scoring and comparison


def scored(model: Model, rows: DataFrame) -> DataFrame:
    """Predictions; classifiers also get the probability of class one as ``score``."""
    out = model.transform(rows)
    if "probability" in out.columns:
        out = out.withColumn("score", vector_to_array("probability")[1])
    return out


def _regression_row(model: Model, rows: DataFrame) -> dict[str, float]:
    return regression_metrics(scored(model, rows), "label", "prediction").first().asDict()


def _classification_row(model: Model, rows: DataFrame) -> dict[str, float]:
    return classification_metrics(scored(model, rows), "label", "prediction", "score").first().asDict()


@dataclass
class Folds:
    """Rows with a vector and a label, and bits for the folds that they train and test."""

    rows: DataFrame
    key: str
    count: int

    def frames(self) -> list[tuple[DataFrame, DataFrame]]:
        """(train, test) of every fold."""

        def part(column: str, k: int) -> DataFrame:
            return self.rows.where(F.col(column).bitwiseAND(1 << k) != 0)

        return [(part("__train", k), part("__test", k)) for k in range(self.count)]


def held_out_folds(data: DataFrame, key: str, count: int) -> Folds:
    """Every value of ``fold`` 0..count-1 is the test part once, all others train."""
    own = F.expr("shiftleft(1, fold)")
    return Folds(stored(data.select("*", own.alias("__test"), (F.lit((1 << count) - 1) - own).alias("__train")), key), key, count)


def one_split(data: DataFrame, key: str) -> Folds:
    """One fold: the rows that ``is_test`` marks are the test part."""
    test = F.col("is_test").cast("int")
    return Folds(stored(data.select("*", test.alias("__test"), (1 - test).alias("__train")), key), key, 1)


def expanding_folds(known: DataFrame, order: str, splits: int) -> Folds:
    """``time_folds`` as bits on the rows."""
    fold = time_folds(known.select(order), order, splits).withColumn("bit", F.expr("shiftleft(1, fold - 1)"))
    masks = fold.groupBy(order).agg(
        *[F.sum(F.when(F.col("part") == part, F.col("bit")).otherwise(0)).cast("int").alias(f"__{part}") for part in ("train", "test")]
    )
    return Folds(stored(known.join(masks, order)), order, splits)


def positive_weights(folds: Folds) -> list[float]:
    """Negatives by positives in the training part of every fold, from one aggregate."""
    bits = [F.col("__train").bitwiseAND(1 << k) != 0 for k in range(folds.count)]
    found = folds.rows.agg(
        *[F.struct(F.count_if(b & (F.col("label") == 1)).alias("p"), F.count_if(b & (F.col("label") == 0)).alias("n")).alias(f"f{k}") for k, b in enumerate(bits)]
    ).first()
    return [float(r.n / max(r.p, 1)) for r in found]


def fold_metrics(kind: str, candidates: Sequence[Candidate], folds: Folds, balanced: bool = False) -> list[dict]:
    """Mean metrics of every candidate over the folds.

    All boosted ensembles are fitted by one call of ``plans.boosted``, the others in a pool of Spark fits. The scores of all
    candidates and folds are written once, and judged by one aggregate and one running total. With ``balanced`` the
    positive rows weigh as much as the negative ones of the fold's training part.
    """
    spark = folds.rows.sparkSession
    positive = positive_weights(folds) if balanced else [1.0] * folds.count
    numbers = [(i, k) for i in range(len(candidates)) for k in range(folds.count)]
    model = {pair: n for n, pair in enumerate(numbers)}
    own = [(i, k) for i, k in numbers if candidates[i].spec]
    parts = []
    if own:
        tasks = [boosted.Task(candidates[i].spec, k, positive[k]) for i, k in own]
        found = boosted.fold_scores(folds.rows, VECTOR, folds.key, F.col("__train"), F.col("__test"), folds.count, tasks)
        parts.append(found.withColumn("model", F.get(F.array(*[F.lit(model[p]) for p in own]), F.col("model"))))
    frames = folds.frames()

    def fit(i: int, k: int) -> DataFrame:
        train, test = frames[k]
        if balanced:
            train = train.withColumn("weight", F.when(F.col("label") == 1, positive[k]).otherwise(1.0))
        out = scored(candidates[i].build().fit(train), test)
        score = F.col("score") if "score" in out.columns else F.lit(None).cast("double")
        return out.select(F.lit(model[i, k]).alias("model"), "label", "prediction", score.alias("score"))

    parts += together(spark, [lambda i=i, k=k: fit(i, k) for i, k in numbers if not candidates[i].spec])
    scores = written(reduce(DataFrame.unionByName, parts), "fold-scores")
    if kind == "regression":
        judged = regression_metrics_by(scores, ["model"], "label", "prediction")
    else:
        judged = classification_metrics_by(scores, ["model"], "label", "prediction", "score")
    names = [c for c in judged.columns if c != "model"]
    by_model = {r.model: r for r in judged.collect()}
    drop_written(scores)
    out = []
    for i, candidate in enumerate(candidates):
        rows = [by_model[model[i, k]] for k in range(folds.count) if model[i, k] in by_model]
        means = {}
        for name in names:
            values = [r[name] for r in rows if r[name] is not None]
            means[name] = sum(values) / len(values) if values else None
        out.append({"model_name": candidate.name, **means})
    return out


def best_regression(rows: list[dict]) -> list[dict]:
    """By MAE, RMSE, then R2; candidates only, a handful of rows."""
    return sorted(rows, key=lambda r: (r["mae"], r["rmse"], -(r["r2"] if r["r2"] is not None else float("-inf"))))


def best_classification(rows: list[dict]) -> list[dict]:
    return sorted(rows, key=lambda r: -r["f1"])


REGRESSION = (_regression_row, best_regression)
CLASSIFICATION = (_classification_row, best_classification)


def stored(df: DataFrame, key: str | None = None) -> DataFrame:
    """A written table: the fits below read its columns many times and survive lost executors.

    With ``key`` a table of ``SPREAD_ROWS`` rows or more lies in equal files, three for every core: Spark's learners pass over it once a level
    with a task a file, and few uneven files leave cores idle each time.
    """
    table = written(df, "training")
    if key is None or table.count() < SPREAD_ROWS:
        return table
    spread = written(table.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, key), "training")
    drop_written(table)
    return spread


def importances(model: Model, features: Sequence[str], spark, top: int | None = None) -> DataFrame:
    """Feature importances in falling order."""
    rows = sorted(zip(features, model.featureImportances.toArray().tolist()), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows[:top] if top else rows, "feature string, importance double")
