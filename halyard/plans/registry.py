"""Model registry as an append-only table; the newest entry per name counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from threading import Lock

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators.selection import aligned
from halyard.sources.sinks import append_log, read_log

SCHEMA = (
    "name string, model_path string, metrics map<string,double>, feature_names array<string>, "
    "trained_at string, model_type string, description string"
)
REGRESSION_METRICS = ["mae", "rmse", "r2"]
_appending = Lock()
CLASS_METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]


class ModelRegistry:
    """Models and their entries under one folder all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.table = f"{self.folder}/registry.parquet"

    def register(
        self,
        name: str,
        model: Model,
        metrics: Mapping[str, float | None],
        feature_names: Sequence[str],
        model_type: str,
        description: str,
    ) -> str:
        """Save the model and append its entry; an earlier model of the name is superseded."""
        stamp = datetime.now(timezone.utc).isoformat()
        path = f"{self.folder}/{name}/{stamp.replace(':', '').replace('+', '_')}"
        model.write().overwrite().save(path)
        known = {k: float(v) for k, v in metrics.items() if v is not None}
        row = (name, path, known, list(feature_names), stamp, model_type, description)
        with _appending:  # jobs may run at once, two writers of one table may not
            append_log(self.spark.createDataFrame([row], SCHEMA).coalesce(1), self.table)
        return path

    def models(self) -> DataFrame:
        entries = read_log(self.spark, self.table, SCHEMA)
        newest = entries.groupBy("name").agg(F.max_by(F.struct(*entries.columns), "trained_at").alias("entry"))
        return newest.select("entry.*")

    def get(self, name: str):
        row = self.models().where(F.col("name") == name).first()
        if row is None:
            raise KeyError(name)
        return row

    def load(self, name: str) -> Model:
        return DefaultParamsReader.loadParamsInstance(self.get(name).model_path, self.spark.sparkContext)

    def predict(self, name: str, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Batch scoring: features aligned to the model's list, absent ones zero."""
        from halyard.plans.training import assembled, scored

        entry = self.get(name)
        features = list(entry.feature_names)
        ready = aligned(rows, features, keep=list(keep))
        return scored(self.load(name), assembled(ready, features, keep))

    def predict_together(self, requests: DataFrame, model: str, keep: Sequence[str]) -> DataFrame:
        """Score requests to several models at once: (model, kept columns, prediction, score).

        ``model`` names the column with each row's model; the other columns are the union of what the models
        read. Every part is aligned to its model's own list, and all parts are one plan. Score is null for
        regressors and clusterings. Rows of a null name or of a model that is not registered come back without prediction.
        """
        found = [r.name for r in self.models().select("name").collect()]  # one row a registered model
        shape = [model, *keep, "prediction", "score"]
        none = F.lit(None).cast("double")
        unknown = requests.where(~F.coalesce(F.col(model).isin(found), F.lit(False))) if found else requests
        out = unknown.withColumns({"prediction": none, "score": none}).select(*shape)
        for name in sorted(found):
            part = self.predict(name, requests.where(F.col(model) == name), [model, *keep])
            score = F.col("score") if "score" in part.columns else none
            out = out.unionByName(part.select(model, *keep, F.col("prediction").cast("double").alias("prediction"), score.alias("score")))
        return out


def leaderboard(models: DataFrame) -> DataFrame:
    """Regressors by MAE, the rest by F1, models without the metric last."""
    names = REGRESSION_METRICS + CLASS_METRICS
    metric = {m: F.try_element_at("metrics", F.lit(m)) for m in names}
    is_regression = F.arrays_overlap(F.map_keys("metrics"), F.array(*[F.lit(m) for m in REGRESSION_METRICS]))
    table = models.select(
        F.when(is_regression, "regression").otherwise("classification").alias("board"),
        "name",
        F.col("model_type").alias("algorithm"),
        "trained_at",
        "description",
        *[metric[m].alias(m) for m in names],
    )
    return table.orderBy("board", F.asc_nulls_last("mae"), F.desc_nulls_last("f1"), "name")
