"""Training jobs, registry, attribution and the drift stream on small data."""

import itertools
import math
from glob import glob

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from halyard.catalog.features import customer_feature_table
from halyard.operators import attribution as B
from halyard.operators import drift
from halyard.plans import jobs as J
from halyard.plans import selecting as S
from halyard.plans import training as T
from halyard.plans.registry import ModelRegistry, leaderboard
from halyard.sources import entities as E
from halyard.sources import scratch
from halyard.sources.tables import StarTables
from halyard.streaming.drift_batches import watch_drift

FOLDER = "/root/testdata/sf0.001"
TINY = T.Budget(trees=4, rounds=3, depth=3, trials=1, folds=2)


@pytest.fixture(scope="module")
def t(spark):
    return StarTables(spark, FOLDER)


@pytest.fixture
def registry(spark, tmp_path):
    return ModelRegistry(spark, str(tmp_path / "models"))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    data = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, d double, label double")
    return T.assembled(df, ["a", "b", "c", "d"], ["id", "label"]).cache()




def value_given(node, x, known, leaf_value):
    if node.numDescendants() == 0:
        return leaf_value(node)
    split, left, right = node.split(), node.leftChild(), node.rightChild()
    f = split.featureIndex()
    if f in known:
        return value_given(left if x[f] <= split.threshold() else right, x, known, leaf_value)
    nl, nr = left.impurityStats().count(), right.impurityStats().count()
    return (nl * value_given(left, x, known, leaf_value) + nr * value_given(right, x, known, leaf_value)) / (nl + nr)


def brute_shapley(root, x, leaf_value):
    n = len(x)
    out = []
    for i in range(n):
        others = [j for j in range(n) if j != i]
        total = 0.0
        for size in range(n):
            weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for known in itertools.combinations(others, size):
                total += weight * (
                    value_given(root, x, {*known, i}, leaf_value) - value_given(root, x, set(known), leaf_value)
                )
        out.append(total)
    return out


def test_attribution_equals_brute_force(spark, vectors, tmp_path):
    model = RandomForestRegressor(numTrees=1, maxDepth=5, featuresCol=T.VECTOR, seed=1, subsamplingRate=1.0).fit(vectors)
    blocks = B.leaf_blocks(B.saved_nodes(spark, model, str(tmp_path)), model)
    x = np.array([r[T.VECTOR].toArray() for r in vectors.limit(6).collect()])
    assert max(b.feature.shape[1] for b in blocks) > 2
    got = B.contributions(x, blocks)[:, :, 0]
    root = list(model._java_obj.trees())[0].rootNode()
    for row, phi in zip(x, got):
        assert phi == pytest.approx(brute_shapley(root, row, lambda n: n.prediction()), abs=1e-10)


@pytest.mark.parametrize(
    "kind,size",
    [
        (RandomForestClassifier, {"numTrees": 5, "maxDepth": 4}),
        (RandomForestRegressor, {"numTrees": 5, "maxDepth": 4}),
        (GBTRegressor, {"maxIter": 4, "maxDepth": 3}),
        (GBTClassifier, {"maxIter": 4, "maxDepth": 3}),
    ],
)
def test_attribution_adds_up(vectors, kind, size):
    from pyspark.ml.functions import vector_to_array

    model = kind(featuresCol=T.VECTOR, seed=1, **size).fit(vectors)
    long = B.attributions(model, vectors, "id", T.VECTOR, ["a", "b", "c", "d"])
    totals = long.groupBy("id", "class_id").agg((F.max("base_value") + F.sum("attribution")).alias("total"))
    scored = model.transform(vectors)
    if kind is RandomForestClassifier:
        want = scored.select("id", F.posexplode(vector_to_array("probability")).alias("class_id", "want"))
    elif kind is GBTClassifier:
        want = scored.select("id", F.lit(0).alias("class_id"), vector_to_array("rawPrediction")[1].alias("want"))
    else:
        want = scored.select("id", F.lit(0).alias("class_id"), F.col("prediction").alias("want"))
    worst = totals.join(want, ["id", "class_id"]).agg(F.max(F.abs(F.col("total") - F.col("want"))), F.count("*")).first()
    assert worst[0] < 1e-9 and worst[1] >= 300
    ranked = B.local_explanation(long, class_id=0).where("id = 0").orderBy("rank").collect()
    sizes = [abs(r.attribution) for r in ranked]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) == 4
    assert B.global_importance(long).count() == 4


def test_revenue_job(spark, t, registry):
    out = J.train_revenue(E.finance(t), registry, TINY)
    assert {r.model_name for r in out.comparison.collect()} == {"random_forest", "gradient_boosting", "boosted_subsample", "boosted_tuned"}
    row = out.results["forecast"].first()
    assert row.forecast_month == E.finance(t).agg(F.max("order_month")).first()[0]
    assert row.predicted_next_month_revenue > 0 and out.metrics["mae"] >= 0
    assert len(out.features) == 75
    assert out.results["log"].count() == 5


def test_churn_job_and_scoring(spark, t, registry):
    table = customer_feature_table(t)
    out = J.train_churn(table, registry, TINY)
    assert not set(out.features) & set(J.CHURN_LEAKS)
    assert out.results["predictions"].count() == table.count()
    scored = registry.predict("churn_prediction_model", table.drop("employee_count"), ["customer_id"])
    assert scored.where(F.col("score").between(0, 1)).count() == table.count()
    with pytest.raises(KeyError):
        registry.get("absent")


def test_demand_job(t, registry):
    out = J.train_demand(E.order_lines(t), E.products(t), E.suppliers(t), registry, TINY)
    assert out.results["requirements"].count() == E.products(t).count()
    assert out.results["forecasts"].where("predicted_demand is null").count() == 0


def test_segments(t, registry):
    out = J.segment_customers(customer_feature_table(t), registry, starts=2)
    assert -1 <= out.metrics["silhouette"] <= 1 and out.metrics["davies_bouldin"] >= 0
    assert out.results["segments"].where("persona is null").count() == 0
    bare = E.customer_kpis(t).select(
        "customer_id", "annual_revenue", "total_revenue",
        (F.col("total_revenue") / F.col("total_orders")).alias("average_order_value"),
        F.col("engagement_score").alias("customer_activity_score"),
    )
    assert J.segment_customers(bare, registry, starts=1).results["segments"].count() == bare.count()


def test_registry_keeps_the_newest(spark, vectors, registry):
    model = RandomForestClassifier(numTrees=2, maxDepth=2, featuresCol=T.VECTOR).fit(vectors)
    registry.register("m", model, {"f1": 0.2}, ["a"], "rf", "old")
    registry.register("m", model, {"f1": 0.4}, ["a", "b"], "rf", "new")
    registry.register("r", model, {"mae": 2.0}, ["a"], "rf", "reg")
    assert registry.get("m").description == "new" and registry.models().count() == 2
    assert [(r.board, r.name) for r in leaderboard(registry.models()).collect()] == [("classification", "m"), ("regression", "r")]


def test_selection(spark, vectors):
    from pyspark.ml.functions import vector_to_array

    x = vector_to_array(T.VECTOR)
    flat = vectors.select(F.col("label").cast("int").alias("y"), *[x[i].alias(c) for i, c in enumerate("abcd")])
    found = {r.feature: r.information for r in S.mutual_information(flat, list("abcd"), "y").collect()}
    assert max(found, key=found.get) == "a" and all(v >= 0 for v in found.values())
    assert len(S.eliminated(flat, list("abcd"), "y", 2, trees=4)) == 2
    report = S.selection_report(flat, list("abcd"), "y", "flat", k=2, trees=(4, 4)).collect()
    assert [r.rank for r in sorted(report, key=lambda r: r.rank)] == list(range(1, len(report) + 1))


def test_folds_cover_every_row(t):
    folds = T.stratified_folds(E.customers(t).select("customer_id", "churn_flag"), "customer_id", "churn_flag", 5)
    sizes = folds.groupBy("churn_flag", "fold").count().groupBy("churn_flag").agg(F.max("count") - F.min("count")).collect()
    assert all(r[1] <= 1 for r in sizes)


def test_drift_stream(spark, t, tmp_path):
    heads = E.order_heads(t).select("order_amount", "order_status")
    heads.limit(100).write.parquet(str(tmp_path / "in"))
    heads.limit(100).withColumn("order_amount", F.col("order_amount") + 1e7).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(heads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = watch_drift(stream, heads, "orders", str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True)
    query.awaitTermination(120)
    log = spark.read.parquet(str(tmp_path / "out/log")).collect()
    assert sorted(r.drift_detected for r in log) == [False, True]
    assert not [path for _, path in scratch._written if "drift-batch" in path]
    reports = {f: sorted(map(str, spark.read.parquet(f).collect())) for f in glob(f"{tmp_path}/out/report/*")}
    assert len(reports) == 2
    # the batches again without the reference: a new checkpoint replays them over the counts that are there
    again = watch_drift(stream, None, "orders", str(tmp_path / "out"), str(tmp_path / "ck2"), available_now=True)
    again.awaitTermination(120)
    assert again.exception() is None
    assert reports == {f: sorted(map(str, spark.read.parquet(f).collect())) for f in glob(f"{tmp_path}/out/report/*")}


def drift_frames(spark):
    rng = np.random.default_rng(3)
    schema = "a double, b long, empty double, kind string, day date"

    def frame(n, shift, kinds):
        rows = [(None if i % 9 == 0 else float(round(rng.normal() + shift, 1)), int(rng.integers(0, 5 + shift)), None, kinds[i % len(kinds)], None) for i in range(n)]
        return spark.createDataFrame(rows, schema)

    return frame(300, 0, ["x", "y", None]), frame(80, 2, ["y", "z", None, "w"])


def test_a_stored_profile_gives_the_report_of_the_reference(spark, tmp_path):
    reference, incoming = drift_frames(spark)
    reference.write.parquet(str(tmp_path / "reference-rows"))
    reference = spark.read.parquet(str(tmp_path / "reference-rows"))
    drift.profile_of(reference).write(str(tmp_path / "profile"))
    profile = drift.Profile.read(spark, str(tmp_path / "profile"))
    for batch in (incoming, incoming.drop("b", "kind"), incoming.limit(0)):
        want = drift.drift_report("d", reference, batch, reference.columns)
        got = drift.drift_against(profile, "d", batch)
        assert any("reference-rows" in f for f in want.inputFiles()) and not any("reference-rows" in f for f in got.inputFiles())
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_profiles_of_parts_merge(spark):
    reference, incoming = drift_frames(spark)
    halves = [reference.where(F.pmod(F.xxhash64(*reference.columns), F.lit(2)) == i) for i in (0, 1)]
    whole, parts = drift.profile_of(reference), drift.merged(*map(drift.profile_of, halves))
    for name in ("numbers", "texts", "ranges"):
        assert sorted(map(str, getattr(parts, name).collect())) == sorted(map(str, getattr(whole, name).collect()))
    got, want = (drift.drift_against(p, "d", incoming).collect() for p in (parts, whole))
    assert sorted(map(str, got)) == sorted(map(str, want))
    with pytest.raises(ValueError):
        drift.merged(whole, drift.profile_of(reference.drop("a")))


def test_a_profile_without_numbers_or_texts(spark, tmp_path):
    days = spark.sql("select date'2024-01-01' as day")
    drift.profile_of(days).write(str(tmp_path / "p"))
    rows = drift.drift_against(drift.Profile.read(spark, str(tmp_path / "p")), "d", days).collect()
    assert [(r.column_name, r.check_name, r.flagged) for r in rows] == [("day", "schema", False)]


def test_four_kinds_of_model_score_one_request_frame(spark, t, registry):
    kpis = E.customer_kpis(t).select("customer_id", "annual_revenue", "engagement_score", "total_orders", "days_since_last_order")
    labelled = kpis.withColumn("label", F.col("days_since_last_order") % 2).withColumn("amount", F.col("annual_revenue") / 2)
    classes, numbers = ["engagement_score", "total_orders"], ["total_orders", "days_since_last_order"]
    forest = RandomForestClassifier(featuresCol=T.VECTOR, labelCol="label", numTrees=5, seed=1)
    trees = GBTRegressor(featuresCol=T.VECTOR, labelCol="amount", maxIter=3, seed=1)
    fits = {
        "churn": (forest, classes, "label"), "risk": (forest.copy().setMaxDepth(3), ["days_since_last_order", *classes], "label"),
        "revenue": (trees, numbers, "amount"), "demand": (trees.copy().setMaxIter(2), ["annual_revenue", "total_orders"], "amount"),
    }
    for name, (learner, features, target) in fits.items():
        registry.register(name, learner.fit(T.assembled(labelled, features, [target])), {}, features, "tree", name)
    # every kind gets its rows; the revenue rows lack a feature, one model is not registered, one row names none
    parts = [kpis.withColumn("model", F.lit(name)) for name in ("churn", "risk", "demand", "other")]
    parts += [kpis.drop("days_since_last_order").withColumn("model", F.lit("revenue")), kpis.limit(1).withColumn("model", F.lit(None).cast("string"))]
    requests = parts[0]
    for part in parts[1:]:
        requests = requests.unionByName(part, allowMissingColumns=True)
    got = {(r.model, r.customer_id): (r.prediction, r.score) for r in registry.predict_together(requests, "model", ["customer_id"]).collect()}
    n = kpis.count()
    assert len(got) == 5 * n + 1
    for name, rows in (("churn", kpis), ("risk", kpis), ("demand", kpis), ("revenue", kpis.drop("days_since_last_order"))):
        for r in registry.predict(name, rows, ["customer_id"]).collect():
            prediction, score = got[name, r.customer_id]
            assert prediction == r.prediction and score == (r.score if "score" in r else None)
    assert all(v == (None, None) for (name, _), v in got.items() if name in (None, "other"))
    assert registry.predict_together(requests.limit(0), "model", ["customer_id"]).count() == 0


def test_what_is_computed_from_the_rule_is_left_out():
    columns = [
        "customer_id", "recency_days", "days_since_last_order", "days_since_last_order_kpi", "churn_risk_score_kpi", "churn_flag",
        "customer_activity_score", "customer_activity_score_robust_scaled", "order_velocity", "customer_value_proxy_standard_scaled",
        "annual_revenue", "engagement_score", "total_orders",
    ]
    made = J.made_from(columns, J.RISK_JOBS["customer_risk_model"][2])
    assert [c for c in columns if c not in made] == ["customer_id", "annual_revenue", "engagement_score", "total_orders"]
    finance = ["revenue", "cash_balance_robust_scaled", "debt_balance", "cash_balance_lag_1", "dscr", "opex"]
    assert J.made_from(finance, J.RISK_JOBS["financial_risk_model"][2]) == finance[1:5]


def test_a_scaled_copy_of_a_rule_column_is_rejected(spark, t, registry):
    finance = E.finance(t)
    copied = finance.withColumn("dscr_minmax_scaled", F.col("dscr") / 5.0)
    out = J.train_risk("financial_risk_model", copied, registry, TINY)
    assert set(out.features) == {"revenue", "gross_margin", "order_count", "cogs", "opex", "ebitda"}


FULL_JOBS = [
    "l7_regression_candidates", "l8_classification_candidates", "l9_random_search", "l10_model_comparison", "l13_revenue_forecast",
    "l14_churn_predictions", "l14_churn_prediction_rows", "l16_demand_forecasts", "l16_forecast_rows", "l16_stock_requirements",
    "x1_global_attribution", "x2_local_attribution", "x2_additivity",
]


@pytest.mark.parametrize("name", FULL_JOBS)
def test_registered_jobs_have_their_full_budget(spark, monkeypatch, name):
    """The budget is caught before anything is trained."""
    from __spark_entry__ import queries

    class Caught(Exception):
        pass

    def candidates(*given):
        raise Caught(given[-1])

    def demand(orders, products, suppliers, registry, budget=T.Budget(trees=100, rounds=120)):
        raise Caught(budget)

    for part in ("classification_candidates", "regression_candidates", "random_trials"):
        monkeypatch.setattr(T, part, candidates)
    monkeypatch.setattr(J, "train_demand", demand)
    with pytest.raises(Caught) as caught:
        queries()[name](spark, "/root/testdata/sf0.001")
    budget = caught.value.args[0]
    assert (budget.trees, budget.rounds) >= (100, 120) and budget.folds == 5 and budget.trials >= 10 and budget.depth == 8


def test_the_registered_package_eliminates_one_feature_at_a_refit(spark, monkeypatch):
    from __spark_entry__ import queries
    from halyard.plans import features as X

    class Caught(Exception):
        pass

    def report(*given, trees, step):
        raise Caught(trees, step)

    monkeypatch.setattr(S, "selection_report", report)
    monkeypatch.setattr(X, "feature_package", lambda *given: {"customer_features": given[0]["customers"]})
    with pytest.raises(Caught) as caught:
        queries()["e23_feature_package"](spark, FOLDER)
    assert caught.value.args == ((150, 250), 1)


def test_looked_up_contributions_are_those_worked_out_row_by_row():
    """Paths shared by leaves, open limits, values on a limit, several outputs."""
    draw = np.random.default_rng(6)
    depth, leaves = 4, 12
    feature = np.array([draw.permutation(6)[:depth] for _ in range(leaves)])
    low = np.where(draw.random((leaves, depth)) < 0.5, -np.inf, draw.integers(0, 4, (leaves, depth)) - 0.0)
    high = np.where(np.isinf(low), draw.integers(1, 5, (leaves, depth)) - 0.0, np.inf)
    block = B.LeafBlock(feature, low, high, draw.random((leaves, depth)), draw.random((leaves, 3)))
    x = draw.integers(0, 6, (B.RUN + 50, 6)).astype(float)
    looked_up, worked_out = np.zeros((2, 6, 3, len(x)))
    B._by_pattern(np.ascontiguousarray(x.T), block, looked_up)
    B._row_by_row(x, block, worked_out)
    assert np.abs(looked_up - worked_out).max() < 1e-12 and np.abs(looked_up).max() > 0.1
    assert np.abs(B.contributions(x, [block]) - worked_out.transpose(2, 0, 1)).max() < 1e-12


def test_large_tables_lie_in_equal_files(spark, monkeypatch):
    rows = spark.range(0, 3000, 1, 2).selectExpr("id", "id % 7 as v")
    assert len(T.stored(rows, "id").inputFiles()) == 2
    monkeypatch.setattr(T, "SPREAD_ROWS", 1000)
    spread = T.stored(rows, "id")
    assert len(spread.inputFiles()) == 3 * spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, rows.collect()))


def test_the_registry_of_linear_fits_reads_the_months_from_a_table(t, monkeypatch):
    from halyard.catalog import models

    read, stored = [], T.stored
    monkeypatch.setattr(models.T, "stored", lambda df, *key: read.append(stored(df, *key)) or read[-1])
    assert models.filled_registry(t).models().count() == 4
    assert len(read) == 1 and read[0].columns == ["label", T.VECTOR]


def test_two_leaves_of_one_parent_are_looked_up_together():
    class Ensemble:
        def nodes(self):  # (tree, id, value, cover, left, right, feature, limit); the second tree splits one feature twice
            return [
                (0, 0, 0.0, 10.0, 1, 2, 0, 0.1), (0, 1, 0.0, 6.0, 3, 4, 1, -0.2), (0, 2, 3.0, 4.0, -1, -1, -1, 0.0),
                (0, 3, 1.0, 2.0, -1, -1, -1, 0.0), (0, 4, -2.0, 4.0, -1, -1, -1, 0.0),
                (1, 0, 0.0, 10.0, 1, 2, 2, 0.0), (1, 1, 5.0, 5.0, -1, -1, -1, 0.0), (1, 2, 0.0, 5.0, 3, 4, 2, 0.5),
                (1, 3, -1.0, 1.0, -1, -1, -1, 0.0), (1, 4, 2.0, 4.0, -1, -1, -1, 0.0),
            ]

    blocks = B.leaf_blocks(None, Ensemble())
    assert sorted((len(b.feature), b.paired) for b in blocks) == [(2, False), (2, True), (2, True)]
    x = np.random.default_rng(2).normal(size=(64, 3))
    x[5, 0], x[6, 2] = np.nan, np.nan
    together, alone = B.contributions(x, blocks), np.concatenate([B.contributions(x[i : i + 1], blocks) for i in range(64)])
    assert np.abs(together - alone).max() < 1e-12
