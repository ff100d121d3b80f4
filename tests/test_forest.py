"""Random trees against plain loops, independence of row order, both plans, odd tables."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from halyard.operators import attribution
from halyard.operators import forest as R
from halyard.plans import forests
from halyard.plans import selecting as S
from halyard.plans.training import VECTOR


def plain_gains(spec, tree, bins, names, label):
    """The same tree by loops over nodes, features, cuts and rows, with the impurity as it is defined."""
    weight = R.drawn(spec, tree, names)
    gains = np.zeros(bins.shape[1])

    def impurity(rows):
        n = sum(weight[i] for i in rows)
        if spec.classes:
            shares = [sum(weight[i] for i in rows if label[i] == c) / n for c in sorted(set(label))]
            return n * (1 - sum(s * s for s in shares))
        mean = sum(weight[i] * label[i] for i in rows) / n
        return sum(weight[i] * (label[i] - mean) ** 2 for i in rows)

    nodes = [[i for i in range(len(label)) if weight[i] > 0]]
    for level in range(spec.depth):
        tried = R._tried(spec, tree, level, len(nodes), bins.shape[1])
        after = []
        for rows, features in zip(nodes, tried):
            best = (1e-9, None)
            for f in features:
                for cut in sorted({int(bins[i, f]) for i in rows})[:-1]:
                    left, right = [i for i in rows if bins[i, f] <= cut], [i for i in rows if bins[i, f] > cut]
                    gain = impurity(rows) - impurity(left) - impurity(right)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, left, right))
            if best[1]:
                f, left, right = best[1]
                gains[f] += best[0]
                after += [left, right]
        nodes = after
        if not nodes:
            break
    return gains / gains.sum() if gains.sum() else gains


def sample(n=120, features=6, seed=3):
    draw = np.random.default_rng(seed)
    bins = draw.integers(0, 9, (n, features)).astype(np.uint8)
    names = draw.integers(0, 2**63, n).astype(np.uint64)
    return bins, names, draw


@pytest.mark.parametrize("kinds", [0, 2, 4])
def test_a_tree_equals_plain_loops(kinds):
    bins, names, draw = sample()
    y = bins[:, 0].astype(float) + bins[:, 1] * 0.5 + draw.random(len(bins)) * 2
    label = np.floor(y / (y.max() + 1e-9) * kinds) if kinds else np.rint(y / y.max() * R.FINE) / R.FINE
    spec = R.Spec(kinds > 0, 4, 3)
    for tree in range(4):
        ours = R.tree_gains(spec, tree, bins, names, label, 32)
        assert ours == pytest.approx(plain_gains(spec, tree, bins, names, label), abs=1e-6)


def test_order_and_runs_of_nodes_do_not_matter(monkeypatch):
    bins, names, draw = sample(400)
    label = (bins[:, 2] > 4).astype(float)
    spec = R.Spec(True, 8, 2)
    whole = R.tree_gains(spec, 5, bins, names, label, 32)
    mixed = draw.permutation(len(bins))
    assert (R.tree_gains(spec, 5, bins[mixed], names[mixed], label[mixed], 32) == whole).all()
    monkeypatch.setattr(R, "CELLS", 1)
    assert R.tree_gains(spec, 5, bins, names, label, 32) == pytest.approx(whole, abs=1e-12)


def test_draws_are_poisson_and_repeated_rows_differ():
    names = R.told_apart(np.zeros(20000, np.uint64))
    assert len(set(names.tolist())) == 20000
    times = R.drawn(R.Spec(True, 3, 1), 0, names)
    assert times.mean() == pytest.approx(1.0, abs=0.03) and (times == 0).mean() == pytest.approx(np.exp(-1), abs=0.02)


def planted(spark, n=600):
    noise = [(F.abs(F.xxhash64("id", F.lit(i))) % 100).cast("double").alias(f"noise_{i}") for i in range(5)]
    signal = (F.abs(F.xxhash64("id", F.lit("s"))) % 100).cast("double")
    frame = spark.range(n).select("id", signal.alias("signal"), F.lit(1.0).alias("flat"), *noise)
    return frame.withColumn("y", (F.col("signal") > 60).cast("int")).withColumn("z", F.col("signal") * 3.0)


@pytest.mark.parametrize("target", ["y", "z"])
def test_both_plans_find_the_planted_feature(spark, target):
    df = planted(spark)
    names = ["flat", "signal", *[f"noise_{i}" for i in range(5)]]
    assert "signal" in S.eliminated(df, names, target, 2, trees=20)
    for block_bytes in (1 << 25, 0):
        rows = forests.ForestRows(df, names, target, target == "y", block_bytes=block_bytes)
        weights = rows.weights(names, 20)
        rows.close()
        assert sum(weights.values()) == pytest.approx(1.0) and weights["flat"] == 0.0
        assert max(weights, key=weights.get) == "signal" and weights["signal"] > 0.5


def test_partitions_do_not_matter(spark):
    df = planted(spark)
    names = ["signal", "noise_0", "noise_1"]
    found = []
    for parts in (1, 7):
        rows = forests.ForestRows(df.repartition(parts), names, "y", True)
        found.append(rows.weights(names, 10))
        rows.close()
    assert found[0] == found[1]


def test_odd_tables(spark):
    kinds = "a double, b double, y int"
    none = spark.createDataFrame([], kinds)
    assert len(S.eliminated(none, ["a", "b"], "y", 1, trees=3)) == 1
    assert [r.importance for r in S.tree_importance(none, ["a", "b"], "y", 3).collect()] == [0.0, 0.0]
    odd = [(None, 1.0, 0), (2.0, None, 1), (2.0, None, 1), (float(5), 3.0, None)] * 20
    weights = {r.feature: r.importance for r in S.tree_importance(spark.createDataFrame(odd, kinds), ["a", "b"], "y", 8).collect()}
    assert set(weights) == {"a", "b"} and sum(weights.values()) == pytest.approx(1.0)
    unlabelled = spark.createDataFrame([(1.0, 2.0, None)] * 5, kinds)
    assert [r.importance for r in S.tree_importance(unlabelled, ["a", "b"], "y", 3).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1.0, 2.0, 1)] * 5, kinds)
    assert {r.importance for r in S.tree_importance(one, ["a", "b"], "y", 3).collect()} == {0.0}
    assert S.eliminated(one, [], "y", 1) == []


@pytest.mark.parametrize("classes", [True, False])
def test_large_nodes_read_a_column_at_a_time_give_the_same(monkeypatch, classes):
    draw = np.random.default_rng(8)
    bins = draw.integers(0, 32, (3000, 9)).astype(np.uint8)
    label = bins[:, 2] + bins[:, 5] + draw.normal(0, 6, len(bins))
    label = (label > 31).astype(float) if classes else label / 64
    names = draw.integers(0, 1 << 62, len(bins)).astype(np.uint64)
    found = []
    for least in (1, 256, 1 << 30):
        monkeypatch.setattr(R, "LARGE", least)
        found.append(R.tree_gains(R.Spec(classes, 8, 3), 0, bins, names, label, 32))
    assert found[0].sum() == pytest.approx(1.0)
    assert all((f == found[0]).all() for f in found)


def plain_tree(spec, number, bins, names, label, weight, kinds):
    """One tree by loops over rows: {node: (feature, bin)} and the values of all nodes."""
    times = R.lots(spec.seed, number, names)
    at, cuts, values = np.zeros(len(names), int), {}, {}

    def sums(rows):
        if spec.classes:
            return np.array([sum(float(times[i]) * weight[i] for i in rows if label[i] == k) for k in range(kinds)])
        return np.array([sum(float(times[i]) for i in rows), sum(times[i] * label[i] for i in rows)])

    def held(x):
        return x / x.sum() if spec.classes else x[1:] / x[0]

    def square(x):
        return (x * x).sum() / x.sum() if spec.classes else x[1] ** 2 / x[0]

    for level in range(spec.depth):
        tried = R._tried(spec, number, level, 1 << level, bins.shape[1])
        for node in range((1 << level) - 1, (2 << level) - 1):
            rows = [i for i in range(len(names)) if at[i] == node and times[i]]
            if not rows:
                continue
            whole = sums(rows)
            values.setdefault(node, held(whole))
            best = (1e-9, None)
            for f in tried[node - (1 << level) + 1]:
                for cut in range(31):
                    left = [i for i in rows if bins[i, f] <= cut]
                    right = [i for i in rows if bins[i, f] > cut]
                    if left and right:
                        gain = square(sums(left)) + square(sums(right)) - square(whole)
                        if gain > best[0] + 1e-9:
                            best = (gain, (int(f), cut))
            if best[1]:
                cuts[node] = best[1]
                for i in rows:
                    at[i] = 2 * node + 1 + (bins[i, best[1][0]] > best[1][1])
                for child in (2 * node + 1, 2 * node + 2):
                    values[child] = held(sums([i for i in rows if at[i] == child]))
    return cuts, values


@pytest.mark.parametrize("classes", [True, False])
def test_trees_of_many_blocks_are_those_of_plain_loops(spark, monkeypatch, classes):
    from halyard.plans import boosted

    draw = np.random.default_rng(3)
    n = 240
    x = draw.integers(0, 6, (n, 5)).astype(float)
    label = (x[:, 0] + x[:, 1] > 5) * 1.0 + (x[:, 2] > 4) if classes else (x[:, 0] * 3 + x[:, 1] * x[:, 2] + draw.integers(0, 3, n)) / 64.0
    weight = draw.integers(1, 4, n) * 1.0
    rows = spark.createDataFrame([(i, Vectors.dense(x[i]), float(label[i]), float(weight[i])) for i in range(n)], ["id", VECTOR, "label", "weight"]).repartition(3)
    monkeypatch.setattr(forests, "ROWS", 50)
    monkeypatch.setattr(boosted, "BLOCK_ROWS", 20)
    monkeypatch.setattr(forests, "TASK_CELLS", 1000)
    monkeypatch.setattr(forests, "PART", 2)
    model = forests.SpreadForest(classes, 3, 3, "id").fit(rows)
    told, trees = model._read()
    names = np.array([r.h for r in rows.selectExpr("id", "xxhash64(id) h").orderBy("id").collect()], np.int64).astype(np.uint64)
    bins = np.stack([np.searchsorted(np.array(e), x[:, i]) for i, e in enumerate(told["limits"])], axis=1)
    scaled = label if classes else (label - told["shift"]) / told["unit"]
    spec = R.Spec(classes, 3, 3 if classes else 2, 42)
    mean = np.zeros((n, told["kinds"]))
    for number, tree in enumerate(trees):
        cuts, values = plain_tree(spec, number, bins, names, scaled, weight, told["kinds"])
        assert {int(i): (int(tree.feature[i]), int(tree.bin[i])) for i in np.flatnonzero(tree.feature >= 0)} == cuts
        for i in range(n):
            node = 0
            while node in cuts:
                node = 2 * node + 1 + (bins[i, cuts[node][0]] > cuts[node][1])
            assert np.abs(tree.value[node] - values[node]).max() < 1e-6
            mean[i] += values[node] / 3
    found = {r.id: r for r in model.transform(rows).collect()}
    for i in range(n):
        if classes:
            assert np.abs(found[i].probability.toArray() - mean[i]).max() < 1e-6 and found[i].prediction == found[i].probability.toArray().argmax()
        else:
            assert abs(found[i].prediction - (mean[i][0] * told["unit"] + told["shift"])) < 1e-6
    assert abs(model.featureImportances.toArray().sum() - 1.0) < 1e-9
    given = attribution.contributions(x, attribution.leaf_blocks(None, model))
    base = np.sum([v[2] for v in model.nodes() if v[1] == 0], axis=0)
    whole = given.sum(axis=1) + base
    assert np.abs(whole - (mean if classes else mean * told["unit"] + told["shift"])).max() < 1e-6


def test_the_learner_of_large_tables_is_saved_and_read_again(spark, monkeypatch, tmp_path):
    from pyspark.ml.regression import RandomForestRegressor
    from pyspark.ml.util import DefaultParamsReader

    rows = spark.createDataFrame([(i, Vectors.dense([i % 7, i % 5]), float(i % 7)) for i in range(300)], ["id", VECTOR, "label"])
    assert isinstance(forests.forest(rows, False, 2, 3, "id"), RandomForestRegressor)
    monkeypatch.setattr(forests.training, "SPREAD_ROWS", 300)
    model = forests.forest(rows, False, 20, 4, "id").fit(rows)
    model.write().save(str(tmp_path / "model"))
    again = DefaultParamsReader.loadParamsInstance(str(tmp_path / "model"), spark.sparkContext)
    pairs = [(r.prediction, s.prediction, r.label) for r, s in zip(model.transform(rows).collect(), again.transform(rows).collect())]
    assert all(a == b for a, b, _ in pairs) and sum(abs(a - c) for a, _, c in pairs) / 300 < 1.0
    assert sorted(model.transform(rows.limit(0)).collect()) == []


def test_large_tables_of_equal_or_unnamed_rows(spark, monkeypatch):
    monkeypatch.setattr(forests, "LIMIT_ROWS", 1)
    rows = spark.range(60).select(F.lit(None).cast("long").alias("id"), array_to_vector(F.array(F.lit(1.0), F.lit(2.0))).alias(VECTOR), F.lit(3.0).alias("label"))
    model = forests.SpreadForest(False, 2, 3, "id").fit(rows)
    assert {r.prediction for r in model.transform(rows).collect()} == {3.0}
    assert model.featureImportances.toArray().tolist() == [0.0, 0.0]
