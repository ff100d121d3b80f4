"""Random forests on binned rows: importances of many refits, and models of large tables.

Importance of features by forests whose rows are binned once, whatever the number of refits.

The rows become bin numbers in one written table. Where that is small (``BLOCK_BYTES``, checked) it is broadcast once and
every refit is one job of trees, each a task's own work, on the columns that are left. Beyond that size the rows stay put and Spark's
forest, which makes the sums of a level of all trees in one job, is fitted on the same columns, depth and number of trees;
its random draws are others.

``forest`` is the learner of a job: Spark's, or from ``SPREAD_ROWS`` rows on ``SpreadForest``, with the same trees, depth, bins and tried
features. Spark's walks every tree from its root for every row and keeps a count a row and tree; here tasks add up blocks with NumPy, one job a
level. The draws of a large table hang on the rows' keys, not on its partitions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.operators import forest as R
from halyard.plans import boosted, training
from halyard.plans.training import SEED, VECTOR, assembled, stored
from halyard.sources.scratch import drop_written, written

DEPTH = 12


class ForestRows:
    """The rows of a table ready for any number of forests on any of its features; rows without a target take no part."""

    def __init__(self, df: DataFrame, features: Sequence[str], target: str, classes: bool, depth: int = DEPTH, block_bytes: int = boosted.BLOCK_BYTES):
        self.features, self.classes, self.depth = list(features), classes, depth
        self.spark = df.sparkSession
        labelled = df.where(F.col(target).isNotNull())
        self.slim = stored(labelled.select(*[F.col(c).cast("double") for c in features], F.col(target).cast("double").alias("__label")))
        rows = assembled(self.slim.withColumnRenamed("__label", "label"), self.features, ["label"]) if features else None
        limits = boosted.limits_of(rows, VECTOR) if features else []
        self.shared = None if limits else self.spark.sparkContext.broadcast([])
        if not limits:  # no rows or no features
            return
        rows = rows.withColumn("__name", F.xxhash64(vector_to_array(VECTOR), "label"))
        shift, unit = boosted._unit(rows, classes)
        label = (F.col("label") - F.lit(shift)) / F.lit(unit)
        none = F.lit(0)
        packed = written(boosted.blocks(rows, VECTOR, "__name", limits, label, F.lit(1.0), none, none), "forest-blocks")
        size = packed.agg(F.sum(F.octet_length("bins"))).first()[0] or 0
        if size <= block_bytes:
            self.shared = self.spark.sparkContext.broadcast([tuple(r) for r in packed.collect()])  # BLOCK_BYTES
        drop_written(packed)

    def weights(self, left: Sequence[str], trees: int) -> dict[str, float]:
        """Importance of each of the features that are left, as shares."""
        if not left:
            return {}
        total = self._together(left, trees) if self.shared is not None else self._spread(left, trees)
        return dict(zip(left, (total / total.sum() if total.sum() > 0 else total).tolist()))

    def _together(self, left: Sequence[str], trees: int) -> np.ndarray:
        tried = max(1, math.ceil(math.sqrt(len(left)) if self.classes else len(left) / 3))
        spec = R.Spec(self.classes, self.depth, tried, SEED)
        places = [self.features.index(c) for c in left]
        shared = self.shared

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = boosted.Block(shared.value, 0) if shared.value else None
            if block is None:
                return
            bins, names = np.asfortranarray(block.bins[:, places]), R.told_apart(block.names)
            for batch in batches:
                numbers = batch.column(0).to_pylist()
                found = [R.tree_gains(spec, n, bins, names, block.label, boosted.BINS).tobytes() for n in numbers]
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(found, pa.binary())], ["tree", "gains"])

        slices = max(1, min(trees, self.spark.sparkContext.defaultParallelism))
        rows = self.spark.range(0, trees, 1, slices).mapInArrow(grow, "tree long, gains binary").collect()  # a number a tree and feature
        each = [np.frombuffer(r.gains) for r in sorted(rows, key=lambda r: r.tree)]
        return np.sum(each, axis=0) if each else np.zeros(len(left))

    def _spread(self, left: Sequence[str], trees: int) -> np.ndarray:
        kind = RandomForestClassifier if self.classes else RandomForestRegressor
        rows = assembled(self.slim.withColumnRenamed("__label", "label"), left, ["label"])
        fitted = kind(numTrees=trees, maxDepth=self.depth, maxBins=boosted.BINS, featuresCol=VECTOR, labelCol="label", seed=SEED).fit(rows)
        return fitted.featureImportances.toArray()

    def close(self) -> None:
        """Let the broadcast rows and the table go."""
        if self.shared is not None:
            self.shared.destroy()
        drop_written(self.slim)


# ---------------------------------------------------------------- forests that predict, rows of any number

ROWS = 1 << 17  # rows of a task that all trees read together
TASK_CELLS = 1 << 22  # sums a task holds; trees beyond it come in a further job
PART = 16  # nodes whose sums travel together
LIMIT_ROWS = 1 << 18  # rows, by hash, that the limits of the bins are taken from (Spark's forest takes 10,000)


def _limits(rows: DataFrame, key: str) -> list[list[float]]:
    """Limits of the bins by the quantiles of all rows, or of about LIMIT_ROWS by the hash of key and content."""
    many = rows.count()
    if many <= LIMIT_ROWS:
        return boosted.limits_of(rows, VECTOR)
    lot = F.pmod(F.xxhash64(F.lit(SEED), key, vector_to_array(VECTOR)), F.lit(1 << 20))
    some = rows.where(lot < int((1 << 20) * LIMIT_ROWS / many) + 1)
    return boosted.limits_of(some, VECTOR) or boosted.limits_of(rows, VECTOR)  # equal rows may all be left out


def grown(packed: DataFrame, spec: R.Spec, trees: int, features: int, kinds: int) -> list[R.Tree]:
    """All trees, a level at a time: tasks add up their rows for the nodes of all trees, Spark adds up the tasks and finds the cuts."""
    out = [R.Tree.empty(spec.depth, kinds if spec.classes else 1) for _ in range(trees)]
    fronts = {n: np.zeros(1, np.int64) for n in range(trees)}
    for level in range(spec.depth):
        fronts = {n: nodes for n, nodes in fronts.items() if len(nodes)}
        wide = min(spec.tried, features) * boosted.BINS * kinds
        runs: list[dict] = [{}]
        for n, nodes in fronts.items():
            if runs[-1] and (sum(map(len, runs[-1].values())) + len(nodes)) * wide > TASK_CELLS:
                runs.append({})
            runs[-1][n] = nodes
        for run in runs:
            for (n, part), row in _cuts(packed, spec, level, run, [out[n] for n in run], kinds).items():
                nodes = run[n][part * PART : (part + 1) * PART]
                after = R.take_cuts(spec, n, out[n], level, nodes, features, np.frombuffer(row).reshape(len(nodes), -1), kinds)
                fronts[n] = np.sort(np.concatenate([fronts[n][fronts[n] >= (2 << level) - 1], after]))
    return out


def _cuts(packed: DataFrame, spec: R.Spec, level: int, run: dict[int, np.ndarray], trees: Sequence[R.Tree], kinds: int) -> dict[tuple[int, int], bytes]:
    """The cuts of one level by tree and part of its nodes: a few numbers a node come back."""
    shared = packed.sparkSession.sparkContext.broadcast(list(zip(run, run.values(), trees)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for block in boosted.chunks(batches, 0, ROWS):
            flat = np.ascontiguousarray(block.bins.T).ravel()
            names = R.told_apart(block.names)
            target = block.label.astype(np.int64) if spec.classes else np.rint(block.label * R.FINE)
            weight = np.rint(block.weight * R.FINE)
            for n, nodes, tree in shared.value:
                found = R.level_sums(spec, n, tree, level, nodes, flat, names, target, weight, kinds, boosted.BINS)
                if n in totals:
                    totals[n] += found
                else:
                    totals[n] = found
        for n, total in totals.items():
            cells = [total[i : i + PART].tobytes() for i in range(0, len(total), PART)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * len(cells), pa.int64()), pa.array(range(len(cells)), pa.int64()), pa.array(cells, pa.binary())], ["tree", "part", "cells"]
            )

    def choose(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c) for c in frame["cells"])
        found = R.best_cuts(spec, total.reshape(-1, wide, boosted.BINS, kinds))
        return pd.DataFrame([(int(key[0]), int(key[1]), found.tobytes())], columns=["tree", "part", "found"])

    first = packed.select((F.octet_length("bins") / F.octet_length("names") * 8).cast("int").alias("n")).first()
    wide = min(spec.tried, first.n)
    sums = packed.mapInArrow(add, "tree long, part long, cells binary")
    rows = sums.groupBy("tree", "part").applyInPandas(choose, "tree long, part long, found binary").collect()
    shared.destroy()
    return {(r.tree, r.part): bytes(r.found) for r in rows}


class ForestModel(Model, DefaultParamsWritable, DefaultParamsReadable):
    """A forest as a Spark ML model: adds ``prediction``, and for classes ``probability``."""

    content = Param(Params._dummy(), "content", "trees, limits and scale as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, content: str | None = None):
        super().__init__()
        if content is not None:
            self._set(content=content)

    def _read(self) -> tuple[dict, list[R.Tree]]:
        told = json.loads(self.getOrDefault(self.content))
        trees = []
        for row in told["trees"]:
            tree = R.Tree.empty(told["depth"], told["kinds"])
            inner, used = row["inner"], row["used"]
            tree.feature[inner], tree.bin[inner], tree.gain[inner] = row["feature"], row["bin"], row["gain"]
            tree.cover[used], tree.value[used] = row["cover"], np.array(row["value"]).reshape(len(used), -1)
            trees.append(tree)
        return told, trees

    @property
    def numClasses(self) -> int:
        """Number of classes, 0 for a regression."""
        told = json.loads(self.getOrDefault(self.content))
        return told["kinds"] if told["classes"] else 0

    @property
    def featureImportances(self) -> DenseVector:
        """Gains by feature, every tree with the same weight, as shares."""
        told, trees = self._read()
        total = np.zeros(len(told["limits"]))
        for tree in trees:
            gains, inner = np.zeros(len(total)), tree.feature >= 0
            np.add.at(gains, tree.feature[inner], tree.gain[inner])
            total += gains / gains.sum() if gains.sum() > 0 else gains
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def nodes(self) -> list[tuple]:
        """(tree, id, value, cover, left, right, feature, limit) of every node; -1 for none. Values add up to the prediction, or to the
        probabilities (of two classes the second's)."""
        told, trees = self._read()
        out = []
        for number, tree in enumerate(trees):
            todo = [0]
            while todo:
                i = todo.pop()
                f = int(tree.feature[i])
                left, right = (2 * i + 1, 2 * i + 2) if f >= 0 else (-1, -1)
                value = tree.value[i][1:] if told["kinds"] == 2 else tree.value[i]
                if not told["classes"]:
                    value = value * told["unit"] + told["shift"]
                limit = told["limits"][f][tree.bin[i]] if f >= 0 else 0.0
                out.append((number, i, value / len(trees), float(tree.cover[i]), left, right, f, limit))
                todo += [c for c in (left, right) if c >= 0]
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        told, trees = self._read()
        depth, kinds = told["depth"], told["kinds"]
        shared = dataset.sparkSession.sparkContext.broadcast(([(t, t.handed_down() / len(trees)) for t in trees], [np.array(q) for q in told["limits"]]))

        @F.arrow_udf("array<double>")
        def means(x: pa.Array) -> pa.Array:
            trees, limits = shared.value
            n = len(x)
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(n, len(limits))
            flat = np.concatenate([np.searchsorted(e, values[:, i]).astype(np.uint8) for i, e in enumerate(limits)])
            rows, out = np.arange(n), np.zeros((n, kinds))
            for tree, value in trees:
                out += value.take(tree.place(flat, rows, n, depth), axis=0)
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * kinds), pa.array(out.ravel()))

        out = dataset.withColumn("__means", means(vector_to_array(VECTOR)))
        if not told["classes"]:
            return out.withColumn("prediction", F.col("__means")[0] * F.lit(told["unit"]) + F.lit(told["shift"])).drop("__means")
        best = F.array_position("__means", F.array_max("__means")) - 1
        return out.withColumn("probability", array_to_vector("__means")).withColumn("prediction", best.cast("double")).drop("__means")


@dataclass(frozen=True)
class SpreadForest:
    """Fits a forest on rows with a vector, a label and, where there is one, a weight; ``key`` names the rows.

    A third of the features are tried in a node, for classes the square root of their number; every tree draws the rows anew.
    """

    classes: bool
    trees: int
    depth: int
    key: str

    def fit(self, rows: DataFrame) -> ForestModel:
        limits = _limits(rows, self.key)
        many = len(limits)
        tried = max(1, math.ceil(math.sqrt(many) if self.classes else many / 3))
        spec = R.Spec(self.classes, self.depth, tried, SEED)
        shift, unit = boosted._unit(rows, self.classes)
        kinds = int(rows.agg(F.max("label")).first()[0]) + 1 if self.classes else 2
        weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
        none = F.lit(0)
        packed = written(boosted.blocks(rows, VECTOR, self.key, limits, (F.col("label") - F.lit(shift)) / F.lit(unit), weight, none, none), "forest-blocks")
        trees = []
        for tree in grown(packed, spec, self.trees, many, kinds):
            inner = np.flatnonzero(tree.feature >= 0)
            used = np.unique(np.concatenate([[0], 2 * inner + 1, 2 * inner + 2])).astype(np.int64)
            told = {"inner": inner, "feature": tree.feature[inner], "bin": tree.bin[inner], "gain": tree.gain[inner], "used": used, "cover": tree.cover[used]}
            trees.append({k: v.tolist() for k, v in told.items()} | {"value": tree.value[used].tolist()})
        drop_written(packed)
        told = {"trees": trees, "limits": limits, "unit": unit, "shift": shift, "classes": self.classes, "depth": self.depth, "kinds": kinds if self.classes else 1}
        return ForestModel(content=json.dumps(told))


def forest(rows: DataFrame, classes: bool, trees: int, depth: int, key: str) -> SpreadForest | RandomForestClassifier | RandomForestRegressor:
    """The learner for rows with a vector, a label and, for classes, a weight."""
    if rows.count() >= training.SPREAD_ROWS:
        return SpreadForest(classes, trees, depth, key)
    common = {"numTrees": trees, "maxDepth": depth, "featuresCol": VECTOR, "labelCol": "label", "seed": SEED}
    return RandomForestClassifier(weightCol="weight", **common) if classes else RandomForestRegressor(**common)
