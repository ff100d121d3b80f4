"""Many boosted ensembles at once: all trials and folds of a search over one binned table.

The rows become bin numbers once, in a written table of packed blocks. Then there are two plans with equal results,
as sums of gradients are exact:

* ``apart``: where the binned training rows are small (``BLOCK_BYTES``, checked), they are broadcast and every
  model is a Spark task.
* ``level_by_level``: rows of any number stay where they are. One job a level makes the sums of all models
  from one read of the columns it needs: each task adds up its blocks. Where the sums of all tasks are few (``SUM_BYTES``, checked) the
  driver adds up the tasks, else Spark does by (model, node) and finds the split there; a row a node comes back. The number of jobs
  is rounds times depth whatever the number of models.
  Margins are kept in the table, which is written anew every ``REFRESH`` rounds; between, tasks add the trees since.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.operators import boosting as B
from halyard.sources.scratch import drop_written, written

BINS = 32
BLOCK_BYTES = 96 << 20
BLOCK_ROWS = 1 << 14
ROWS = 1 << 17  # rows of a task that are added up together
SUM_BYTES = 32 << 20
REFRESH = 2
PARTS = "names binary, label binary, weight binary, train binary, test binary, bins binary, margins binary"


@dataclass(frozen=True)
class Task:
    """One model: its spec, the bit of its training and test rows, and the weight of positive rows."""

    spec: B.Spec
    fold: int = 0
    positive: float = 1.0


# ---------------------------------------------------------------- binned rows


def limits_of(rows: DataFrame, vector: str, bins: int = BINS) -> list[list[float]]:
    """For every feature the upper limits of its bins but the last: quantiles, or all values where they are few."""
    wide = rows.select(vector_to_array(vector).alias("x"))
    first = wide.first()
    if first is None:
        return []
    names = [f"x{i}" for i in range(len(first.x))]
    flat = wide.select(*[F.col("x")[i].alias(c) for i, c in enumerate(names)])
    found = flat.approxQuantile(names, [i / bins for i in range(1, bins)], 0.001)
    return [sorted(set(q)) for q in found]


def blocks(rows: DataFrame, vector: str, key: str, limits: list[list[float]], label: Column, weight: Column, train: Column, test: Column) -> DataFrame:
    """Rows in packed blocks; ``train`` and ``test`` have a bit for every fold. One value of weight or bits that all rows have is held once."""
    edges = rows.sparkSession.sparkContext.broadcast([np.array(q) for q in limits])  # BINS numbers a feature

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                names, label, weight, train, test, x = batch.slice(start, BLOCK_ROWS).columns
                values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                bins = np.stack([np.searchsorted(e, values[:, i]) for i, e in enumerate(edges.value)], axis=1).astype(np.uint8)
                label, *more = (c.to_numpy(zero_copy_only=False) for c in (label, weight, train, test))
                parts = [names.to_numpy().tobytes(), label.tobytes(), *((c[:1] if (c == c[0]).all() else c).tobytes() for c in more), bins.tobytes(), b""]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], [c.split()[0] for c in PARTS.split(", ")])

    slim = rows.select(
        F.xxhash64(key).alias("names"),
        F.coalesce(label.cast("double"), F.lit(0.0)).alias("label"),
        weight.cast("double").alias("weight"),
        train.cast("long").alias("train"),
        test.cast("long").alias("test"),
        vector_to_array(vector).alias("x"),
    )
    return slim.mapInArrow(pack, PARTS)


class Block:
    """The unpacked rows of one or more packed blocks."""

    def __init__(self, parts: Sequence[Sequence[bytes]], models: int):
        kinds = [np.uint64, np.float64, np.float64, np.int64, np.int64]
        sizes = [len(p[1]) // 8 for p in parts]

        def column(i: int) -> np.ndarray:
            read = [np.frombuffer(p[i], kinds[i]) for p in parts]
            if i > 1 and all(len(x) == 1 and x[0] == read[0][0] for x in read):
                return np.broadcast_to(read[0], sum(sizes))
            return np.concatenate([np.repeat(x, n) if i > 1 and len(x) == 1 else x for x, n in zip(read, sizes)])

        self.names, self.label, self.weight, self.train, self.test = map(column, range(5))
        self.bins = np.concatenate([np.frombuffer(p[5], np.uint8).reshape(n, -1) for p, n in zip(parts, sizes)])
        self.margins = None
        if parts[0][6]:
            self.margins = np.concatenate([np.frombuffer(p[6], np.float64).reshape(n, models) for p, n in zip(parts, sizes)])

    def weights(self, task: Task) -> np.ndarray:
        return np.where(self.label == 1, self.weight * task.positive, self.weight) if task.spec.classes else self.weight

    def trains(self, task: Task) -> np.ndarray:
        return (self.train >> task.fold) & 1 == 1

    def tests(self, task: Task) -> np.ndarray:
        return (self.test >> task.fold) & 1 == 1


def chunks(batches: Iterator[pa.RecordBatch], models: int, rows: int) -> Iterator[Block]:
    """The packed blocks of a task, some together."""
    held, size = [], 0
    for batch in batches:
        for parts in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(parts)
            size += len(parts[1]) // 8
            if size >= rows:
                yield Block(held, models)
                held, size = [], 0
    if held:
        yield Block(held, models)


def bases(packed: DataFrame, tasks: Sequence[Task], folds: int) -> list[float]:
    """The margin that every model starts from: zero, or the mean label of its training rows."""
    if all(t.spec.classes for t in tasks):
        return [0.0] * len(tasks)

    def add(batches):
        for batch in batches:
            for parts in zip(*(c.to_pylist() for c in batch.columns)):
                block = Block([parts], 0)
                bits = (block.train[:, None] >> np.arange(folds)) & 1
                exact = np.rint(block.label * B.FINE)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(folds)), pa.array(bits.T @ exact), pa.array(bits.sum(axis=0))], ["fold", "total", "n"])

    sums = packed.mapInArrow(add, "fold long, total double, n long").groupBy("fold").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    means = {r.fold: r.t / B.FINE / r.n if r.n else 0.0 for r in sums.collect()}
    return [0.0 if t.spec.classes else means.get(t.fold, 0.0) for t in tasks]


# ---------------------------------------------------------------- two plans

SCORED = "model long, label double, margin double"


def _scores(model: int, label: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(label), model)), pa.array(label), pa.array(margin)], ["model", "label", "margin"])


def packed_trees(trees: Sequence[B.Tree]) -> str:
    """The nodes of all trees as JSON."""
    rows = []
    for tree in trees:
        inner = np.flatnonzero(tree.feature >= 0).tolist()
        used = sorted({0, *(c for i in inner for c in (2 * i + 1, 2 * i + 2))})
        rows.append({
            "size": len(tree.feature), "inner": inner, "feature": tree.feature[inner].tolist(), "bin": tree.bin[inner].tolist(),
            "gain": tree.gain[inner].tolist(), "used": used, "value": tree.value[used].tolist(), "cover": tree.cover[used].tolist(),
        })
    return json.dumps(rows)


def unpacked_trees(text: str) -> list[B.Tree]:
    trees = []
    for row in json.loads(text):
        tree = B.Tree.empty((row["size"] + 1).bit_length() - 2)
        tree.feature[row["inner"]], tree.bin[row["inner"]], tree.gain[row["inner"]] = row["feature"], row["bin"], row["gain"]
        tree.value[row["used"]], tree.cover[row["used"]] = row["value"], row["cover"]
        trees.append(tree)
    return trees


def apart(packed: DataFrame, tasks: Sequence[Task], starts: Sequence[float], unit: float, trees: bool = False) -> DataFrame:
    """Every model in a task of its own, over broadcast blocks of a checked size: scores of its test rows, or its trees."""
    spark = packed.sparkSession
    if not any(t.spec.rows_share < 1.0 for t in tasks):  # no row is drawn
        packed = packed.withColumn("names", F.lit(b""))
    shared = spark.sparkContext.broadcast(([tuple(r) for r in packed.collect()], list(tasks), list(starts)))  # BLOCK_BYTES

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, tasks, starts = shared.value
        block = Block(parts, 0)
        by_column = np.ascontiguousarray(block.bins.T)
        block.bins = None
        for batch in batches:
            for number in batch.column(0).to_pylist():
                task = tasks[number]
                grown, margin = B.fitted_by_column(
                    task.spec, by_column, block.names, block.label, block.weights(task), starts[number], BINS, unit, block.trains(task)
                )
                if trees:
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packed_trees(grown)])], ["model", "trees"])
                else:
                    mine = block.tests(task)
                    yield _scores(number, block.label[mine], margin[mine])

    # the longest first, so that none of them runs alone at the end
    order = sorted(range(len(tasks)), key=lambda n: -tasks[n].spec.rounds * tasks[n].spec.depth * tasks[n].spec.rows_share * tasks[n].spec.columns_share)
    place = F.lit([*order]) if order else F.array().cast("array<int>")
    numbers = spark.range(0, len(tasks), 1, len(tasks) or 1).select(F.get(place, F.col("id").cast("int")).cast("long").alias("id"))
    return numbers.mapInArrow(fit, "model long, trees string" if trees else SCORED)


def level_by_level(packed: DataFrame, tasks: Sequence[Task], starts: Sequence[float], unit: float, trees: bool = False):
    """All models together, a job a level: scores of every model's test rows, or the trees of all."""
    spark = packed.sparkSession
    n = len(tasks)
    first = packed.select(F.octet_length("bins") / F.octet_length("names") * 8).first()
    features = int(first[0]) if first else 0
    grown: list[list[B.Tree]] = [[] for _ in tasks]
    since = [0] * n  # trees that the table's margins hold already
    table, parts = None, packed.rdd.getNumPartitions()

    def margins(block: Block, model: int, more: Sequence[B.Tree], starts) -> np.ndarray:
        out = np.full(len(block.label), starts[model]) if block.margins is None else block.margins[:, model]
        for tree in more:
            out = out + tree.value[tree.place(block.bins)]
        return out

    def refreshed() -> DataFrame:
        shared = spark.sparkContext.broadcast(([g[s:] for g, s in zip(grown, since)], list(starts)))

        def add(batches):
            later, starts = shared.value
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    block = Block([row], n)
                    now = np.stack([margins(block, m, later[m], starts) for m in range(n)], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in [*row[:6], now.tobytes()]], batch.schema.names)

        return written((table if table is not None else packed).mapInArrow(add, PARTS), "boosted-margins")

    def splits(growing: dict[int, B.Growing]) -> dict[int, np.ndarray]:
        later = {m: grown[m][since[m] :] for m in growing}
        shared = spark.sparkContext.broadcast((growing, later, list(tasks), list(starts)))

        def add(batches):
            growing, later, tasks, starts = shared.value
            totals: dict[int, np.ndarray] = {}
            for block in chunks(batches, n, ROWS):
                for m, now in growing.items():
                    task = tasks[m]
                    g, h = B.gradients(task.spec, block.label, block.weights(task), margins(block, m, later[m], starts))
                    some = B.drawn(task.spec, now.number, block.names)
                    rows = np.flatnonzero(block.trains(task) if some is None else block.trains(task) & some)
                    part = block.bins if len(rows) == len(g) else block.bins[rows]
                    found = B.sums(part, now.tree.place(part, now.level), now.frontier, now.columns, g[rows], h[rows], BINS)
                    totals[m] = totals[m] + found if m in totals else found
            for m, total in totals.items():
                nodes = growing[m].frontier
                cells = [np.ascontiguousarray(total[:, i]).tobytes() for i in range(len(nodes))]
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(nodes)), pa.array(nodes), pa.array(cells, pa.binary())], ["model", "node", "cells"])

        def best(growing, tasks, model: int, cells) -> np.ndarray:
            total = sum(np.frombuffer(c, np.float64) for c in cells).reshape(2, 1, len(growing[model].columns), BINS)
            return B.best_splits(total, tasks[model].spec, unit)[0]

        def choose(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            model, node = int(key[0]), int(key[1])
            growing, _, tasks, _ = shared.value
            return pd.DataFrame([(model, node, best(growing, tasks, model, frame["cells"]).tolist())], columns=["model", "node", "split"])

        held = table if table is not None else packed
        if not any(tasks[m].spec.rows_share < 1.0 for m in growing):
            held = held.withColumn("names", F.lit(b""))
        sums = held.mapInArrow(add, "model long, node long, cells binary")
        if sum(16 * BINS * len(now.columns) * len(now.frontier) for now in growing.values()) * parts <= SUM_BYTES:
            cells: dict[tuple[int, int], list] = {}
            for r in sums.collect():  # SUM_BYTES
                cells.setdefault((r.model, r.node), []).append(r.cells)
            known = {pair: best(growing, tasks, pair[0], found) for pair, found in cells.items()}
        else:
            rows = sums.groupBy("model", "node").applyInPandas(choose, "model long, node long, split array<double>").collect()
            known = {(r.model, r.node): r.split for r in rows}
        shared.destroy()
        none = [-1.0, 0, 0, 0.0, 0.0, 0.0, 0.0]
        return {m: np.array([known.get((m, node), none) for node in now.frontier]) for m, now in growing.items()}

    for number in range(max((t.spec.rounds for t in tasks), default=0)):
        all_growing = {m: B.Growing(t.spec, number, features) for m, t in enumerate(tasks) if number < t.spec.rounds}
        open_ones = all_growing
        while open_ones:
            found = splits(open_ones)
            open_ones = {m: now for m, now in open_ones.items() if now.take(found[m])}
        for m, now in all_growing.items():
            grown[m].append(now.tree)
        if (number + 1) % REFRESH == 0:
            old, table = table, refreshed()
            since = [len(g) for g in grown]
            if old is not None:
                drop_written(old)
    if trees:
        return spark.createDataFrame([(m, packed_trees(g)) for m, g in enumerate(grown)], "model long, trees string")
    old, table = table, refreshed()
    if old is not None:
        drop_written(old)
    shared = spark.sparkContext.broadcast(list(tasks))

    def scores(batches):
        for batch in batches:
            for parts in zip(*(c.to_pylist() for c in batch.columns)):
                block = Block([parts], n)
                for m, task in enumerate(shared.value):
                    mine = block.tests(task)
                    yield _scores(m, block.label[mine], block.margins[mine, m])

    return table.mapInArrow(scores, SCORED)


# ---------------------------------------------------------------- what jobs call


def _ready(rows: DataFrame, vector: str, key: str, limits, label: Column, weight: Column, train: Column, test: Column):
    packed = written(blocks(rows, vector, key, limits, label, weight, train, test), "boosted-blocks")
    bins, whole = packed.agg(F.sum(F.octet_length("bins")), F.sum(sum(F.octet_length(c.split()[0]) for c in PARTS.split(", ")))).first()
    # a row's numbers are held beside its bins
    return packed, apart if (bins or 0) <= BLOCK_BYTES and (whole or 0) <= 2 * BLOCK_BYTES else level_by_level


def _unit(rows: DataFrame, classes: bool) -> tuple[float, float]:
    """Shift and unit of the label: regression labels are scaled into -1 to 1."""
    if classes:
        return 0.0, 1.0
    r = rows.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    if r.low is None:
        return 0.0, 1.0
    return (r.low + r.high) / 2.0, max((r.high - r.low) / 2.0, 1e-12)


def fold_scores(rows: DataFrame, vector: str, key: str, train: Column, test: Column, folds: int, tasks: Sequence[Task]) -> DataFrame:
    """(model, label, prediction, score) of the test rows of every model, labels in their own unit."""
    classes = tasks[0].spec.classes
    shift, unit = _unit(rows, classes)
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    label = (F.col("label") - F.lit(shift)) / F.lit(unit)
    packed, plan = _ready(rows, vector, key, limits_of(rows, vector), label, weight, train, test)
    found = written(plan(packed, tasks, bases(packed, tasks, folds), unit), "boosted-scores")
    drop_written(packed)
    if classes:
        p = 1.0 / (1.0 + F.exp(-F.col("margin")))
        return found.select("model", "label", (p > 0.5).cast("double").alias("prediction"), p.alias("score"))
    back = lambda c: F.col(c) * F.lit(unit) + F.lit(shift)
    return found.select("model", back("label").alias("label"), back("margin").alias("prediction"), F.lit(None).cast("double").alias("score"))


class BoostedModel(Model, DefaultParamsWritable, DefaultParamsReadable):
    """Boosted trees as a Spark ML model: adds ``prediction``, and for classes ``probability``."""

    content = Param(Params._dummy(), "content", "trees, limits and scale as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, content: str | None = None):
        super().__init__()
        if content is not None:
            self._set(content=content)

    def _read(self) -> dict:
        return json.loads(self.getOrDefault(self.content))

    @property
    def featureImportances(self) -> DenseVector:
        """Gains by feature, as shares."""
        told = self._read()
        gains = np.zeros(len(told["limits"]))
        for tree in unpacked_trees(told["trees"]):
            np.add.at(gains, tree.feature[tree.feature >= 0], tree.gain[tree.feature >= 0])
        return DenseVector(gains / gains.sum() if gains.sum() > 0 else gains)

    def nodes(self) -> list[tuple]:
        """(tree, id, value, cover, left, right, feature, limit) of every node; -1 for none."""
        told = self._read()
        out = []
        for number, tree in enumerate(unpacked_trees(told["trees"])):
            todo = [0]
            while todo:
                i = todo.pop()
                f = int(tree.feature[i])
                left, right = (2 * i + 1, 2 * i + 2) if f >= 0 else (-1, -1)
                limit = told["limits"][f][tree.bin[i]] if f >= 0 else 0.0
                base = told["base"] if not number else 0.0  # the start belongs to every leaf of the first tree
                value = (tree.value[i] + base) * told["unit"] + (told["shift"] if not number else 0.0)
                out.append((number, i, float(value), float(tree.cover[i]), left, right, f, limit))
                todo += [c for c in (left, right) if c >= 0]
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        told = self._read()
        shared = dataset.sparkSession.sparkContext.broadcast((unpacked_trees(told["trees"]), [np.array(q) for q in told["limits"]]))
        base = told["base"]

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            trees, limits = shared.value
            out = np.full(len(x), base)
            if len(x):
                values = np.stack(x.to_numpy())
                bins = np.stack([np.searchsorted(e, values[:, i]) for i, e in enumerate(limits)], axis=1)
                for tree in trees:
                    out = out + tree.value[tree.place(bins)]
            return pd.Series(out)

        out = dataset.withColumn("__margin", margin(vector_to_array(told["vector"])))
        if not told["classes"]:
            return out.withColumn("prediction", F.col("__margin") * F.lit(told["unit"]) + F.lit(told["shift"])).drop("__margin")
        p = 1.0 / (1.0 + F.exp(-F.col("__margin")))
        return out.withColumn("probability", array_to_vector(F.array(1.0 - p, p))).withColumn("prediction", (p > 0.5).cast("double")).drop("__margin")


@dataclass(frozen=True)
class BoostedTrees:
    """Fits one ensemble on rows with a vector, a label and, where there is one, a weight; ``key`` names the rows, else their content does."""

    spec: B.Spec
    vector: str
    key: str | None = None

    def fit(self, rows: DataFrame) -> BoostedModel:
        # fits of one frame agree whatever its partitions: a row is known by the hash of its content
        rows = rows.where(F.col("label").isNotNull()).withColumn("__name", F.col(self.key) if self.key else F.hash(vector_to_array(self.vector), "label"))
        shift, unit = _unit(rows, self.spec.classes)
        weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
        limits = limits_of(rows, self.vector)
        packed, plan = _ready(rows, self.vector, "__name", limits, (F.col("label") - F.lit(shift)) / F.lit(unit), weight, F.lit(1), F.lit(0))
        tasks = [Task(self.spec)]
        starts = bases(packed, tasks, 1)
        trees = plan(packed, tasks, starts, unit, trees=True).first().trees
        drop_written(packed)
        told = {"trees": trees, "limits": limits, "base": starts[0], "unit": unit, "shift": shift, "vector": self.vector, "classes": self.spec.classes}
        return BoostedModel(content=json.dumps(told))

