"""Categorical encoders and scalers: a small fit over the data, then plain projections.

A fit is one aggregate. Category tables up to ``MAX_CATEGORIES`` rows come back
and are joined as a broadcast of that proven size, so the wide frame is never
shuffled for an encoding; larger ones stay distributed and are joined as such.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions import calendar_parts, half_up
from halyard.operators.describe import numeric_columns
from halyard.operators.ordered import exact_quantiles, running_totals
from halyard.sources.scratch import written

MAX_CATEGORIES = 10_000
#: Indicator columns beyond which making a row costs more than moving it.
MANY_COLUMNS = 500
SMOOTHING = 10.0
UNKNOWN = "Unknown"

STATS = "column_name string, value string, n long, target_n long, target_sum double"


def with_date_features(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Seven calendar columns, replacing columns of the same name; the frame is
    returned as it is when the date is absent."""
    if column not in df.columns:
        return df
    parts = calendar_parts(column, prefix)
    return df.select(*[c for c in df.columns if c not in parts], *[e.alias(n) for n, e in parts.items()])


def category_stats(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """Rows, target count and target sum per column and value, all columns in one pass."""
    measure = F.col(target).cast("double") if target else F.lit(None).cast("double")
    narrow = df.select(measure.alias("__target"), *[F.col(c).cast("string").alias(c) for c in columns])
    return (
        narrow.unpivot("__target", list(columns), "column_name", "value")
        .groupBy("column_name", "value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("__target").alias("target_n"),
            half_up(F.sum("__target"), 4).alias("target_sum"),
        )
    )


def encode(
    df: DataFrame,
    frequency: Sequence[str] = (),
    target: Sequence[str] = (),
    target_column: str | None = None,
    smoothing: float = SMOOTHING,
    fit_on: DataFrame | None = None,
    limit: int = MAX_CATEGORIES,
) -> DataFrame:
    """Adds ``<c>_frequency`` (share of rows, missing being a value) and
    ``<c>_target_encoded`` (smoothed target mean, unseen values get the overall mean).

    ``fit_on`` may be a cheaper frame with the same rows of these columns.
    """
    frequency = [c for c in frequency if c in df.columns]
    target = [c for c in target if c in df.columns] if target_column in df.columns else []
    columns = list(dict.fromkeys([*frequency, *target]))
    if not columns:
        return df
    stats = category_stats(fit_on if fit_on is not None else df, columns, target_column if target else None)
    found = stats.limit(limit + 1).collect()
    bounded = len(found) <= limit
    if bounded:
        first = [r for r in found if r.column_name == columns[0]]
        total = sum(r.n for r in first)
        seen, summed = sum(r.target_n for r in first), sum(r.target_sum or 0.0 for r in first)
    else:
        stats = written(stats, "category-stats")
        whole = stats.where(F.col("column_name") == columns[0]).agg(F.sum("n"), F.sum("target_n"), F.sum("target_sum"))
        total, seen, summed = whole.first()
    mean = summed / seen if seen else None

    out = df
    for c in columns:
        if bounded:
            part = [tuple(r) for r in found if r.column_name == c]
            table = F.broadcast(df.sparkSession.createDataFrame(part, STATS))
        else:
            table = stats.where(F.col("column_name") == c)
        value, n = F.col(f"__{c}_value"), F.col("target_n")
        smoothed = (F.col("target_sum") / n * n + F.lit(mean) * F.lit(smoothing)) / (n + F.lit(smoothing))
        wanted = []
        if c in frequency:
            wanted.append((F.col("n") / F.lit(float(total or 1))).alias(f"__{c}_frequency"))
        if c in target:
            known = value.isNotNull() & (n > 0)
            wanted.append(F.when(known, smoothed).otherwise(F.lit(mean)).alias(f"__{c}_target"))
        table = table.withColumnRenamed("value", f"__{c}_value").select(f"__{c}_value", *wanted)
        out = out.join(table, out[c].cast("string").eqNullSafe(table[f"__{c}_value"]), "left")
    named = []
    for c in frequency:
        named.append(F.coalesce(F.col(f"__{c}_frequency"), F.lit(0.0)).alias(f"{c}_frequency"))
    for c in target:
        named.append(F.coalesce(F.col(f"__{c}_target"), F.lit(mean)).alias(f"{c}_target_encoded"))
    return out.select(*df.columns, *named)


def out_of_fold(
    df: DataFrame, key: str, columns: Sequence[str], target: str, folds: int = 5, smoothing: float = SMOOTHING, seed: int = 42, fold: Column | None = None
) -> DataFrame:
    """Adds ``<c>_target_encoded`` whose value for a row is learned from the rows of the other folds only.

    The fold is the hash of the key, or a column 0..folds-1. One pass adds up the target by (column, value, fold); the total of a value less the own
    fold's is the smoothed mean of the others. A value that no other fold has, and a missing one,
    gets the mean of the other folds.
    """
    fold = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds)) if fold is None else fold).cast("int")
    texts = [F.col(c).cast("string").alias(c) for c in columns]
    narrow = df.select(fold.alias("__fold"), F.col(target).cast("double").alias("__target"), *texts)
    sums = written(
        narrow.unpivot(["__fold", "__target"], list(columns), "column_name", "value")
        .groupBy("column_name", "value", "__fold")
        .agg(F.count("__target").alias("n"), half_up(F.sum("__target"), 4).alias("total")),
        "out-of-fold-sums",
    )
    of_fold = {r["__fold"]: (r.n, r.total or 0.0) for r in sums.where(F.col("column_name") == columns[0]).groupBy("__fold").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    means = []
    for f in range(folds):
        n, total = (sum(v[i] for k, v in of_fold.items() if k != f) for i in (0, 1))
        means.append(F.lit(total / n if n else None).cast("double"))
    # every value has a row for every fold it must be encoded in: its total less that fold's part
    totals = sums.groupBy("column_name", "value").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("__fold", F.struct("n", "total")))).alias("own")
    )
    out = df.withColumn("__fold", fold).withColumn("__mean", F.get(F.array(*means), F.col("__fold")))
    for c in columns:
        table = totals.where((F.col("column_name") == c) & F.col("value").isNotNull()).select(
            F.col("value").alias(f"__{c}_value"), F.struct("n", "total", "own").alias(f"__{c}")
        )
        out = out.join(table, out[c].cast("string") == table[f"__{c}_value"], "left").drop(f"__{c}_value")
    named = []
    for c in columns:
        own = F.try_element_at(F.col(f"__{c}")["own"], F.col("__fold"))
        n = F.col(f"__{c}")["n"] - F.coalesce(own["n"], F.lit(0))
        total = F.coalesce(F.col(f"__{c}")["total"], F.lit(0.0)) - F.coalesce(own["total"], F.lit(0.0))
        smoothed = (total + F.col("__mean") * F.lit(smoothing)) / (n + F.lit(smoothing))
        named.append(F.when(n > 0, smoothed).otherwise(F.col("__mean")).alias(f"{c}_target_encoded"))
    return out.select(*df.columns, *named)


def categories(df: DataFrame, column: str) -> list[str]:
    """The sorted distinct values, missing as ``Unknown``: the names of the columns to come."""
    values = df.select(F.coalesce(F.col(column).cast("string"), F.lit(UNKNOWN)).alias("v")).distinct()
    return sorted(r.v for r in values.collect())


def dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A written table (column_name, value, index): the values of all columns, numbered 0.. in order of column and value.

    The distinct values are range-partitioned; a slice's first number is the count of the slices before it.
    """
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in columns]
    values = df.select(*texts).unpivot([], list(columns), "column_name", "value").distinct()
    numbered = running_totals(values.withColumn("one", F.lit(1)), [], ["column_name", "value"], ["one"])
    return written(numbered.select("column_name", "value", (F.col("one_through") - 1).cast("long").alias("index")), "one-hot-dictionary")


def one_hot_sparse(df: DataFrame, key: str, columns: Sequence[str], words: DataFrame | None = None) -> DataFrame:
    """(key, size, indices, values): one sparse vector a row, over the values of all columns.

    ``words`` is a dictionary, fitted here when not given; a value it does not hold gives no entry. The key names a row.
    Nothing is collected, and the number of values changes no plan; ``as_vector`` makes a Spark ML vector of the three columns.
    """
    words = dictionary(df, columns) if words is None else words
    found = indicator_rows(df, key, columns).join(words, ["column_name", "value"], "left")
    entries = F.sort_array(F.collect_list("index"))  # one for each column at most
    size = words.agg(F.count("*")).scalar()
    return found.groupBy(key).agg(entries.alias("indices")).select(
        key, size.alias("size"), "indices", F.transform("indices", lambda _: F.lit(1.0)).alias("values")
    )


def as_vector(size: str = "size", indices: str = "indices", values: str = "values"):
    """A Spark ML vector from the columns of ``one_hot_sparse``."""
    make = F.udf(lambda n, i, v: Vectors.sparse(n, i, v), VectorUDT())
    return make(size, indices, values)


def indicator_rows(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The same indicators as rows (key, column_name, value), one for each 1, for columns of any number of values."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in columns]
    return df.select(key, *texts).unpivot(key, list(columns), "column_name", "value")


def one_hot(
    df: DataFrame, columns: Sequence[str] | Mapping[str, Sequence[str]], keep_source: bool = True
) -> DataFrame:
    """One 0/1 column ``<column>_<value>`` per category, all in one projection.

    A mapping gives the categories; otherwise they are read from the data. A column
    for each value is what is asked for here; ``one_hot_sparse`` needs none. Rows that become
    more than ``MANY_COLUMNS`` wide are dealt over all cores while they are narrow, however few files hold them.
    """
    if not isinstance(columns, Mapping):
        columns = {c: categories(df, c) for c in columns if c in df.columns}
    if sum(map(len, columns.values())) > MANY_COLUMNS:
        df = df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)
    indicators = [
        (F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) == F.lit(v)).cast("double").alias(f"{c}_{v}")
        for c, values in columns.items()
        for v in values
    ]
    kept = [c for c in df.columns if keep_source or c not in columns]
    return df.select(*kept, *indicators)


def ordinal(df: DataFrame, categories_of: Mapping[str, Sequence[str]], keep_source: bool = True) -> DataFrame:
    """Position in the given list as ``<column>_ordinal``, -1 when not in it."""

    def place(c: str, values: Sequence[str]):
        text = F.coalesce(F.col(c), F.lit(UNKNOWN))
        return (F.array_position(F.array(*map(F.lit, values)), text) - 1).cast("double").alias(f"{c}_ordinal")

    there = {c: v for c, v in categories_of.items() if c in df.columns}
    kept = [c for c in df.columns if keep_source or c not in there]
    return df.select(*kept, *[place(c, v) for c, v in there.items()])


# ---------------------------------------------------------------- scaling


def fit_scaler(df: DataFrame, columns: Sequence[str], method: str) -> dict[str, tuple[float, float]]:
    """(centre, width) per column over the rows, missing counted as zero; a zero width becomes one."""
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    if method == "robust":
        found = exact_quantiles(filled, list(columns), [0.25, 0.5, 0.75])
        pairs = {c: (q[1], q[2] - q[0]) if q[1] is not None else (0.0, 0.0) for c, q in found.items()}
    elif method in ("standard", "minmax"):
        centre, width = {
            "standard": (F.avg, F.stddev_pop),
            "minmax": (F.min, lambda c: F.max(c) - F.min(c)),
        }[method]
        row = filled.agg(*[F.struct(centre(c).alias("a"), width(c).alias("b")).alias(c) for c in columns]).first()
        pairs = {c: (row[c].a or 0.0, row[c].b or 0.0) for c in columns}
    else:
        raise ValueError(f"unknown scaling method {method!r}")
    return {c: (a, b if b else 1.0) for c, (a, b) in pairs.items()}


def scale(df: DataFrame, columns: Sequence[str], method: str = "standard", fit_on: DataFrame | None = None) -> DataFrame:
    """Adds ``<c>_<method>_scaled`` for the numeric columns among ``columns``."""
    numeric = set(numeric_columns(df))
    wanted = [c for c in columns if c in numeric]
    if not wanted:
        return df
    fitted = fit_scaler(fit_on if fit_on is not None else df, wanted, method)
    return df.select(
        "*",
        *[
            ((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(a)) / F.lit(b)).alias(f"{c}_{method}_scaled")
            for c, (a, b) in fitted.items()
        ],
    )
