"""Column profiles: descriptive statistics and pairwise correlation."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.operators.ordered import exact_quantiles
from halyard.operators.union import stacked
from halyard.sources.scratch import written

NUMBERS = T.NumericType
MOMENT_ROWS = 1 << 16
MOMENTS = ["n", "mean", "square", "product", "odd"]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMBERS)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def describe_all(df: DataFrame) -> DataFrame:
    """One row per column: counts for all, moments and exact quartiles for
    numbers, distinct values and the most frequent one for text."""
    numbers, texts = numeric_columns(df), text_columns(df)
    df = written(df.select(*numbers, *texts), "profile")  # each pass below reads the columns, not the plan again
    parts = []
    if numbers:
        quartiles = exact_quantiles(df, numbers, [0.25, 0.5, 0.75])
        wide = df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.count(c).alias("count"),
                    F.avg(c).alias("mean"),
                    F.stddev_samp(c).alias("std"),
                    F.min(c).cast("double").alias("min"),
                    *[F.lit(q).cast("double").alias(n) for n, q in zip(("q25", "q50", "q75"), quartiles[c])],
                    F.max(c).cast("double").alias("max"),
                ).alias(c)
                for c in numbers
            ]
        )
        parts.append(wide.select(F.explode(F.array(*numbers)).alias("s")).select("s.*"))
    if texts:
        counts = (
            df.select(*texts)
            .unpivot([], texts, "column_name", "value")
            .where(F.col("value").isNotNull())
            .groupBy("column_name", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        parts.append(
            counts.groupBy("column_name").agg(
                F.sum("n").alias("count"),
                F.count(F.lit(1)).alias("unique"),
                F.max_by("value", F.struct("n", "value")).alias("top"),
                F.max("n").alias("freq"),
            )
        )
    out = stacked(parts)
    kinds = {"count": "long", "unique": "long", "top": "string", "freq": "long"}
    kinds.update({c: "double" for c in ("mean", "std", "min", "q25", "q50", "q75", "max")})
    return out.select(
        "column_name",
        *[(F.col(c) if c in out.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()],
    )


def _moments(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """For all column pairs, over the rows of a block where both are present: rows, own mean, own squares and products about the means."""
    there = ~np.isnan(x)
    one = there.astype(float)
    n = one.T @ one
    centre = np.where(there, x, 0.0).sum(axis=0) / np.maximum(one.sum(axis=0), 1.0)
    off = np.where(there, x - centre, 0.0)
    some = np.maximum(n, 1.0)
    sums = off.T @ one  # of the row's column, where the other is present too
    return n, centre[:, None] + sums / some, (off * off).T @ one - sums * sums / some, off.T @ off - sums * sums.T / some


def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The moments of two blocks together."""
    n = a[0] + b[0]
    some = np.maximum(n, 1.0)
    # where one block has no row of a pair, its mean says nothing
    gap = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    share = a[0] * b[0] / some
    mean = np.where(a[0] > 0, a[1] + gap * b[0] / some, b[1])
    return n, mean, a[2] + b[2] + gap * gap * share, a[3] + b[3] + gap * gap.T * share


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair over the rows where both are present.

    Each task adds up the moments of all pairs in one pass over its rows, and sends one row; these few are merged by Spark.
    A value that is not finite makes its pairs' correlation NaN.
    """
    names = columns or numeric_columns(df)
    pairs = list(combinations(range(len(names)), 2))
    wide = len(names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, odd = None, np.zeros((wide, wide), bool)
        for batch in batches:
            for start in range(0, batch.num_rows, MOMENT_ROWS):
                part = batch.slice(start, MOMENT_ROWS)
                there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in part.columns], axis=1)
                x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in part.columns], axis=1)
                strange = (there & ~np.isfinite(x)).astype(float)
                if strange.any():
                    hit = strange.T @ there.astype(float) > 0
                    odd |= hit | hit.T
                found = _moments(np.where(there & np.isfinite(x), x, np.nan))
                total = found if total is None else _merged(total, found)
        if total is not None:
            cells = [np.ascontiguousarray(m).tobytes() for m in (*total, odd.astype(float))]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], MOMENTS)

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, odd = None, np.zeros((wide, wide), bool)
        for batch in parts:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] is None:  # the row that is always there
                    continue
                *found, strange = (np.frombuffer(c).reshape(wide, wide) for c in row)
                odd |= strange > 0
                total = tuple(found) if total is None else _merged(total, tuple(found))
        if total is None:
            total = tuple(np.zeros((wide, wide)) for _ in range(4))
        n, _, square, product = (np.where(odd, np.nan, m) for m in total)
        n = np.where(odd, 2.0, n)
        told = [(names[i], names[j], n[i, j], square[i, j], square[j, i], product[i, j]) for i, j in pairs]
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*told)], ["column_a", "column_b", "n", "a", "b", "c"])

    slim = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    parts = slim.mapInArrow(add, ", ".join(f"{m} binary" for m in MOMENTS))  # a row a task
    always = df.sparkSession.range(1).select(*[F.lit(None).cast("binary").alias(m) for m in MOMENTS])
    summed = parts.union(always).repartition(1).mapInArrow(whole, "column_a string, column_b string, n double, a double, b double, c double")
    correlation = F.when(F.col("n") > 1, F.col("c") / F.sqrt(F.col("a") * F.col("b")))
    return summed.select("column_a", "column_b", correlation.alias("correlation"))


def correlated_columns(df: DataFrame, threshold: float = 0.9, columns: list[str] | None = None) -> list[str]:
    """Columns that correlate beyond the threshold with an earlier one.

    Only the pairs above the threshold travel to the driver, at most one per
    column pair.
    """
    names = columns or numeric_columns(df)
    high = correlation_pairs(df, names).where(F.abs("correlation") > threshold).select("column_b").distinct()
    dropped = {row.column_b for row in high.collect()}
    return [c for c in names if c in dropped]
