"""Projection helpers, top-k, unions of lists, and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halyard.operators.describe import numeric_columns
from halyard.operators.union import stacked


def existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that are there."""
    return df.select(*[c for c in wanted if c in df.columns])


def aligned(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """A model's feature list, absent features as zero, unknown columns left out."""
    return df.select(*keep, *[F.col(c) if c in df.columns else F.lit(0).alias(c) for c in features])


def numbers_only(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def column_or(df: DataFrame, name: str, default: object) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First k rows of a total order; every partition keeps k rows, no full sort."""
    return df.orderBy(*order).limit(k)


def best(df: DataFrame, order: list[Column]) -> DataFrame:
    return top_k(df, order, 1)


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both by column name; a column one side lacks is null there."""
    return old.unionByName(new, allowMissingColumns=True)


def unexpected_values(reference: DataFrame, incoming: DataFrame, column: str) -> DataFrame:
    """Distinct values of the incoming side that the reference never has."""
    seen = reference.select(F.col(column).alias("value")).distinct()
    new = incoming.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return new.join(seen, "value", "left_anti")


def missing_columns(expected: list[str], incoming: DataFrame) -> list[str]:
    return [c for c in expected if c not in incoming.columns]


def positions(names: DataFrame, order: list[Column]) -> DataFrame:
    """A short list of names with their place in it."""
    return names.select("name", F.row_number().over(W.orderBy(*order)).alias("place"))


def ordered_union(lists: list[DataFrame]) -> DataFrame:
    """Names of several short lists (name, place), first occurrence wins, renumbered."""
    listed = stacked([df.select("name", F.lit(i).alias("list_no"), "place") for i, df in enumerate(lists)])
    first = listed.groupBy("name").agg(F.min(F.struct("list_no", "place")).alias("spot"))
    return first.select("name", F.row_number().over(W.orderBy("spot")).alias("place"))
