"""Vectors in bounded shards, and queries in bounded blocks against every shard."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKED = "part long, dim int, n long, ids binary, matrix binary"


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part: an id, and a vector of finite numbers only.

    Null or empty vectors, vectors with a null, NaN or infinite component, and
    rows without an id are left out. Other columns are not read.
    """
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad
    )


def parts_for(rows: int, part_rows: int) -> int:
    return max(1, math.ceil(rows / part_rows))


def pack(df: DataFrame, parts: int, extra: dict[str, str] | None = None) -> DataFrame:
    """One row per part and dimension: ids in order and their vectors as one matrix.

    Rows go to parts by the hash of their id, so copies of one vector spread
    evenly. Of rows that share an id the smallest vector stands for it.
    ``extra`` names further numeric columns, kept as arrays beside the ids.
    """
    extra = extra or {}

    def stack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(order=frame["v"].map(tuple)).sort_values(["id", "order"]).drop_duplicates("id")
        row = {
            "part": [int(frame["part"].iloc[0])],
            "dim": [int(frame["dim"].iloc[0])],
            "n": [len(frame)],
            "ids": [frame["id"].to_numpy(np.int64).tobytes()],
            "matrix": [np.stack(frame["v"].to_numpy()).astype(np.float64).tobytes()],
        }
        row |= {c: [frame[c].to_numpy(kind).tobytes()] for c, kind in extra.items()}
        return pd.DataFrame(row)

    placed = df.select(
        F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.size("v").alias("dim"), "id", "v", *extra
    )
    schema = PACKED + "".join(f", {c} binary" for c in extra)
    return placed.groupBy("part", "dim").applyInPandas(stack, schema)


def unpack(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["matrix"], np.float64).reshape(len(ids), int(row["dim"]))


def against_all(
    shards: DataFrame, n_shards: int, blocks: DataFrame, n_blocks: int, work: Callable[[pd.Series, pd.Series], pd.DataFrame], schema: str
) -> DataFrame:
    """Every query block with every shard of its dimension, one bounded pair a group.

    Both sides hold one packed row per part; only those rows are repeated.
    """

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = shards.withColumnRenamed("part", "shard").withColumn("block", numbers(n_blocks))
    right = blocks.withColumnRenamed("part", "block").withColumn("shard", numbers(n_shards))
    keys = ["shard", "block", "dim"]
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in columns})
        return work(a.iloc[0], b.iloc[0])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, schema)
