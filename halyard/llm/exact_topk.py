"""Exact top-k by inner product of integer vectors, by refining score histograms.

Every query is scored against every candidate. Round by round a histogram of the
scores inside each query's interval narrows the interval to the bin that holds
its k-th score, until the bin is one score wide. A last pass keeps what scores
above that value and, at it, the smallest ids that are still needed.

A part counts only its own best k scores inside an interval. Scores below those
cannot move the k-th value, so the bin found is that of the full histogram.

Defined cases: vectors that are null, empty or hold null or non-finite components
and rows without an id take no part; zero vectors do. Rows that share an id count
once (the smallest vector stands for it). Vectors of other dimensions are not
compared. Ties go to the smaller id. Queries with fewer than k candidates get all.
An empty table gives no rows. Scores must fit a long, else ArithmeticError.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm import vectors
from halyard.sources.scratch import written

SHARD_ROWS = 8192
BLOCK_ROWS = 1024
BIN_BITS = 11
EXACT = 2.0**53  # sums of whole numbers up to here are exact in a double


def integers(df: DataFrame, scale: float = 1024.0) -> DataFrame:
    """Components x become floor(scale * x), in double precision."""
    return df.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double")))


def _scores(shard: pd.Series, block: pd.Series, exact: bool):
    ids, points = vectors.unpack(shard)
    query_ids, queries = vectors.unpack(block)
    if exact:
        scores = (queries @ points.T).astype(np.int64)
    else:
        whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
        scores = whole(queries).dot(whole(points).T).astype(np.int64)
    return ids, query_ids, scores, ids[None, :] == query_ids[:, None]


def _counts(bin_width: int, bins: int, exact: bool):
    """Histogram of each query's best scores inside [low, low + bins * bin_width)."""

    def work(shard: pd.Series, block: pd.Series) -> pd.DataFrame:
        ids, query_ids, scores, own = _scores(shard, block, exact)
        low, need = np.frombuffer(block["low"], np.int64), np.frombuffer(block["need"], np.int64)
        bin_of = (scores - low[:, None]) // bin_width
        bin_of[own | (bin_of < 0) | (bin_of >= bins)] = -1
        most = min(int(need.max()), bin_of.shape[1])
        best = -np.partition(-bin_of, most - 1, axis=1)[:, :most]
        who, slot = np.nonzero(best >= 0)
        pairs, n = np.unique(np.stack([who, best[who, slot]], 1), axis=0, return_counts=True)
        return pd.DataFrame({"query_id": query_ids[pairs[:, 0]], "bin": pairs[:, 1], "n": n})

    return work


def _members(exact: bool):
    """What scores above a query's k-th value, and the smallest ids at it."""

    def work(shard: pd.Series, block: pd.Series) -> pd.DataFrame:
        ids, query_ids, scores, own = _scores(shard, block, exact)
        low, need = np.frombuffer(block["low"], np.int64), np.frombuffer(block["need"], np.int64)
        above = (scores > low[:, None]) & ~own
        level = (scores == low[:, None]) & ~own
        level &= np.cumsum(level, axis=1) <= need[:, None]  # ids are in order
        who, at = np.nonzero(above | level)
        return pd.DataFrame({"query_id": query_ids[who], "vec_id": ids[at], "score": scores[who, at]})

    return work


def top_k(
    candidates: DataFrame,
    queries: DataFrame,
    key: str,
    vector: str,
    k: int,
    scale: float = 1024.0,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
    bin_bits: int = BIN_BITS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products, exactly."""
    left = integers(vectors.usable(candidates, key, vector), scale)
    right = integers(vectors.usable(queries, key, vector), scale)
    right = right.groupBy("id").agg(F.min("v").alias("v"))  # one vector an id, as in the shards
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n_left, longest = left.agg(F.count("*"), F.max(square)).first()
    n_right, asked = right.agg(F.count("*"), F.max(square)).first()
    n_shards, n_blocks = vectors.parts_for(n_left, shard_rows), vectors.parts_for(n_right, block_rows)
    # Cauchy-Schwarz: no score lies outside +-bound
    bound = int(np.sqrt(longest or 0.0) * np.sqrt(asked or 0.0) * (1 + 1e-9)) + 2
    if bound >= 2**62:
        raise ArithmeticError("inner products of these vectors do not fit a long")
    exact = bound < EXACT
    shards = written(vectors.pack(left, n_shards), "topk-shards")
    bits = (2 * bound + 1).bit_length()
    state = right.select("id", "v", F.lit(-bound).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))
    kinds = {"low": "int64", "need": "int64"}
    while bits > 0:
        step = min(bin_bits, bits)
        bits -= step
        width = 1 << bits
        blocks = vectors.pack(state, n_blocks, kinds)
        counts = vectors.against_all(
            shards, n_shards, blocks, n_blocks, _counts(width, 1 << step, exact), "query_id long, bin long, n long"
        )
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        crossed = (
            counts.groupBy("query_id", "bin")
            .agg(F.sum("n").alias("n"))
            .withColumn("reached", F.sum("n").over(down))
            .join(state.select(F.col("id").alias("query_id"), "need"), "query_id")
            .where(F.col("reached") >= F.col("need"))
            .groupBy("query_id")
            .agg(F.max(F.struct("bin", (F.col("reached") - F.col("n")).alias("above"))).alias("at"))
            .select(F.col("query_id").alias("id"), "at.bin", "at.above")
        )
        # a query that never reaches k keeps its lowest bin: all its candidates score at or above it
        state = written(
            state.join(crossed, "id", "left").select(
                "id",
                "v",
                (F.col("low") + F.coalesce("bin", F.lit(0)) * width).alias("low"),
                (F.col("need") - F.coalesce("above", F.lit(0))).alias("need"),
            ),
            "topk-state",
        )
    found = vectors.against_all(
        shards, n_shards, vectors.pack(state, n_blocks, kinds), n_blocks, _members(exact), "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
