"""Nearest neighbours by inner product over vantage-point trees, one tree a shard.

Inner product becomes a distance by one more component: with M the longest
norm of a shard, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the nearest x' has the largest product.
The far side of a node is entered when the query's gap to the node's sphere is
at most ``factor`` times its current k-th distance: one is exact search,
smaller factors prune more.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without an id. Rows that share an id count
once (the smallest vector stands for it). Equal vectors share one place in the
tree and are told apart by id. Vectors of other dimensions are not compared.
Ties go to the smaller id. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm import vectors
from halyard.sources.scratch import written

SHARD_ROWS = 8192
BLOCK_ROWS = 4096
LEAF_ROWS = 256
FACTOR = 0.7
PAIRS = 1 << 16  # scored again at once
NO_ID = np.iinfo(np.int64).max


def build_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, list[tuple]]:
    """Order of the points and nodes (start, stop, vantage row, radius, inner child, outer child)."""
    order, nodes = np.arange(len(points)), []
    todo = [(0, len(points), -1, 0)]
    while todo:
        start, stop, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][4 + side] = at
        nodes.append([start, stop, -1, 0.0, -1, -1])
        if stop - start <= leaf:
            continue
        rows = order[start:stop]
        # the point farthest from the centre splits the rest most unevenly in direction
        vantage = rows[np.argmax(((points[rows] - points[rows].mean(0)) ** 2).sum(1))]
        away = np.sqrt(((points[rows] - points[vantage]) ** 2).sum(1))
        sort = np.argsort(away, kind="stable")
        middle = len(rows) // 2
        radius = float(away[sort[middle]])
        middle = int(np.searchsorted(away[sort], radius))  # equal distances stay together, outside
        if middle == 0:
            continue  # all but the vantage point lie on one sphere: a leaf
        order[start:stop] = rows[sort]
        nodes[at][2], nodes[at][3] = int(vantage), radius
        todo += [(start, start + middle, at, 0), (start + middle, stop, at, 1)]
    return order, nodes


class Search:
    """One block of queries in one tree: each query's ``keep`` best places by product, then by the smallest id there.

    Products by matrix only choose what is scored: all places within their rounding bound of the last one kept,
    however many, are scored again in one order of addition, and these scores decide.
    """

    def __init__(self, points, order, nodes, own, queries, first_ids, keep, factor):
        self.points, self.order, self.nodes, self.factor = points, order, nodes, factor
        self.queries, self.own, self.first_ids = queries, own, first_ids
        self.norms = (queries**2).sum(1)
        self.longest = (points**2).sum(1).max() if len(points) else 0.0
        self.bound = 8 * queries.shape[1] * np.finfo(float).eps * np.sqrt(self.norms * self.longest)
        self.best = np.full((len(queries), keep), -np.inf)
        self.rows = np.full((len(queries), keep), -1)

    def distance(self, products, who):
        return np.sqrt(np.maximum(self.norms[who][:, None] + self.longest - 2 * products, 0))

    def exact(self, who, rows):
        dim, out = self.queries.shape[1], np.empty(len(who))
        for i in range(0, len(who), PAIRS):
            part = slice(i, i + PAIRS)
            out[part] = (self.queries[who[part]] * self.points[rows[part], :dim]).sum(1)
        return out

    def leaf(self, start, stop, who):
        rows, keep = self.order[start:stop], self.best.shape[1]
        found = self.queries[who] @ self.points[rows, : self.queries.shape[1]].T
        found[self.own[who][:, None] == rows[None, :]] = -np.inf
        last = self.best[who, -1]
        if len(rows) > keep:
            last = np.maximum(last, -np.partition(-found, keep - 1, axis=1)[:, keep - 1])
        near = (found >= (last - self.bound[who])[:, None]) & np.isfinite(found)
        who = who[near.any(axis=1)]
        if not len(who):
            return
        query, column = np.nonzero(near[near.any(axis=1)])
        names = np.concatenate([self.rows[who].ravel(), rows[column]])
        scores = np.concatenate([self.best[who].ravel(), self.exact(who[query], rows[column])])
        query = np.concatenate([np.repeat(np.arange(len(who)), keep), query])
        order = np.lexsort((np.where(names < 0, NO_ID, self.first_ids[names]), -scores, query))
        starts = np.searchsorted(query[order], np.arange(len(who)))
        top = order[starts[:, None] + np.arange(keep)]
        self.best[who], self.rows[who] = scores[top], names[top]

    def run(self, at, who):
        start, stop, vantage, radius, inner, outer = self.nodes[at]
        if not len(who):
            return
        if inner < 0:
            self.leaf(start, stop, who)
            return
        point = self.points[vantage, : self.queries.shape[1]]
        away = self.distance((self.queries[who] @ point)[:, None], who)[:, 0]
        inside = away < radius
        for first, second, group in ((inner, outer, inside), (outer, inner, ~inside)):
            own = who[group]
            self.run(first, own)
            worst = self.distance((self.best[own, -1] - self.bound[own])[:, None], own)[:, 0]
            # what rounding can do to the distances is added: equal products on the other side are met
            self.run(second, own[np.abs(away[group] - radius) <= self.factor * worst + 2 * np.sqrt(self.bound[own])])


def _index(shard: pd.Series) -> tuple:
    """Distinct vectors of a shard in their raised form, and the ids at each."""
    ids, matrix = vectors.unpack(shard)
    if len(ids):
        distinct, place = np.unique(matrix, axis=0, return_inverse=True)
        place = place.reshape(-1)
    else:
        distinct, place = matrix, np.zeros(0, int)
    by_place = np.argsort(place, kind="stable")  # ids are in order, so they stay so within a place
    starts = np.searchsorted(place[by_place], np.arange(len(distinct) + 1))
    norms = (distinct**2).sum(1)
    raised = np.concatenate([distinct, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], 1)
    return ids[by_place], starts, raised


def add_trees(shards: DataFrame, leaf: int) -> DataFrame:
    """A vantage-point tree for each shard, beside its distinct vectors and their ids."""

    def index(batches):
        for frame in batches:
            for _, row in frame.iterrows():
                ids, starts, raised = _index(row)
                order, nodes = build_tree(raised, leaf)
                yield pd.DataFrame(
                    {
                        "part": [row["part"]],
                        "dim": [row["dim"]],
                        "ids": [ids.tobytes()],
                        "starts": [starts.astype(np.int64).tobytes()],
                        "points": [raised.tobytes()],
                        "place": [order.astype(np.int64).tobytes()],
                        "nodes": [np.array(nodes, np.float64).tobytes()],
                    }
                )

    return shards.mapInPandas(
        index, "part long, dim int, ids binary, starts binary, points binary, place binary, nodes binary"
    )


def _searcher(k: int, factor: float):
    def work(shard: pd.Series, block: pd.Series) -> pd.DataFrame:
        dim = int(shard["dim"])
        ids, starts = np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["starts"], np.int64)
        points = np.frombuffer(shard["points"], np.float64).reshape(-1, dim + 1)
        order = np.frombuffer(shard["place"], np.int64)
        nodes = [(int(a), int(b), int(v), r, int(i), int(o)) for a, b, v, r, i, o in np.frombuffer(shard["nodes"], np.float64).reshape(-1, 6)]
        query_ids, queries = vectors.unpack(block)
        # a query's own vector is skipped in the tree only if no other id shares it
        alone = np.flatnonzero(np.diff(starts) == 1)
        of_id = dict(zip(ids[starts[alone]].tolist(), alone.tolist()))
        own = np.array([of_id.get(q, -2) for q in query_ids.tolist()])
        # one place more than asked for: a place may hold the query itself beside its copies
        search = Search(points, order, nodes, own, queries, ids[starts[:-1]], k + 1, factor)
        search.run(0, np.arange(len(queries)))
        who, slot = np.nonzero(np.isfinite(search.best))
        rows, scores = search.rows[who, slot], search.best[who, slot]
        counts = np.minimum(np.diff(starts)[rows], k + 1)
        at = np.repeat(np.arange(len(rows)), counts)
        step = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        found = pd.DataFrame({"query_id": query_ids[who[at]], "vec_id": ids[starts[rows[at]] + step], "score": scores[at]})
        found = found[found["query_id"] != found["vec_id"]]
        return found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)

    return work


def nearest(
    candidates: DataFrame,
    queries: DataFrame,
    key: str,
    vector: str,
    k: int,
    factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of largest inner product found."""
    zero = F.forall("v", lambda x: x == 0.0)
    left = vectors.usable(candidates, key, vector).where(~zero)
    right = vectors.usable(queries, key, vector).where(~zero)
    n_shards = vectors.parts_for(left.count(), shard_rows)
    n_blocks = vectors.parts_for(right.count(), block_rows)
    index = written(add_trees(vectors.pack(left, n_shards), leaf_rows), "vp-index")
    found = vectors.against_all(
        index, n_shards, vectors.pack(right, n_blocks), n_blocks, _searcher(k, factor), "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
