"""Ranked lexical search: documents grouped by which of an item's terms they hold.

1. Documents are read once: each gives its number of terms and its counts of the terms that
   any item asks for, as one row (``postings``). Totals and document counts are added up from these rows.
2. Blocks of documents are ranked for every item. In a block every term has a bitmap of the
   documents that hold it and a ceiling, its weight times its largest share there. While an
   item's k-th score is known from earlier blocks, terms of low ceilings that cannot reach it
   even together are set aside: the documents of the other terms' bitmaps, OR-ed, are left.
   These documents are grouped by the bits of their terms, one mask a group. No
   document of a mask scores above the sum of its terms' ceilings, so masks are evaluated by falling sum, and when
   the next sum is below the k-th score the block is finished, safely: equal sums are still evaluated, as ties go by id.
3. Each task hands on its k best of every item; a ranked window keeps k of those.

Items are broadcast, in passes of at most ``PASS_TERMS`` terms each, whatever their number.
A block has a bounded number of (term, document) cells. All sums are of whole numbers below 2**53.

Defined cases: a null text has no terms, and a document or item without terms is not ranked or asked for. Repeated
documents are ranked each. Items that share an id (null is one) are one item of all their terms.
Documents without an id come after those with one. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.llm import arrow_text
from halyard.sources.scratch import written

PASS_TERMS = 1 << 17
BLOCK_CELLS = 1 << 23
BLOCK_DOCS = 1 << 13
SLICE_BYTES = 1 << 20
NO_ID = (1 << 63) - 1
#: Bytes that part terms become a blank, capitals small letters; all others, those above 0x7F too, belong to terms.
FOLDED = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(FOLDED).split()


def _slices(batches: Iterator[pa.RecordBatch]):
    """(batch part, its texts) of batches whose last column is the text."""
    for batch in batches:
        data, offsets = arrow_text.texts(batch.column(batch.num_columns - 1))
        for start, stop in arrow_text.ranges(offsets, SLICE_BYTES):
            found = [data[a:b].tobytes() for a, b in zip(offsets[start:stop], offsets[start + 1 : stop + 1])]
            yield batch.slice(start, stop - start), found


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term) of every item, each term once."""
    slim = items.select(F.col(key).alias("item"), F.col(text).alias("text"))
    schema = T.StructType([slim.schema["item"], T.StructField("term", T.BinaryType())])

    def run(batches):
        for part, texts in _slices(batches):
            found = [(i, t) for i, text in enumerate(texts) for t in set(terms_of(text))]
            places = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(places), pa.array([t for _, t in found], pa.binary())], schema.names)

    return slim.mapInArrow(run, schema).distinct()


def postings(docs: DataFrame, key: str, text: str, wanted: list[bytes]) -> DataFrame:
    """(id, n, terms, counts) of every document with a term: all its terms counted, the wanted ones by their place."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # PASS_TERMS at most
    lists = pa.list_(pa.int32())

    def run(batches):
        places = {t: i for i, t in enumerate(shared.value)}
        for part, texts in _slices(batches):
            rows, at = [], []
            for i, text in enumerate(texts):
                words = terms_of(text)
                if words:
                    counts = Counter(words)
                    here = sorted(places[t] for t in counts.keys() & places.keys())
                    rows.append((len(words), here, [counts[shared.value[p]] for p in here]))
                    at.append(i)
            ids = part.column(0).take(pa.array(at, pa.int64()))
            n, terms, times = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(terms, lists), pa.array(times, lists)], ["id", "n", "terms", "counts"]
            )

    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "id long, n long, terms array<int>, counts array<int>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Best:
    """The k best (score, id) of every item, so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * items
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * items

    def least(self, item: int) -> int:
        """The score that a further document must reach."""
        return int(self.scores[item][-1]) if len(self.scores[item]) == self.k else 1

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[item], scores]), np.concatenate([self.ids[item], ids])
        first = np.lexsort((ids, -scores))[: self.k]
        first = first[scores[first] > 0]
        self.scores[item], self.ids[item] = scores[first], ids[first]


def _masks(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for the mask of every column of a table of bits, and the first column of each mask."""
    packed = np.packbits(bits, axis=0)
    pad = -len(packed) % 8
    words = np.concatenate([packed, np.zeros((pad, packed.shape[1]), np.uint8)]) if pad else packed
    words = np.ascontiguousarray(words.T).view(np.uint64)
    number = np.zeros(len(words), np.int64)
    first = np.zeros(0, np.int64)
    for column in words.T:
        _, place = np.unique(column, return_inverse=True)
        _, first, number = np.unique(number * (place.max(initial=0) + 1) + place, return_index=True, return_inverse=True)
    return number, first


class Block:
    """Bitmaps, shares and ceilings of the terms that occur in a block of documents."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, doc: np.ndarray, counts: np.ndarray, weights: np.ndarray):
        self.ids = ids
        here, row = np.unique(terms, return_inverse=True)
        self.row = {int(t): i for i, t in enumerate(here)}
        self.weights = weights[here]
        shares = (1_000_000_000 * counts) // (1000 * counts + 8 * lengths[doc])
        # float64 holds these numbers, their products and sums exactly; the products are below 2**53
        self.shares = np.zeros((len(here), len(ids)))
        self.shares[row, doc] = shares
        held = np.zeros((len(here), len(ids)), bool)
        held[row, doc] = True
        self.bitmaps = np.packbits(held, axis=1)
        self.ceilings = self.weights * self.shares.max(axis=1, initial=0).astype(np.int64)

    def rank(self, item: int, terms: list[int], best: Best) -> None:
        rows = np.array([self.row[t] for t in terms if t in self.row], np.int64)
        if not len(rows):
            return
        rows = rows[np.argsort(self.ceilings[rows], kind="stable")]
        ceilings = self.ceilings[rows]
        aside = int(np.searchsorted(np.cumsum(ceilings), best.least(item)))  # these together stay below the k-th score
        held = np.bitwise_or.reduce(self.bitmaps[rows[aside:]], axis=0, initial=0) if aside < len(rows) else np.zeros(0, np.uint8)
        docs = np.flatnonzero(np.unpackbits(held)[: len(self.ids)]) if len(held) else np.zeros(0, np.int64)
        if not len(docs):
            return
        bits = np.unpackbits(self.bitmaps[rows], axis=1, count=len(self.ids))[:, docs]
        number, first = _masks(bits)
        most = ceilings @ bits[:, first].astype(np.int64)
        order = np.argsort(-most, kind="stable")
        falling = most[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        turn = place[number]  # the place of a document's mask in the falling order
        docs_in_order = np.argsort(turn, kind="stable")
        stops = np.searchsorted(turn[docs_in_order], np.arange(len(order)), "right")
        weights = self.weights[rows].astype(np.float64)
        start, mask, step = 0, 0, 1
        while mask < len(order) and falling[mask] >= best.least(item):
            mask = min(mask + step, len(order))
            some = docs[docs_in_order[start : stops[mask - 1]]]
            best.add(item, (weights @ self.shares[np.ix_(rows, some)]).astype(np.int64), self.ids[some])
            start, step = int(stops[mask - 1]), 2 * step


def _blocks(batches: Iterator[pa.RecordBatch]):
    """(ids, n, terms, document, counts) of bounded blocks of documents, gathered over batches."""
    waiting, cells = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            terms, counts = part.column(2), part.column(3)
            sizes = np.diff(terms.offsets.to_numpy()).astype(np.int64)
            waiting.append((
                part.column(0).fill_null(NO_ID).to_numpy(), part.column(1).to_numpy(), terms.flatten().to_numpy(),
                sizes, counts.flatten().to_numpy().astype(np.int64),
            ))
            cells = sum(len(w[0]) for w in waiting) * len(np.unique(np.concatenate([w[2] for w in waiting])))
            if cells >= BLOCK_CELLS or sum(len(w[0]) for w in waiting) >= BLOCK_DOCS:
                yield _joined(waiting)
                waiting = []
    if waiting:
        yield _joined(waiting)


def _joined(waiting: list[tuple]) -> tuple[np.ndarray, ...]:
    ids, n, terms, sizes, counts = (np.concatenate(c) for c in zip(*waiting))
    return ids, n, terms, np.repeat(np.arange(len(ids)), sizes), counts


def ranked(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, k: int) -> DataFrame:
    """(item, rank, id, score): the k documents of highest scores above zero of every item, ties by id."""
    asked = written(item_terms(items, item_key, item_text), "lexical-items")
    passes = max(1, math.ceil(asked.count() / PASS_TERMS))
    out = None
    for p in range(passes):
        part = _one_pass(docs, key, text, asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p), k)
        out = part if out is None else out.unionByName(part)
    first = W.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("item", "rank", "id", "score")


def _one_pass(docs: DataFrame, key: str, text: str, asked: DataFrame, k: int) -> DataFrame:
    """(item, id, score): every task's best documents for one pass of items."""
    spark = docs.sparkSession
    pairs = asked.toArrow()  # PASS_TERMS rows, or one item
    wanted = sorted(set(pairs["term"].to_pylist()))
    places = {t: i for i, t in enumerate(wanted)}
    held: dict[object, list[int]] = {}
    for item, term in zip(pairs["item"].to_pylist(), pairs["term"].to_pylist()):
        held.setdefault(item, []).append(places[term])
    rows = written(postings(docs, key, text, wanted), "lexical-postings")
    totals = rows.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    holding = np.zeros(len(wanted), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toLocalIterator():
        holding[r.t] = r.n
    weights = np.array([weight(totals.documents, int(n)) for n in holding], np.int64)
    groups = list(held.values())
    shared = spark.sparkContext.broadcast((groups, weights))  # PASS_TERMS numbers, or one item
    documents, terms = totals.documents, totals.terms or 1

    def run(batches):
        groups, weights = shared.value
        best = Best(len(groups), k)
        for ids, n, term, doc, counts in _blocks(batches):
            lengths = 100 - 90 + (90 * n * documents) // terms
            block = Block(ids, lengths, term, doc, counts, weights)
            for item, own in enumerate(groups):
                block.rank(item, own, best)
        number = np.repeat(np.arange(len(groups), dtype=np.int64), [len(s) for s in best.scores])
        scores, ids = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (best.scores, best.ids))
        yield pa.RecordBatch.from_arrays(
            [pa.array(number), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], ["number", "id", "score"]
        )

    found = rows.mapInArrow(run, "number long, id long, score long")
    schema = T.StructType([T.StructField("number_", T.LongType()), asked.schema["item"]])
    names = spark.createDataFrame(list(enumerate(held)), schema)
    return found.join(F.broadcast(names), F.col("number") == F.col("number_")).select("item", "id", "score")
