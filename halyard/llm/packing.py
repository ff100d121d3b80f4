"""Packing of tokenised documents into windows by Karmarkar-Karp differencing.

A document of more tokens than a window holds gives whole windows and a rest.
Rests are gathered until they fill ``shard_windows`` windows, then split into near-equal
windows: every piece starts as a partial partition of its own; the two partitions
of largest imbalance are merged, the fullest windows of one with the emptiest of the
other, until one partition is left. When its fullest window exceeds the capacity the
number of windows rises; when that would pad more than ``max_padding`` the pieces
are cut in half first, longest allowed length by longest allowed length.

Each Spark task packs the documents of its input split as they stream by; memory holds one shard, and a task
that is run again gives the same sequences. What is left when a split ends, less than a shard, is shuffled: the
rests of ``SPLITS`` neighbouring splits are packed together, so padding does not grow with their number.
A sequence's id holds the split's number above 2**40; those of rests lie above 2**62.

Defined cases: null text is empty and has the end token only; repeated rows are
packed each; a null id stays null; an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from halyard.llm import arrow_text
from halyard.sources.scratch import written

CAPACITY = 4096
SHARD_WINDOWS = 64
MAX_PADDING = 0.01
STORED_WORDS = 100_000
SLICE_BYTES = 2 << 20
SPLITS = 64  # whose rests are packed together
#: Texts of these characters are lowered and split here as the tokenizer does it, others go through it whole.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0131-\\u0148\\u014a-\\u017e]*")
#: The tokenizer's own split for lowered texts of these characters; letters come first, as no other piece starts with one.
PIECES = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\\[-`{-~]+").findall

_tokenizers: dict[int, WordIds] = {}


class WordIds:
    """Ids of texts by a tokenizer that treats each piece of its own split alone; pieces met before are stored.

    Only the tokenizer makes ids: distinct pieces of plain texts go through it in one call, and the
    ids that end a piece (the suffix of its vocabulary) part them. Pieces are kept in two generations, so that
    frequent ones stay when the store fills up.
    """

    def __init__(self, file: str, literal: bool = False):
        self.full = Tokenizer.from_str(file)
        self.full.encode_special_tokens = literal
        self.words = Tokenizer.from_str(file)
        self.words.encode_special_tokens = True
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.added = [] if literal else [t.content for t in self.full.get_added_tokens_decoder().values()]
        vocabulary, suffix = self.full.get_vocab(), self.full.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.store: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Pieces that the tokenizer's own split leaves whole, in one call."""
        ids = np.array(self.words.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        packed = ids.tobytes()
        if len(stops) == len(pieces):
            self.store.update(zip(pieces, [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)]))
        else:
            self.store.update(zip(pieces, self._encoded(pieces)))

    def _hold(self, wanted: set[str]) -> None:
        """Have all wanted pieces in the store."""
        if len(self.store) + len(wanted) > STORED_WORDS:
            self.older, self.store = self.store, {}
        missing = wanted - self.store.keys()
        known = missing & self.older.keys()
        self.store.update(zip(known, map(self.older.__getitem__, known)))
        if len(known) < len(missing):
            self._learn(list(missing - known))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        out: list[bytes | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if PLAIN.fullmatch(t) and not any(a in t for a in self.added)]
        split = [PIECES(texts[i].lower()) for i in plain]
        self._hold(set().union(*split))
        for i, pieces in zip(plain, split):
            out[i] = b"".join(map(self.store.__getitem__, pieces))
        others = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(others, self._encoded([texts[i] for i in others])):
            out[i] = ids
        return out


def _tokenizer(file: Broadcast, literal: bool) -> WordIds:
    """One tokenizer a Python worker, kept over tasks."""
    key = hash((file.value, literal))
    if key not in _tokenizers:
        _tokenizers[key] = WordIds(file.value, literal)
    return _tokenizers[key]


def _members(node) -> list[int]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo += x
        elif x is not None:
            out.append(x)
    return out


def differencing(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """Karmarkar-Karp: (sum, members) of so many windows, near-equal in their sums.

    A partial partition is the falling list of its non-empty windows; the rest are
    empty. Its imbalance is the gap between its fullest and its emptiest window.
    """
    queue = []
    for i, size in enumerate(sizes):
        part = [(size, i)]
        queue.append((-size if windows > 1 else 0, i, part))
    heapq.heapify(queue)
    tick = len(sizes)
    while len(queue) > 1:
        _, _, a = heapq.heappop(queue)
        _, _, b = heapq.heappop(queue)
        alone = max(windows - len(b), 0)  # the fullest of a meet empty windows of b
        merged = a[:alone]
        rest = a[alone:]
        short = len(b) - len(rest)  # the fullest of b meet empty windows of a
        merged += b[:short]
        merged += [(x + y, (p, q)) for (x, p), (y, q) in zip(rest, b[: short - 1 if short else None : -1])]
        merged.sort(key=lambda w: -w[0])
        gap = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(queue, (-gap, tick, merged))
        tick += 1
    return [(total, _members(node)) for total, node in queue[0][2]] if queue else []


def near_equal(sizes: list[int], capacity: int, max_padding: float) -> tuple[list[tuple[int, int, int]], list[list[int]]]:
    """Pieces (item, start, length) and windows of piece numbers, none above the capacity."""
    total = sum(sizes)
    least = math.ceil(total / capacity)
    most = max(least, math.floor(total / (1 - max_padding) / capacity), 1)
    limit = capacity
    while True:
        pieces = [(i, s, min(limit, n - s)) for i, n in enumerate(sizes) for s in range(0, n, limit)]
        lengths = [n for _, _, n in pieces]
        for windows in range(least, most + 1):
            found = differencing(lengths, windows)
            if found[0][0] <= capacity:
                return pieces, [members for _, members in found]
        if limit == 1:
            most += 1
        limit = max(1, limit // 2)


class Packer:
    """Rests of documents waiting for a shard to fill."""

    def __init__(self, capacity: int, shard_windows: int, max_padding: float, first_id: int):
        self.capacity, self.full = capacity, capacity * shard_windows
        self.max_padding, self.sequence = max_padding, first_id
        self.waiting: list[tuple] = []
        self.tokens = 0

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        """(key, start, ids, doc_tokens, sequence_id, offset) of what can be placed now."""
        n = len(ids) // 4
        start = 0
        while n - start >= self.capacity:
            yield key, start, ids[4 * start : 4 * (start + self.capacity)], n, self.sequence, 0
            self.sequence += 1
            start += self.capacity
        if start < n:
            yield from self.add_rest(key, start, ids[4 * start :], n)

    def add_rest(self, key, start: int, ids: bytes, n: int) -> Iterator[tuple]:
        """The same of a part of a document that is shorter than a window."""
        self.waiting.append((key, start, ids, n))
        self.tokens += len(ids) // 4
        if self.tokens >= self.full:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if not self.waiting:
            return
        pieces, windows = near_equal([len(w[2]) // 4 for w in self.waiting], self.capacity, self.max_padding)
        for members in windows:
            offset = 0
            for p in sorted(members):
                item, cut, length = pieces[p]
                key, start, ids, n = self.waiting[item]
                yield key, start + cut, ids[4 * cut : 4 * (cut + length)], n, self.sequence, offset
                offset += length
            self.sequence += 1
        self.waiting, self.tokens = [], 0

    def rest(self) -> Iterator[tuple]:
        """What waits for a shard to fill: (key, start, ids, doc_tokens)."""
        yield from self.waiting
        self.waiting, self.tokens = [], 0


def pack(
    docs: DataFrame,
    key: str,
    text: str,
    tokenizer_path: str,
    end_id: int,
    capacity: int = CAPACITY,
    shard_windows: int = SHARD_WINDOWS,
    max_padding: float = MAX_PADDING,
    literal: bool = False,
) -> DataFrame:
    """One row a piece: (id, start, ids, doc_tokens, sequence_id, offset); ids packed as little-endian unsigned 32-bit.

    With ``literal`` the names of added tokens inside texts are text like any other.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())  # a vocabulary, under two MB
    columns = [
        T.StructField("id", docs.schema[key].dataType),
        T.StructField("start", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
    schema = T.StructType(columns)
    end = np.array([end_id], "<u4").tobytes()

    def made(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.binary(), *[pa.int64()] * (len(names) - 3)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, split = _tokenizer(file, literal), TaskContext.get().partitionId()
        packer = Packer(capacity, shard_windows, max_padding, split << 40)
        names, kind = [*schema.names, "split"], None
        for batch in batches:
            kind = batch.schema.field(0).type
            _, offsets = arrow_text.texts(batch.column(1))
            for start, stop in arrow_text.ranges(offsets, SLICE_BYTES):
                part = batch.slice(start, stop - start)
                ids = tokenizer.encode([t or "" for t in part.column(1).to_pylist()])
                rows = [(*r, split) for k, i in zip(part.column(0).to_pylist(), ids) for r in packer.add(k, i + end)]
                if rows:
                    yield made(rows, kind, names)
        rows = [(*r, None, place, split) for place, r in enumerate(packer.rest())]
        if rows:
            yield made(rows, kind, names)
        arrow_text.give_back()

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["split", "offset"])
        packer = Packer(capacity, shard_windows, max_padding, (1 << 62) + (int(frame["split"].iloc[0]) // SPLITS << 32))
        rows = [r for k, ids, n, s in zip(frame["id"], frame["ids"], frame["doc_tokens"], frame["start"]) for r in packer.add_rest(k, int(s), ids, int(n))]
        rows += packer.flush()
        return pd.DataFrame(rows, columns=schema.names)

    first = written(docs.select(key, text).mapInArrow(run, T.StructType([*columns, T.StructField("split", T.LongType())])), "packed-pieces")
    rests = first.where("sequence_id is null")
    last = rests.groupBy(F.floor(F.col("split") / SPLITS)).applyInPandas(gather, schema)
    return first.where("sequence_id is not null").select(*schema.names).unionByName(last)
