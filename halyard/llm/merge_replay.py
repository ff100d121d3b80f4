"""Byte-level BPE by replaying merges over all distinct words of a slice of the corpus.

The rows of a slice are split by the pattern; each distinct word not met before
is laid out once, byte by byte, in a chain of some thousand words. An inverted index holds, for
every merge that could apply somewhere, the positions where its pair stands; a
heap gives the merges in rank order. Applying a merge walks its positions and
touches only the two neighbours of each. Texts are then put together from the
ids of their words. Spark deals the slices out: no word is shuffled, and memory
holds one slice and a bounded store of words met before (beyond the bound the
store starts anew and words are replayed again).

Defined cases: null text is empty and has no ids; repeated rows are encoded each;
other columns stay, but a column named as the output is replaced; an empty table
gives no rows. Ids are bytes, little-endian unsigned 32-bit.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from halyard.llm import arrow_text

SLICE_BYTES = 3 << 20
STORED_WORDS = 300_000
REPLAYED_WORDS = 4_000  # laid out at once: the chain and its index stay in the processor's cache
NONE: dict[int, int] = {}  # of tokens without pairs

_encoders: dict[tuple, Encoder] = {}


class Encoder:
    """The merges of one rank file, and the words met before."""

    def __init__(self, rank_file: bytes, pattern: str):
        lines = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.words = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pieces: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.pieces[rank] = token
        # the pairs that merge: of each rank by left half, of each left half by right, of each right half by left
        self.halves: list[dict[int, int]] = [NONE] * len(self.pieces)
        self.by_left: list[dict[int, int]] = [NONE] * len(self.pieces)
        self.by_right: list[dict[int, int]] = [NONE] * len(self.pieces)
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    for table, a, b, c in ((self.halves, rank, left, right), (self.by_left, left, right, rank), (self.by_right, right, left, rank)):
                        if table[a] is NONE:
                            table[a] = {}
                        table[a][b] = c
        self.byte_ranks = np.full((256, 256), -1, np.int64)  # of two bytes, -1 where they do not merge
        byte_of = {rank: b for b, rank in enumerate(self.single.tolist())}
        for left, b in byte_of.items():
            for right, rank in self.by_left[left].items():
                if right in byte_of:
                    self.byte_ranks[b, byte_of[right]] = rank
        self.store: dict[str, bytes] = {}

    def _alone(self, word: bytes) -> list[int]:
        """One word by itself: merge the first pair of lowest rank until none is left."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        while len(ids) > 1:
            found = [(self.by_left[a].get(b, 1 << 60), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
            rank, at = min(found)
            if rank == 1 << 60:
                break
            ids[at : at + 2] = [rank]
        return ids

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, packed."""
        lengths = np.array([len(w) for w in words], np.int64)
        if not lengths.sum():
            return [b""] * len(words)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        data = np.frombuffer(b"".join(words), np.uint8)
        chain = self.single[data]
        n = len(chain)
        following = np.arange(1, n + 1)
        following[starts[1:][lengths > 0] - 1] = n  # the end of a word
        before = np.arange(-1, n - 1)
        before[starts[:-1][lengths > 0]] = n
        inner = np.flatnonzero(following < n)
        ranks = self.byte_ranks[data[inner], data[inner + 1]]
        ranks, positions = ranks[ranks >= 0], inner[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        edges = np.flatnonzero(np.diff(ranks, prepend=-1))
        index = {int(ranks[a]): positions[a:b].tolist() for a, b in zip(edges, [*edges[1:], len(ranks)])}
        queue = list(index)
        heapq.heapify(queue)
        token, after, prior = [*chain.tolist(), -1], [*following.tolist(), n], [*before.tolist(), n]
        odd = []
        while queue:
            rank = heapq.heappop(queue)
            places = index.pop(rank, None)
            if places is None:
                continue
            if len(places) > 1:
                places.sort()
            halves, rights, lefts = self.halves[rank], self.by_left[rank], self.by_right[rank]
            for p in places:
                q = after[p]
                if q == n or halves.get(token[p]) != token[q]:
                    continue
                token[p], token[q] = rank, -1
                r = after[p] = after[q]
                if r != n:
                    prior[r] = p
                    if rights:
                        new = rights.get(token[r])
                        if new is not None:
                            if new in index:
                                index[new].append(p)
                            else:
                                index[new] = [p]
                                heapq.heappush(queue, new)
                            if new <= rank:
                                odd.append(p)
                if lefts:
                    o = prior[p]
                    if o != n:
                        new = lefts.get(token[o])
                        if new is not None:
                            if new in index:
                                index[new].append(o)
                            else:
                                index[new] = [o]
                                heapq.heappush(queue, new)
                            if new <= rank:
                                odd.append(o)
        ids = np.array(token[:n], np.int64)
        alive = np.concatenate([[0], np.cumsum(ids >= 0)])
        packed = ids[ids >= 0].astype("<u4").tobytes()
        cuts = (alive[starts] * 4).tolist()
        out = [packed[a:b] for a, b in zip(cuts, cuts[1:])]
        # a merge that makes room for one of lower rank leaves the common order: those words alone
        for w in {int(np.searchsorted(starts, p, "right")) - 1 for p in odd}:
            out[w] = np.array(self._alone(words[w]), "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.words.findall(t) for t in texts]
        store = self.store
        missing = list(set().union(*split).difference(store))
        if len(store) + len(missing) > STORED_WORDS:
            store.clear()
            missing = list(set().union(*split))
        raw = [w.encode() for w in missing]
        whole = [self.ranks.get(w) for w in raw]
        for w, rank in zip(missing, whole):
            if rank is not None:
                store[w] = rank.to_bytes(4, "little")
        rest = [i for i, rank in enumerate(whole) if rank is None]
        for run in (rest[i : i + REPLAYED_WORDS] for i in range(0, len(rest), REPLAYED_WORDS)):
            for i, ids in zip(run, self.replay([raw[i] for i in run])):
                store[missing[i]] = ids
        return [b"".join(map(store.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoder(file: Broadcast, pattern: str) -> Encoder:
    """One encoder a Python worker, kept over tasks."""
    key = (hash(file.value), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(file.value, pattern)
    return _encoders[key]


def _mapped(docs: DataFrame, column: str, work) -> DataFrame:
    """The frame with a binary column made from Arrow batches."""
    kept = [f for f in docs.schema.fields if f.name != column]
    schema = T.StructType([*kept, T.StructField(column, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, made in work(batch):
                arrays = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(made, pa.binary())], [*[f.name for f in kept], column])

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, text: str, rank_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The rows with the packed ids of their text."""
    with open(rank_path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, about one MB

    def work(batch):
        encoder = _encoder(file, pattern)
        values = batch.column(batch.schema.get_field_index(text))
        for start, stop in arrow_text.ranges(arrow_text.texts(values)[1], SLICE_BYTES):
            part = batch.slice(start, stop - start)
            yield part, encoder.encode([v or "" for v in values.slice(start, stop - start).to_pylist()])

    return _mapped(docs, ids, work)


def decode(docs: DataFrame, ids: str, rank_path: str, pattern: str, out: str = "decoded") -> DataFrame:
    """The rows with the bytes that their packed ids stand for; null ids give no bytes."""
    with open(rank_path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batch):
        encoder = _encoder(file, pattern)
        values = batch.column(batch.schema.get_field_index(ids))
        yield batch, [encoder.decode(v or b"") for v in values.to_pylist()]

    return _mapped(docs, out, work)
