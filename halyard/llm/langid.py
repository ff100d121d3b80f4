"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent 1- to 3-grams of a text, most frequent first.
A document gets the language whose profile is nearest to its own by the
out-of-place distance: the sum of the differences in rank, an n-gram that the
language's profile lacks counting as far as the profile is long.

Texts are lowered; whatever is not a letter is one space between words. n-grams
are single letters, pairs, and triples with no space in the middle. Ties in
frequency go to the smaller n-gram, ties in distance to the first language by name.

Defined cases: text that is null or has no letter is ``und`` with score 0, and so
is every text when nothing was learned; repeated rows each count; other columns
stay, but columns named as the outputs are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.llm import arrow_text

PROFILE = 400
BITS = 21  # of a code point
SLICE_CHARS = 1 << 19
HELD_GRAMS = 1 << 21
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For every code point whether it is a letter, made once a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """All n-grams of a text, each as one number; none if it has no letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    points = np.where(_is_letter()[points], points, 32)
    space = points == 32
    points = points[~(space & np.concatenate([[False], space[:-1]]))]
    if len(points) < 3:
        return np.zeros(0, np.int64)
    pairs = points[:-1] << BITS | points[1:]
    triples = pairs[:-1] << BITS | points[2:]
    return np.concatenate([points[points != 32], pairs, triples[points[1:-1] != 32]])


def profile(keys: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first."""
    if len(keys) > length:  # only what ties with the last place needs sorting
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))[:length]]


def learn(docs: DataFrame, text: str, language: str, length: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language from all rows with a text and a language.

    Every task adds up its n-grams before they are shuffled. What reaches the
    driver is ``length`` n-grams a language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            for name, (keys, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys), pa.array(n)], ["language", "gram", "n"])
            held.clear()

        def add(name: str, parts: list[np.ndarray]):
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            if name in held:
                keys = np.concatenate([held[name][0], keys])
                n = np.concatenate([held[name][1], n])
                keys, at = np.unique(keys, return_inverse=True)
                n = np.bincount(at, n, len(keys)).astype(np.int64)
            held[name] = keys, n

        for batch in batches:
            waiting: dict[str, list[np.ndarray]] = {}
            size: dict[str, int] = {}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting.setdefault(name, []).append(grams(body))
                size[name] = size.get(name, 0) + len(body)
                if size[name] > SLICE_CHARS:
                    add(name, waiting.pop(name))
                    size[name] = 0
            for name, parts in waiting.items():
                add(name, parts)
            if sum(len(keys) for keys, _ in held.values()) > HELD_GRAMS:
                yield from out()
        yield from out()
        arrow_text.give_back()

    slim = docs.select(F.col(language).cast("string").alias("language"), F.col(text).alias("body")).dropna()
    counted = slim.mapInArrow(count, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("language").orderBy(F.desc("n"), "gram")
    rows = counted.withColumn("place", F.row_number().over(best)).where(F.col("place") <= length).collect()
    found: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r.language, r.place)):
        found.setdefault(row.language, []).append(row.gram)
    return found


class Profiles:
    """The languages' profiles as one table of ranks."""

    def __init__(self, learned: dict[str, list[int]], length: int):
        self.names, self.length = sorted(learned), length
        self.keys = np.unique(np.concatenate([np.array(learned[n], np.int64) for n in self.names]))
        self.ranks = np.full((len(self.keys) + 1, len(self.names)), length, np.int64)  # the last row: in no profile
        for i, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.keys, learned[name]), i] = np.arange(len(learned[name]))

    def nearest(self, text: str) -> tuple[str, float]:
        """Language and 1 - distance / largest possible distance."""
        found = grams(text)
        if not len(found):
            return UNKNOWN, 0.0
        own = profile(*np.unique(found, return_counts=True), self.length)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        ranks = self.ranks[np.where(self.keys[at] == own, at, len(self.keys))]
        away = np.where(ranks == self.length, self.length, np.abs(ranks - np.arange(len(own))[:, None])).sum(0)
        best = int(np.argmin(away))
        return self.names[best], 1.0 - float(away[best]) / (self.length * len(own))


def predict(
    docs: DataFrame, text: str, learned: dict[str, list[int]], length: int = PROFILE, language: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """The rows with the nearest language and its score from 0 to 1."""
    kept = [f for f in docs.schema.fields if f.name not in (language, score)]
    schema = T.StructType([*kept, T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(learned, length) if learned else None
        for batch in batches:
            bodies = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = [profiles.nearest(b or "") if profiles else (UNKNOWN, 0.0) for b in bodies]
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            arrays += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)
        arrow_text.give_back()

    return docs.mapInArrow(run, schema)
