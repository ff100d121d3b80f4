"""Quality by importance resampling: hashed n-gram models of target and raw text.

Words and marks, and pairs of neighbours, are hashed into ``BUCKETS`` buckets. Two
generative models hold the share of each bucket: in the target texts (a bounded
sample of labelled rows) and in all texts. A text's log importance is the sum over its
n-grams of the log ratio of the two shares, its own first ``OWN`` occurrences of each left out of
both models (else a text's rare words would speak for what it is labelled). Gumbel top-k draws without replacement in
proportion to importance: to each log importance comes Gumbel noise, made from the hash
of the row, and the k largest sums are kept.

k is the number of texts whose log importance comes within ``MARGIN`` of the level that
all but ``missed`` of the labelled target texts reach, so what is like the target stays.

Defined cases: null or empty text has no n-grams and log importance 0; without target rows
both models agree, and all is kept; repeated rows get the same sum, and of equal sums at
the cut the smaller ids stay (null first); other columns stay, but columns named as the outputs are
replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.llm import arrow_text, shingles
from halyard.sources.scratch import written

BUCKETS = 1 << 15
TARGET_ROWS = 50_000
MISSED = 0.001
MARGIN = 4.0  # nats below that level; Gumbel noise seldom moves a text further
SMOOTHING = 2.0
OWN = 3  # occurrences of an n-gram in a text that do not speak for or against the text itself
SLICE_BYTES = 1 << 18
BINS = 1000
FEW = 1000
U = np.uint64

# 0 space, 1 marks, 2 letters, digits and all beyond ASCII
KIND = np.ones(256, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = 0
KIND[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), ord("_"), *range(0x80, 0x100)]] = 2


def buckets(data: np.ndarray, offsets: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the rows, and the row it is in."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = KIND[data]
    edge = np.zeros(n + 1, bool)  # a token starts or ends before this byte
    edge[offsets] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    edge[[0, n]] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    some = kind[starts] > 0
    starts, ends = starts[some], ends[some]
    up, down = shingles.powers.get(n + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[:n])])
    token = shingles.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
    row = np.searchsorted(offsets, starts, "right") - 1
    same = row[:-1] == row[1:]
    pair = shingles.mix(token[:-1] * shingles.BASE + token[1:])[same]
    grams = np.concatenate([token, pair])
    return (grams % U(count)).astype(np.int64), np.concatenate([row, row[:-1][same]])


def _slices(batch: pa.RecordBatch, text: str):
    data, offsets = arrow_text.texts(batch.column(batch.schema.get_field_index(text)))
    for start, stop in arrow_text.ranges(offsets, SLICE_BYTES):
        yield start, stop, data, offsets[start : stop + 1]


def train(docs: DataFrame, text: str, target: str, count: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in all rows, and in the target rows (column ``target`` true).

    Each task adds up all its rows; one row a bucket reaches the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, wanted = np.zeros(count, np.int64), np.zeros(count, np.int64)
        for batch in batches:
            flags = np.array(batch.column(1).to_pylist(), bool)
            for start, stop, data, offsets in _slices(batch, "body"):
                bucket, row = buckets(data, offsets, count)
                raw += np.bincount(bucket, minlength=count)
                wanted += np.bincount(bucket[flags[start:stop][row]], minlength=count)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(wanted[some])], ["bucket", "raw", "target"])
        arrow_text.give_back()

    slim = docs.select(F.col(text).alias("body"), F.coalesce(F.col(target), F.lit(False)).alias("flag"))
    rows = slim.mapInArrow(add, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, wanted = np.zeros(count), np.zeros(count)
    for bucket, r, w in rows:
        raw[bucket], wanted[bucket] = r, w
    return raw, wanted


def score(docs: DataFrame, text: str, target: str, raw: np.ndarray, wanted: np.ndarray, out: str = "log_ratio") -> DataFrame:
    """The rows with their log importance; target rows are left out of both models when they are scored."""
    kept = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])
    count, share = len(raw), wanted.sum() / max(raw.sum(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = np.array(batch.column(batch.schema.get_field_index(target)).to_pylist(), bool)
            found = np.zeros(batch.num_rows)
            for start, stop, data, offsets in _slices(batch, text):
                bucket, row = buckets(data, offsets, count)
                own, n = np.unique(row * count + bucket, return_counts=True)
                row, bucket = own // count, own % count
                mine = np.minimum(n, OWN)
                in_target = wanted[bucket] - mine * flags[start:stop][row]
                ratio = np.log(in_target + SMOOTHING) - np.log((raw[bucket] - mine) * share + SMOOTHING)
                found[start:stop] = np.bincount(row, n * ratio, stop - start)
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found)], schema.names)
        arrow_text.give_back()

    return docs.mapInArrow(run, schema)


def largest(scored: DataFrame, value: str, tie: str, k: int) -> tuple[float, DataFrame]:
    """The level above which all rows are among the k largest, and the rows at or below it that are too.

    Histograms narrow the place of the k-th value down to a bin of few rows or of one value; only
    that bin is sorted.
    """
    low, high, rows = scored.agg(F.min(value), F.max(value), F.count("*")).first()
    if k >= rows or low is None:
        return float("-inf"), scored.limit(0)
    inside, need = rows, k
    top = high
    while inside > FEW and low < top:
        width = (top - low) / BINS
        if width <= 0 or low + width <= low or top - width >= top:
            break
        number = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        part = scored.where((F.col(value) >= low) & (F.col(value) <= top))
        counts = part.groupBy(number.alias("bin")).agg(F.count("*"), F.min(value), F.max(value)).collect()  # BINS rows at most
        for _, n, least, most in sorted(counts, reverse=True):
            if need <= n:
                inside, low, top = n, least, most
                break
            need -= n
    edge = scored.where((F.col(value) >= low) & (F.col(value) <= top)).orderBy(F.desc(value), tie).limit(need)
    return top, edge


def resample(docs: DataFrame, key: str, text: str, labelled: DataFrame, missed: float = MISSED, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(id, log_ratio, sample_key, kept) of every row; ``labelled`` holds the ids of target rows in column ``id``.

    At most ``target_rows`` of them, by hash, train the target model: that many ids are broadcast.
    """
    wanted = labelled.select(F.col("id").alias("target_id")).dropna().distinct().orderBy(F.xxhash64("target_id"), "target_id").limit(target_rows)
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("body"))
    flagged = slim.join(F.broadcast(wanted), F.col("id") == F.col("target_id"), "left").select(
        "id", "body", F.col("target_id").isNotNull().alias("flag")
    )
    raw, target = train(flagged, "body", "flag")
    uniform = (F.shiftrightunsigned(F.xxhash64("id", "body"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    named = flagged.select("id", "body", "flag", (-F.log(-F.log(uniform))).alias("noise"))
    scored = score(named, "body", "flag", raw, target).select("id", "flag", "log_ratio", (F.col("log_ratio") + F.col("noise")).alias("sample_key"))
    scored = written(scored, "importance")
    level = scored.where("flag").agg(F.percentile("log_ratio", F.lit(missed))).first()[0]  # of target_rows values at most
    k = scored.where(F.col("log_ratio") >= F.lit(level - MARGIN if level is not None else float("-inf"))).count()
    top, edge = largest(scored, "sample_key", "id", k)
    last = edge.agg(F.min(F.struct("sample_key", F.lit(0)))["sample_key"].alias("key"), F.count("*").alias("n")).first()
    above = F.col("sample_key") > F.lit(top)
    if not last.n:
        return scored.select("id", "log_ratio", "sample_key", above.alias("kept"))
    ties = edge.where(F.col("sample_key") == last.key).agg(F.max("id")).first()[0]
    at_cut = (F.col("sample_key") == last.key) & (F.col("id").isNull() | (F.col("id") <= F.lit(ties)))
    kept = above | (F.col("sample_key") > last.key) | F.coalesce(at_cut, F.lit(False))
    return scored.select("id", "log_ratio", "sample_key", kept.alias("kept"))
