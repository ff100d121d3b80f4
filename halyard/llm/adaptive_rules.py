"""Quality rules with limits of their own for every language and source.

1. Each text is measured once (``measured``): words, symbols, repeated lines, repeated words.
2. Four rates of the documents that pass the base rules go into quantile sketches, one for each
   (language, source, rate). A sketch is a table of log-linear buckets with their counts: whole
   numbers below 64 are their own bucket, larger ones keep their six leading bits, so a
   quantile is off by less than one part in 64. Sketches merge by adding counts: a language's is the sum of
   its sources', the whole corpus's that of all languages. The result does not depend on how rows lie in partitions.
3. The limits of a group are fences around its quartiles: ``factor`` times the distance of the
   quartiles, or times the rate's least spread where they are nearer. A group of fewer than
   ``least_rows`` documents takes the limits of its language, a small language those of the corpus.
4. Limits are joined to the measures by language and source; a document outside any limit goes.

A hot source adds up in its own tasks before the shuffle: what is shuffled is one row a bucket and task.

Defined cases: null text is empty; text without words fails the base rules. A null language or source is a group
like any other. Repeated rows and rows that share an id are measured and counted each. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.llm import arrow_text
from halyard.sources.scratch import written

SLICE_BYTES = 1 << 20
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
LEAST_ROWS = 200
FACTOR = 4
EXACT_BITS = 6
SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


@dataclass(frozen=True)
class Rate:
    """A whole-numbered rate, its least spread, and whether low values are outside too."""

    name: str
    sql: str
    spread: int
    both: bool = False


RATES = [
    Rate("symbols", "1000000 * n_symbols div greatest(word_chars, 1)", 5_000),
    Rate("dup_lines", "1000000 * n_dup_lines div greatest(n_lines, 1)", 100_000),
    Rate("repeats", "1000000 * n_repeat_words div greatest(n_words, 1)", 100_000),
    Rate("word_length", "1000 * word_chars div greatest(n_words, 1)", 250, both=True),
]


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    pairs = ids[:-2] * len(numbers) + ids[1:-1]
    if len(numbers) >= 1 << 21:  # three numbers would not fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, place, times = np.unique(pairs * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[place] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def measure(data: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    words = data.split()  # at the six white-space bytes, as the contract has it
    bare = data.translate(None, SPACE)
    points = np.frombuffer(bare, np.uint8)
    lines = [line for line in data.split(b"\n") if line.translate(None, SPACE)]
    return (
        len(words),
        len(points) - int(np.count_nonzero((points & 0xC0) == 0x80)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(words),
        len(lines),
    )


def measured(docs: DataFrame, key: str, text: str, lang: str, source: str) -> DataFrame:
    """(id, lang, source, counts) of every row."""
    slim = docs.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    schema = T.StructType([*slim.schema.fields[:3], *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_text.texts(batch.column(3))
            for start, stop in arrow_text.ranges(offsets, SLICE_BYTES):
                rows = [measure(data[a:b].tobytes()) for a, b in zip(offsets[start:stop], offsets[start + 1 : stop + 1])]
                part = batch.slice(start, stop - start)
                counts = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *counts], schema.names)

    return slim.mapInArrow(run, schema)


def fails_base() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def sketches(measures: DataFrame, rates: Sequence[Rate] = RATES) -> DataFrame:
    """(lang, source, rate, bucket, n): the sketch of every group, from rows that pass the base rules."""
    values = measures.where(~fails_base()).select("lang", "source", *[F.expr(r.sql).alias(r.name) for r in rates])
    long = values.unpivot(["lang", "source"], [r.name for r in rates], "rate", "value")
    low_bits = F.greatest(F.length(F.bin("value")) - EXACT_BITS, F.lit(0))
    sized = long.withColumn("bits", low_bits).withColumn("base", F.expr("shiftleft(shiftright(value, bits), bits)"))
    return sized.groupBy("lang", "source", "rate", F.expr("base + (shiftleft(1L, bits) - 1) div 2").alias("bucket")).agg(F.count("*").alias("n"))


def merged(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketches added up to coarser groups."""
    return cells.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))


def fences(cells: DataFrame, by: Sequence[str], rates: Sequence[Rate] = RATES, factor: int = FACTOR) -> DataFrame:
    """(by, rows, limits) of each group: limits is a struct of (low, high) a rate, null where nothing bounds."""
    place = W.partitionBy(*by, "rate")  # a group has at most some 1,300 buckets a rate
    through = cells.select("*", F.sum("n").over(place.orderBy("bucket")).alias("through"), F.sum("n").over(place).alias("rows"))
    first = lambda k: F.min(F.when(4 * F.col("through") >= k * F.col("rows"), F.col("bucket")))
    quartiles = through.groupBy(*by, "rate").agg(F.max("rows").alias("rows"), first(1).alias("q1"), first(3).alias("q3"))

    def limits(rate: Rate) -> Column:
        wide = factor * F.greatest(F.col("q3") - F.col("q1"), F.lit(rate.spread))
        here = F.col("rate") == rate.name
        low = F.max(F.when(here, F.col("q1") - wide)) if rate.both else F.lit(None).cast("long")
        return F.struct(low.alias("low"), F.max(F.when(here, F.col("q3") + wide)).alias("high")).alias(rate.name)

    return quartiles.groupBy(*by).agg(F.max("rows").alias("rows"), F.struct(*[limits(r) for r in rates]).alias("limits"))


def limits(cells: DataFrame, rates: Sequence[Rate] = RATES, factor: int = FACTOR, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(lang, source, limits) of every group of the sketches, a small one's from what contains it."""
    by_language = merged(cells, ["lang"])
    own, language, corpus = (
        fences(c, by, rates, factor) for c, by in ((cells, ["lang", "source"]), (by_language, ["lang"]), (merged(by_language, []), []))
    )
    language = language.select(F.col("lang").alias("lang_"), F.when(F.col("rows") >= least_rows, F.col("limits")).alias("of_language"))
    chosen = own.join(language, F.col("lang").eqNullSafe(F.col("lang_")), "left")
    enough = F.when(F.col("rows") >= least_rows, F.col("limits"))
    everything = corpus.select("limits").scalar()
    return chosen.select("lang", "source", F.coalesce(enough, "of_language", everything).alias("limits"))


def inside(rates: Sequence[Rate] = RATES) -> Column:
    """Whether no rate is outside the limits joined to the row."""
    out = F.lit(True)
    for r in rates:
        value, low, high = F.expr(r.sql), F.col("limits")[r.name]["low"], F.col("limits")[r.name]["high"]
        out = out & F.coalesce(value <= high, F.lit(True)) & F.coalesce(value >= low, F.lit(True))
    return out


def judged(
    docs: DataFrame,
    key: str,
    text: str,
    lang: str,
    source: str,
    rates: Sequence[Rate] = RATES,
    factor: int = FACTOR,
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """(id, lang, source, counts, limits, base_failed, kept) of every row."""
    measures = written(measured(docs, key, text, lang, source), "rule-measures")
    cells = written(sketches(measures, rates), "rule-sketches")
    found = limits(cells, rates, factor, least_rows).select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), "limits")
    same = F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_"))
    return measures.join(found, same, "left").select(
        *measures.columns, "limits", fails_base().alias("base_failed"), (~fails_base() & inside(rates)).alias("kept")
    )
