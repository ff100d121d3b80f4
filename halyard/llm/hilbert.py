"""Shards by Hilbert-curve order over several metadata dimensions, cut into runs.

Each dimension is quantised to whole numbers below 2**bits: text columns by a
hash bucket (equality on the column then touches few runs), sizes by their
logarithm. Rows sort by curve index, then by the hash of the text and the id, and
the order is cut into runs whose row counts differ by at most one (law "rows").

Defined cases: null text has size 16 and the checksum of no bytes; nulls in a
dimension share one bucket; null ids sort first. Equal rows are told apart by
their place in the input. Fewer rows than shards leave shards empty. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.sources.scratch import written

BITS = 8


def hash_cell(c: str, bits: int = BITS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(1 << bits))


def log_cell(c: Column, bits: int = BITS, largest_log2: int = 32) -> Column:
    """Whole numbers from one up on a logarithmic scale; beyond 2**largest_log2 the last cell."""
    top = (1 << bits) - 1
    return F.least(F.lit(top), F.floor(F.log2(F.greatest(c, F.lit(1))) * F.lit(top / largest_log2))).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def curve_index(cells: Sequence[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a point whose coordinates are below 2**bits.

    Works from the highest bit down: at each level a set bit of axis i mirrors the
    lower bits of axis 0, a clear one swaps them with axis i's; then the Gray code
    is undone and the bits are interleaved.
    """
    n = len(cells)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        first, own, low = F.get(x, F.lit(0)), F.get(x, s["i"]), s["q"] - one
        mirror = own.bitwiseAND(s["q"]) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        return F.transform(
            x,
            lambda v, j: F.when(mirror, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(
                F.when((j == 0) | (j == s["i"]), F.when(s["i"] == 0, v).otherwise(v.bitwiseXOR(swap))).otherwise(v)
            ),
        )

    levels = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
    places = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])

    def gray(x: Column) -> Column:
        """Every axis takes in the ones before it."""
        return F.transform(x, lambda v, j: F.aggregate(F.slice(x, F.lit(1), j + 1), zero, lambda a, y: a.bitwiseXOR(y)))

    def parity(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        return F.aggregate(levels, zero, lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - one)).otherwise(t))

    def interleaved(x: Column, t: Column) -> Column:
        bit = lambda s: F.when(F.get(x, s["i"]).bitwiseXOR(t).bitwiseAND(s["q"]) != 0, one).otherwise(zero)
        return F.aggregate(places, zero, lambda a, s: a * 2 + bit(s))

    turned = F.aggregate(steps, F.array(*[c.cast("long") for c in cells]), turn)
    return _let(turned, lambda x: _let(gray(x), lambda y: _let(parity(y), lambda t: interleaved(y, t))))


def in_curve_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with ``place``, their number from 0 in the order of the columns.

    Rows are range-partitioned and sorted; a row's place is the count of the
    partitions before it plus its number inside its own. The sorted rows are
    written first, so a repeated task cannot draw other range limits. The input
    place as last sort column keeps equal rows from sharing one range.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "input_place"]
    ranged = df.withColumn("input_place", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    row = F.monotonically_increasing_id()
    kept = written(
        ranged.drop("input_place").select("*", F.shiftright(row, 33).alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")),
        "curve-order",
    )
    before, starts = 0, []
    for part, n in sorted(kept.groupBy("part").count().collect()):  # one row a partition
        starts.append((part, before))
        before += n
    offsets = spark.createDataFrame(starts, "part long, start long")
    return kept.join(F.broadcast(offsets), "part").withColumn("place", F.col("start") + F.col("row")).drop("part", "row", "start").withColumn(
        "total", F.lit(before).cast("long")
    )


def shards(docs: DataFrame, key: str, text: str, categories: Sequence[str], n_shards: int, bits: int = BITS) -> DataFrame:
    """(id, size, text_crc32, curve, shard, slot) for every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(body).cast("long") + 16
    # named by place: the caller's columns cannot clash with them
    slim = docs.select(
        F.col(key).alias("id"),
        size.alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("text_hash"),
        *[hash_cell(c, bits).alias(f"cell_{i}") for i, c in enumerate(categories)],
    ).withColumn("cell_size", log_cell(F.col("size"), bits))
    cells = [F.col(f"cell_{i}") for i in range(len(categories))] + [F.col("cell_size")]
    curved = slim.select("id", "size", "text_crc32", "text_hash", curve_index(cells, bits).alias("curve"))
    placed = in_curve_order(curved, ["curve", "text_hash", "id"])
    shard = F.expr(f"({n_shards} * (place + 1) + total - 1) div total - 1")
    return placed.withColumn("shard", shard.cast("int")).select(
        "id", "size", "text_crc32", "curve", "shard", (F.col("place") - F.expr(f"(shard * total) div {n_shards}")).alias("slot")
    )


def write_shards(docs: DataFrame, key: str, placed: DataFrame, folder: str, n_shards: int) -> None:
    """The documents as one folder a shard, rows in slot order; ids must be unique here."""
    where = placed.select(F.col("id").alias(key), "shard", "slot")
    (
        docs.join(where, key)
        .repartition(n_shards, "shard")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(folder)
    )
