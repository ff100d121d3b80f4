"""Order statistics without an un-partitioned sort.

A running total over all rows, or over one very large group, would put the
whole sequence into one task. Here rows are range-partitioned into slices, each
slice is summed on its own, and the few slice totals give every slice its
starting point. A group of any size spreads over as many slices as it needs.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from halyard.sources.scratch import written

SLICE = "__slice"


def ordered_slices(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Rows range-partitioned by ``order``, the slice number as a stored column.

    Writing the rows fixes the slice of each: a lost executor cannot make a
    later stage see other slice limits than an earlier one.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *order).withColumn(SLICE, F.spark_partition_id()), "slices")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys, null being equal to null."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def running_totals(
    df: DataFrame, group: list[str], order: list[str], totals: list[str], parts: int | None = None
) -> DataFrame:
    """Adds ``<t>_through``: the total of ``t`` up to and including the row, within the group."""
    sliced = ordered_slices(df, [*group, *order], parts)
    place = [*group, SLICE]
    earlier = W.partitionBy(*group).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(*place)
        .agg(*[F.sum(t).alias(f"__{t}_slice") for t in totals])
        .select(*place, *[F.coalesce(F.sum(f"__{t}_slice").over(earlier), F.lit(0)).alias(f"__{t}_start") for t in totals])
    )
    inside = W.partitionBy(*place).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = sliced.join(starts, same_keys(sliced, starts, place)).drop(*[starts[c] for c in place])
    return joined.select(*df.columns, *[(F.sum(t).over(inside) + F.col(f"__{t}_start")).alias(f"{t}_through") for t in totals])


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], accuracy: int = 10_000
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of several columns, exact, by one method at any size.

    An approximate pass brackets the values at the two ranks around each target;
    counts below and inside each bracket prove it, and an end that does not hold is
    opened. Only the values inside a bracket are counted and ranked. The columns are
    written once for the passes.
    """
    margin = 2.0 / accuracy
    edges = [e for p in probabilities for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    numbers = written(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "quantiles")
    probe = numbers.agg(
        *[F.struct(F.count(c).alias("n"), F.percentile_approx(c, edges, accuracy).alias("edges")).alias(c) for c in columns]
    ).first()
    out: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    brackets = {
        f"{c}@{i}": (c, i, probe[c].edges[2 * i], probe[c].edges[2 * i + 1], p * (probe[c].n - 1))
        for c in columns
        for i, p in enumerate(probabilities)
        if probe[c].n
    }
    if not brackets:
        return out
    # counts of the values under and up to each edge show whether the two ranks lie between them
    proof = numbers.agg(
        *[
            F.struct(F.count_if(F.col(c) < low).alias("under"), F.count_if(F.col(c) <= high).alias("through")).alias(tag)
            for tag, (c, _, low, high, _) in brackets.items()
        ]
    ).first()
    for tag, (c, i, low, high, position) in list(brackets.items()):
        if proof[tag].under > math.floor(position):
            low = float("-inf")
        if proof[tag].through <= math.ceil(position):
            high = float("inf")
        if low == high:  # both ranks hold this value
            out[c][i] = low
            del brackets[tag]
        else:
            brackets[tag] = (c, i, low, high, position)
    if not brackets:
        return out
    below = {tag: proof[tag].under if low > float("-inf") else 0 for tag, (_, _, low, _, _) in brackets.items()}
    hits = {tag: F.col(c).between(low, high) for tag, (c, _, low, high, _) in brackets.items()}
    tagged = F.array(
        *[F.when(hits[tag], F.struct(F.lit(tag).alias("tag"), F.col(brackets[tag][0]).alias("value"))) for tag in hits]
    )
    near = (
        numbers.where(reduce(lambda a, b: a | b, hits.values()))
        .select(F.explode(tagged).alias("s"))
        .where(F.col("s").isNotNull())
        .groupBy("s.tag", "s.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_totals(near, ["tag"], ["value"], ["n"])

    def at(tag: str, rank: int) -> Column:
        reached = (F.col("tag") == tag) & (F.col("n_through") + below[tag] > rank)
        return F.min(F.when(reached, F.col("value")))

    found = ranked.agg(
        *[
            at(tag, rank).alias(f"{tag}{side}")
            for tag, (*_, position) in brackets.items()
            for side, rank in (("<", math.floor(position)), (">", math.ceil(position)))
        ]
    ).first()
    for tag, (c, i, _, _, position) in brackets.items():
        low, high = found[f"{tag}<"], found[f"{tag}>"]
        out[c][i] = low + (high - low) * (position - math.floor(position))
    return out


# ---------------------------------------------------------------- two samples


def kolmogorov_tail(distance: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample p-value: 2 * sum (-1)^(k-1) exp(-2 k^2 x^2)."""
    x = F.sqrt(n * m / (n + m)) * distance
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda total, k: total
        + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * k * k * x * x),
    )
    # below 0.2 the tail is 1 to more than ten digits and the series no longer settles
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


#: Both samples at most this large: the exact p-value; above, the series. The reference changes over here too (fixed value).
EXACT_ROWS = 10_000


def lattice_tail(n: int, m: int, gap: int) -> float:
    """Share of the orders of n and m rows in which the two distributions part by gap / (n m) or more.

    An order is a path over the lattice (i, j); the last step into (i, j) came from i - 1 with probability
    i / (i + j). All paths are followed diagonal by diagonal; one that reaches the gap counts whatever follows,
    so small shares keep their digits.
    """
    n, m = min(n, m), max(n, m)
    if gap <= 0:
        return 1.0
    i = np.arange(n + 1)
    reached = np.zeros(n + 1)
    for s in range(1, n + m + 1):
        low, high = max(0, s - m), min(n, s)  # the diagonal's part of the lattice
        at = i[low : high + 1]
        stay = reached[low : high + 1] * (s - at)
        stay[1 if low == 0 else 0 :] += reached[max(low - 1, 0) : high] * at[1 if low == 0 else 0 :]
        reached[low : high + 1] = np.where(np.abs(at * m - (s - at) * n) >= gap, 1.0, stay / s)
        if low:
            reached[low - 1] = 0.0
    return float(min(reached[n], 1.0))


@F.pandas_udf(DoubleType())
def _exact_tail(distance: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """One row a tested column; null where a sample is empty or larger than ``EXACT_ROWS``."""

    def tail(d, a, b):
        if pd.isna(d) or min(a, b) < 1 or max(a, b) > EXACT_ROWS:
            return None
        return lattice_tail(int(a), int(b), round(d * a * b))

    return pd.Series([tail(*row) for row in zip(distance, n, m)], dtype="float64")


def ks_two_sample(reference: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and p-value per column, exact for samples of at most ``EXACT_ROWS``."""

    def side(df: DataFrame, is_reference: bool) -> DataFrame:
        return df.select(
            F.lit(is_reference).alias("is_reference"), *[F.col(c).cast("double").alias(c) for c in columns]
        )

    values = (
        side(reference, True)
        .unionByName(side(incoming, False))
        .unpivot("is_reference", columns, "column_name", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count_if("is_reference").alias("ref"), F.count_if(~F.col("is_reference")).alias("inc"))
    )
    return _distance(values)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n): rows of each distinct value of numeric columns, null left out."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column_name", "value")
    return long.where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def ks_of_counts(reference: DataFrame, incoming: DataFrame) -> DataFrame:
    """``ks_two_sample`` of two tables of ``value_counts``, whose rows of one value add up."""
    none = F.lit(0).cast("long")
    both = reference.select("column_name", "value", F.col("n").alias("ref"), none.alias("inc")).unionByName(
        incoming.select("column_name", "value", none.alias("ref"), F.col("n").alias("inc"))
    )
    return _distance(both.groupBy("column_name", "value").agg(F.sum("ref").alias("ref"), F.sum("inc").alias("inc")))


def _distance(values: DataFrame) -> DataFrame:
    through = running_totals(values, ["column_name"], ["value"], ["ref", "inc"])
    sizes = through.groupBy("column_name").agg(F.sum("ref").alias("ref_rows"), F.sum("inc").alias("inc_rows"))
    gap = F.abs(
        F.try_divide(F.col("ref_through").cast("double"), F.col("ref_rows").cast("double"))
        - F.try_divide(F.col("inc_through").cast("double"), F.col("inc_rows").cast("double"))
    )
    # one row per tested column
    found = through.join(F.broadcast(sizes), "column_name").groupBy("column_name").agg(
        F.max("ref_rows").alias("ref_rows"), F.max("inc_rows").alias("inc_rows"), F.max(gap).alias("statistic")
    )
    n, m = F.col("ref_rows").cast("double"), F.col("inc_rows").cast("double")
    exact = _exact_tail("statistic", "ref_rows", "inc_rows")
    return found.select("*", F.coalesce(exact, kolmogorov_tail(F.col("statistic"), n, m)).alias("p_value"))


# ---------------------------------------------------------------- ranked scores


def score_counts(scored: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score with their running totals, for every group."""
    counts = scored.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    return running_totals(counts, [*by], ["score"], ["pos", "neg"])


def area_under_curve(scored: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """ROC area by mid-ranks: a positive beats every lower negative and half of the tied ones."""
    counts = score_counts(scored, label, score, by)
    lower = (F.col("neg_through") - F.col("neg")).cast("double")
    wins = F.sum(F.col("pos").cast("double") * (lower + F.col("neg") / F.lit(2.0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return counts.groupBy(*by).agg(F.try_divide(wins, pairs).alias("roc_auc"))


def roc_points(scored: DataFrame, label: str, score: str) -> DataFrame:
    """True and false positive rate at every distinct threshold (score >= threshold)."""
    counts = score_counts(scored, label, score)
    sizes = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("s")).scalar()

    def rate(part: str, size: Column) -> Column:
        at_or_above = size - F.col(f"{part}_through") + F.col(part)
        return F.try_divide(at_or_above.cast("double"), size.cast("double"))

    return counts.select(
        F.col("score").alias("threshold"), rate("neg", sizes["n"]).alias("fpr"), rate("pos", sizes["p"]).alias("tpr")
    )


# ---------------------------------------------------------------- hash-ordered positions



def hash_positions(df: DataFrame, key: str, within: list[str], seed: int = 42) -> DataFrame:
    """Adds ``position``: 0.. in the order of a seeded hash of ``key``, per ``within`` group (null is one).

    Leading hex digits of the hash cut each group into even slices, so a group
    with most of the rows is still numbered in parallel. There are at least 16
    slices for each shuffle partition; their number does not change a position.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = max(3, math.ceil(math.log(16 * partitions, 16)))
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    hashed = df.withColumn("__hash", F.md5(F.concat(F.lit(f"{seed}:"), text))).withColumn(SLICE, F.substring("__hash", 1, digits))
    place = [*within, SLICE]
    earlier = W.partitionBy(*within).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    starts = (
        hashed.groupBy(*place)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*place, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    )
    inside = W.partitionBy(*place).orderBy("__hash", key)
    joined = hashed.join(starts, same_keys(hashed, starts, place)).drop(*[starts[c] for c in place])
    return joined.select(*df.columns, (F.row_number().over(inside) - 1 + F.col("__start")).alias("position"))
