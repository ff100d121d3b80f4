"""Drift of an incoming batch against a reference frame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators.describe import numeric_columns, text_columns
from halyard.operators.ordered import ks_of_counts, ks_two_sample, value_counts
from halyard.operators.selection import unexpected_values
from halyard.operators.union import stacked

# fixed values: significance of the distance test, and the mean test's width
SIGNIFICANCE = 0.05
DEVIATIONS = 2.0


def schema_check(expected: list[str], incoming: DataFrame) -> DataFrame:
    """One row per expected column: present or not, and how many incoming rows fill it."""
    filled = incoming.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[(F.count(c) if c in incoming.columns else F.lit(None).cast("long")).alias(c) for c in expected],
    )
    long = filled.unpivot("__rows", expected, "column_name", "filled")
    return long.select(
        "column_name",
        F.col("filled").isNull().alias("missing"),
        F.coalesce("filled", F.lit(0)).alias("filled"),
        F.col("__rows").alias("incoming_rows"),
    )


def _side(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """Long (column, min, max, mean, deviation) of one side, from one aggregate."""
    stats = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.min(c).cast("double").alias(f"{prefix}_min"),
                F.max(c).cast("double").alias(f"{prefix}_max"),
                F.avg(c).alias(f"{prefix}_mean"),
                F.stddev_samp(c).alias(f"{prefix}_std"),
            ).alias(c)
            for c in columns
        ]
    )
    return stats.select(F.explode(F.array(*columns)).alias("s")).select("s.*")


def shared_numbers(reference: DataFrame, incoming: DataFrame) -> list[str]:
    return [c for c in numeric_columns(reference) if c in incoming.columns]


def range_check(reference: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    return _ranges(_side(reference, columns, "ref"), _side(incoming, columns, "inc"))


def _ranges(reference: DataFrame, incoming: DataFrame) -> DataFrame:
    joined = reference.join(incoming, "column_name")
    outside = (F.col("inc_min") < F.col("ref_min")) | (F.col("inc_max") > F.col("ref_max"))
    return joined.select(
        "column_name", "ref_min", "ref_max", "inc_min", "inc_max", F.coalesce(outside, F.lit(False)).alias("out_of_bounds")
    )


def mean_deviation(reference: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    """Drift when the means differ by more than two reference deviations."""
    joined = _side(reference, columns, "ref").join(_side(incoming, columns, "inc"), "column_name")
    far = F.abs(F.col("ref_mean") - F.col("inc_mean")) > F.lit(DEVIATIONS) * F.col("ref_std")
    return joined.select(
        "column_name",
        "ref_mean",
        "inc_mean",
        F.coalesce(far & (F.col("ref_std") > 0), F.lit(False)).alias("drift_detected"),
    )


def distance_check(reference: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    tested = ks_two_sample(reference, incoming, columns)
    return tested.select("*", (F.col("p_value") < SIGNIFICANCE).alias("drift_detected"))


def category_check(reference: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    """Values of each text column the reference never has."""
    parts = [
        unexpected_values(reference, incoming, c).select(F.lit(c).alias("column_name"), "value") for c in columns
    ]
    return stacked(parts)


@dataclass(frozen=True)
class Profile:
    """What the checks need of a reference: its columns and the rows of each distinct value.

    ``numbers`` and ``texts`` hold (column_name, value, n), ``ranges`` one row a numeric column with
    ref_min and ref_max. Profiles of parts of a reference can be merged.
    """

    columns: tuple[str, ...]
    numbers: DataFrame
    texts: DataFrame
    ranges: DataFrame
    numeric: tuple[str, ...]
    text: tuple[str, ...]

    def write(self, folder: str) -> None:
        """Four tables under a folder; an earlier profile there is replaced."""
        spark = self.numbers.sparkSession
        for name in ("numbers", "texts", "ranges"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        rows = [(i, c, "number" if c in self.numeric else "text" if c in self.text else None) for i, c in enumerate(self.columns)]
        spark.createDataFrame(rows, "place int, column_name string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/columns")

    @staticmethod
    def read(spark: SparkSession, folder: str) -> "Profile":
        rows = sorted(spark.read.parquet(f"{folder}/columns").collect())  # one a column of the reference
        tables = [spark.read.parquet(f"{folder}/{name}") for name in ("numbers", "texts", "ranges")]
        kinds = [tuple(r.column_name for r in rows if r.kind == kind) for kind in ("number", "text")]
        return Profile(tuple(r.column_name for r in rows), *tables, *kinds)


COUNTS = "column_name string, value {}, n long"
RANGES = "column_name string, ref_min double, ref_max double"


def profile_of(reference: DataFrame) -> Profile:
    """The profile of a reference frame, from its per-value counts and one aggregate."""
    spark = reference.sparkSession
    numeric, text = numeric_columns(reference), text_columns(reference)
    numbers = value_counts(reference, numeric) if numeric else spark.createDataFrame([], COUNTS.format("double"))
    ranges = _side(reference, numeric, "ref").select("column_name", "ref_min", "ref_max") if numeric else spark.createDataFrame([], RANGES)
    texts = _text_counts(reference, text) if text else spark.createDataFrame([], COUNTS.format("string"))
    return Profile(tuple(reference.columns), numbers, texts, ranges, tuple(numeric), tuple(text))


def _text_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    long = df.select(*columns).unpivot([], list(columns), "column_name", "value").where(F.col("value").isNotNull())
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def merged(first: Profile, second: Profile) -> Profile:
    """The profile of the rows of both references, which have the same columns."""
    if (first.columns, first.numeric, first.text) != (second.columns, second.numeric, second.text):
        raise ValueError("profiles of different columns")

    def added(one: DataFrame, other: DataFrame) -> DataFrame:
        return one.unionByName(other).groupBy("column_name", "value").agg(F.sum("n").alias("n"))

    ranges = first.ranges.unionByName(second.ranges).groupBy("column_name")
    ranges = ranges.agg(F.min("ref_min").alias("ref_min"), F.max("ref_max").alias("ref_max"))
    return Profile(
        first.columns, added(first.numbers, second.numbers), added(first.texts, second.texts), ranges, first.numeric, first.text
    )


def drift_against(profile: Profile, dataset: str, incoming: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """``drift_report`` against a stored profile: only the incoming rows are aggregated, the reference is not read."""
    numbers = [c for c in profile.numeric if c in incoming.columns]
    texts = [c for c in profile.text if c in incoming.columns]
    ranges = distances = categories = None
    if numbers:
        tested = F.col("column_name").isin(numbers)
        ranges = _ranges(profile.ranges.where(tested), _side(incoming, numbers, "inc"))
        found = ks_of_counts(profile.numbers.where(tested), value_counts(incoming, numbers))
        distances = found.select("*", (F.col("p_value") < SIGNIFICANCE).alias("drift_detected"))
    if texts:
        new = _text_counts(incoming.select(*[F.col(c).cast("string").alias(c) for c in texts]), texts)
        categories = new.join(profile.texts, ["column_name", "value"], "left_anti").select("column_name", "value")
    return _report(dataset, schema_check(expected or list(profile.columns), incoming), ranges, distances, categories)


def drift_report(dataset: str, reference: DataFrame, incoming: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """All checks as one long table: (dataset, column, check, statistic, p_value, detail, flagged)."""
    numbers = shared_numbers(reference, incoming)
    texts = [c for c in text_columns(reference) if c in incoming.columns]
    return _report(
        dataset,
        schema_check(expected or reference.columns, incoming),
        range_check(reference, incoming, numbers) if numbers else None,
        distance_check(reference, incoming, numbers) if numbers else None,
        category_check(reference, incoming, texts) if texts else None,
    )


def _report(
    dataset: str, schema: DataFrame, ranges: DataFrame | None, distances: DataFrame | None, categories: DataFrame | None
) -> DataFrame:
    none = F.lit(None)

    def rows(df: DataFrame, check: str, statistic, p_value, detail, flagged) -> DataFrame:
        return df.select(
            F.lit(dataset).alias("dataset"),
            "column_name",
            F.lit(check).alias("check_name"),
            statistic.cast("double").alias("statistic"),
            p_value.cast("double").alias("p_value"),
            detail.cast("string").alias("detail"),
            flagged.alias("flagged"),
        )

    parts = [rows(schema, "schema", none, none, none, F.col("missing"))]
    if ranges is not None:
        parts.append(rows(ranges, "range", none, none, none, F.col("out_of_bounds")))
    if distances is not None:
        parts.append(rows(distances, "distance", F.col("statistic"), F.col("p_value"), none, F.col("drift_detected")))
    if categories is not None:
        parts.append(rows(categories, "category", none, none, F.col("value"), F.lit(True)))
    return stacked(parts)


def drift_summary(report: DataFrame) -> DataFrame:
    """One log row per dataset; only distance and category findings count as drift."""
    drifting = F.col("flagged") & F.col("check_name").isin("distance", "category")
    return report.groupBy("dataset").agg(
        (~F.bool_or(F.col("flagged") & (F.col("check_name") == "schema"))).alias("schema_valid"),
        F.bool_or(drifting).alias("drift_detected"),
        F.count_if(F.col("check_name") == "distance").alias("num_features_checked"),
    )
