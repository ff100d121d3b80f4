"""Validation: rules are data, each table is read once for its counts and ranges."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import half_up
from halyard.operators import quality_rules as rules
from halyard.operators.union import stacked

REPORT = ["table_name", "check_name", "status", "passed", "failed_records", "message"]
STATUSES = ["pass", "fail", "skip"]


def _graded(found: DataFrame) -> DataFrame:
    """Raw checks (table, check, failed count, texts) to report rows; a null count means skipped."""
    failed = F.coalesce("failed_records", F.lit(0)).cast("long")
    skipped = F.col("failed_records").isNull()
    status = F.when(skipped, "skip").when(failed == 0, "pass").otherwise("fail")
    message = F.when(skipped, "column absent").when(failed == 0, F.col("good")).otherwise(F.col("bad"))
    return found.select(
        "table_name",
        "check_name",
        status.alias("status"),
        (status != "fail").alias("passed"),
        failed.alias("failed_records"),
        message.alias("message"),
    )


def _check(table: str, name: str, failed: Column, good: str, bad: Column) -> Column:
    return F.struct(
        F.lit(table).alias("table_name"),
        F.lit(name).alias("check_name"),
        failed.cast("long").alias("failed_records"),
        F.lit(good).alias("good"),
        bad.alias("bad"),
    )


def _unpacked(aggregated: DataFrame) -> DataFrame:
    """One row holding an array of checks ``s``, to one row per check."""
    return aggregated.selectExpr("inline(s)")


def _columns_check(df: DataFrame, table: str, required: list[str]) -> Column:
    missing = [c for c in required if c not in df.columns]
    text = F.lit("missing: " + ", ".join(missing))
    return _check(table, "required_columns", F.lit(len(missing)), "all columns present", text)


def _rows_check(table: str, minimum: int) -> Column:
    short = F.greatest(F.lit(minimum) - F.count(F.lit(1)), F.lit(0))
    return _check(table, "minimum_row_count", short, "enough rows", F.lit(f"fewer than {minimum} rows"))


def _range_check(df: DataFrame, table: str, column: str, low: float | None, high: float | None) -> Column:
    name = f"range_{column}"
    if column not in df.columns:
        return _check(table, name, F.lit(None), "", F.lit(""))
    tests = [f"{column} < {low}"] * (low is not None) + [f"{column} > {high}"] * (high is not None)
    count = F.expr(f"count_if({' or '.join(tests) or 'false'})")
    text = F.concat(count.cast("string"), F.lit(f" values of {column} out of range"))
    return _check(table, name, count, f"{column} in range", text)


def _key_checks(df: DataFrame, table: str, key: str) -> DataFrame:
    copies = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    extra = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    check = _check(table, "primary_key_uniqueness", extra, "key is unique", F.lit(f"repeated values of {key}"))
    return _unpacked(copies.agg(F.array(check).alias("s")))


def _reference_checks(
    df: DataFrame, table: str, key: str, parent: DataFrame, parent_name: str, parent_key: str
) -> DataFrame:
    counted = df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("n"))
    parents = parent.select(F.col(parent_key).alias("__key")).distinct()
    lost = F.coalesce(F.sum("n"), F.lit(0))
    text = F.concat(lost.cast("string"), F.lit(f" rows without a parent for {key}"))
    check = _check(table, f"foreign_key_{key}_to_{parent_name}", lost, "every reference resolves", text)
    return _unpacked(counted.join(parents, "__key", "left_anti").agg(F.array(check).alias("s")))


def required_columns(df: DataFrame, table: str, required: list[str]) -> DataFrame:
    """Names only, no data is read."""
    row = df.sparkSession.range(1).select(F.array(_columns_check(df, table, required)).alias("s"))
    return _graded(_unpacked(row))


def primary_key(df: DataFrame, table: str, key: str) -> DataFrame:
    """Rows beyond the first per key value; a missing key counts as one value."""
    return _graded(_key_checks(df, table, key))


def foreign_key(df: DataFrame, table: str, key: str, parent: DataFrame, parent_name: str, parent_key: str) -> DataFrame:
    """Rows whose key has no parent. Keys are counted first, so a frequent key crosses the join once."""
    return _graded(_reference_checks(df, table, key, parent, parent_name, parent_key))


def counts_and_ranges(
    df: DataFrame, table: str, minimum_rows: int | None, ranges: Mapping[str, tuple[float | None, float | None]]
) -> DataFrame:
    """Minimum row count and all numeric ranges of a table in one aggregate."""
    checks = [] if minimum_rows is None else [_rows_check(table, minimum_rows)]
    checks += [_range_check(df, table, c, *limits) for c, limits in ranges.items()]
    return _graded(_unpacked(df.agg(F.array(*checks).alias("s"))))


WHOLE = {"tinyint", "smallint", "int", "bigint"}


def _tagged(df: DataFrame, children: list[tuple[int, str]], parents: list[tuple[int, str]], sums: list[tuple[int, Column]], whole: set[int]) -> DataFrame:
    """(rule, key, text, n, parent) entries of one table, from one read of it.

    A row gives an entry for every rule that it takes part in: its key as a child, its key as a parent, and
    one for a plain count (values out of range) that it adds to. Keys of the rules in ``whole`` stay numbers, others are texts.
    """

    def entry(rule: int, key: Column, n: int, parent: bool) -> Column:
        none = F.lit(None)
        number, text = (key, none) if rule in whole else (none, key)
        return F.struct(
            F.lit(rule).alias("rule"), number.cast("long").alias("key"), text.cast("string").alias("text"),
            F.lit(n).cast("long").alias("n"), F.lit(parent).alias("parent"),
        )

    entries = [entry(rule, F.col(key), 1, False) for rule, key in children]
    entries += [entry(rule, F.col(key), 0, True) for rule, key in parents]
    entries += [F.when(hit, entry(rule, F.lit(None), 1, False)) for rule, hit in sums]
    # not ``filter``: it would take the whole array out of compiled code
    return df.select(F.explode(F.array(*entries)).alias("e")).where(F.col("e").isNotNull()).select("e.*")


def _out_of_range(column: str, low: float | None, high: float | None) -> Column:
    tests = [f"{column} < {low}"] * (low is not None) + [f"{column} > {high}"] * (high is not None)
    return F.expr(" or ".join(tests) or "false")


def validate(
    tables: Mapping[str, DataFrame],
    minimum_rows: Mapping[str, int] = rules.MINIMUM_ROWS,
) -> DataFrame:
    """Every rule on every table as one long report.

    Each table is read once: its rows become tagged entries of all rules that concern it, as child or as parent. The
    entries of all tables are counted together by rule and key, which adds up frequent keys before the one
    shuffle, and the rules are read off these counts.
    """
    listed: list[tuple] = []  # rule, table, check, kind, minimum, good, bad before and after the count
    children: dict[str, list] = {name: [] for name in tables}
    parents: dict[str, list] = {name: [] for name in tables}
    sums: dict[str, list] = {name: [] for name in tables}
    rows_of: dict[str, int] = {}

    def rule(table: str, check: str, kind: str, good: str, before: str = "", after: str = "", minimum: int = 0) -> int:
        listed.append((len(listed), table, check, kind, minimum, good, before, after))
        return len(listed) - 1

    for name, df in tables.items():
        missing = [c for c in rules.REQUIRED_COLUMNS[name] if c not in df.columns]
        rule(name, "required_columns", "given", "all columns present", "missing: " + ", ".join(missing), "", len(missing))
        if name in minimum_rows:
            least = minimum_rows[name]
            rows_of[name] = rule(name, "minimum_row_count", "least", "enough rows", f"fewer than {least} rows", "", least)
        for column, limits in rules.NUMERIC_RANGES.get(name, {}).items():
            if column in df.columns:
                number = rule(name, f"range_{column}", "sum", f"{column} in range", "", f" values of {column} out of range")
                sums[name].append((number, _out_of_range(column, *limits)))
            else:
                rule(name, f"range_{column}", "skip", "")
        if name in rules.PRIMARY_KEYS:
            key = rules.PRIMARY_KEYS[name]
            children[name].append((rule(name, "primary_key_uniqueness", "extra", "key is unique", f"repeated values of {key}"), key))
    for name, key, parent, parent_key in rules.FOREIGN_KEYS:
        if name in tables and parent in tables:
            text = f" rows without a parent for {key}"
            number = rule(name, f"foreign_key_{key}_to_{parent}", "lost", "every reference resolves", "", text)
            children[name].append((number, key))
            parents[parent].append((number, parent_key))

    # every row is an entry of each rule with its table as child: such a rule counts the rows too
    counted_by = {number: number for number, *_ in listed}
    for name, number in rows_of.items():
        if children[name]:
            counted_by[number] = children[name][0][0]
        else:
            sums[name].append((number, F.lit(True)))
    kinds: dict[int, set[str]] = {}
    for keyed in (children, parents):
        for name, entries in keyed.items():
            for number, key in entries:
                kinds.setdefault(number, set()).add(dict(tables[name].dtypes)[key])
    whole = {number for number, found in kinds.items() if found <= WHOLE}
    parts = [_tagged(df, children[n], parents[n], sums[n], whole) for n, df in tables.items() if children[n] or parents[n] or sums[n]]
    counted = stacked(parts).groupBy("rule", "key", "text").agg(F.sum("n").alias("n"), F.bool_or("parent").alias("parent"))
    found = counted.groupBy("rule").agg(
        F.sum("n").alias("total"),
        F.sum(F.col("n") - 1).alias("extra"),
        # a missing key has no parent, whatever the parents hold
        F.sum(F.when(F.col("parent") & (F.col("key").isNotNull() | F.col("text").isNotNull()), 0).otherwise(F.col("n"))).alias("lost"),
    ).withColumnRenamed("rule", "counted")
    spark = next(iter(tables.values())).sparkSession
    schema = "rule int, table_name string, check_name string, kind string, minimum long, good string, before string, after string, counted int"
    told = spark.createDataFrame([(*r, counted_by[r[0]]) for r in listed], schema).join(F.broadcast(found), "counted", "left")  # one row a rule
    kind, minimum = F.col("kind"), F.col("minimum")

    def counted_or_zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    failed = (
        F.when(kind == "given", minimum)
        .when(kind == "least", F.greatest(minimum - counted_or_zero("total"), F.lit(0)))
        .when(kind == "sum", counted_or_zero("total"))
        .when(kind == "extra", counted_or_zero("extra"))
        .when(kind == "lost", counted_or_zero("lost"))
    )
    bad = F.concat("before", F.when(kind.isin("sum", "lost"), failed.cast("string")).otherwise(F.lit("")), F.col("after"))
    return _graded(told.select("table_name", "check_name", failed.alias("failed_records"), "good", bad.alias("bad")))


def summarise(report: DataFrame) -> DataFrame:
    """Totals; a skipped check counts as passed here."""
    return report.agg(
        F.countDistinct("table_name").alias("checked_tables"),
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if("passed").alias("passed_checks"),
        F.count_if(~F.col("passed")).alias("failed_checks"),
        half_up(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"),
    )


def quality_score(report: DataFrame) -> DataFrame:
    """Share of checks that pass outright, in percent; 0 for an empty report."""
    share = F.avg((F.col("status") == "pass").cast("double"))
    return report.agg(half_up(F.coalesce(share, F.lit(0.0)) * F.lit(100.0), 2).alias("quality_score"))


def status_counts(report: DataFrame) -> DataFrame:
    """Pass, fail and skip counts, zero when a status does not occur."""
    return report.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    ).unpivot([], STATUSES, "status", "checks")


def failures(report: DataFrame) -> DataFrame:
    return report.where(F.col("status") == "fail").orderBy("table_name", "check_name")


def empty_report(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [],
        "table_name string, check_name string, status string, passed boolean, failed_records long, message string",
    )
