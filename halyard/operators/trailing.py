"""Lags and trailing statistics per key, safe when one key holds most rows.

A window over a key sorts all of that key's rows in one task. Keys with more
rows than ``hot_rows`` are therefore cut into ordered slices, and every slice
is given the few rows before it that its frames look back on. The results are
the same as of one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.functions import safe_div, whole_days
from halyard.operators.ordered import SLICE, ordered_slices
from halyard.operators.rollups import mean_money, money, rows

HOT_ROWS = 5_000_000
HALO = "__halo"


def trailing_expressions(
    base: WindowSpec,
    columns: Sequence[str],
    lags: Sequence[int] = (),
    windows: Sequence[int] = (),
    spread: bool = True,
) -> dict[str, Column]:
    """Lags and means/deviations of the rows before the current one.

    The deviation is the sample one: null with a single row in the frame.
    """
    out: dict[str, Column] = {}
    for c in columns:
        for k in lags:
            out[f"{c}_lag_{k}"] = F.lag(c, k).over(base)
        for k in windows:
            frame = base.rowsBetween(-k, -1)
            out[f"{c}_roll_mean_{k}"] = F.avg(c).over(frame)
            if spread:
                out[f"{c}_roll_std_{k}"] = F.stddev_samp(c).over(frame)
    return out


def sortable(df: DataFrame) -> list[str]:
    """Columns whose type has an order."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def hot_keys(df: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows: at most rows/limit of them."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit).select(key)


def _with_lookback(sliced: DataFrame, key: str, order: list[str], columns: list[str], depth: int) -> DataFrame:
    """Each slice plus the ``depth`` rows of its key that come before it, flagged."""
    newest_first = W.partitionBy(key, SLICE).orderBy(*[F.desc(c) for c in order])
    narrow = list(dict.fromkeys([key, *order, *columns]))
    # per key: depth rows per slice, whatever the size of the key
    tails = (
        sliced.select(SLICE, *narrow)
        .withColumn("__back", F.row_number().over(newest_first))
        .where(F.col("__back") <= depth)
        .withColumn("__seq", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    )
    starts = tails.groupBy(key, F.col(SLICE).alias("__target")).agg((F.min("__seq") - 1).alias("__before"))
    halo = (
        tails.select(*narrow, F.explode(F.sequence("__seq", F.col("__seq") + (depth - 1))).alias("__before"))
        .alias("h")
        .join(starts.alias("s"), F.col(f"h.{key}").eqNullSafe(F.col(f"s.{key}")) & (F.col("h.__before") == F.col("s.__before")))
        .select(*[F.col(f"h.{c}").alias(c) for c in narrow], F.col("__target").alias(SLICE), F.lit(True).alias(HALO))
    )
    return sliced.withColumn(HALO, F.lit(False)).unionByName(halo, allowMissingColumns=True)


def trailing_features(
    df: DataFrame,
    key: str,
    order: list[str],
    columns: Sequence[str],
    lags: Sequence[int] = (),
    windows: Sequence[int] = (),
    spread: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``df`` with lag and trailing columns, by ``order`` within a key; null is a key like any other.

    Rows that the order leaves tied are put in the order of the remaining columns
    of the frame, in their sequence; rows equal in all columns are interchangeable.

    Join dimensions after this, not before: the plain window leaves the rows
    placed by the key, so a join on it needs no shuffle of the fact side.
    """
    columns = [c for c in columns if c in df.columns]
    order = [*order, *[c for c in sortable(df) if c not in order and c != key]]

    def apply(frame: DataFrame, parts: list[str]) -> DataFrame:
        base = W.partitionBy(*parts).orderBy(*order)
        named = trailing_expressions(base, columns, lags, windows, spread)
        return frame.select("*", *[e.alias(n) for n, e in named.items()])

    hot = hot_keys(df, key, hot_rows).select(F.col(key).alias(f"__hot_{key}"))
    if hot.isEmpty():
        return apply(df, [key])
    depth = max([*lags, *windows])
    is_hot = F.col(key).eqNullSafe(F.col(f"__hot_{key}"))
    sliced = ordered_slices(df.join(hot, is_hot, "left_semi"), [key, *order])
    cut = apply(_with_lookback(sliced, key, order, list(columns), depth), [key, SLICE])
    whole = apply(df.join(hot, is_hot, "left_anti"), [key])
    return whole.unionByName(cut.where(~F.col(HALO)).drop(HALO, SLICE))


def extended_customer_orders(orders: DataFrame, order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Customer roll-up with extremes, spread, tenure and means of the trailing columns.

    The window already places a customer's rows together, so the group-by needs
    no second shuffle.
    """
    latest = orders.agg(F.max("order_date")).scalar()
    columns = ["order_amount"]
    trailed = trailing_features(orders, "customer_id", order, columns, (1,), (3, 5), spread=False, hot_rows=hot_rows)
    rolled = trailed.groupBy("customer_id").agg(
        rows().alias("total_orders"),
        money("order_amount").alias("total_revenue"),
        mean_money("order_amount").alias("average_order_value"),
        mean_money("discount_rate").alias("average_discount_rate"),
        F.avg("shipping_days").alias("average_shipping_days"),
        F.max("order_amount").alias("max_order_value"),
        F.min("order_amount").alias("min_order_value"),
        F.stddev_samp("order_amount").alias("revenue_std"),
        F.max("order_date").alias("last_order_date"),
        F.min("order_date").alias("first_order_date"),
        mean_money("order_amount_lag_1").alias("order_amount_lag_1"),
        F.avg("order_amount_roll_mean_3").alias("order_amount_roll_mean_3"),
        F.avg("order_amount_roll_mean_5").alias("order_amount_roll_mean_5"),
    )
    return rolled.select(
        "*",
        safe_div("total_revenue", "total_orders").alias("revenue_per_order"),
        whole_days("last_order_date", "first_order_date").alias("customer_tenure_days"),
        whole_days(latest, "last_order_date").alias("days_since_last_order"),
    )
