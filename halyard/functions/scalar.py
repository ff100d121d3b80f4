"""Scalar expressions. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c: Column | str, digits: int) -> Column:
    """Round half up by ``floor(x * 10^n + 0.5) / 10^n``.

    Beyond 2^53 a double has no digits left to round, and ``floor`` would run
    out of the long range, so such values pass through.
    """
    value, scale = col(c).cast("double"), float(10**digits)
    return F.when(F.abs(value * scale) < float(2**53), F.floor(value * scale + 0.5) / scale).otherwise(value)


def safe_div(top: Column | str, bottom: Column | str) -> Column:
    """Quotient as double, null when the denominator is zero or null."""
    return F.try_divide(col(top).cast("double"), col(bottom).cast("double"))


def zero_if_none(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0.0))


def bounded(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Clip to [low, high]; null stays null (``greatest``/``least`` would hide it)."""
    value = col(c)
    out = value
    if high is not None:
        out = F.when(value > high, F.lit(high)).otherwise(out)
    if low is not None:
        out = F.when(value < low, F.lit(low)).otherwise(out)
    return out


def month_text(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def quarter_text(c: Column | str) -> Column:
    return F.concat(F.year(col(c)).cast("string"), F.lit("-Q"), F.quarter(col(c)).cast("string"))


def _micros(c: Column | str) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def whole_days(later: Column | str, earlier: Column | str) -> Column:
    """Floor of the difference in days, as a long."""
    return F.floor((_micros(later) - _micros(earlier)) / F.lit(float(DAY_MICROS))).cast("long")


def calendar_parts(c: Column | str, prefix: str) -> dict[str, Column]:
    """Seven calendar features; a missing date gives zeros."""
    date = col(c)
    parts = {
        "year": F.year(date),
        "month": F.month(date),
        "quarter": F.quarter(date),
        "dayofweek": F.weekday(date),
        "day": F.dayofmonth(date),
        "is_month_start": (F.dayofmonth(date) == 1).cast("int"),
        "is_month_end": (F.to_date(date) == F.last_day(date)).cast("int"),
    }
    return {f"{prefix}_{name}": F.coalesce(part.cast("int"), F.lit(0)) for name, part in parts.items()}


def cyclical(c: Column | str, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position in a cycle."""
    angle = F.lit(2 * math.pi) * col(c) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def weighted(weights: Mapping[str, float]) -> Column:
    """Linear combination of columns, terms added in the given order."""
    total = None
    for name, weight in weights.items():
        term = F.lit(weight) * F.col(name)
        total = term if total is None else total + term
    return total


def ladder(rungs: list[tuple[Column, object]], otherwise: object) -> Column:
    """First rung whose condition holds wins; a null condition does not hold."""
    chain = None
    for condition, value in rungs:
        chain = F.when(condition, F.lit(value)) if chain is None else chain.when(condition, F.lit(value))
    return chain.otherwise(F.lit(otherwise))
