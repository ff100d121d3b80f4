"""Column expressions shared by the operators."""

from halyard.functions.scalar import (
    bounded,
    calendar_parts,
    cyclical,
    half_up,
    ladder,
    month_text,
    quarter_text,
    safe_div,
    weighted,
    whole_days,
    zero_if_none,
)

__all__ = [
    "bounded",
    "calendar_parts",
    "cyclical",
    "half_up",
    "ladder",
    "month_text",
    "quarter_text",
    "safe_div",
    "weighted",
    "whole_days",
    "zero_if_none",
]
