"""Union of many frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames by column name, null where a frame lacks a column.

    Frames are paired level by level: a left-deep chain would analyse the
    growing plan once per frame.
    """
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [p[0].unionByName(p[1], allowMissingColumns=True) if len(p) == 2 else p[0] for p in pairs]
    return parts[0]
