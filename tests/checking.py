"""Run a registered query beside its SQL counterpart and compare every value."""

from __future__ import annotations

import duckdb
import pandas as pd

from halyard.sources.tables import STAR


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in STAR:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plan(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


def _plain(column: pd.Series) -> pd.Series:
    """Numbers as float (missing as NaN), all else as text."""
    if pd.api.types.is_bool_dtype(column):
        return column.astype(str)
    if pd.api.types.is_numeric_dtype(column):
        return column.astype(float)
    values = [v for v in column if v is not None and v == v]
    if values and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        return pd.to_numeric(column).astype(float)
    return column.map(lambda v: "<none>" if v is None or v != v else str(v))


def _sorted(frame: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    plain = pd.DataFrame({c: _plain(frame[c]) for c in names})
    return plain.sort_values(names, na_position="last").reset_index(drop=True)


def compare(df, con, text) -> str | None:
    """None when equal, else what differs."""
    names = sorted(df.columns)
    theirs = con.execute(text).df()
    if sorted(theirs.columns) != names:
        return f"columns {sorted(set(theirs.columns) ^ set(names))}"
    ours = df.toPandas()
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    ours, theirs = _sorted(ours, names), _sorted(theirs, names)
    bad = {}
    for c in names:
        a, b = ours[c], theirs[c]
        if a.dtype != b.dtype:  # all missing on one side, or different kinds
            if not (a.isna() | (a == "<none>")).all() or not (b.isna() | (b == "<none>")).all():
                bad[c] = f"kinds {a.dtype} and {b.dtype}"
            continue
        off = ~((a == b) | (a.isna() & b.isna()))
        if off.any():
            at = off.idxmax()
            bad[c] = f"{off.sum()} of {len(a)} rows, first {a[at]!r} and {b[at]!r}"
    return str(bad) if bad else None
