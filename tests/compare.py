"""Order-insensitive comparison of a Spark result with its SQL twin."""

from __future__ import annotations

import math


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "item"):
        return _plain(value.item())
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(df, connection, sql: str) -> list[str]:
    """Empty when both sides hold the same columns and rows."""
    answer = connection.execute(sql)
    names = [c[0] for c in answer.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    ours = rows_of(df.columns, df.collect())
    theirs = rows_of(names, answer.fetchall())
    out = []
    if len(ours) != len(theirs):
        out.append(f"{len(ours)} rows != {len(theirs)} rows")
    have, want = set(ours), set(theirs)
    extra = [r for r in ours if r not in want][:2]
    lost = [r for r in theirs if r not in have][:2]
    if ours != theirs:
        out.append(f"only ours: {extra}\nonly theirs: {lost}")
    return out
