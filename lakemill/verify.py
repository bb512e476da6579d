"""Comparing a result with a golden answer: as multisets of rows, with exact,
last-digit or relative tolerance for numbers."""

from __future__ import annotations

import csv
import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame


def _plain(v: Any) -> Any:
    if isinstance(v, datetime):
        return v.date().isoformat() if v.time().isoformat() == "00:00:00" else v.isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, str):
        return v.rstrip(" ")
    return v


def _order(row: tuple) -> tuple:
    return tuple((v is None, str(type(v) in (int, float)), round(v, 1) if isinstance(v, float) else v if isinstance(v, int) else str(v)) for v in row)


def same_rows(got: list[tuple], want: list[tuple], relative: float = 0.0, absolute: float = 0.0) -> list[str]:
    """Differences, at most ten; none if the multisets of rows agree."""
    out = [] if len(got) == len(want) else [f"{len(got)} rows, expected {len(want)}"]
    a, b = (sorted((tuple(map(_plain, r)) for r in rows), key=_order) for rows in (got, want))
    for x, y in zip(a, b):
        ok = len(x) == len(y) and all(
            math.isclose(p, q, rel_tol=relative, abs_tol=absolute) if isinstance(p, (int, float)) and isinstance(q, (int, float)) and not isinstance(p, bool) else p == q for p, q in zip(x, y)
        )
        if not ok:
            out.append(f"{x} instead of {y}")
        if len(out) >= 10:
            break
    return out


def compare(df: DataFrame, columns: list[str], want: list[tuple], relative: float = 0.0, last_digits: int | None = None) -> list[str]:
    """A result (small, as answers are) against rows in the order of columns.
    last_digits: numbers may be off by one in that decimal place."""
    names = sorted(columns)
    if sorted(df.columns) != names:
        return [f"columns {sorted(df.columns)}, expected {names}"]
    got = [tuple(r) for r in df.select(*columns).collect()]
    return same_rows(got, want, relative, 10.0**-last_digits * 1.000001 if last_digits is not None else 0.0)


def _value(field: str) -> Any:
    for kind in (int, float):
        try:
            return kind(field)
        except ValueError:
            pass
    return field or None


def read_answer(path: str) -> tuple[list[str], list[tuple]]:
    """Columns and rows of a `|`-delimited answer with a header: a file, or a
    folder of part files that each have one."""
    at = Path(path)
    parts = sorted(at.glob("part-*")) if at.is_dir() else [at]
    columns: list[str] = []
    rows: list[tuple] = []
    for p in parts:
        with p.open(newline="") as f:
            lines = list(csv.reader(f, delimiter="|"))
        if lines:
            columns = [c.strip().lower() for c in lines[0]]
            rows += [tuple(map(_value, r)) for r in lines[1:]]
    return columns, rows


def compare_files(got: str, want: str, relative: float = 0.0, last_digits: int | None = None) -> list[str]:
    """Differences between two answers; columns may stand in another order."""
    (a, rows_a), (b, rows_b) = read_answer(got), read_answer(want)
    if sorted(a) != sorted(b):
        return [f"columns {sorted(a)}, expected {sorted(b)}"]
    rows_a = [tuple(r[a.index(c)] for c in b) for r in rows_a]
    return same_rows(rows_a, rows_b, relative, 10.0**-last_digits * 1.000001 if last_digits is not None else 0.0)
