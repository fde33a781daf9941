"""Run queries against their SQL in DuckDB on the same Parquet files and compare rows, names and types."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pyarrow as pa

DATA = "/root/testdata/sf0.01"


def connection(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _kind(kind: pa.DataType) -> str:
    if pa.types.is_timestamp(kind):
        return "timestamp" + ("_tz" if kind.tz else "")
    return str(kind).replace("large_", "")


def _key(row: tuple) -> tuple:
    return tuple((x is None, str(round(x, 4)) if isinstance(x, float) else str(x)) for x in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b))
    return a == b


def differences(got: pa.Table, want: pa.Table) -> list[str]:
    names = sorted(got.column_names)
    if names != sorted(want.column_names):
        return [f"columns {names} and {sorted(want.column_names)}"]
    found = [f"type of {n}: {_kind(got.schema.field(n).type)} and {_kind(want.schema.field(n).type)}" for n in names if _kind(got.schema.field(n).type) != _kind(want.schema.field(n).type)]
    a = sorted(zip(*(got[n].to_pylist() for n in names), strict=True), key=_key)
    b = sorted(zip(*(want[n].to_pylist() for n in names), strict=True), key=_key)
    if len(a) != len(b):
        return [*found, f"rows {len(a)} and {len(b)}"]
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(_same(i, j) for i, j in zip(x, y, strict=True))]
    return [*found, *(f"{x} and {y}" for x, y in bad[:2])] if bad else found
