"""Run registered queries on Spark and their SQL on DuckDB, and compare every value."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return repr(value)


def differences(df, con, sql: str, limit: int = 5) -> tuple[int, list[str]]:
    """Row count and the first differences in columns, counts or values."""
    got_columns = sorted(df.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want_rows = cursor.fetchall()
    got_rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in got_columns]).collect()]
    if sorted(names) != got_columns:
        return len(got_rows), [f"columns {got_columns} != {sorted(names)}"]
    at = [names.index(c) for c in got_columns]
    got = sorted(tuple(_plain(v) for v in row) for row in got_rows)
    want = sorted(tuple(_plain(row[i]) for i in at) for row in want_rows)
    if got == want:
        return len(got), []
    extra, missing = set(got) - set(want), set(want) - set(got)
    found = [f"rows {len(got)} != {len(want)}"] if len(got) != len(want) else []
    found.append(f"columns {got_columns}; {len(extra)} only in Spark, {len(missing)} only in SQL")
    found += [f"  spark {row}" for row in sorted(extra)[:limit]] + [f"  sql   {row}" for row in sorted(missing)[:limit]]
    return len(got), found
