"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return repr(value)


def differences(df, con, sql: str) -> list[str]:
    """Empty if names, types and rows agree exactly."""
    relation = con.sql(sql)
    ours = dict(df.dtypes)
    theirs = dict(zip(relation.columns, [str(t) for t in relation.types], strict=True))
    if sorted(ours) != sorted(theirs):
        return [f"columns differ: {sorted(set(ours) ^ set(theirs))}"]
    found = [
        f"{name}: {ours[name]} against {theirs[name]}"
        for name in ours
        if KINDS.get(ours[name], ours[name]) != theirs[name]
    ]
    names = sorted(ours)
    mine = sorted(tuple(_plain(row[n]) for n in names) for row in df.collect())
    at = [relation.columns.index(n) for n in names]
    other = sorted(tuple(_plain(row[i]) for i in at) for row in relation.fetchall())
    if len(mine) != len(other):
        found.append(f"{len(mine)} rows against {len(other)}")
    elif mine != other:
        a, b = next((a, b) for a, b in zip(mine, other, strict=True) if a != b)
        cells = [(n, x, y) for n, x, y in zip(names, a, b, strict=True) if x != y]
        found.append(f"rows differ, first at {a[:3]}: {cells[:4]}")
    return found
