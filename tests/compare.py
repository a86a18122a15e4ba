"""Exact comparison of a Spark result with a DuckDB result, columns and rows in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT",
    "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float) and math.isnan(value):
        return (1, "")
    return (2, repr(value))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_key(r[i]) for i in order) for r in rows])


def differences(spark_df, con, sql) -> list[str]:
    """What differs, empty when nothing does."""
    out = []
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    got = spark_df.collect()
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    for field, kind in spark_df.dtypes:
        if SPARK_TYPES[kind] != types[field]:
            out.append(f"type of {field}: {kind} != {types[field]}")
    a, b = rows_of(spark_df.columns, got), rows_of(names, expected)
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        left, right = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
        out.append(f"values: only in Spark {left}; only in SQL {right}")
    return out
