"""Compare a Spark result with SQL run by DuckDB on the same tables."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def _kind(name: str) -> str:
    same = {
        "int64": "bigint", "int32": "int", "string": "string", "large_string": "string",
        "double": "double", "bool": "boolean", "date32[day]": "date", "float": "float",
    }
    return same.get(name, "timestamp" if name.startswith("timestamp") else name)


def normalised(table):
    columns = sorted(table.column_names)
    kinds = [(c, _kind(str(table.schema.field(c).type))) for c in columns]
    values = [table[c].to_pylist() for c in columns]
    rows = [tuple(_plain(v) for v in row) for row in zip(*values)]
    return kinds, sorted(rows, key=repr)


def differences(spark_table, duck_table) -> str | None:
    """None when schema and rows agree, else a short account."""
    kinds, rows = normalised(spark_table)
    wanted_kinds, wanted = normalised(duck_table)
    if kinds != wanted_kinds:
        return f"schema: {kinds} != {wanted_kinds}"
    if len(rows) != len(wanted):
        return f"row count: {len(rows)} != {len(wanted)}"
    for row, other in zip(rows, wanted):
        if row != other:
            return f"first difference:\n  {row}\n  {other}"
    return None
