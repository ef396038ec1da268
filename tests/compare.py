"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import duckdb

from nearwell.plans.domain import BASE

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v) -> str:
    if isinstance(v, float):
        return f"{v:.6g}" if v else "0"
    return repr(v)


def _rows(rows, order) -> list[str]:
    return sorted("|".join(_value(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str | None:
    """None when both sides agree on columns, types and rows, else what differs."""
    rel = con.sql(sql)
    left = {c: TYPES.get(t, t) for c, t in df.dtypes}
    right = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    if left != right:
        return f"schema: {sorted(left.items())} vs {sorted(right.items())}"
    names = sorted(left)
    spark_rows = [tuple(r) for r in df.collect()]
    a = _rows(spark_rows, [df.columns.index(c) for c in names])
    b = _rows(rel.fetchall(), [rel.columns.index(c) for c in names])
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"rows {len(a)} vs {len(b)}; spark only {only_a[:2]}; sql only {only_b[:2]}"
