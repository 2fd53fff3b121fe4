"""Compare a query with its SQL, order aside."""
from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if (Path(sf_dir) / f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}


def type_difference(spark_df, con, sql: str) -> str | None:
    """Column types must agree too: a wider type may hash differently."""
    want = dict(zip(*[[r[i] for r in con.execute(f"DESCRIBE {sql}").fetchall()] for i in (0, 1)]))
    off = [(n, t, want.get(n)) for n, t in spark_df.dtypes if SAME_TYPE.get(t) != want.get(n)]
    return f"types {off}" if off else None


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    off = type_difference(spark_df, con, sql)
    if off:
        return off
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"got {g}\nwant {w}"
    return None
