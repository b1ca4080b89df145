"""Spark-vs-DuckDB comparison used by the tests and by ``tools/check_oracles.py``.

Columns are compared by name (sorted), rows as an unordered multiset of
canonical strings, plus a coarse type-family check.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from decimal import Decimal

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, Decimal):
        return format(v.normalize(), "f") if v != 0 else "0"
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def _family(type_name: str) -> str:
    t = type_name.lower()
    if t.startswith("decimal"):
        return t.replace(" ", "")
    for fam, keys in [("int32", ("integer", "int")), ("int64", ("bigint", "long")),
                      ("double", ("double",)), ("string", ("varchar", "string")),
                      ("date", ("date",)), ("timestamp", ("timestamp",)), ("bool", ("boolean",))]:
        if t in keys or t.startswith(keys[0]):
            return fam
    return t


def spark_rows(df):
    cols = df.columns
    types = {f.name: _family(f.dataType.simpleString()) for f in df.schema.fields}
    return cols, types, [tuple(r) for r in df.collect()]


def duck_rows(con, sql):
    rel = con.sql(sql)
    cols = rel.columns
    types = {c: _family(str(t)) for c, t in zip(cols, rel.types)}
    return cols, types, rel.fetchall()


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_canon(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return h, lines


def compare(df, sql, con) -> dict:
    s_cols, s_types, s_rows = spark_rows(df)
    d_cols, d_types, d_rows = duck_rows(con, sql)
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": sorted(s_cols) == sorted(d_cols)}
    out["type_mismatch"] = {c: (s_types[c], d_types.get(c)) for c in s_cols
                            if c in d_types and s_types[c] != d_types[c]}
    if out["columns_match"]:
        sh, sl = digest(s_cols, s_rows)
        dh, dl = digest(d_cols, d_rows)
        out["values_match"] = sh == dh
        if sh != dh:
            ss, ds = set(sl), set(dl)
            out["only_spark"] = sorted(ss - ds)[:3]
            out["only_oracle"] = sorted(ds - ss)[:3]
    else:
        out["values_match"] = False
        out["spark_cols"], out["oracle_cols"] = s_cols, d_cols
    out["ok"] = (out["values_match"] and out["spark_rows"] == out["oracle_rows"])
    return out
