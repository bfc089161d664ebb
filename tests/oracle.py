"""Run a registered query and its SQL twin on the same files and compare."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return cols, kinds, sorted((tuple(_cell(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_duck(con, text):
    rel = con.sql(text)
    names, kinds = rel.columns, dict(zip(rel.columns, map(str, rel.types)))
    cols = sorted(names)
    pos = [names.index(c) for c in cols]
    return cols, kinds, sorted((tuple(_cell(r[i]) for i in pos) for r in rel.fetchall()), key=repr)


SAME = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def compare(df, con, text) -> list[str]:
    """Differences as readable lines; empty when schema and values agree."""
    a_cols, a_kinds, a = rows_of_spark(df)
    b_cols, b_kinds, b = rows_of_duck(con, text)
    if a_cols != b_cols:
        return [f"columns {a_cols} vs {b_cols}"]
    out = [f"type of {c}: {a_kinds[c]} vs {b_kinds[c]}" for c in a_cols if SAME.get(a_kinds[c]) != b_kinds[c]]
    if len(a) != len(b):
        out.append(f"row counts {len(a)} vs {len(b)}")
    if a != b:
        sa, sb = set(a), set(b)
        out.append(f"values: {len(sa - sb)} only in spark, {len(sb - sa)} only in sql")
        out += [f"  {a_cols}"]
        out += [f"  spark {x}" for x in sorted(sa - sb, key=repr)[:3]]
        out += [f"  sql   {x}" for x in sorted(sb - sa, key=repr)[:3]]
    return out
