"""Spark rows against DuckDB rows, the way the driver compares them: columns by name, any order."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def kind(type_name: str) -> str:
    t = type_name.lower()
    if t in ("bigint", "int", "integer", "smallint", "hugeint", "long"):
        return t.replace("integer", "int").replace("long", "bigint")
    return {"varchar": "string", "string": "string"}.get(t, t)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    types = {d[0]: kind(str(d[1])) for d in cur.description}
    mine = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    if types != mine:
        return f"types { {k: (mine[k], types[k]) for k in mine if mine[k] != types[k]} }"
    order = sorted(names)
    theirs = sorted(str([str(r[names.index(n)]) for n in order]) for r in cur.fetchall())
    ours = sorted(str([str(r[n]) for n in order]) for r in df.collect())
    if ours != theirs:
        a, b = sorted(set(ours) - set(theirs)), sorted(set(theirs) - set(ours))
        return f"{len(ours)} / {len(theirs)} rows; only spark {a[:2]}; only sql {b[:2]}"
    return None
