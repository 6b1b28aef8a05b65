"""Compares a registered query with its SQL on the same tables."""

from __future__ import annotations

import datetime
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    """One spelling for values both engines return in their own types."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return value + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in (value.values() if isinstance(value, dict) else value))
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, query, sf: str) -> tuple[list[str], dict]:
    """Differences (empty when equal) and timings."""
    t0 = time.time()
    df = query.run(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cols, mine = sorted_rows(df.columns, rows)
    info = {"spark": t1 - t0, "rows": len(rows)}
    if query.sql is None:
        return ([] if rows else ["no rows"]), info
    result = con.execute(query.sql)
    names = [d[0] for d in result.description]
    theirs_raw = result.fetchall()
    info["duckdb"] = time.time() - t1
    ocols, theirs = sorted_rows(names, theirs_raw)
    problems = []
    if cols != ocols:
        problems.append(f"columns {cols} != {ocols}")
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} != {len(theirs)}")
    if not mine:
        problems.append("no rows")
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad and not problems:
        problems.append(f"{len(bad)} of {len(mine)} rows differ; first {bad[0][0]} != {bad[0][1]}")
    elif bad:
        problems.append(f"first difference {bad[0][0]} != {bad[0][1]}")
    for a, b in list(zip(mine, theirs))[:1]:
        kinds = [(c, type(x), type(y)) for c, x, y in zip(cols, a, b) if x is not None and y is not None and type(x) is not type(y)]
        if kinds:
            problems.append(f"types {kinds}")
    return problems, info
