"""Runs registered queries next to their check SQL in DuckDB."""

from __future__ import annotations

import math
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def compare(spark, con, name, fn, sql, sf_dir) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    left = Counter(tuple(_norm(v) for v in r) for r in df.select(*cols).collect())
    t1 = time.time()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    order = [names.index(c) for c in cols] if sorted(names) == cols else None
    if order is None:
        return {"name": name, "ok": False, "why": f"columns {cols} vs {sorted(names)}"}
    right = Counter(tuple(_norm(r[i]) for i in order) for r in rel.fetchall())
    t2 = time.time()
    bad = {
        f.name: (f.dataType.simpleString(), types[f.name])
        for f in df.schema
        if KINDS.get(f.dataType.simpleString(), "?") != types[f.name]
    }
    out = {
        "name": name, "ok": left == right and not bad, "rows": sum(left.values()),
        "oracle_rows": sum(right.values()), "spark": round(t1 - t0, 2), "duckdb": round(t2 - t1, 2),
    }
    if bad:
        out["types"] = bad
    if left != right:
        out["only_spark"] = list((left - right).items())[:2]
        out["only_sql"] = list((right - left).items())[:2]
        out["n_diff"] = sum((left - right).values())
    return out
