"""Run every registered query on Spark and its DuckDB oracle; compare rows, columns and values.

Usage: python tools/check_oracle.py [sf_dir] [key ...]
Prints one line per key: OK (exact), APPROX (equal within 1e-9 relative), or the difference,
plus any column whose type kind differs.  APPROX_DETAIL=1 shows the first inexact row.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if v.__class__.__name__ == "Decimal":
        return float(v)
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, str(x)) if isinstance(x, str) else (2, x) for x in row)


def _close(a, b):
    if a == b:
        return True
    if isinstance(a, float) and isinstance(b, (int, float)) or isinstance(b, float) and isinstance(a, (int, float)):
        return abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return False


def _kind(t: str) -> str:
    t = t.lower()
    if t.startswith(("decimal",)):
        return "decimal"
    for k, names in {"int": ("int", "integer", "int32"), "long": ("bigint", "long", "int64"),
                     "double": ("double", "float"), "string": ("string", "varchar"), "bool": ("boolean",)}.items():
        if t in names:
            return k
    return t


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"COLUMNS spark={spark_cols} duck={duck_cols}"
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    a = sorted((tuple(_norm(r[i]) for i in si) for r in spark_rows), key=_key)
    b = sorted((tuple(_norm(r[i]) for i in di) for r in duck_rows), key=_key)
    if len(a) != len(b):
        return f"ROWS spark={len(a)} duck={len(b)}"
    if a == b:
        return "OK"
    for x, y in zip(a, b):
        if not all(_close(p, q) for p, q in zip(x, y)):
            return f"VALUES first diff spark={x} duck={y}"
    if os.environ.get("APPROX_DETAIL"):
        for x, y in zip(a, b):
            if x != y:
                return f"APPROX first diff spark={x} duck={y}"
    return "APPROX"


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    only = [a for a in args if not os.path.isdir(a)]
    from tradelens.plans.catalog import queries
    from tradelens.plans.oracle import oracle_sql
    from tradelens.session import build_session

    spark = build_session(8, 8, "oracle-check")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    qs, ors = queries(), oracle_sql()
    bad = 0
    for key, fn in qs.items():
        if only and key not in only:
            continue
        t0 = time.time()
        rows = []
        try:
            df = fn(spark, sf)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
            ts = time.time() - t0
            if key not in ors:
                print(f"{key:28s} NO-ORACLE rows={len(rows)} {ts:.1f}s")
                continue
            rel = con.sql(ors[key])
            dcols = rel.columns
            dtypes = [str(t) for t in rel.types]
            drows = rel.fetchall()
            res = compare(rows, cols, drows, dcols)
            stypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            odd = [f"{c}:{stypes[c]}/{t}" for c, t in zip(dcols, dtypes)
                   if c in stypes and _kind(stypes[c]) != _kind(t)]
            if odd:
                res += " TYPES " + ",".join(odd)
        except Exception as e:  # noqa: BLE001
            res = f"ERROR {type(e).__name__}: {str(e)[:300]}"
            ts = time.time() - t0
        if not res.startswith(("OK", "APPROX")):
            bad += 1
        print(f"{key:28s} {res[:400]} rows={len(rows)} {ts:.1f}s", flush=True)
    print("FAILURES", bad)


if __name__ == "__main__":
    main()
