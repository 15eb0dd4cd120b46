"""Local twin of the driver's correctness gate.

Runs each registered Spark query and its DuckDB oracle on the same parquet
tables and compares row count, column names and an order-insensitive hash
of the values.  Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def _digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                 "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date",
                 "FLOAT": "float", "FLOAT[]": "array<float>", "SMALLINT": "smallint"}


def type_mismatches(sdf, rel) -> list[str]:
    """Columns whose Spark type differs from the oracle's (after type mapping)."""
    spark_t = dict(sdf.dtypes)
    out = []
    for name, dtype in [(d[0], d[1]) for d in rel.description]:
        want = DUCK_TO_SPARK.get(str(dtype), str(dtype))
        if spark_t.get(name) != want:
            out.append(f"{name}: spark {spark_t.get(name)} vs oracle {dtype}")
    return out


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def run(names=None, sf="/root/testdata/sf0.01"):
    import __spark_entry__ as E
    from tablescope.session import get_spark
    spark = get_spark()
    con = duck(sf)
    qs, oq = E.queries(), E.oracle_sql()
    results = {}
    for name in sorted(qs):
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, results[name], flush=True)
            continue
        dt = time.time() - t0
        if name not in oq:
            results[name] = f"rows-only {len(srows)}"
            print(f"{name:28s} {dt:6.1f}s rows-only {len(srows)}", flush=True)
            continue
        try:
            rel = con.execute(oq[name])
            ocols = [d[0] for d in rel.description]
            orows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = f"ORACLE ERROR {str(e)[:300]}"
            print(name, results[name], flush=True)
            continue
        bad_types = type_mismatches(sdf, rel)
        if bad_types:
            print(f"   TYPES {name}: {bad_types}")
        hs, ls = _digest(scols, srows)
        ho, lo = _digest(ocols, orows)
        ok = sorted(scols) == sorted(ocols) and len(srows) == len(orows) and hs == ho
        results[name] = "OK" if ok else "MISMATCH"
        print(f"{name:28s} {dt:6.1f}s {results[name]} rows {len(srows)}/{len(orows)}", flush=True)
        if not ok:
            print("   spark cols", sorted(scols), "\n   duck  cols", sorted(ocols))
            diff_s = [x for x in ls if x not in set(lo)][:3]
            diff_o = [x for x in lo if x not in set(ls)][:3]
            print("   spark only:", diff_s, "\n   duck only:", diff_o)
    return results


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    res = run(args or None, sf)
    bad = {k: v for k, v in res.items() if v != "OK" and not v.startswith("rows-only")}
    print(f"{len(res) - len(bad)}/{len(res)} fine; bad: {sorted(bad)}")
