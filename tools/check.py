"""Run registered queries against their DuckDB SQL and report mismatches: check.py SF key..."""

import importlib
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

from stavework.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "null"
        if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
            return str(bool(v))
        if isinstance(v, float):
            return f"f{v + 0.0:.6f}"
        return str(v)
    return sorted("|".join(cell(v) for v in row) for row in df.astype(object).itertuples(index=False))


def main() -> None:
    sf = sys.argv[1]
    entry = importlib.import_module("__spark_entry__")
    queries, oracles = entry.queries(), entry.oracle_sql()
    keys = sys.argv[2:] or list(queries)
    keys = [k for a in keys for k in queries if k == a or (a.endswith("*") and k.startswith(a[:-1]))]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                          "spark.driver.memory": "10g", "spark.sql.ansi.enabled": os.environ.get("ANSI", "true")})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    base = f"/root/testdata/sf{sf}"
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{base}/{t}.parquet'")
    bad = []
    for k in keys:
        t0 = time.time()
        try:
            got = queries[k](spark, base)
            types = dict(got.dtypes)
            got = got.toPandas()
        except Exception as e:
            print(f"FAIL {k}: {str(e)[:900]}", flush=True); bad.append(k); continue
        t1 = time.time()
        if k not in oracles:
            print(f"rows {k}: {len(got)} rows {t1-t0:.1f}s", flush=True); continue
        try:
            want = con.execute(oracles[k]).df()
            wt = {d[0]: str(d[1]) for d in con.description}
        except Exception as e:
            print(f"ORACLE FAIL {k}: {str(e)[:900]}", flush=True); bad.append(k); continue
        t2 = time.time()
        a, b = norm(got), norm(want)
        odd = {c: (types.get(c), wt.get(c)) for c in set(types) | set(wt)
               if {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(types.get(c)) != wt.get(c)}
        ok = a == b and sorted(got.columns) == sorted(want.columns)
        print(f"{'ok  ' if ok else 'DIFF'} {k}: {len(a)} rows spark {t1-t0:.1f}s duck {t2-t1:.1f}s {'types '+str(odd) if odd else ''}", flush=True)
        if not ok:
            bad.append(k)
            sa, sb = set(a) - set(b), set(b) - set(a)
            print("   cols", sorted(got.columns), sorted(want.columns), len(a), len(b))
            for s in sorted(sa)[:4]: print("   spark", s)
            for s in sorted(sb)[:4]: print("   duck ", s)
    print("bad:", bad)


main()
