"""Compares registered queries with their oracle SQL: python tests/verify.py SF_DIR [QUERY...]."""

import glob
import os
import sys
import time

import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def frames_differ(a, b) -> str:
    """What is different between two pandas frames as multisets of rows, or ''."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    cols = sorted(a.columns)

    def text(v) -> str:
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "null"
        if isinstance(v, float):
            return repr(int(v)) if v == int(v) else f"{v:.9g}"
        if hasattr(v, "tolist"):
            return str([text(x) for x in v.tolist()] if isinstance(v.tolist(), list) else text(v.tolist()))
        return str(v)

    rows = [sorted(map(str, ([text(v) for v in r] for r in f[cols].astype(object).itertuples(index=False)))) for f in (a, b)]
    if rows[0] == rows[1]:
        return ""
    one, two = (list(set(x) - set(y)) for x, y in (rows, rows[::-1]))
    return f"{len(rows[0])} and {len(rows[1])} rows; only here {len(one)} {one[:3]}; only there {len(two)} {two[:3]}"


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return con


if __name__ == "__main__":
    import __spark_entry__ as e
    from netloom.session import build_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    q, o, con = e.queries(), e.oracle_sql(), duck(sf)
    for n in names or q:
        t = time.time()
        got = q[n](spark, sf).toPandas()
        t1 = time.time() - t
        said = "no SQL"
        if n in o:
            r = con.execute(o[n])
            said = frames_differ(got, r.fetchdf()) or "ok"
        print(f"{n}: {len(got)} rows, {t1:.1f} s, {said}"[:1500], flush=True)
