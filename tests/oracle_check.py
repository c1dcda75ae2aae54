"""Run a registered Spark query and its DuckDB oracle side by side (like the driver's gate).

Usage: python -m tests.oracle_check [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

sys.path.insert(0, ".")

import __spark_entry__ as entry  # noqa: E402
from answerbank.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    try:
        import decimal

        if isinstance(v, decimal.Decimal):
            return round(float(v), 6)
    except Exception:
        pass
    return str(v)


def digest(cols: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def compare(spark, sf_dir: str, name: str, con=None) -> dict:
    con = con or duck(sf_dir)
    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return {"name": name, "rows": len(s_rows), "spark_s": round(t1 - t0, 2), "oracle": None}
    res = con.sql(sql)
    d_cols = list(res.columns)
    d_rows = [tuple(r) for r in res.fetchall()]
    t2 = time.time()
    out = {
        "name": name,
        "spark_rows": len(s_rows),
        "oracle_rows": len(d_rows),
        "cols_match": sorted(s_cols) == sorted(d_cols),
        "hash_match": digest(s_cols, s_rows) == digest(d_cols, d_rows),
        "spark_s": round(t1 - t0, 2),
        "oracle_s": round(t2 - t1, 2),
    }
    if not out["hash_match"]:
        out["spark_cols"] = s_cols
        out["oracle_cols"] = d_cols
        si = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        di = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        ss = sorted(repr(tuple(_norm(r[i]) for i in si)) for r in s_rows)
        ds = sorted(repr(tuple(_norm(r[i]) for i in di)) for r in d_rows)
        diff_s = sorted(set(ss) - set(ds))[:3]
        diff_d = sorted(set(ds) - set(ss))[:3]
        out["only_spark"] = [x[:300] for x in diff_s]
        out["only_oracle"] = [x[:300] for x in diff_d]
    return out


def main() -> None:
    from answerbank.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, sf_dir, n, con)
        except Exception as exc:  # report and continue
            r = {"name": n, "error": repr(exc)[:800]}
        if "error" in r:
            ok = False
        elif "oracle_rows" in r:
            ok = bool(r["hash_match"] and r["cols_match"] and r["spark_rows"] == r["oracle_rows"])
        else:
            ok = True  # rows-only query (no oracle SQL)
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + repr(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
