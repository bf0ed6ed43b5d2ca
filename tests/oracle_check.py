"""Local stand-in for the driver's correctness gate.

Runs each registered Spark query and its DuckDB oracle on the same parquet tables and
compares column names, row counts and the multiset of rows (doubles compared after
rounding to 6 significant places).  Usage: python tests/oracle_check.py [sf_dir] [names...]
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


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.6g}") if abs(v) < 1e6 else round(v, 1)
    if hasattr(v, "item"):
        return norm(v.item())
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return norm(float(v))
    except Exception:
        pass
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(records, cols):
    return sorted((tuple(norm(r[c]) for c in cols) for r in records), key=lambda t: tuple((x is None, str(x)) for x in t))


def rows_of_frame(pdf, cols):
    """Same normalisation as ``rows_of`` on a pandas frame, column by column (much faster
    than indexing Spark Rows by name for large results)."""
    columns = [[norm(v) for v in pdf[c].tolist()] for c in cols]
    return sorted(zip(*columns), key=lambda t: tuple((x is None, str(x)) for x in t))


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from agrolattice.session import build_session
    # ORACLE_SPARK_TZ runs Spark in another session time zone (results must not change)
    spark = build_session("local[8]", shuffle_partitions=8,
                          extra={"spark.sql.session.timeZone": os.environ.get("ORACLE_SPARK_TZ", "UTC"),
                                 # results are collected to compare them: room for large outputs
                                 "spark.driver.memory": "8g", "spark.driver.maxResultSize": "4g"})
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    ok_all = True
    for name in (names or list(qs)):
        t = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            scols = sorted(sdf.columns)
            spdf = sdf.toPandas()  # Arrow transfer
        except Exception as e:  # noqa: BLE001
            print(f"{name}: SPARK ERROR {e!r}"[:2000]); ok_all = False; continue
        ts = time.time() - t
        if name not in sql:
            print(f"{name}: rows-only {len(spdf)} rows ({ts:.1f}s)"); continue
        try:
            dpdf = con.execute(sql[name]).df()
            dcols = list(dpdf.columns)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: DUCKDB ERROR {e!r}"[:2000]); ok_all = False; continue
        if sorted(dcols) != scols:
            print(f"{name}: COLUMNS differ spark-only={set(scols)-set(dcols)} duck-only={set(dcols)-set(scols)}")
            ok_all = False; continue
        a, b = rows_of_frame(spdf, scols), rows_of_frame(dpdf, scols)
        if a == b:
            print(f"{name}: OK {len(a)} rows ({ts:.1f}s)")
        else:
            ok_all = False
            print(f"{name}: MISMATCH spark={len(a)} duck={len(b)} cols={scols}")
            sa, sb = set(a), set(b)
            for x in list(sa - sb)[:3]:
                print("   spark-only", x)
            for x in list(sb - sa)[:3]:
                print("   duck-only ", x)
    spark.stop()
    sys.exit(0 if ok_all else 1)


if __name__ == "__main__":
    main()
