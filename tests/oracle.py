"""Side-by-side check of a Spark query against its DuckDB oracle SQL.

Mirrors the driver's correctness gate: same row count, same column names,
and the same multiset of rows (order-insensitive), floats compared after
rounding to a fixed number of significant digits.
"""

from __future__ import annotations

import datetime
import math

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, sig: int):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == 0:
            return 0.0
        return float(f"{v:.{sig}g}")
    if hasattr(v, "item"):
        return _norm(v.item(), sig)
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, datetime.datetime):
        return v.date() if v.time() == datetime.time(0) else v
    return v


def rows_of(pdf: pd.DataFrame, sig: int) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].astype(object).itertuples(index=False, name=None):
        out.append(tuple(_norm(None if (isinstance(x, float) and math.isnan(x)) else x, sig) for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                 "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
                 "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def type_diff(spark_df, con, sql: str) -> dict:
    """Columns whose Spark type does not map to the oracle's DuckDB type."""
    rel = con.sql(sql)
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    out = {}
    for f in spark_df.schema.fields:
        st = SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
        if st != duck_types.get(f.name):
            out[f.name] = (st, duck_types.get(f.name))
    return out


def compare(spark_df, con, sql: str, sig: int = 9, check_types: bool = True) -> tuple[bool, str]:
    if check_types:
        td = type_diff(spark_df, con, sql)
        if td:
            return False, f"types differ (spark, oracle): {td}"
    s = spark_df.toPandas()
    d = con.execute(sql).df()
    if sorted(s.columns) != sorted(d.columns):
        return False, f"columns differ: spark={sorted(s.columns)} oracle={sorted(d.columns)}"
    if len(s) != len(d):
        return False, f"row count differs: spark={len(s)} oracle={len(d)}"
    rs, rd = rows_of(s, sig), rows_of(d, sig)
    for a, b in zip(rs, rd):
        if a != b:
            return False, f"first differing row: spark={a} oracle={b}"
    return True, f"{len(s)} rows equal"


def main(argv=None):
    """``python -m tests.oracle [sf_dir] [name ...]``: check registered queries."""
    import sys
    import time

    sys.path.insert(0, ".")
    import __spark_entry__ as se
    from tabulon.session import get_session

    args = list(argv if argv is not None else sys.argv[1:])
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    qs, orc = se.queries(), se.oracle_sql()
    names = args or list(qs)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, sf_dir)
            if n in orc:
                ok, msg = compare(df, con, orc[n])
            else:
                ok, msg = True, f"rows-only: {df.count()} rows"
        except Exception as exc:  # report and continue
            ok, msg = False, f"ERROR {type(exc).__name__}: {str(exc)[:300]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {n:32s} {time.time() - t0:6.2f}s  {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
