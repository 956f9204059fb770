"""Compare registered queries with their SQL in DuckDB, ignoring row and column order."""

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


LAST_ROWS = [0]


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 2**53 else v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir) -> str:
    """Empty text when both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    LAST_ROWS[0] = sum(want.values())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        extra, lost = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"{sum(got.values())} rows vs {sum(want.values())}; only here {extra}; only there {lost}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from martloom.session import build_session

    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    oracle = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and name not in names and not any(n.endswith("*") and name.startswith(n[:-1]) for n in names):
            continue
        start = time.time()
        try:
            if name in oracle:
                why = compare(spark, con, name, fn, oracle[name], sf_dir)
            else:
                why = "" if fn(spark, sf_dir).collect() is not None else "no rows"
        except Exception as exc:  # noqa: BLE001
            why = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(why)
        print(f"{'FAIL' if why else 'ok  '} {name} {time.time() - start:.2f}s rows={LAST_ROWS[0]} {why}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
