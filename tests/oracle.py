"""Run one registered query in Spark and its counterpart in DuckDB and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb
import numpy as np


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating)):
        return float(repr(float(value)))
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in row) for row in df.select(*names).collect()), key=repr)


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def difference(spark_result, duck_result) -> str | None:
    (names, rows), (want_names, want_rows) = spark_result, duck_result
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(rows) != len(want_rows):
        extra = [r for r in rows[:2000] if r not in want_rows[:2000]][:1]
        return f"{len(rows)} rows != {len(want_rows)}; e.g. {extra!r:.600} vs {want_rows[:1]!r:.600}"
    for got, want in zip(rows, want_rows):
        if got != want:
            return f"\n  got  {got!r:.900}\n  want {want!r:.900}"
    return None


if __name__ == "__main__":
    import sys
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from doclake.plans import ORACLES, QUERIES
    from doclake.session import get_session

    sf = sys.argv[1]
    chosen = [k for k in QUERIES if not sys.argv[2:] or any(k.startswith(a) for a in sys.argv[2:])]
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    for key in chosen:
        start = time.time()
        try:
            got = spark_rows(QUERIES[key](spark, sf))
            took = time.time() - start
            if key in ORACLES:
                print(f"{'OK ' if not (d := difference(got, duck_rows(con, ORACLES[key]))) else 'BAD'} {key} {len(got[1])} rows {took:.1f}s {d or ''}")
            else:
                print(f"ROWS {key} {len(got[1])} rows {took:.1f}s")
        except Exception as e:
            print(f"ERR {key} {str(e)[:700]}")
