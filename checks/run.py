"""Run registered queries next to their SQL and compare: python -m checks.run [names...]"""

import datetime
import decimal
import math
import os
import sys
import time

import duckdb


def connect(d):
    con = duckdb.connect()
    for file in sorted(os.listdir(d)):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{file}'")
    return con


def _plain(v):
    if isinstance(v, (decimal.Decimal, float)):
        v = float(v)
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in data)


def compare(df, con, sql):
    """None if both agree, else what differs."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows / {len(want[1])}"
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(wrong)} of {len(got[1])} rows, first {str(wrong[0])[:600]}" if wrong else None


def main(names, d):
    from checks.catalog import ORACLES, QUERIES
    from sentilake.session import build_session

    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(d)
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, d)
            if name in ORACLES:
                result = compare(df, con, ORACLES[name]) or "ok"
            else:
                result = f"{len(df.collect())} rows, no SQL"
            types = f" {df.count()} rows"
        except Exception as error:
            result, types = f"{type(error).__name__}: {str(error)[:900]}", ""
        print(f"{name:34s} {time.time() - start:6.2f}s {result}{types}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:], os.environ.get("CHECK_DIR", "/root/testdata/sf0.01"))
