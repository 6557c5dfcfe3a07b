"""Runs queries beside their SQL as the driver does: columns by name, rows as sorted values."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    c.execute("SET threads = 4")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if v is not None and type(v).__name__ == "Decimal":
        return float(f"{float(v):.12g}")
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, connection_, query, sql, sf):
    df = query(spark, sf)
    a = rows_of(df.columns, df.collect())
    got = connection_.execute(sql)
    b = rows_of([d[0] for d in got.description], got.fetchall())
    if a == b:
        return len(a[1]), ""
    if a[0] != b[0]:
        return len(a[1]), f"columns {a[0]} and {b[0]}"
    x, y = set(a[1]), set(b[1])
    return len(a[1]), f"{len(a[1])} and {len(b[1])} rows; only Spark {sorted(x - y, key=repr)[:2]}; only SQL {sorted(y - x, key=repr)[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = f"/root/testdata/{sys.argv[1]}"
    cores = os.environ.get("CORES", "4")
    session = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", cores).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    c = connection(sf)
    for name in sys.argv[2:] or sqls:
        t = time.time()
        try:
            if name in sqls:
                n, why = compare(session, c, queries[name], sqls[name], sf)
            else:
                n, why = queries[name](session, sf).count(), ""
        except Exception as e:  # noqa: BLE001
            n, why = -1, f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{'ok  ' if not why else 'FAIL'} {name} {n} rows {time.time() - t:.1f} s {why[:900]}", flush=True)
