"""Run a catalog query on Spark and its SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from palaver.catalog import CATALOG
from palaver.catalog.base import TABLES, Source


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(table, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, name: str, folder: str) -> str:
    """Empty when equal, else a description of the difference."""
    entry = CATALOG[name]
    df = entry.run(Source(spark, folder))
    got = [tuple(r) for r in df.collect()]
    if entry.sql is None:
        return "" if got else "no rows"
    relation = con.execute(entry.sql)
    columns = [d[0] for d in relation.description]
    wanted = relation.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    left, right = _rows(df.columns, got), _rows(columns, wanted)
    if left == right:
        return "" if left else "equal but empty"
    in_left, in_right = set(left), set(right)
    only_left = [r for r in left if r not in in_right][:3]
    only_right = [r for r in right if r not in in_left][:3]
    return f"{len(left)} vs {len(right)} rows; only spark {only_left}; only sql {only_right}"


def main() -> None:
    from palaver.session import build_session
    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    for name in sorted(CATALOG):
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            result = compare(spark, con, name, folder)
        except Exception as error:  # report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{'ok  ' if not result else 'FAIL'} {name} {time.time() - start:.1f}s {result[:1200]}", flush=True)


if __name__ == "__main__":
    main()
