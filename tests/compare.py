"""Run registered queries on Spark and their SQL on DuckDB and compare the results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from fleetlens.plans.inputs import TABLES

TESTDATA = "/root/testdata"


def connect(path: str):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{path}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, (bytearray, memoryview)):
        return bytes(x)
    if isinstance(x, decimal.Decimal):
        return ("decimal", x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else ("%.9g" % (x + 0.0))
    if isinstance(x, dt.datetime) and x.tzinfo:
        return ("zoned", x)
    if isinstance(x, list):
        return [plain(i) for i in x]
    return x


def family(name: str) -> str:
    name = name.lower()
    for key, members in {
        "int": ("tinyint", "smallint", "int", "bigint", "integer", "long"), "float": ("double", "float"),
        "text": ("string", "varchar"), "bool": ("boolean",), "ntz": ("timestamp_ntz",), "date": ("date",),
    }.items():
        if name in members:
            return key
    return name


def compare(spark, con, name: str, build, sql: str, path: str) -> str | None:
    """None if equal, else what differs."""
    df = build(spark, path)
    got = df.collect()
    rel = con.sql(sql)
    want_cols, want_types = rel.columns, [str(t) for t in rel.types]
    want = rel.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} vs {sorted(want_cols)}"
    spark_types = dict(df.dtypes)
    for c, t in zip(want_cols, want_types):
        a, b = family(spark_types[c]), family("timestamp_ntz" if t == "TIMESTAMP" else t)
        if a != b:
            return f"type of {c}: spark {spark_types[c]} vs {t}"
    order = sorted(want_cols)
    a = sorted(repr([plain(r[c]) for c in order]) for r in got)
    idx = [want_cols.index(c) for c in order]
    b = sorted(repr([plain(r[i]) for i in idx]) for r in want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}" + _sample(a, b, order)
    if a != b:
        return "values differ" + _sample(a, b, order)
    return None


def _sample(a, b, order) -> str:
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return (f" ({len(only_a)} / {len(only_b)})\n   columns {order}\n   spark {only_a[:2]}\n   sql   {only_b[:2]}")


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from fleetlens.session import build_session

    sf = os.environ.get("SF", "0.01")
    path = f"{TESTDATA}/sf{sf}"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(path)
    builders, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in builders.items():
        if argv and not any(a in name for a in argv):
            continue
        t = time.time()
        try:
            if name in sql:
                diff = compare(spark, con, name, build, sql[name], path)
                rows = ""
            else:
                diff, rows = None, f" rows-only {build(spark, path).count()}"
        except Exception as exc:  # report and go on to the next query
            diff = f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - t:.2f}s{rows if diff is None else ''} {diff or ''}", flush=True)
    print("failed", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
