"""Run registered queries beside their oracle SQL and compare columns, types and values.

    python tests/compare.py [--sf DIR] [key or prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from prepwright.session import provide_folder  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").appName("prepwright-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    provide_folder(spark)
    return spark


def oracle(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(rows: list, order: list[int]) -> list[str]:
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return repr(v)
    return sorted("|".join(cell(row[i]) for i in order) for row in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else a short description."""
    mine = [tuple(row) for row in spark_df.collect()]
    con.execute(sql)
    names, types = [d[0] for d in con.description], [str(d[1]) for d in con.description]
    theirs = con.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    kinds = dict(zip(names, types))
    for name, kind in spark_df.dtypes:
        if TYPES.get(kind, kind) != kinds[name]:
            return f"type of {name}: {kind} != {kinds[name]}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    a = canonical(mine, [spark_df.columns.index(c) for c in sorted(names)])
    b = canonical(theirs, [names.index(c) for c in sorted(names)])
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None


def main(arguments: list[str]) -> int:
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.01"
    if "--sf" in arguments:
        at = arguments.index("--sf")
        sf = arguments[at + 1]
        del arguments[at:at + 2]
    spark, con = session(), oracle(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for key, run in queries.items():
        if arguments and not any(key.startswith(a) for a in arguments):
            continue
        started = time.time()
        try:
            df = run(spark, sf)
            if key in sql:
                found = difference(df, con, sql[key])
            else:
                found = None if df.collect() else "no rows"
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += found is not None
        state = "ok" if found is None else "FAIL " + found
        print(f"{key:32s} {'oracle' if key in sql else 'rows':6s} {time.time() - started:6.1f}s {state}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
