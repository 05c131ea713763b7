"""Run registered queries next to their SQL and report differences.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def make_spark(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("assetpulse-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, int(value))
    if isinstance(value, (int, float)):
        if isinstance(value, float) and math.isnan(value):
            return (0, "nan")
        return (1, round(float(value), 9))
    if isinstance(value, (list, tuple)):
        return (3, tuple(canonical(v) for v in value))
    return (2, str(value))


def table_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    got_rows = [tuple(r) for r in spark_df.collect()]
    got = table_of(spark_df.columns, got_rows)
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = table_of(columns, cur.fetchall())
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {
        f.name: (f.dataType.simpleString(), types.get(f.name))
        for f in spark_df.schema.fields
        if kinds.get(f.dataType.simpleString()) != types.get(f.name)
    }
    if odd:
        return f"types {odd}"
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        a, b = bad[0]
        names = sorted(columns)
        cells = [f"{n}: {x[1]} != {y[1]}" for n, x, y in zip(names, a, b) if x != y]
        return f"{len(bad)} of {len(got)} rows differ; first: {cells} in {[x[1] for x in a]}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    from __spark_entry__ import oracle_sql, queries

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = make_spark(), duck(sf_dir)
    calls, sqls = queries(), oracle_sql()
    failures = 0
    for name in args.names or calls:
        begin = time.time()
        try:
            df = calls[name](spark, sf_dir)
            if name in sqls:
                verdict = differences(df, con, sqls[name]) or "ok"
            else:
                verdict = "ok (no SQL)"
            note = f"{df.count()} rows"
        except Exception as error:  # report and go on with the next query
            if os.environ.get("TRACE"):
                traceback.print_exc()
            verdict, note = f"ERROR {type(error).__name__}: {str(error)[:700]}", ""
        failures += not verdict.startswith("ok")
        print(f"{time.time() - begin:6.1f}s {name}: {verdict} {note}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(main())
