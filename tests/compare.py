"""Run registered queries next to their DuckDB statements and compare the rows.

    python -m tests.compare SF_DIR [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(shaped, key=repr)


def compare(spark, con, build, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = build(spark, sf_dir)
    cols, rows = canonical(df.columns, df.collect())
    cur = con.execute(sql)
    want_cols, want = canonical([d[0] for d in cur.description], cur.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}; first {rows[:1]} / {want[:1]}"
    for a, b in zip(rows, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{len(rows)} rows, first difference\n  spark {a}\n  duckdb {b}"[:1500]
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir, wanted = argv[0], argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            if name in oracle:
                problem = compare(spark, con, build, oracle[name], sf_dir)
                status = "ok" if problem is None else f"MISMATCH {problem}"
            else:
                n = build(spark, sf_dir).count()
                problem, status = None, f"rows {n}"
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem = status = f"ERROR {type(exc).__name__}: {str(exc)[:1500]}"
        bad += problem is not None
        print(f"{name:32s} {time.time() - t:6.2f}s {status}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
