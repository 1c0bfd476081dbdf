"""Compare registered queries with their SQL: python tests/compare.py FOLDER [query ...]"""

import math
import os
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    return value


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(
        (tuple(plain(v) for v in row) for row in df.select(*names).collect()), key=repr
    )


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(row[i]) for i in order) for row in cursor.fetchall()]
    return [names[i] for i in order], sorted(rows, key=repr)


def difference(got: tuple, wanted: tuple) -> str:
    """What differs, "" if nothing does."""
    if got[0] != wanted[0]:
        return f"columns {got[0]} instead of {wanted[0]}"
    if len(got[1]) != len(wanted[1]):
        extra = list(set(got[1]) - set(wanted[1]))[:2], list(set(wanted[1]) - set(got[1]))[:2]
        return f"{len(got[1])} rows instead of {len(wanted[1])}: {extra}"
    bad = [(g, w) for g, w in zip(got[1], wanted[1], strict=True) if g != w]
    return f"{len(bad)} rows differ, such as {got[0]} {bad[0][0]} instead of {bad[0][1]}" if bad else ""


def main() -> None:
    import __spark_entry__ as entry

    folder, only = sys.argv[1], sys.argv[2:]
    spark, con = session(int(os.environ.get("CPUS", "8"))), database(folder)
    oracles, failed = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            got = spark_rows(run(spark, folder))
            took = time.time() - start
            start = time.time()
            note = difference(got, sql_rows(con, oracles[name])) if name in oracles else "no SQL"
            sql_took = time.time() - start
        except Exception as problem:  # noqa: BLE001
            failed += 1
            print(f"FAIL {name}: {str(problem)[:1500]}", flush=True)
            continue
        failed += bool(note) and note != "no SQL"
        print(f"{note or 'ok':8.1500} {name}: {len(got[1])} rows, {took:.2f} s, SQL {sql_took:.2f} s", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
