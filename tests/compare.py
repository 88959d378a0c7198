"""Hold registered queries against their SQL: python -m tests.compare SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, name, query, sql, sf_dir) -> str:
    """Empty if the query's rows are those of the SQL."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    made = con.execute(sql)
    want = rows_of([c[0] for c in made.description], made.fetchall())
    if got[0] != want[0]:
        return f"{name}: columns {got[0]}, not {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{name}: {len(got[1])} rows, not {len(want[1])}; first {got[1][:1]}, {want[1][:1]}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"{name}: {a}, not {b}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con, bad = session(), database(sf_dir), 0
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            said = differences(spark, con, name, query, sql[name], sf_dir) if name in sql else f"{query(spark, sf_dir).count()} rows, no SQL"
        except Exception as e:  # the next query still runs
            said = f"{name}: {type(e).__name__} {str(e)[:1500]}"
        bad += bool(said) and "no SQL" not in said
        print(f"{name} {time.time() - began:.1f}s {said or 'equal'}", flush=True)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
