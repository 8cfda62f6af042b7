"""Run every query against its SQL equivalent: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata")


def run_sql(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def differences(df: DataFrame, columns: list[str], rows: list[tuple]) -> str:
    """Empty if both sides hold the same rows, in any order."""
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    names = sorted(columns)

    def keyed(values):
        return tuple((v is not None, v if v is not None else 0) for v in values)

    ours = sorted((tuple(r[n] for n in names) for r in df.collect()), key=keyed)
    at = [columns.index(n) for n in names]
    theirs = sorted((tuple(r[i] for i in at) for r in rows), key=keyed)
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    for mine, other in zip(ours, theirs, strict=True):
        for a, b in zip(mine, other, strict=True):
            if isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=1e-9):
                if a != b:
                    print("  inexact:", a, b)
                continue
            if a != b or isinstance(a, float) != isinstance(b, float):
                return f"{mine} and {other}"
    return ""


def main() -> None:
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = str(DATA / sf)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if name not in sql or len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        df = query(spark, sf_dir)
        n = df.count()
        spent = time.time() - start
        start = time.time()
        columns, rows = run_sql(sf_dir, sql[name])
        problem = differences(df, columns, rows)
        bad += bool(problem)
        print(f"{name:22s} {n:8d} rows {spent:6.2f}s  {problem or 'same'}", flush=True)
    sys.exit(bad)


if __name__ == "__main__":
    main()
