"""Result sinks: CSV, JSON lines, a whole payload, and a limited report as one text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.operators.compare import domain_list

#: Rows of a report that the driver holds, unless a caller allows more.
REPORT_ROWS = 10_001


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header; quotes are doubled, nulls are empty fields."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", '""')
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read back what :func:`write_csv` wrote."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per row; null fields are kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_payload(result: DataFrame, schemes: DataFrame, status: str, path: str) -> None:
    """A result of any size: ``rows``, ``prefixes`` and ``status`` as JSON lines under ``path``.

    ``status`` is written last, so a folder that has it is whole.
    """
    write_json(result, f"{path}/rows")
    write_json(domain_list(schemes), f"{path}/prefixes")
    columns = F.array(*[F.lit(c.upper()) for c in result.columns])
    one = result.sparkSession.range(1)
    write_json(one.select(F.lit(status).alias("status"), columns.alias("cols")), f"{path}/status")


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """(kind, line): every line of the three parts, as written."""
    parts = [
        spark.read.text(f"{path}/{kind}").select(F.lit(kind).alias("kind"), F.col("value").alias("line"))
        for kind in ("rows", "prefixes", "status")
    ]
    return parts[0].union(parts[1]).union(parts[2])


def payload(result: DataFrame | None, status: str, limit: int | None, most_rows: int = REPORT_ROWS) -> str:
    """``{cols, rows, status}`` of a limited report as one JSON text.

    ``limit`` codes of either end and the total must be ``most_rows`` at most; a larger result, and the
    list of domains, which grows with the codes, are written by :func:`write_payload`.
    """
    if result is None:
        return json.dumps({"cols": [], "rows": [], "status": status})
    if limit is None or 2 * limit + 1 > most_rows:
        raise ValueError(f"a report has a limit and at most {most_rows} rows; use write_payload for others")
    rows = [list(row) for row in result.collect()]
    return json.dumps({"cols": [c.upper() for c in result.columns], "rows": rows, "status": status})
