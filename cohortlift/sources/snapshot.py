"""What the input tables consist of: their files with size and time, or a version that the caller names.

Files are listed by Spark and compared as tables, so their number does not matter; contents are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, length bigint, modified timestamp"


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, length, modified`` of all data files under files or folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def digests(
    spark: SparkSession, sources: Mapping[str, list[str]], versions: Mapping[str, str] | None = None
) -> dict[str, str]:
    """A text for each input that changes when one of its files, or its version, does."""
    found = {name: f"version {text}" for name, text in (versions or {}).items()}
    listed = [files(spark, paths).withColumn("name", F.lit(name)) for name, paths in sorted(sources.items())]
    if listed:
        digest = F.sum(F.xxhash64("path", "length", "modified").cast("decimal(38,0)"))
        rows = reduce(DataFrame.unionByName, listed).groupBy("name").agg(
            F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), digest.alias("digest")
        )
        found |= {name: "no files" for name in sources}
        found |= {r["name"]: f"{r['n']} files, {r['bytes']} bytes, {r['digest']}" for r in rows.collect()}
    return found


def added(before: DataFrame, now: DataFrame) -> list[str] | None:
    """Paths of the files that were added, or None if a file was changed or removed."""
    keys = ["path", "length", "modified"]
    if not before.join(now, keys, "left_anti").isEmpty():
        return None
    return [r["path"] for r in now.join(before, keys, "left_anti").select("path").collect()]
