"""A ranked result of any size, stored in shards of consecutive places, and pages of it.

Rows are sorted into ranges, a shard each, and numbered inside their shard as they are written; a row's place is the
number of rows in the shards before plus its own number. No task and no window sees all rows, and a page opens
only the files of the shards that hold its places.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlift.sources.files import Files

_BITS = 33  # of a number that Spark gives, counted inside a task


def write_ranked(df: DataFrame, order: list[Column], path: str, shards: int | None = None) -> Ranked:
    """Store the rows in the given order, in so many shards, or in as many as adaptive execution makes."""
    ranges = df.repartitionByRange(shards, *order) if shards else df.repartitionByRange(*order)
    at = F.monotonically_increasing_id()
    numbered = ranges.sortWithinPartitions(*order).withColumn("_at", at)
    numbered = numbered.withColumn("_shard", F.shiftright("_at", _BITS)).withColumn(
        "_at", F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))
    )
    numbered.write.partitionBy("_shard").parquet(f"{path}/rows")
    schema = numbered.schema
    stored = df.sparkSession.read.schema(schema).parquet(f"{path}/rows")
    sizes = {r["_shard"]: r["n"] for r in stored.groupBy("_shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    manifest = {"schema": schema.json(), "shards": sorted(sizes.items())}
    Files(df.sparkSession).create(f"{path}/shards.json", json.dumps(manifest))
    return Ranked(df.sparkSession, path)


class Ranked:
    """A stored ranking; places count from 1. A folder without its list of shards is not whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        manifest = json.loads(Files(spark).read(f"{path}/shards.json"))
        self._schema = StructType.fromJson(json.loads(manifest["schema"]))
        self._shards = [s for s, _ in manifest["shards"]]
        self._first = [1]  # place of the first row of each shard, and of the row after all
        for _, n in manifest["shards"]:
            self._first.append(self._first[-1] + n)

    def __len__(self) -> int:
        return self._first[-1] - 1

    def page(self, first: int, last: int) -> DataFrame:
        """The rows of the places ``first`` to ``last`` (those there are), in order, with their ``place``."""
        begin = max(0, bisect_right(self._first, first) - 1)
        end = min(bisect_left(self._first, last + 1), len(self._shards))
        return self._read(range(begin, end)).where(F.col("place").between(first, last)).orderBy("place")

    def placed(self) -> DataFrame:
        """All rows with their ``place``, in no order."""
        return self._read(range(len(self._shards)))

    def _read(self, wanted: range) -> DataFrame:
        reader = self.spark.read.schema(self._schema).option("basePath", f"{self.path}/rows")
        folders = [f"{self.path}/rows/_shard={self._shards[i]}" for i in wanted]
        rows = reader.parquet(*folders) if folders else self.spark.createDataFrame([], self._schema)
        # One row for each shard that is read.
        before = self.spark.createDataFrame([(self._shards[i], self._first[i]) for i in wanted], "_shard bigint, _first bigint")
        return (
            rows.join(F.broadcast(before), "_shard")
            .withColumn("place", F.col("_first") + F.col("_at"))
            .drop("_shard", "_at", "_first")
        )

