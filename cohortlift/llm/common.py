"""What the operators of this subpackage share: tables, scratch space, measured broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.sources.files import Files
from cohortlift.sources.stage import shared_folder

#: Rows of a few bytes each that may be broadcast; beyond it a join shuffles.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables of one run, written to the folder that all executors share.

    A written table cuts the lineage: if an executor is lost, later steps read the files again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``df`` as a table, with a folder for each value of the column ``by``."""
        path = f"{self.folder}/{name}"
        writer = df.write.mode("error")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self, name: str, schema: str) -> DataFrame:
        """All tables written under the folder ``name``; no rows if there is none."""
        path = f"{self.folder}/{name}"
        if not Files(self.spark).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def within(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it is counted to have at most ``rows`` rows.

    ``df`` should be a written table, as it is counted first. The rows joined are equal either way.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    """A hash of id and text that is never null; equal rows share it."""
    return F.xxhash64(F.col(key), F.col(text))


def fold(key: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in fold 0, the crc32 of no bytes."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def batched(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters in all, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def least_of_each(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """Of each of a few groups ``by`` the rows with the ``most`` least hashes of ``key``, which is unique in ``rows``.

    The hash that ends a group's share is found among the hashes below a bound that about four times as many
    rows meet (more, should they be too few), so no task or window holds a group.
    """
    h, kind = F.xxhash64(key), dict(rows.dtypes)[by]
    spark, low, span = rows.sparkSession, -(1 << 63), 1 << 64
    sizes = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return rows

    def bounded(ends: dict) -> DataFrame:
        ends = spark.createDataFrame(list(ends.items()), f"{by} {kind}, _end bigint")
        return rows.join(F.broadcast(ends), by).where(h <= F.col("_end")).drop("_end").select(rows.columns)

    share, ends, open_ = {g: 4 * most / n for g, n in sizes.items()}, {}, set(sizes)
    while open_:
        bounds = {g: low + min(span - 1, int(share[g] * span)) for g in open_}
        found: dict = {g: [] for g in open_}
        for r in bounded(bounds).select(by, h.alias("h")).collect():
            found[r[by]].append(r["h"])
        for g, hashes in found.items():
            if len(hashes) >= min(most, sizes[g]):
                ends[g] = sorted(hashes)[min(most, len(hashes)) - 1]
            share[g] *= 4
        open_ -= set(ends)
    return bounded(ends)


def one_text_each(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The rows of ``sample`` (with a unique ``doc_id``) that have documents, each with one whole text.

    Of several documents of an id that of least hash counts; the others are dropped before they are shuffled.
    """
    others = [c for c in sample.columns if c != "doc_id"]
    text = whole_text()
    least = F.min(F.struct(F.xxhash64(text).alias("h"), text.alias("text"))).alias("least")
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return joined.groupBy("doc_id", *others).agg(least).select("doc_id", *others, "least.text")


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): all other columns in one, so that none can clash with a working column."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*others).alias("row"))


def unpacked(rows: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """The columns that were packed, in their order, and ``more``."""
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in columns], *more)


def without(docs: DataFrame, dropped: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Packed documents but those whose ``row_key`` is in ``dropped`` (a column ``key``)."""
    keys = within(scratch.write(dropped.select("key").distinct(), name))
    keyed = docs.withColumn("key", row_key())
    return keyed.join(keys, "key", "left_anti").drop("key")
