"""Tables that are built once and read by later steps, in a folder all executors share."""

from __future__ import annotations

import copy
import hashlib
import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.functions.codes import TOTAL
from cohortlift.sources.files import Files


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode a fresh one if it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlift-"))
    return spark.sparkContext.getCheckpointDir()


class StageTables:
    """Named tables under one folder: built when first asked for, then read, by later applications too.

    The tables of one build lie in a folder of their own, ``<prefix>/builds/<build>``. A table exists once
    its manifest is there, which is written after the commit: an unfinished build is done again, of two
    at a time the first counts, and nothing depends on the session's catalog or on an executor's blocks.
    :meth:`rebuild` starts a new build; who reads the old one goes on until :meth:`clean`.

    ``keys`` tells for a name what its table was made from (such as a hash of rules and of input files): made from
    something else it is another table. A table may have several parts, so that rows can be added to the parts of
    an earlier table without writing those again.
    """

    def __init__(
        self,
        spark: SparkSession,
        prefix: str | None = None,
        folder: str | None = None,
        keys: Mapping[str, str] | None = None,
    ):
        self.spark = spark
        self.files = Files(spark)
        self.prefix = prefix or f"cohortlift_{uuid.uuid4().hex[:12]}"
        self.root = f"{folder or shared_folder(spark)}/{self.prefix}"
        self.keys = dict(keys or {})
        builds = [b for b in self.files.names(f"{self.root}/builds") if not b.startswith(".")]
        self.build = builds[-1] if builds else self._new_build()

    def _new_build(self) -> str:
        build = f"{time.time_ns():020d}_{uuid.uuid4().hex[:8]}"
        self.files.create(f"{self.root}/builds/{build}/BUILD", build)
        return build

    @property
    def folder(self) -> str:
        return f"{self.root}/builds/{self.build}"

    def variant(self, key: str, keys: Mapping[str, str] | None = None) -> StageTables:
        """Tables that depend on this build, under ``key``."""
        return StageTables(self.spark, key, self.folder, keys)

    def keyed(self, keys: Mapping[str, str]) -> StageTables:
        """The tables of the same build that were made from something else."""
        other = copy.copy(self)
        other.keys = dict(keys)
        return other

    def table(
        self,
        name: str,
        build: Callable[[], DataFrame],
        bucket_by: str | None = None,
        buckets: int | None = None,
        conf: dict[str, str] | None = None,
        range_by: str | None = None,
    ) -> DataFrame:
        """The stage table ``name``, written from ``build()`` if it does not exist yet.

        Buckets are sorted by their key; so are the files of a table laid out by ranges of a column, of
        which a reader of few values opens few. ``conf`` holds for the session while it is written.
        """
        if not self.exists(name):
            path = f"{self.folder}/{name}_{uuid.uuid4().hex[:8]}"
            manifest = {"paths": [path], "bucket_by": bucket_by, "buckets": buckets if bucket_by else None}
            with _conf(self.spark, conf or {}):
                df = build()
                if range_by:
                    df = df.repartitionByRange(range_by).sortWithinPartitions(range_by)
                if manifest["buckets"]:
                    writer = df.write.format("parquet").bucketBy(buckets, bucket_by).sortBy(bucket_by)
                    writer.option("path", path).saveAsTable(_table_name(path))
                else:
                    df.write.parquet(path)
                manifest["columns"] = df.dtypes
            self.files.create(self._manifest(name), json.dumps(manifest))
        return reduce(DataFrame.union, self.parts(name))

    def join_parts(self, name: str, tables: list[tuple[StageTables, str]]) -> None:
        """Make the parts of written tables, with the same columns and buckets, the parts of the table ``name``."""
        found = [of._found(table) for of, table in tables]
        manifest = {**found[0], "paths": [path for f in found for path in f["paths"]]}
        self.files.create(self._manifest(name), json.dumps(manifest))

    def parts(self, name: str) -> list[DataFrame]:
        """The parts of a written table; a row is in one part only."""
        found = self._found(name)
        if not found["buckets"]:
            return [self.spark.read.parquet(path) for path in found["paths"]]
        return [self._bucketed(path, found) for path in found["paths"]]

    def _bucketed(self, path: str, found: dict) -> DataFrame:
        name = _table_name(path)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{column}` {kind}" for column, kind in found["columns"])
            by = found["bucket_by"]
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
                f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {found['buckets']} BUCKETS "
                f"LOCATION '{path}'"
            )
        return self.spark.table(name)

    def exists(self, name: str) -> bool:
        return self.files.exists(self._manifest(name))

    def bucket_count(self, name: str) -> int | None:
        """Number of buckets a written table has, or None."""
        return self._found(name)["buckets"]

    def _manifest(self, name: str) -> str:
        key = self.keys.get(name)
        return f"{self.folder}/{name}_{key}.json" if key else f"{self.folder}/{name}.json"

    def _found(self, name: str) -> dict:
        return json.loads(self.files.read(self._manifest(name)))

    def drop(self, *names: str) -> None:
        """Forget stage tables, so that they are built anew when next asked for."""
        for name in names:
            self.files.delete(self._manifest(name))

    def rebuild(self) -> None:
        """Start a new build, for changed inputs; the tables of the old one stay as they are."""
        self.build = self._new_build()

    def clean(self) -> None:
        """Delete all builds but the present one. Nobody should be reading them any more."""
        for build in self.files.names(f"{self.root}/builds"):
            if build != self.build:
                self.files.delete(f"{self.root}/builds/{build}")

    def remove(self) -> None:
        """Delete all tables, as for a study under a random prefix that is over."""
        self.files.delete(self.root)


def _table_name(path: str) -> str:
    """A name for the session's catalog that no other path has."""
    table = path.rsplit("/", 1)[1]
    return f"cohortlift_{hashlib.sha256(path.encode()).hexdigest()[:12]}_{table.rsplit('_', 1)[0]}"


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@dataclass(frozen=True)
class Stored:
    """A stored cohort: its size, the hash of its members, and where its counts are."""

    cohort_id: str
    n: int
    members_hash: int
    written: str

    @property
    def ids(self) -> tuple[int, ...]:
        return tuple(map(int, re.findall(r"\d+", self.cohort_id)))


class CohortStore:
    """Stored cohort counts of one build.

    Each write has a folder with one part for each cohort. What is stored of a patient set or a query
    master is named by empty files in a folder of that set or master, so a request lists that folder and
    reads one part, however many cohorts are stored. A cohort that is counted again gets a newer name.
    """

    SCHEMA = "ccd string, cnt bigint, frc double, members_hash bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self.files = Files(spark)

    def find(self, result: int | None = None, master: int | None = None) -> list[Stored]:
        """Newest counts of each cohort of a patient set or of a query master, newest ids last."""
        folder = f"result/{result}" if result is not None else f"master/{master}"
        newest: dict[str, Stored] = {}
        for name in self.files.names(f"{self.path}/{folder}"):
            if name.count("~") == 3:
                cohort_id, n, members_hash, written = name.split("~")
                found = Stored(cohort_id, int(n), int(members_hash), written)
                if cohort_id not in newest or newest[cohort_id].written < written:
                    newest[cohort_id] = found
        return sorted(newest.values(), key=lambda s: s.ids)

    def newest(self, result: int | None = None, master: int | None = None) -> Stored | None:
        found = self.find(result, master)
        return found[-1] if found else None

    def get(self, cohort_id: str) -> Stored | None:
        result = int(cohort_id.rsplit("_R", 1)[1])
        return next((s for s in self.find(result=result) if s.cohort_id == cohort_id), None)

    def write(self, counts: DataFrame) -> None:
        written = f"{time.time_ns():020d}_{uuid.uuid4().hex[:8]}"
        path = f"{self.path}/counts/{written}"
        (
            counts.select("ccd", "cnt", "frc", "members_hash", "cohort_id")
            .hint("rebalance", "cohort_id")  # few files per cohort; AQE splits large ones
            .write.partitionBy("cohort_id")
            .parquet(path)
        )
        totals = self.spark.read.schema(f"{self.SCHEMA}, cohort_id string").parquet(path)
        for r in totals.where(F.col("ccd") == TOTAL).select("cohort_id", "cnt", "members_hash").collect():
            stored = Stored(r.cohort_id, r.cnt, r.members_hash, written)
            name = f"{r.cohort_id}~{r.cnt}~{r.members_hash}~{written}"
            for folder in (f"master/{stored.ids[0]}", f"result/{stored.ids[2]}"):
                self.files.create(f"{self.path}/{folder}/{name}", "")

    def counts(self, stored: Stored) -> DataFrame:
        """``ccd, cnt, frc, members_hash, cohort_id`` of one cohort."""
        path = f"{self.path}/counts/{stored.written}/cohort_id={stored.cohort_id}"
        return self.spark.read.schema(self.SCHEMA).parquet(path).withColumn("cohort_id", F.lit(stored.cohort_id))

    def counts_of(self, stored: list[Stored]) -> DataFrame:
        """:meth:`counts` of several cohorts, in one scan for each write that they come from."""
        by_write: dict[str, list[str]] = {}
        for s in stored:
            by_write.setdefault(s.written, []).append(s.cohort_id)
        reader = self.spark.read.schema(f"{self.SCHEMA}, cohort_id string")
        scans = [
            reader.parquet(f"{self.path}/counts/{written}").where(F.col("cohort_id").isin(ids))
            for written, ids in sorted(by_write.items())
        ]
        return reduce(DataFrame.union, scans)

    def cohort(self, cohort_id: str) -> DataFrame:
        stored = self.get(cohort_id)
        if stored is None:
            raise KeyError(cohort_id)
        return self.counts(stored)
