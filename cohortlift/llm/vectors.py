"""What the vector searches share: integer vectors, sums over all of them, blocks of queries, best rows.

A search takes a stated set of queries against all rows. Queries go to the tasks in blocks of bounded size, one
round for each block; the rows are never collected.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.common import Scratch

#: Queries that go to the tasks at a time: some 16 MB at 64 components.
QUERY_BLOCK = 16_384
#: Vectors are shorter than this, so that every inner product fits a long.
LONGEST = 2.0**31
_SUMS = "cell bigint, value double"


def integer_rows(df: DataFrame, scale: int, *more: Column) -> DataFrame:
    """Distinct (vec_id, v, len2, *more): ``v`` is ``floor(scale * x)`` of each component x, ``len2`` its square.

    A vector that is null, holds a null or non-finite component, or is ``LONGEST`` or longer, is left out.
    Rows equal in all of these columns count as one.
    """
    x = F.col("embedding")
    sound = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < LONGEST, F.lit(False)))
    v = F.transform(F.when(x.isNotNull() & sound, x), lambda c: F.floor(c.cast("double") * scale))
    len2 = F.aggregate("v", F.lit(0.0), lambda total, c: total + c.cast("double") * c)
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"), *more)
    return rows.where("v is not null").distinct().withColumn("len2", len2).where(F.col("len2") < LONGEST**2)


def matrix(column: pa.ListArray, d: int) -> np.ndarray:
    """The lists as rows of ``d`` numbers; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == d).all():
        return flat.reshape(len(sizes), d).astype(np.int64, copy=False)
    out = np.zeros((len(sizes), d), dtype=np.int64)
    out[np.arange(d) < sizes[:, None]] = flat
    return out


def summed(rows: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of the numbers that ``of`` gives for a matrix of some of them.

    Each task adds up its own; as many numbers as ``of`` gives reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = of(matrix(batch["v"], d).astype(float))
            total = part if total is None else total + part
        if total is not None:
            cells = pa.array(np.arange(len(total)), pa.int64())
            yield pa.RecordBatch.from_arrays([cells, pa.array(total)], names=["cell", "value"])

    found = rows.select("v").mapInArrow(run, _SUMS).groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(found.num_rows)
    out[found["cell"].to_numpy()] = found["value"].to_numpy()
    return out


@dataclass
class Queries:
    """One block of queries; a query is known by ``block`` and its place in it."""

    block: int
    ids: np.ndarray
    v: np.ndarray
    table: pa.Table

    def __len__(self) -> int:
        return len(self.ids)


def query_blocks(queries: DataFrame, d: int, scratch: Scratch, size: int = QUERY_BLOCK) -> Iterator[Queries]:
    """The distinct rows ``queries`` in blocks of about ``size``, dealt out by a hash."""
    n = queries.count()
    blocks = math.ceil(n / size)
    if not blocks:
        return
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    dealt = scratch.write(queries.withColumn("block", block), "queries", by="block") if blocks > 1 else queries
    for b in range(blocks):
        found = dealt.where(F.col("block") == b) if blocks > 1 else dealt
        held = found.orderBy("vec_id", "v").toArrow()
        if held.num_rows:
            yield Queries(b, held["vec_id"].to_numpy(), matrix(held["v"], d), held)


def lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype(float) ** 2).sum(axis=1))


class Best:
    """The ``k`` best rows of each of ``n`` groups: highest score, then smallest id; rows without id last.

    ``kth[g]`` is a score that k rows of group g have been found to reach, or the given lower bound.
    """

    def __init__(self, n: int, k: int, kth: np.ndarray | None = None):
        self.k = k
        self.kth = np.full(n, -np.inf) if kth is None else kth.astype(float).copy()
        self.group = self.score = self.id = np.zeros(0, dtype=np.int64)
        self.none = np.zeros(0, dtype=bool)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        enough = score >= self.kth[group]
        if not enough.any():
            return
        g, s, i, n = (
            np.concatenate([held, new[enough]])
            for held, new in ((self.group, group), (self.score, score), (self.id, ids), (self.none, none))
        )
        order = np.lexsort((i, n, -s, g))
        g, s, i, n = g[order], s[order], i[order], n[order]
        first = np.flatnonzero(np.diff(g, prepend=-1))
        place = np.arange(len(g)) - np.repeat(first, np.diff(first, append=len(g)))
        last = place == self.k - 1
        self.kth[g[last]] = np.maximum(self.kth[g[last]], s[last])
        keep = place < self.k
        self.group, self.score, self.id, self.none = g[keep], s[keep], i[keep], n[keep]

    def arrays(self) -> list[pa.Array]:
        """group, id (null where there is none), score."""
        ids = pa.array(self.id, pa.int64(), mask=self.none)
        return [pa.array(self.group.astype(np.int32)), ids, pa.array(self.score, pa.int64())]
