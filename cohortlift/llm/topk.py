"""Exact top-k inner products: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz bounds.

All vectors are laid out by descending length, in parts. A block of queries meets the parts in waves that grow
eightfold, the longest vectors first, and takes from wave to wave the k-th best score found so far. The search
ends when the longest vector left times the query's length is below it for every query.

Within a part, vectors and queries are rotated by the right singular vectors of all vectors, so that the first
coordinates carry most of the products. Partial sums over them, plus the product of the lengths of what is
left, bound a product from above; pairs whose bound is below the k-th best score are dropped, and the others
are scored by whole numbers. Bounds have a margin for rounding, so nothing is lost.

Defined results: vectors that are null, hold null or non-finite components, or are 2**31 and longer as integers
take no part; shorter vectors than others are filled up with zeros; rows equal in id and vector are one row; rows
that share only the id are rows of their own, each of them a query if its id is divisible by 100; rows without
id are never queries, and come last among equal scores. An empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlift.llm.common import Scratch, table
from cohortlift.llm.vectors import Best, Queries, integer_rows, lengths, matrix, query_blocks, summed

SCALE, TOP = 1024, 10
#: Vectors of a part, and parts at most; beyond it parts get larger, read in batches.
PART_ROWS, MOST_PARTS = 4_096, 4_096
#: Each wave has so many times the parts of all before.
GROWTH = 8
#: Coordinates by which partial sums grow, queries and vectors of a step, and the share of pairs left from which
#: they are scored one by one.
SEGMENT, STEP, SPARSE = 16, 1_024, 0.1
#: Relative margin of the bounds; rounding is a thousand times less.
MARGIN = 1e-9
_HITS = "block int, query int, query_id bigint, vec_id bigint, score bigint"


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """The right singular vectors of all vectors, as columns, the strongest first."""
    squares = summed(rows, d, lambda x: (x.T @ x).ravel()).reshape(d, d)
    return np.linalg.eigh(squares)[1][:, ::-1].copy()


class Rotated:
    """Vectors in rotated coordinates, with the length of what is left after each segment."""

    def __init__(self, v: np.ndarray, turn: np.ndarray):
        d = v.shape[1]
        self.v = v
        self.x = v.astype(float) @ turn
        self.cuts = [*range(0, d, SEGMENT), d] if d else [0]
        tails = np.zeros((len(v), len(self.cuts)))
        for i in range(len(self.cuts) - 2, -1, -1):
            part = self.x[:, self.cuts[i] : self.cuts[i + 1]]
            tails[:, i] = tails[:, i + 1] + (part**2).sum(axis=1)
        self.left = np.sqrt(tails)

    def __len__(self) -> int:
        return len(self.v)


def candidates(q: Rotated, c: Rotated, kth: np.ndarray, rows: slice, cols: slice) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, vector) of the pairs whose bound is not below the query's k-th best score."""
    longest = c.left[cols, 0].max(initial=0)
    floor = kth - MARGIN * q.left[:, 0] * longest
    at = np.arange(len(q))[rows]
    at = at[q.left[at, 0] * longest >= floor[at]]
    partial = np.zeros((len(at), len(range(*cols.indices(len(c))))))
    for i in range(len(q.cuts)):
        if i:
            segment = slice(q.cuts[i - 1], q.cuts[i])
            partial += q.x[at, segment] @ c.x[cols, segment].T
        open_ = partial + q.left[at, i][:, None] * c.left[cols, i] >= floor[at][:, None]
        alive = open_.any(axis=1)
        if not alive.all():
            at, partial, open_ = at[alive], partial[alive], open_[alive]
        if not len(at) or open_.mean() < SPARSE:
            break
    found, where = np.nonzero(open_)
    return at[found], where + (cols.start or 0)


def searched(batches: Iterator[pa.RecordBatch], held: Queries, kth: np.ndarray, turn: np.ndarray, k: int) -> Best:
    """The best vectors of a task for every query of the block, none of a score below ``kth``."""
    d = turn.shape[0]
    q, best = Rotated(held.v, turn), Best(len(held), k, kth)
    for batch in batches:
        c = Rotated(matrix(batch["v"], d), turn)
        none = np.asarray(batch["vec_id"].is_null())
        ids = batch["vec_id"].fill_null(0).to_numpy()
        for a in range(0, len(c), STEP):
            for b in range(0, len(q), STEP):
                i, j = candidates(q, c, best.kth, slice(b, b + STEP), slice(a, min(a + STEP, len(c))))
                own = (held.ids[i] == ids[j]) & ~none[j]
                own[own] = (held.v[i[own]] == c.v[j[own]]).all(axis=1)
                i, j = i[~own], j[~own]
                best.add(i, np.einsum("ij,ij->i", held.v[i], c.v[j]), ids[j], none[j])
    return best


def _wave(parts: DataFrame, held: Queries, kth: np.ndarray, turn: np.ndarray, k: int) -> DataFrame:
    sent = parts.sparkSession.sparkContext.broadcast((held.block, held.ids, held.v, kth, turn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, v, floor, turn = sent.value
        best = searched(batches, Queries(block, ids, v, None), floor, turn, k)
        group, vec_id, score = best.arrays()
        of = pa.array(np.full(len(best.group), block, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [of, group, pa.array(ids[best.group], pa.int64()), vec_id, score],
            names=["block", "query", "query_id", "vec_id", "score"],
        )

    return parts.select("vec_id", "v").mapInArrow(run, _HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best_first = Window.partitionBy("block", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return hits.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


def waves(parts: int) -> list[tuple[int, int]]:
    """Ranges of parts, first and last."""
    out, first, last = [], 0, 0
    while first < parts:
        out.append((first, min(last, parts - 1)))
        first, last = last + 1, (last + 1) * (GROWTH + 1) - 1
    return out


def top_products(
    rows: DataFrame, is_query: Column, k: int, scratch: Scratch, part_rows: int = PART_ROWS, **blocks
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query with other rows.

    ``rows`` are as :func:`integer_rows` gives them; ``is_query`` must not hold for a null id.
    """
    rows = scratch.write(rows, "rows")
    n, d = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    parts = min(MOST_PARTS, max(1, math.ceil(n / part_rows)))
    by_length = rows.repartitionByRange(parts, F.desc("len2"), "vec_id", F.xxhash64("v"))
    laid = scratch.write(
        by_length.sortWithinPartitions(F.desc("len2"), "vec_id").withColumn("part", F.spark_partition_id()),
        "by_length",
        by="part",
    )
    longest = {r["part"]: math.sqrt(r["len2"]) for r in laid.groupBy("part").agg(F.max("len2").alias("len2")).collect()}
    turn = rotation(rows, d) if n and d else np.zeros((d or 0, d or 0))
    for held in query_blocks(rows.where(is_query), d or 0, scratch, **blocks):
        kth = np.full(len(held), -np.inf)
        for first, last in waves(max(longest) + 1):
            reach = lengths(held.v) * max((x for p, x in longest.items() if p >= first), default=0)
            if (reach < kth - MARGIN * reach).all():
                break
            wave = _wave(laid.where(F.col("part").between(first, last)), held, kth, turn, k)
            scratch.write(wave, f"hits/{held.block}/{first}")
            if last < max(longest):
                reached = _ranked(scratch.all(f"hits/{held.block}", _HITS), k).where(F.col("rank") == k).select("query", "score").toArrow()
                kth[reached["query"].to_numpy()] = reached["score"].to_numpy()
    return _ranked(scratch.all("hits", _HITS), k).select("query_id", "rank", "vec_id", "score")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of every hundredth vector with all others."""
    rows = integer_rows(table(spark, sf_dir, "embeddings"), SCALE)
    return top_products(rows, F.col("vec_id") % 100 == 0, TOP, Scratch(spark, "op11"))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 10
"""
