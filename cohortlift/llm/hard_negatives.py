"""Hard negatives by an R-tree, packed by sort-tile-recursion over all vectors.

Tiles: vectors are cut into slabs by the coordinate that varies most, and each slab into tiles by the next one;
ties are cut by id, so that no tile grows with a common vector. A task packs the rows of its tile into a tree in the
same way by further coordinates. A node's minimum bounding box gives the interval of the inner products of a query
with its vectors, coordinate by coordinate.

Searches: a block of anchors goes to the tasks. Each anchor first looks into the tile with the highest upper end
(of the boxes of all tiles), then into all others that its k-th best score so far does not exclude. Within a tree a
queue yields the box with the highest upper end; boxes strictly below the k-th best score, and boxes outside all
score windows, are left out. Positives are found first; their scores make the windows of the negatives.

Defined results: rows whose label or vector is null, with null or non-finite components, or with a vector of
2**31 and more as integers, take no part; shorter vectors are filled up with zeros; rows equal in id, label and
vector are one row, rows that share only the id are rows of their own; rows without id are never anchors, and come
last among equal scores. An empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlift.llm.common import Scratch, table
from cohortlift.llm.vectors import Queries, integer_rows, lengths, matrix, query_blocks, summed

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative has at least so many hundredths of the positive's score, and no more than it.
LEAST_SHARE = 80
#: Vectors of a tile, and tiles at most; beyond it tiles get larger, read as several trees.
TILE_ROWS, MOST_TILES = 8_192, 1_024
#: Vectors of a tree, of a leaf, and children of a node.
TREE_ROWS, LEAF, FANOUT = 16_384, 128, 8
#: Coordinates by which a tree is packed, at most.
LEVELS = 4
MARGIN = 1e-9
_HITS = "block int, query int, anchor_id bigint, high bigint, vec_id bigint, score bigint"
_BOX = "tile int, low array<bigint>, high array<bigint>"


def str_order(v: np.ndarray, by: list[int], leaf: int) -> np.ndarray:
    """An order in which every ``leaf`` rows are a tile: sort by a coordinate, cut into slabs, go on in each."""
    if len(v) <= leaf or not by:
        return np.arange(len(v))
    order = np.argsort(v[:, by[0]], kind="stable")
    leaves = math.ceil(len(v) / leaf)
    slab = leaf * math.ceil(leaves / math.ceil(leaves ** (1 / len(by))))
    if len(by) == 1 or slab >= len(v):
        return order
    cuts = range(0, len(v), slab)
    return np.concatenate([order[a : a + slab][str_order(v[order[a : a + slab]], by[1:], leaf)] for a in cuts])


class Tree:
    """Boxes over vectors: ``low`` and ``high`` of each node, leaves first, the root last."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, labels: np.ndarray, v: np.ndarray, by: list[int]):
        order = str_order(v, by, LEAF)
        self.ids, self.none, self.labels, self.v = ids[order], none[order], labels[order], v[order]
        starts = np.arange(0, len(v), LEAF)
        low = [np.minimum.reduceat(self.v, starts, axis=0)]
        high = [np.maximum.reduceat(self.v, starts, axis=0)]
        self.leaves, at = len(starts), 0
        self.children: list[range | None] = [None] * self.leaves
        while len(low[-1]) > 1:
            starts = np.arange(0, len(low[-1]), FANOUT)
            self.children += [range(at + s, at + min(s + FANOUT, len(low[-1]))) for s in starts.tolist()]
            at += len(low[-1])
            low.append(np.minimum.reduceat(low[-1], starts, axis=0))
            high.append(np.maximum.reduceat(high[-1], starts, axis=0))
        self.low, self.high = np.concatenate(low).astype(float), np.concatenate(high).astype(float)
        self.x, self.longest = self.v.astype(float), lengths(self.v).max(initial=0)

    def scores(self, rows: slice, q: np.ndarray) -> np.ndarray:
        """Inner products with the rows of a leaf: by floating point where all its sums are whole and exact."""
        if self.longest * math.sqrt(float((q.astype(float) ** 2).sum())) < 2.0**52:
            return (self.x[rows] @ q).astype(np.int64)
        return self.v[rows] @ q

    def rows(self, leaf: int) -> slice:
        return slice(leaf * LEAF, min((leaf + 1) * LEAF, len(self.v)))


def intervals(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query with any vector of each box."""
    up, down = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    least, greatest = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    slack = MARGIN * (up @ np.abs(high).T + up @ np.abs(low).T - down @ np.abs(high).T - down @ np.abs(low).T)
    return least - slack, greatest + slack


class ScoreWindow:
    """The ``k`` best rows of an anchor with scores from ``low`` to ``high``; ``kth`` is what a row must reach."""

    def __init__(self, k: int, low: float, high: float):
        self.k, self.low, self.high, self.kth = k, low, high, low
        self.found: list[tuple[int, bool, int]] = []

    def open(self, least: float, greatest: float) -> bool:
        return greatest >= self.kth and least <= self.high

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        for i in np.flatnonzero((scores >= self.kth) & (scores <= self.high)).tolist():
            insort(self.found, (-int(scores[i]), bool(none[i]), int(ids[i])))
            if len(self.found) > self.k:
                self.found.pop()
            if len(self.found) == self.k:
                self.kth = -self.found[-1][0]


def best_first(
    tree: Tree, q: np.ndarray, least: np.ndarray, greatest: np.ndarray, windows: list, wanted: Callable
) -> int:
    """Fill the windows of one anchor from a tree; gives the number of leaves that were opened.

    ``wanted(rows)`` tells which rows of a leaf are positives or negatives of the anchor.
    """
    root, opened = len(tree.children) - 1, 0
    queue = [(-greatest[root], root)]
    while queue:
        upper, node = heapq.heappop(queue)
        if all(-upper < w.kth for w in windows):
            break
        if not any(w.open(least[node], greatest[node]) for w in windows):
            continue
        if tree.children[node] is None:
            rows = tree.rows(node)
            opened += 1
            scores = tree.scores(rows, q)
            inside = (scores >= min(w.kth for w in windows)) & (scores <= max(w.high for w in windows))
            take = np.flatnonzero(inside & wanted(rows))
            if len(take):
                scores, take = scores[take], take + rows.start
                for w in windows:
                    w.add(scores, tree.ids[take], tree.none[take])
        else:
            for child in tree.children[node]:
                if any(w.open(least[child], greatest[child]) for w in windows):
                    heapq.heappush(queue, (-greatest[child], child))
    return opened


def _trees(batches: Iterator[pa.RecordBatch], by: list[int], d: int) -> Iterator[tuple[int, Tree]]:
    """The trees of a task's tiles, of a bounded number of rows each."""
    held: list[pa.RecordBatch] = []

    def tree() -> tuple[int, Tree]:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        none = t["vec_id"].is_null().to_numpy()
        ids, labels = t["vec_id"].fill_null(0).to_numpy(), t["label"].to_numpy()
        return t["tile"][0].as_py(), Tree(ids, none, labels, matrix(t["v"], d), by)

    for batch in batches:
        tiles = batch["tile"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(tiles)) + 1).tolist(), len(tiles)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for c in range(a, b, TREE_ROWS):
                part = batch.slice(c, min(TREE_ROWS, b - c))
                if held and (
                    held[0]["tile"][0] != part["tile"][0] or sum(map(len, held)) + len(part) > TREE_ROWS
                ):
                    yield tree()
                held.append(part)
    if held:
        yield tree()


class Mining:
    """Anchors of one block against all tiles."""

    def __init__(self, tiles: DataFrame, by: list[int], d: int, boxes: dict[int, tuple], held: Queries, scratch: Scratch):
        self.tiles, self.by, self.d, self.held, self.scratch = tiles, by, d, held, scratch
        self.labels = held.table["label"].to_numpy()
        self.numbers = sorted(boxes)
        low, high = (np.array([boxes[t][i] for t in self.numbers], dtype=float) for i in (0, 1))
        self.least, self.greatest = intervals(held.v, low, high)

    def search(self, windows: list[list[tuple[float, float]]], same: bool, k: int, name: str) -> DataFrame:
        """Hits of every window (low, high) of every anchor: the best tile first, then all that are left."""
        place = np.argmax(self.greatest, axis=1)
        some = np.array([len(w) > 0 for w in windows])
        near = np.zeros(self.greatest.shape, dtype=bool)
        near[np.arange(len(place))[some], place[some]] = True
        lowest = np.array([min((a for a, _ in w), default=np.inf) for w in windows])
        highest = np.array([max((b for _, b in w), default=-np.inf) for w in windows])
        reach = (self.greatest >= lowest[:, None]) & (self.least <= highest[:, None])
        first = self._wave(near & reach, windows, same, k, f"{name}/{self.held.block}/first")
        best = _ranked(first, k).where(F.col("rank") == k).select("query", "high", "score").toArrow().to_pydict()
        kth = {(q, h): s for q, h, s in zip(best["query"], best["high"], best["score"], strict=True)}
        windows = [
            [(max(low, kth.get((q, _as_long(high)), low)), high) for low, high in w] for q, w in enumerate(windows)
        ]
        lowest = np.array([min((a for a, _ in w), default=np.inf) for w in windows])
        rest = reach & ~near & (self.greatest >= lowest[:, None])
        self._wave(rest, windows, same, k, f"{name}/{self.held.block}/rest")
        return self.scratch.all(f"{name}/{self.held.block}", _HITS)

    def _wave(self, where: np.ndarray, windows: list, same: bool, k: int, name: str) -> DataFrame:
        anchors = {t: np.flatnonzero(where[:, i]) for i, t in enumerate(self.numbers) if where[:, i].any()}
        held = self.held
        sent = self.tiles.sparkSession.sparkContext.broadcast(
            (held.block, held.ids, held.v, self.labels, windows, anchors, self.by, self.d)
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, ids, v, labels, windows, anchors, by, d = sent.value
            for tile, tree in _trees(batches, by, d):
                at = anchors.get(tile, [])
                if not len(at):
                    continue
                least, greatest = intervals(v[at], tree.low, tree.high)
                out = []
                for i, a in enumerate(at.tolist()):
                    found = [ScoreWindow(k, low, high) for low, high in windows[a]]
                    best_first(tree, v[a], least[i], greatest[i], found, _wanted(tree, ids[a], labels[a], v[a], same))
                    for w in found:
                        out += [(a, _as_long(w.high), None if none else i, -s) for s, none, i in w.found]
                query, high, vec_id, score = zip(*out, strict=True) if out else ((), (), (), ())
                at = np.array(query, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), block, dtype=np.int32)),
                        pa.array(at),
                        pa.array(ids[at], pa.int64()),
                        *(pa.array(x, pa.int64()) for x in (high, vec_id, score)),
                    ],
                    names=["block", "query", "anchor_id", "high", "vec_id", "score"],
                )

        tiles = self.tiles.where(F.col("tile").isin(sorted(anchors))) if anchors else self.tiles.limit(0)
        return self.scratch.write(tiles.mapInArrow(run, _HITS), name)


def _as_long(high: float) -> int:
    return int(min(high, 2.0**62))


def _wanted(tree: Tree, anchor: int, label: int, v: np.ndarray, same: bool) -> Callable:
    if not same:
        return lambda rows: tree.labels[rows] != label

    def positives(rows: slice) -> np.ndarray:
        take = tree.labels[rows] == label
        own = take & (tree.ids[rows] == anchor) & ~tree.none[rows]
        own[own] = (tree.v[rows][own] == v).all(axis=1)
        return take & ~own

    return positives


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best_first_ = Window.partitionBy("block", "query", "high").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return hits.withColumn("rank", F.row_number().over(best_first_)).where(F.col("rank") <= k)


def packed_tiles(rows: DataFrame, d: int, scratch: Scratch, tile_rows: int) -> tuple[DataFrame, list[int], dict]:
    """The rows in tiles, the coordinates by spread, and the box of each tile."""
    n = rows.count()
    sums = summed(rows, d, lambda x: np.concatenate([x.sum(axis=0), (x**2).sum(axis=0)])) if n and d else np.zeros(0)
    spread = sums[d:] / max(n, 1) - (sums[:d] / max(n, 1)) ** 2
    by = np.argsort(-spread, kind="stable").tolist()
    tiles = min(MOST_TILES, max(1, math.ceil(n / tile_rows)))
    slabs = math.ceil(math.sqrt(tiles))
    coordinate = [F.coalesce(F.get("v", F.lit(i)), F.lit(0).cast("bigint")) for i in by[:2]]
    coordinate += [F.lit(0).cast("bigint")] * (2 - len(coordinate))
    shares = [i / slabs for i in range(1, slabs)]
    ends = rows.agg(F.percentile_approx(coordinate[0], shares)).first()[0] if shares else []
    slab = F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end <= coordinate[0])) if ends else F.lit(0)
    keyed = rows.withColumns({"slab": slab, "along": coordinate[1]})
    cut = keyed.repartitionByRange(tiles, "slab", "along", "vec_id", F.xxhash64("v"))
    laid = scratch.write(
        cut.sortWithinPartitions("slab", "along").select("vec_id", "label", "v", F.spark_partition_id().alias("tile")),
        "tiles",
        by="tile",
    )

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile, v = batch["tile"].to_numpy(), matrix(batch["v"], d)
            starts = np.flatnonzero(np.diff(tile, prepend=-1))
            low, high = (f.reduceat(v, starts, axis=0).tolist() for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tile[starts], pa.int32()), pa.array(low, pa.list_(pa.int64())), pa.array(high, pa.list_(pa.int64()))],
                names=["tile", "low", "high"],
            )

    def over(f, name: str) -> Column:
        return F.array(*[f(F.get(name, F.lit(i))) for i in range(d)]).alias(name)

    boxes = laid.select("tile", "v").mapInArrow(bounds, _BOX).groupBy("tile").agg(over(F.min, "low"), over(F.max, "high"))
    return laid, by[:LEVELS], {r["tile"]: (r["low"], r["high"]) for r in boxes.collect()}


def mined(
    rows: DataFrame, is_anchor: Column, positives: int, negatives: int, scratch: Scratch,
    tile_rows: int = TILE_ROWS, **blocks,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every anchor.

    ``rows`` are as :func:`integer_rows` gives them, with a ``label``.
    """
    rows = scratch.write(rows, "rows")
    d = rows.agg(F.max(F.size("v"))).first()[0] or 0
    tiles, by, boxes = packed_tiles(rows, d, scratch, tile_rows)
    for held in query_blocks(rows.where(is_anchor), d, scratch, **blocks):
        mining = Mining(tiles, by, d, boxes, held, scratch)
        everything = [[(-np.inf, np.inf)]] * len(held)
        found = mining.search(everything, True, positives, "positives")
        scores = _ranked(found, positives).select("query", "score").distinct().toArrow().to_pydict()
        windows: list[list[tuple[float, float]]] = [[] for _ in range(len(held))]
        for q, score in zip(scores["query"], scores["score"], strict=True):
            low = -(-LEAST_SHARE * score // 100)
            if low <= score:
                windows[q].append((low, score))
        mining.search(windows, False, negatives, "negatives")
    p = _ranked(scratch.all("positives", _HITS), positives).select(
        "block", "query", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    n = _ranked(scratch.all("negatives", _HITS), negatives).select(
        "block", "query", F.col("high").alias("positive_score"), "rank",
        F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    return p.join(n, ["block", "query", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, in windows below the scores of its five best positives."""
    label = F.col("label").cast("bigint")
    moved = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (label + 1) % 10).otherwise(label)
    rows = integer_rows(table(spark, sf_dir, "embeddings"), SCALE, moved.alias("label")).where("label is not null")
    return mined(rows, F.col("vec_id") % 100 == 0, POSITIVES, NEGATIVES, Scratch(spark, "op13"))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
),
negatives AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS place
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE place <= 5
"""
