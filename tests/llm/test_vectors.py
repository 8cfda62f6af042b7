"""Top-k products and hard negatives, against brute force over all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlift.llm import hard_negatives, registry, topk
from cohortlift.llm.common import Scratch
from cohortlift.llm.vectors import Best, integer_rows
from tests.oracle_check import differences, run_sql

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, rank string"
NONE, INF, NAN = None, math.inf, math.nan

#: Nulls, vectors that take no part, ties, repeated rows, one id with two vectors, unequal and no components.
ODD = [
    (0, [0.5, -0.25], 1, 0.0, "x"),
    (0, [0.5, -0.25], 1, 0.0, "x"),
    (100, [0.5, -0.25], 2, None, None),
    (100, [-0.5, 0.75], 2, None, None),
    (7, [0.5, -0.25], 0, None, None),
    (None, [0.5, -0.25], 0, None, None),
    (None, [0.5, -0.25], 1, None, None),
    (-200, [0.25], 1, None, None),
    (3, [], 1, None, None),
    (4, None, 1, None, None),
    (5, [0.5, NONE], 1, None, None),
    (6, [0.5, NAN], 1, None, None),
    (8, [INF, 0.5], 1, None, None),
    (9, [3e38, 0.5], 1, None, None),
    (11, [0.0, 0.0], 2, None, None),
    (12, [1.0, 1.0], None, None, None),
    (13, [2e6, -2e6], 1, None, None),
    (14, [-2e6, 2e6], 2, None, None),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def whole(x, scale):
    """The integer components, or None for a vector that takes no part."""
    if x is None or any(c is None or not math.isfinite(c) for c in x):
        return None
    v = tuple(math.floor(scale * float(np.float32(c))) for c in x)
    return None if sum(c * c for c in v) >= 2**62 else v


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def clustered(n, d, seed):
    """Vectors around a few centres, of unlike lengths, many of them equal."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    x = centres[rng.integers(6, size=n)] * rng.lognormal(sigma=0.7, size=(n, 1)) + rng.normal(size=(n, d)) * 0.2
    x[n // 2 : n // 2 + n // 5] = x[0]
    return [(i, [float(c) for c in x[i]], int(rng.integers(4)), 0.0, "x") for i in range(n)]


def brute_top(rows, k):
    found = {(i, v) for i, x, *_ in rows if (v := whole(x, topk.SCALE)) is not None}
    out = []
    for q in found:
        if q[0] is not None and q[0] % 100 == 0:
            scored = [(-product(q[1], c[1]), c[0] is None, c[0] or 0, c[0]) for c in found if c != q]
            out += [(q[0], place, c[3], -c[0]) for place, c in enumerate(sorted(scored, key=lambda c: c[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("part_rows, size", [(4_096, 16_384), (20, 3), (150, 1)])
def test_top_products_equal_brute_force(spark, part_rows, size):
    rows = ODD if part_rows == 4_096 else clustered(700, 37, part_rows)
    ints = integer_rows(frame(spark, rows), topk.SCALE)
    found = topk.top_products(ints, F.col("vec_id") % 100 == 0, 4, Scratch(spark, "t"), part_rows, size=size)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_top(rows, 4)


def test_no_vectors_and_no_queries(spark):
    for rows in ([], [(1, [1.0], 0, 0.0, "x")], [(100, None, 0, 0.0, "x")]):
        ints = integer_rows(frame(spark, rows), topk.SCALE)
        assert topk.top_products(ints, F.col("vec_id") % 100 == 0, 4, Scratch(spark, "t")).count() == 0


def test_rotation_keeps_products_and_sorts_by_strength(spark):
    rows = integer_rows(frame(spark, clustered(300, 40, 1)), topk.SCALE)
    turn = topk.rotation(rows, 40)
    v = np.array([r["v"] for r in rows.collect()], dtype=float)
    strength = ((v @ turn) ** 2).sum(axis=0)
    assert (np.diff(strength) <= 1e-6 * strength[0]).all()
    assert np.allclose((v @ turn) @ (v @ turn).T, v @ v.T)


def test_bounds_drop_most_pairs_and_lose_none():
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(size=(600, 48)) * np.geomspace(900, 1, 48)).astype(np.int64)
    turn = np.linalg.eigh((v.T @ v).astype(float))[1][:, ::-1].copy()
    q, c = topk.Rotated(v[:50], turn), topk.Rotated(v, turn)
    products = v[:50] @ v.T
    kth = np.sort(products, axis=1)[:, -10].astype(float)
    i, j = topk.candidates(q, c, kth, slice(0, 50), slice(0, 600))
    wanted = set(zip(*np.nonzero(products >= kth[:, None]), strict=True))
    assert wanted <= set(zip(i, j, strict=True)) and len(i) < 0.1 * products.size
    # A query too short to reach its bound with the longest vector is not looked at.
    i, _ = topk.candidates(q, c, np.full(50, 1e15), slice(0, 50), slice(0, 600))
    assert not len(i)


def test_waves_cover_all_parts_once():
    for parts in (1, 2, 9, 10, 300):
        covered = [p for first, last in topk.waves(parts) for p in range(first, last + 1)]
        assert covered == list(range(parts))


def test_best_keeps_ties_by_id():
    rng, best = random.Random(3), Best(3, 4)
    rows = [(rng.randrange(3), rng.randrange(5), rng.randrange(1000), rng.random() < 0.1) for _ in range(500)]
    for a in range(0, 500, 37):
        g, s, i, n = (np.array(x) for x in zip(*rows[a : a + 37], strict=True))
        best.add(g, s, i, n)
    found = sorted(zip(best.group, -best.score, best.none, best.id, strict=True))
    want = sorted((g, -s, n, i) for g, s, i, n in rows)
    assert found == [r for g in range(3) for r in [w for w in want if w[0] == g][:4]]


def brute_mined(rows, k, m):
    found = {(i, v, l) for i, x, l, *_ in rows if l is not None and (v := whole(x, hard_negatives.SCALE)) is not None}
    out = []
    for a in found:
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted(((-product(a[1], c[1]), c[0] is None, c[0] or 0, c) for c in found if c != a), key=lambda c: c[:3])
        for s, _, _, p in [c for c in scored if c[3][2] == a[2]][:k]:
            inside = [n for n in scored if n[3][2] != a[2] and 80 * -s <= 100 * -n[0] <= 100 * -s]
            out += [(a[0], p[0], place, n[3][0], -s, -n[0]) for place, n in enumerate(inside[:m], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("tile_rows, size", [(8_192, 16_384), (20, 3), (150, 1), (60, 100)])
def test_hard_negatives_equal_brute_force(spark, tile_rows, size):
    rows = ODD if tile_rows == 8_192 else clustered(700, 7 if tile_rows == 60 else 23, tile_rows)
    ints = integer_rows(frame(spark, rows), hard_negatives.SCALE, F.col("label").cast("bigint").alias("label"))
    ints = ints.where("label is not null")
    found = hard_negatives.mined(ints, F.col("vec_id") % 100 == 0, 4, 3, Scratch(spark, "t"), tile_rows, size=size)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_mined(rows, 4, 3)


def test_no_vectors_and_no_anchors(spark):
    for rows in ([], [(1, [1.0], 0, 0.0, "x")], [(100, [1.0], None, 0.0, "x")]):
        ints = integer_rows(frame(spark, rows), 256, F.col("label").cast("bigint").alias("label"))
        found = hard_negatives.mined(ints.where("label is not null"), F.col("vec_id") % 100 == 0, 4, 3, Scratch(spark, "t"))
        assert found.count() == 0


def test_boxes_hold_their_rows_and_bound_their_products():
    rng = np.random.default_rng(4)
    v = rng.integers(-300, 300, size=(3_000, 6))
    tree = hard_negatives.Tree(np.arange(3_000), np.zeros(3_000, bool), np.zeros(3_000), v, [0, 1, 2, 3])
    assert sorted(map(tuple, tree.v.tolist())) == sorted(map(tuple, v.tolist()))
    q = rng.integers(-300, 300, size=(20, 6))
    least, greatest = hard_negatives.intervals(q, tree.low, tree.high)

    def check(node):
        if tree.children[node] is None:
            rows = tree.rows(node)
        else:
            parts = [check(c) for c in tree.children[node]]
            rows = slice(parts[0].start, parts[-1].stop)
        products = tree.v[rows] @ q.T
        assert (products.min(axis=0) >= least[:, node]).all() and (products.max(axis=0) <= greatest[:, node]).all()
        return rows

    assert check(len(tree.children) - 1) == slice(0, 3_000)
    # Packed boxes are much smaller than those of rows in any order.
    loose = hard_negatives.Tree(np.arange(3_000), np.zeros(3_000, bool), np.zeros(3_000), v, [])
    size = lambda t: (t.high - t.low)[: t.leaves].sum()
    assert size(tree) < 0.7 * size(loose)


def test_queue_opens_few_leaves(monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 32)
    rng = np.random.default_rng(5)
    v = rng.integers(-300, 300, size=(20_000, 3))
    tree = hard_negatives.Tree(np.arange(20_000), np.zeros(20_000, bool), np.zeros(20_000), v, [0, 1, 2])
    q = np.array([200, -100, 50])
    least, greatest = hard_negatives.intervals(q[None], tree.low, tree.high)
    for low, high in ((-np.inf, np.inf), (10_000, 20_000)):
        window = hard_negatives.ScoreWindow(5, low, high)
        every = lambda rows: np.ones(rows.stop - rows.start, dtype=bool)
        opened = hard_negatives.best_first(tree, q, least[0], greatest[0], [window], every)
        want = sorted((-s, i) for i, s in enumerate((v @ q).tolist()) if low <= s <= high)[:5]
        assert [(s, i) for s, _, i in window.found] == want
        assert opened < 0.25 * tree.leaves


def test_op13_equals_its_sql(spark):
    for data in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        columns, rows = run_sql(data, registry.oracle_sql()["op13_hard_negatives"])
        found = registry.queries()["op13_hard_negatives"](spark, data)
        assert differences(found, columns, rows) == ""
        assert found.count() > 0 and dict(found.dtypes)["rank"] == "int"


def test_op11_equals_its_sql(spark):
    for data in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        columns, rows = run_sql(data, registry.oracle_sql()["op11_topk"])
        found = registry.queries()["op11_topk"](spark, data)
        assert differences(found, columns, rows) == ""
        assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
