import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlift.functions import scores


def textbook(a, n, q, p):
    if q == p:
        chisq = 0.0
    elif q == 1 or p == 1:
        chisq = None
    else:
        cells = [n * q, (n - a) * q, n * (1 - q), (n - a) * (1 - q)]
        chisq = (a - n * q) ** 2 * sum(1 / c for c in cells) if all(cells) else None
    if p == q:
        odds = 1.0
    elif p in (0, 1) or q in (0, 1):
        odds = 0.0
    else:
        odds = (1 - q) * p / ((1 - p) * q)
    return chisq, odds, (q < p) - (q > p)


def scored(spark, cells):
    df = spark.createDataFrame(cells, "i int, a bigint, n bigint, q double, p double")
    q, p = F.col("q"), F.col("p")
    return df.select(
        "i",
        scores.chisq(F.col("a"), F.col("n"), q, p),
        scores.odds_ratio(q, p),
        scores.direction(q, p),
    ).orderBy("i").collect()


CASES = {
    "equal": (10, 100, 0.1, 0.1),
    "equal at one": (100, 100, 1.0, 1.0),
    "equal at zero": (0, 100, 0.0, 0.0),
    "cohort has none": (0, 100, 0.2, 0.0),
    "cohort has all": (100, 100, 0.2, 1.0),
    "reference has all": (90, 100, 1.0, 0.9),
    "over": (40, 100, 0.2, 0.4),
    "under": (10, 100, 0.2, 0.1),
    "lab fraction of tested": (7, 34, 0.25, 0.7),
    "empty cohort": (0, 0, 0.3, 0.0),
}


def test_every_branch(spark):
    cells = [(i, *c) for i, c in enumerate(CASES.values())]
    for name, case, row in zip(CASES, CASES.values(), scored(spark, cells), strict=True):
        chisq, odds, direction = textbook(*case)
        assert row[1] == (None if chisq is None else pytest.approx(chisq)), name
        assert row[2] == pytest.approx(odds), name
        assert row[3] == direction, name


def test_known_values(spark):
    row = scored(spark, [(0, 40, 100, 0.2, 0.4)])[0]
    # 20^2 * (1/20 + 1/12 + 1/80 + 1/48) and (0.8 * 0.4) / (0.6 * 0.2)
    assert row[1] == pytest.approx(400 * (1 / 20 + 1 / 12 + 1 / 80 + 1 / 48))
    assert row[2] == pytest.approx(8 / 3)
    assert row[3] == 1


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(0, 50), st.integers(0, 50), st.integers(0, 60), st.integers(0, 60)),
        min_size=20,
        max_size=200,
    )
)
def test_any_counts(spark, drawn):
    cells = []
    for i, (a, rest, r, r_rest) in enumerate(drawn):
        n, m = a + rest, max(r + r_rest, 1)
        cells.append((i, a, n, r / m, a / n if n else 0.0))
    for (_, a, n, q, p), row in zip(cells, scored(spark, cells), strict=True):
        if q == 0 and q != p:
            continue  # such codes are filtered before scoring
        chisq, odds, direction = textbook(a, n, q, p)
        assert (row[1] is None) == (chisq is None)
        if chisq is not None:
            assert math.isclose(row[1], chisq, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(row[2], odds, rel_tol=1e-9)
        assert row[3] == direction
