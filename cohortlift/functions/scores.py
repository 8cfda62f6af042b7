"""Over/under-representation scores as Column expressions.

Every function takes the reference fraction ``q`` and the cohort fraction ``p``. The test for equal
fractions comes first in all three, so a code with equal fractions is neutral even at 0 or 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chisq(count: Column, size: Column, q: Column, p: Column) -> Column:
    """Squared gap between observed and expected count over its scale, for a cohort of ``size``.

    The four reciprocal cells ``1/(N q) + 1/((N-a) q) + 1/(N (1-q)) + 1/((N-a)(1-q))`` share the
    factor ``1/(q (1-q))`` and fold to ``(2N - a) / (N (N-a) q (1-q))``. Null where a cell is empty.
    """
    n = size.cast("double")
    a = count.cast("double")
    gap = a - n * q
    cells = n * (n - a) * q * (1 - q)
    return (
        F.when(q == p, F.lit(0.0))
        .when((q == 1) | (p == 1), F.lit(None).cast("double"))
        .otherwise(gap * gap * (2 * n - a) / F.nullif(cells, F.lit(0.0)))
    )


def odds_ratio(q: Column, p: Column) -> Column:
    """Odds in the cohort over odds in the reference; 0 where either side has no odds."""
    return (
        F.when(p == q, F.lit(1.0))
        .when(p.isin(0.0, 1.0) | q.isin(0.0, 1.0), F.lit(0.0))
        .otherwise((1 - q) * p / ((1 - p) * q))
    )


def direction(q: Column, p: Column) -> Column:
    """1 over-represented, -1 under-represented, 0 equal."""
    return F.when(q == p, F.lit(0)).when(q < p, F.lit(1)).otherwise(F.lit(-1))
