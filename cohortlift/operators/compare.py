"""Scoring, filtering and two-sided ranking of a cohort against a reference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlift.functions import codes, scores
from cohortlift.functions.codes import TOTAL

ALL = "ALL"
RESULT_COLUMNS = [
    "prefix", "ccd", "name", "ref", "frc_ref", "test", "frc_test", "chisq", "odds_ratio", "dir",
]
RANKINGS = ("odds_ratio", "chisq")


def wanted_patterns(patterns: list[str] | str | None) -> list[str]:
    """The patterns without repeats; none if every domain is wanted."""
    wanted = {patterns} if isinstance(patterns, str) else set(patterns or [])
    return [] if ALL in wanted else sorted(wanted)


def scheme_filter(schemes: DataFrame, patterns: list[str] | str | None = None) -> DataFrame:
    """Names (``c_name``) of the domains whose key starts with one of ``patterns``.

    No pattern, or ``ALL`` among them, keeps every domain. ``%`` and ``_`` are wildcards.
    """
    wanted = wanted_patterns(patterns)
    if wanted:
        hits = [codes.like(F.col("c_key"), p + "%") for p in wanted]
        schemes = schemes.where(reduce(lambda a, b: a | b, hits))
    return schemes.select("c_name").distinct()


def domain_list(schemes: DataFrame) -> DataFrame:
    return schemes.select(
        F.col("c_name").alias("name"), F.col("c_description").alias("description")
    ).orderBy("name", "description")


def concept_scores(
    population: DataFrame,
    test: DataFrame,
    reference: DataFrame | None = None,
    cutoff: float | None = None,
    size: int | None = None,
) -> DataFrame:
    """Score every code of one cohort's ``(ccd, cnt, frc)`` against the population or a cohort.

    Codes absent from the reference are left out, and codes (``TOTAL`` too) with a reference
    count below ``cutoff``. The cohort's ``size`` is read from its ``TOTAL`` row if not given.
    """
    if size is None:
        n = test.where(F.col("ccd") == TOTAL).select("cnt").scalar()
    else:
        n = F.lit(size)
    rows = test.select("ccd", F.col("cnt").alias("test"), F.col("frc").alias("frc_test"))
    base = _base(population, reference, cutoff).join(rows, "ccd", "left")
    return _scored(base, n).select(*RESULT_COLUMNS)


def scores_of_many(
    population: DataFrame,
    counts: DataFrame,
    sizes: dict[str, int],
    reference: DataFrame | None = None,
    cutoff: float | None = None,
) -> DataFrame:
    """:func:`concept_scores` of several cohorts, with their ``cohort_id``, from their ``(cohort_id, ccd, cnt, frc)``."""
    named = [F.struct(F.lit(c).alias("cohort_id"), F.lit(n).cast("bigint").alias("_n")) for c, n in sizes.items()]
    base = _base(population, reference, cutoff).select("*", F.inline(F.array(*named)))
    rows = counts.select("cohort_id", "ccd", F.col("cnt").alias("test"), F.col("frc").alias("frc_test"))
    return _scored(base.join(rows, ["cohort_id", "ccd"], "left"), F.col("_n")).select("cohort_id", *RESULT_COLUMNS)


def _base(population: DataFrame, reference: DataFrame | None, cutoff: float | None) -> DataFrame:
    """Codes with their count and fraction in the reference."""
    if reference is None:
        base = population.withColumnsRenamed({"total": "ref", "frc_total": "frc_ref"})
    else:
        base = population.select("prefix", "ccd", "name").join(
            reference.select("ccd", F.col("cnt").alias("ref"), F.col("frc").alias("frc_ref")), "ccd"
        )
    base = base.where("frc_ref > 0")
    return base if cutoff is None else base.where(F.col("ref") >= cutoff)


def _scored(base: DataFrame, n: Column) -> DataFrame:
    q, p = F.col("frc_ref"), F.col("frc_test")
    return base.withColumns(
        {
            # Stored counts are positive; a code without one has no patient in the cohort.
            "test": F.coalesce("test", F.lit(0).cast("bigint")),
            "frc_test": F.coalesce("frc_test", F.lit(0.0)),
        }
    ).withColumns(
        {
            "chisq": scores.chisq(F.col("test"), n, q, p),
            "odds_ratio": scores.odds_ratio(q, p),
            "dir": scores.direction(q, p),
        }
    )


def compare(
    scored: DataFrame,
    schemes: DataFrame,
    limit: int | None = None,
    patterns: list[str] | str | None = None,
    rank_by: str = "odds_ratio",
) -> DataFrame:
    """The ``TOTAL`` row, then the codes of the wanted domains from most over- to most under-represented.

    ``limit`` keeps that many codes of either end: two top-k sorts, and no global window. ``rank_by``
    is ``odds_ratio`` or ``chisq`` (signed by direction). Ties are ordered by code.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    total, codes_ = _parts(scored, schemes, patterns)
    if limit is None:
        return total.unionByName(codes_).orderBy(*result_order(rank_by))
    over = codes_.orderBy(*rank_order(rank_by)).limit(limit)
    under = codes_.orderBy(*rank_order(rank_by, most_over_first=False)).limit(limit)
    both = over.union(under).distinct()
    return total.unionByName(both).orderBy(*result_order(rank_by)).limit(2 * limit + 1)


def compare_many(
    scored: DataFrame,
    schemes: DataFrame,
    limit: int | None = None,
    patterns: list[str] | str | None = None,
    rank_by: str = "odds_ratio",
) -> DataFrame:
    """:func:`compare` for every ``cohort_id`` of ``scored``, in one plan; rows of a cohort are in its order.

    Each task keeps ``limit`` rows of a cohort and end, before these few are shuffled by cohort. (Spark does so up to
    1,000 rows, ``spark.sql.optimizer.windowGroupLimitThreshold``; a larger limit sorts a cohort's codes.)
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    total, codes_ = _parts(scored, schemes, patterns, limit=None)
    if limit is not None:
        ends = []
        for most_over_first in (True, False):
            best = Window.partitionBy("cohort_id").orderBy(*rank_order(rank_by, most_over_first))
            ends.append(codes_.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= limit))
        codes_ = ends[0].union(ends[1]).drop("_rank").distinct()
    return total.unionByName(codes_).orderBy("cohort_id", *result_order(rank_by))


def _parts(
    scored: DataFrame, schemes: DataFrame, patterns: list[str] | str | None, limit: int | None = 1
) -> tuple[DataFrame, DataFrame]:
    """The ``TOTAL`` row, or rows, and the codes of the wanted domains."""
    is_total = F.col("ccd") == TOTAL
    total = scored.where(is_total)
    codes_ = scored.where(~is_total & F.col("prefix").isNotNull())
    if wanted_patterns(patterns):
        allowed = scheme_filter(schemes, patterns).withColumnRenamed("c_name", "prefix")
        codes_ = codes_.join(allowed, "prefix", "left_semi").select(*scored.columns)
    return (total.limit(limit) if limit else total), codes_


def placed(result: DataFrame, rank_by: str = "odds_ratio") -> DataFrame:
    """A limited comparison with the ``place`` of each row; for reports, as one task numbers all rows."""
    return result.withColumn("place", F.row_number().over(Window.orderBy(*result_order(rank_by))))


def rank_order(rank_by: str = "odds_ratio", most_over_first: bool = True) -> list[Column]:
    """Sort keys from one end of the ranking. Unscored codes count as most over-represented."""
    if rank_by not in RANKINGS:
        raise ValueError(f"rank_by must be one of {RANKINGS}, not {rank_by!r}")
    key = F.col("odds_ratio") if rank_by == "odds_ratio" else F.col("chisq") * F.col("dir")
    side = key.desc_nulls_first() if most_over_first else key.asc_nulls_last()
    return [side, F.col("ccd").asc()]


def result_order(rank_by: str = "odds_ratio") -> list[Column]:
    """Sort keys of a whole result: the ``TOTAL`` row first."""
    return [(F.col("ccd") == TOTAL).desc(), *rank_order(rank_by)]


def parse_limit(value: str | int | None) -> int | None:
    """A row limit given as a number, digits, or ``ALL`` / nothing for no limit."""
    if value is None or (isinstance(value, str) and value.upper() == ALL):
        return None
    if isinstance(value, int) or value.isdigit():
        return int(value)
    raise ValueError(f"limit must be a whole number or {ALL}, not {value!r}")
