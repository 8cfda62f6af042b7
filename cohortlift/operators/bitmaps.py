"""Cohort counts by bitmaps: for each code and range of 64 patient numbers a word, cohorts likewise, AND and bit count.

Patients get dense numbers inside the hash bucket of the pairs that they are in, so that the words of a code are as
few as its patients allow. Only codes that fill their words are kept so; a rare code would have about a word for each
of its pairs. The pairs of rare codes are counted as pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patients of a word.
WIDTH = 64
#: A code is common if its words hold so many patients on average, were its patients spread evenly.
LEAST_PER_WORD = 4
_WORDS_PER_BUCKET = 1 << 40


def numbered(active: DataFrame, buckets: int) -> DataFrame:
    """``pn, word, bit``: the place of every active patient, dense within its bucket."""
    bucket = F.pmod(F.hash("pn"), F.lit(buckets))
    at = F.row_number().over(Window.partitionBy("_bucket").orderBy("pn")) - 1
    return (
        active.withColumn("_bucket", bucket)
        .withColumn("_at", at)
        .select(
            "pn",
            (F.col("_bucket") * F.lit(_WORDS_PER_BUCKET) + (F.col("_at") / WIDTH).cast("bigint")).alias("word"),
            F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_at") % WIDTH).alias("bit"),
        )
    )


def common_codes(totals: DataFrame, n_active: int, least_per_word: float = LEAST_PER_WORD) -> DataFrame:
    """``ccd`` of the codes whose words are worth while."""
    return totals.where(F.col("total") >= least_per_word * n_active / WIDTH).select("ccd")


def code_words(pairs: DataFrame, numbers: DataFrame, common: DataFrame) -> DataFrame:
    """``word, ccd, bits`` of the common codes."""
    return _words(pairs.join(common, "ccd", "left_semi").join(numbers, "pn"), "word", "ccd")


def cohort_words(members: DataFrame, numbers: DataFrame) -> DataFrame:
    """``cohort_id, word, bits`` of distinct ``(cohort_id, pn)``."""
    return _words(members.join(numbers, "pn"), "cohort_id", "word")


def _words(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.bit_or("bit").alias("bits"))


def word_hits(words: DataFrame, cohorts: DataFrame) -> DataFrame:
    """``cohort_id, ccd, cnt`` of the common codes, from words of codes and cohorts."""
    both: Column = F.bit_count(words["bits"].bitwiseAND(cohorts["bits"]))
    return (
        words.join(cohorts, "word")
        .select("cohort_id", "ccd", both.cast("bigint").alias("n"))
        .groupBy("cohort_id", "ccd")
        .agg(F.sum("n").alias("cnt"))
        .where("cnt > 0")
    )


def worth_words(n: int, n_active: int, n_words: int, n_common_pairs: int) -> bool:
    """Whether a cohort of ``n`` meets fewer words than pairs of the common codes."""
    met = n_words * (1 - (1 - min(1.0, n / max(1, n_active))) ** WIDTH)
    return met < n_common_pairs * n / max(1, n_active)
