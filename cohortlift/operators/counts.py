"""Distinct-patient counts per concept: in the population and in cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlift.functions import codes
from cohortlift.functions.codes import TOTAL, TOTAL_NAME

MEMBERS_PER_BUCKET = 1_000_000  # above, members are sorted (and may spill) and not hashed


def pair_totals(pairs: DataFrame) -> DataFrame:
    """``ccd, total``: the patients of every code. ``pairs`` must be distinct, as :func:`patient_concepts` gives them."""
    return pairs.groupBy("ccd").agg(F.count("*").alias("total"))


def population_counts(
    pairs: DataFrame,
    names: DataFrame,
    n_active: Column | int,
    denominator: Column | int | None = None,
    min_total: int = 10,
    strip: str = "leading",
) -> DataFrame:
    """``prefix, ccd, name, total, frc_total`` per code with more than ``min_total`` patients.

    ``n_active`` fills the ``TOTAL`` row; ``denominator`` (by default the same number) divides the
    counts of all codes but flagged labs, which are divided by the count of their base lab.
    """
    return population_of_totals(pair_totals(pairs), names, n_active, denominator, min_total, strip)


def population_of_totals(
    totals: DataFrame,
    names: DataFrame,
    n_active: Column | int,
    denominator: Column | int | None = None,
    min_total: int = 10,
    strip: str = "leading",
) -> DataFrame:
    """:func:`population_counts` from the ``(ccd, total)`` of all codes."""
    n_active = _number(n_active)
    denominator = n_active if denominator is None else _number(denominator)
    ccd = F.col("ccd")
    counted = _with_base_count(totals, "total")
    codes_ = (
        counted.where(F.col("total") > min_total)
        .withColumn("lookup", codes.lookup_code(ccd, strip))
        .join(names.withColumnRenamed("concept_cd", "lookup"), "lookup", "left")
        .select(
            codes.scheme_prefix(ccd, F.col("lookup")).alias("prefix"),
            "ccd",
            codes.labelled_name(ccd, F.col("name")).alias("name"),
            "total",
            _fraction("total", denominator).alias("frc_total"),
        )
    )
    total_row = totals.sparkSession.range(1).select(
        F.lit(TOTAL).alias("prefix"),
        F.lit(TOTAL).alias("ccd"),
        F.lit(TOTAL_NAME).alias("name"),
        n_active.cast("bigint").alias("total"),
        F.lit(1.0).alias("frc_total"),
    )
    return codes_.unionByName(total_row)


def cohort_sizes(members: DataFrame) -> DataFrame:
    """Per ``cohort_id`` of distinct ``(cohort_id, pn)``: size and an order-free hash of the ids."""
    return members.groupBy("cohort_id").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("pn")).alias("members_hash")
    )


def measure_cohorts(members: DataFrame, cohort_ids: list[str]) -> dict[str, tuple[int, int]]:
    """``{cohort id: (size, members hash)}`` of the named cohorts, ``(0, 0)`` for empty ones."""
    named = members.where(F.col("cohort_id").isin(cohort_ids))
    found = {row[0]: (row[1], row[2]) for row in cohort_sizes(named).collect()}
    return {c: found.get(c, (0, 0)) for c in cohort_ids}


def cohort_counts(
    pairs: DataFrame | list[DataFrame],
    members: DataFrame,
    population: DataFrame,
    sizes: dict[str, tuple[int, int]],
    buckets: int | None = None,
) -> DataFrame:
    """``cohort_id, ccd, cnt, frc, members_hash`` of each measured cohort: positive counts and the total.

    Counts of all cohorts come from one pass over ``pairs``, for codes of the population. Flagged labs are
    divided by the cohort's count of their base lab, other codes by the cohort's size; the ``TOTAL`` row
    holds the size. ``members`` are distinct ``(cohort_id, pn)``. See :func:`cohort_hits` for ``buckets``.
    """
    parts = pairs if isinstance(pairs, list) else [pairs]
    return cohort_fractions(cohort_hits(parts, members, sizes, buckets), sizes, population)


def cohort_hits(
    parts: list[DataFrame], members: DataFrame, sizes: dict[str, tuple[int, int]], buckets: int | None = None
) -> DataFrame:
    """``cohort_id, ccd, cnt``: how many members of each measured cohort have each code.

    ``parts`` are the pairs, or parts of them that have no row in common. If they have ``buckets`` by patient,
    only the members are shuffled: each bucket probes a hash table of its share of them or, if the share
    is large, is merged with it.
    """
    if not sizes:
        raise ValueError("name at least one cohort")
    members = members.join(_measures(parts[0], sizes).select("cohort_id"), "cohort_id", "left_semi")
    if buckets:
        # Spelled out, as otherwise the side with more partitions would set the number for both.
        members = members.repartition(buckets, "pn")
        if sum(n for n, _ in sizes.values()) / buckets <= MEMBERS_PER_BUCKET:
            members = members.hint("shuffle_hash")
    met = [pairs.join(members, "pn").select("cohort_id", "ccd") for pairs in parts]
    return reduce(DataFrame.union, met).groupBy("cohort_id", "ccd").agg(F.count("*").alias("cnt"))


def cohort_fractions(
    hits: DataFrame, sizes: dict[str, tuple[int, int]], population: DataFrame | None = None
) -> DataFrame:
    """The counts of :func:`cohort_counts` from the hits of the measured cohorts; of all codes without a population."""
    measures = _measures(hits, sizes)
    counted = _with_base_count(hits, "cnt", "cohort_id")
    if population is not None:
        counted = counted.join(population.where(F.col("ccd") != TOTAL).select("ccd"), "ccd", "left_semi")
    counted = counted.join(measures, "cohort_id").select(
        "cohort_id", "ccd", "cnt", _fraction("cnt", F.col("n")).alias("frc"), "members_hash"
    )
    totals = measures.select(
        "cohort_id", F.lit(TOTAL).alias("ccd"), F.col("n").alias("cnt"), F.lit(1.0).alias("frc"), "members_hash"
    )
    return counted.unionByName(totals)


def _measures(of: DataFrame, sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """A row for each cohort of a request."""
    rows = [(c, n, h) for c, (n, h) in sizes.items()]
    return F.broadcast(of.sparkSession.createDataFrame(rows, "cohort_id string, n bigint, members_hash bigint"))


def with_zeros(counts: DataFrame, population: DataFrame, cohort_ids: list[str]) -> DataFrame:
    """``cohort_id, ccd, cnt, frc`` of the named cohorts for every population code."""
    ids = F.explode(F.array(*[F.lit(c) for c in cohort_ids])).alias("cohort_id")
    found = counts.select("cohort_id", "ccd", "cnt", "frc")
    return (
        population.select(ids, "ccd")
        .join(found, ["cohort_id", "ccd"], "left")
        .select("cohort_id", "ccd", F.coalesce("cnt", _long(0)).alias("cnt"), F.coalesce("frc", F.lit(0.0)).alias("frc"))
    )


def counts_wide(population: DataFrame, counts: DataFrame, cohort_ids: list[str]) -> DataFrame:
    """The population counts with one ``<cohort>`` and one ``frc_<cohort>`` column per cohort."""
    columns = []
    for c in cohort_ids:
        here = F.col("cohort_id") == c
        columns += [F.max(F.when(here, F.col("cnt"))).alias(c)]
        columns += [F.max(F.when(here, F.col("frc"))).alias(f"frc_{c}")]
    wide = counts.where(F.col("cohort_id").isin(cohort_ids)).groupBy("ccd").agg(*columns)
    zeros = [
        F.coalesce(F.col(n), zero).alias(n)
        for c in cohort_ids
        for n, zero in ((c, _long(0)), (f"frc_{c}", F.lit(0.0)))
    ]
    return population.join(wide, "ccd", "left").select(
        "prefix", "ccd", "name", "total", "frc_total", *zeros
    )


def concept_schemes(counts: DataFrame, schemes: DataFrame) -> DataFrame:
    """``c_key, c_name, c_description`` of every prefix in use; unknown ones describe themselves."""
    found = schemes.select(
        F.col("c_name").alias("prefix"),
        F.nullif("c_key", F.lit("")).alias("c_key"),
        F.nullif("c_description", F.lit("")).alias("c_description"),
    )
    return (
        counts.where("prefix is not null")
        .select("prefix")
        .distinct()
        .join(found, "prefix", "left")
        .select(
            F.coalesce("c_key", "prefix").alias("c_key"),
            F.col("prefix").alias("c_name"),
            F.coalesce("c_description", "prefix").alias("c_description"),
        )
    )


def duplicate_keys(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Key values that occur more than once, with their number of rows; empty for a valid key.

    With ``partitions`` the rows are counted in that many tasks after the shuffle: of keys that are nearly all
    different, a count before it would hold as many as are in a file.
    """
    if partitions:
        df = df.select(*keys).repartition(partitions, *keys)
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def key_violations(table_name: str, df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """``table_name, key, n_rows`` of repeated keys, the key as JSON text; see :func:`duplicate_keys`."""
    key = F.to_json(F.struct(*keys)).alias("key")
    return duplicate_keys(df, keys, partitions).select(F.lit(table_name).alias("table_name"), key, "n_rows")


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _number(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _with_base_count(counted: DataFrame, count: str, *group: str) -> DataFrame:
    """Add ``base_count``: for a flagged lab code, the count of the lab without the flag, if any.

    A base code's window holds at most three rows (itself, high and low), so this replaces two
    self-joins of the counts without making large groups.
    """
    ccd = F.col("ccd")
    base = codes.unflagged_code(ccd)
    is_base = ~codes.is_flagged(ccd) & ccd.startswith(codes.BASE_LAB_PREFIX)
    family = Window.partitionBy(*group, "_base")
    return (
        counted.withColumn("_base", base)
        .withColumn("_of_base", F.max(F.when(is_base & (F.col(count) > 0), F.col(count))).over(family))
        .withColumn("base_count", F.when(codes.is_flagged(ccd), F.col("_of_base")))
        .drop("_base", "_of_base")
    )


def _fraction(count: str, otherwise: Column) -> Column:
    whole = F.coalesce(F.col("base_count"), otherwise).cast("double")
    return F.col(count).cast("double") / F.nullif(whole, F.lit(0.0))
