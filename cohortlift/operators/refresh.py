"""What added facts change: new rows of tables that are bucketed by patient, and counts by the difference.

Old facts are not read again. A table of the distinct facts of all patients, active or not, tells what a patient
had before that becomes active by a new fact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.operators import concepts as cc

#: Joins by patient and code run inside the buckets by patient.
IN_BUCKETS = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


#: Added rows of a bucket that are held as a hash table; more are merged, which may spill.
MOST_HASHED = 2_000_000


def known_facts(facts: DataFrame, partitions: int) -> DataFrame:
    """Distinct ``(pn, concept_cd, flag)`` of all patients, without nulls, in ``partitions`` by patient."""
    return cc.distinct_facts(facts, partitions).withColumn("flag", F.coalesce("flag", F.lit("")))


def new_rows(rows: DataFrame, parts: list[DataFrame], buckets: int | None = None) -> DataFrame:
    """The distinct ``rows`` that no part has; both are tables with the same columns and ``buckets``.

    The few rows that there are already are found by probing hash tables of ``rows``, a bucket each, with the
    parts, and taken away, so the large side is neither shuffled nor sorted.
    """
    hashed = buckets is None or rows.count() <= MOST_HASHED * buckets
    probe = rows.hint("shuffle_hash" if hashed else "merge")
    known = reduce(DataFrame.union, [part.join(probe, rows.columns).select(rows.columns) for part in parts])
    return rows.join(known, rows.columns, "left_anti")


def pairs_to_add(
    added: DataFrame, earlier: list[DataFrame], active: DataFrame, newly_active: DataFrame, expansion: DataFrame, buckets: int
) -> DataFrame:
    """Distinct ``(pn, ccd)`` of the added facts of active patients and of all facts of newly active ones."""
    active, newly_active = (a.repartition(buckets, "pn") for a in (active, newly_active))
    before = [part.join(newly_active.hint("shuffle_hash"), "pn").select(part.columns) for part in earlier]
    facts = reduce(DataFrame.union, [added.join(active, "pn", "left_semi"), *before])
    return cc.expanded(facts, expansion, partitions=buckets)


def added_up(before: DataFrame, more: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Counts by ``keys`` and the counts to add to them."""
    both = before.select(*keys, count).unionByName(more.select(*keys, count))
    return both.groupBy(*keys).agg(F.sum(count).alias(count))
