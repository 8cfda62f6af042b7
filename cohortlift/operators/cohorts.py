"""Patient sets of the query tool: lineage, members, subset check and stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.functions import codes
from cohortlift.functions.codes import TOTAL

PATIENT_SET = 1  # result type of a patient set


def resolve_query(
    masters: DataFrame,
    instances: DataFrame,
    results: DataFrame,
    patient_sets: DataFrame,
    query_master_id: int | None = None,
) -> DataFrame:
    """The latest patient set with members of one query master, or of every query master."""
    lineage = _lineage(masters, instances, results)
    if query_master_id is not None:
        # The runs of one master are few; only the memberships of their sets are read.
        lineage = lineage.where(F.col("query_master_id") == query_master_id)
        sets = [r.result_instance_id for r in lineage.select("result_instance_id").distinct().collect()]
        patient_sets = patient_sets.where(F.col("result_instance_id").isin(sets))
    with_members = patient_sets.select("result_instance_id").distinct()
    lineage = lineage.join(with_members, "result_instance_id", "left_semi")
    newest = F.max(F.struct("result_instance_id", "query_instance_id")).alias("newest")
    return _with_cohort_id(
        lineage.groupBy("query_master_id").agg(newest).select("query_master_id", "newest.*")
    )


def resolve_patient_set(
    masters: DataFrame,
    instances: DataFrame,
    results: DataFrame,
    result_instance_id: int | list[int] | None = None,
) -> DataFrame:
    """The query master and instance of one patient set, of several, or of every patient set."""
    lineage = _lineage(masters, instances, results)
    if result_instance_id is not None:
        lineage = lineage.where(F.col("result_instance_id").isin(result_instance_id))
    newest = F.max(F.struct("query_instance_id", "query_master_id")).alias("newest")
    return _with_cohort_id(
        lineage.groupBy("result_instance_id").agg(newest).select("result_instance_id", "newest.*")
    )


def cohort(patient_sets: DataFrame, active: DataFrame, result_instance_id: int) -> DataFrame:
    """Distinct active members (``pn``) of one patient set."""
    return (
        patient_sets.where(F.col("result_instance_id") == result_instance_id)
        .select(F.col("patient_num").alias("pn"))
        .distinct()
        .join(active, "pn", "left_semi")
    )


def cohort_members(
    patient_sets: DataFrame, active: DataFrame, sets: dict[str, int]
) -> DataFrame:
    """Distinct active ``(cohort_id, pn)`` of several patient sets ``{cohort id: set}`` in one scan."""
    named = patient_sets.sparkSession.createDataFrame(
        list(sets.items()), "cohort_id string, result_instance_id bigint"
    )
    return (
        patient_sets.where(F.col("result_instance_id").isin(list(sets.values())))
        .join(F.broadcast(named), "result_instance_id")  # no larger than the dict
        .select("cohort_id", F.col("patient_num").alias("pn"))
        .distinct()
        .join(active, "pn", "left_semi")
        .select("cohort_id", "pn")
    )


def subset_check(patient_sets: DataFrame, test_id: int, reference_id: int) -> DataFrame:
    """One row ``n_missing``: test members that are not reference members. A subset gives 0.

    Raw memberships are compared, whether active or not, in one scan and one aggregation.
    """
    result = F.col("result_instance_id")
    return (
        patient_sets.where(result.isin(test_id, reference_id))
        .groupBy("patient_num")
        .agg(
            F.bool_or(result == test_id).alias("in_test"),
            F.bool_or(result == reference_id).alias("in_reference"),
        )
        .where("in_test and not in_reference")
        .agg(F.count("*").alias("n_missing"))
    )


def stored_cohorts(
    counts: DataFrame,
    result_instance_id: int | None = None,
    query_master_id: int | None = None,
) -> DataFrame:
    """``cohort_id, n, members_hash`` of the stored results, by patient set or query master."""
    stored = counts.where(F.col("ccd") == TOTAL).select(
        "cohort_id", F.col("cnt").alias("n"), "members_hash"
    )
    for part, wanted in (("result", result_instance_id), ("master", query_master_id)):
        if wanted is not None:
            stored = stored.where(codes.cohort_id_part(F.col("cohort_id"), part) == wanted)
    return stored


def existing_cohort(
    counts: DataFrame,
    result_instance_id: int | None = None,
    query_master_id: int | None = None,
) -> DataFrame:
    """Stored rows of the newest matching cohort; no rows if there is none."""
    newest = newest_cohort(stored_cohorts(counts, result_instance_id, query_master_id))
    return counts.where(F.col("cohort_id") == newest.select("cohort_id").scalar())


def newest_cohort(stored: DataFrame) -> DataFrame:
    """One row: the stored cohort with the highest ids, or nulls if there is none."""
    ids = [
        codes.cohort_id_part(F.col("cohort_id"), part) for part in ("master", "instance", "result")
    ]
    row = F.struct("cohort_id", "n", "members_hash")
    return stored.agg(F.max_by(row, F.struct(*ids)).alias("newest")).select("newest.*")


def _lineage(masters: DataFrame, instances: DataFrame, results: DataFrame) -> DataFrame:
    return (
        results.where(F.col("result_type_id") == PATIENT_SET)
        .select("result_instance_id", "query_instance_id")
        .join(instances.select("query_instance_id", "query_master_id"), "query_instance_id")
        .join(masters.select("query_master_id"), "query_master_id")
    )


def _with_cohort_id(lineage: DataFrame) -> DataFrame:
    ids = ["query_master_id", "query_instance_id", "result_instance_id"]
    return lineage.select(*ids, codes.cohort_id(*[F.col(c) for c in ids]).alias("cohort_id"))
