"""The distinct patient x concept table and its parts, and the names of the concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.functions.codes import HIGH, LOW
from cohortlift.operators.joins import LEAST_HOT_ROWS, fits_broadcast, hot_key_join, hot_keys
from cohortlift.operators.ontology import Predicate, predicate

#: Patients with very many facts are looked for among this share of the facts.
HOT_SHARE = 0.01


def active_patients(facts: DataFrame, rule: Predicate) -> DataFrame:
    """Distinct patients (``pn``) with at least one fact that meets ``rule``."""
    return (
        facts.where(predicate(rule))
        .where(F.col("patient_num").isNotNull())
        .select(F.col("patient_num").alias("pn"))
        .distinct()
    )


def fact_triples(facts: DataFrame, active: DataFrame, partitions: int | None = None) -> DataFrame:
    """Distinct ``(pn, concept_cd, flag)`` of active patients; flags other than H and L are null.

    Repeats are dropped before the patient join, on all three columns, so one patient or code with very
    many facts does not fill a task: afterwards a patient has at most three rows per code. Catalyst moves
    the semi-join below the aggregation when the active patients are small enough to broadcast. With
    ``partitions`` both sides of the join, and the result, are hash partitioned by patient into that many
    parts, and facts are shuffled once.
    """
    triples = distinct_facts(facts, partitions)
    if partitions:
        active = active.repartition(partitions, "pn").hint("shuffle_hash")
    return triples.join(active, "pn", "left_semi")


def distinct_facts(facts: DataFrame, partitions: int | None = None) -> DataFrame:
    """Distinct ``(pn, concept_cd, flag)`` of all patients, hash partitioned by patient if ``partitions`` are given.

    Then only the facts of patients with very many of them are made distinct before the shuffle: nearly all
    others are new where they are read, and a hash table of them would be as large as the files.
    """
    flag = F.when(F.col("valueflag_cd").isin(HIGH, LOW), F.col("valueflag_cd"))
    rows = facts.where((F.col("concept_cd") != "") & F.col("patient_num").isNotNull()).select(
        F.col("patient_num").alias("pn"), "concept_cd", flag.alias("flag")
    )
    if partitions:
        hot = hot_keys(rows.sample(HOT_SHARE, 1), ["pn"], int(LEAST_HOT_ROWS * HOT_SHARE)).select("pn")
        if not hot.isEmpty():
            hot = F.broadcast(hot)
            repeated = rows.join(hot, "pn", "left_semi").distinct()
            rows = rows.join(hot, "pn", "left_anti").unionByName(repeated)
        rows = rows.repartition(partitions, "pn")
    return rows.distinct()


def concept_rollup(
    branch_map: DataFrame,
    facts: DataFrame,
    active: DataFrame,
    small: bool | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Distinct patient x ancestor branch code, hash partitioned by patient if ``partitions`` are given."""
    facts = facts.withColumn("valueflag_cd", F.lit(None).cast("string"))
    return (
        _with_branches(branch_map, fact_triples(facts, active, partitions), small, facts, partitions)
        .select("pn", F.col("branch_cd").alias("ccd"))
        .distinct()
    )


def abnormal_flags(
    branch_map: DataFrame,
    facts: DataFrame,
    active: DataFrame,
    small: bool | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Distinct patient x ``H_``/``L_`` + value-flag branch code, like :func:`concept_rollup`."""
    flagged = facts.where(F.col("valueflag_cd").isin(HIGH, LOW))
    triples = fact_triples(flagged, active, partitions)
    return (
        _with_branches(branch_map.where("is_vf"), triples, small, flagged, partitions)
        .select("pn", F.concat_ws("_", "flag", "branch_cd").alias("ccd"))
        .distinct()
    )


def code_expansion(branch_map: DataFrame) -> DataFrame:
    """``(from_cd, need_flag, ccd)``: every code a fact of ``from_cd`` counts for.

    A mapped code counts for itself, for each of its branches and, if the fact carries the needed
    flag, for the flagged code of each value-flag branch.
    """

    def row(flag: str | None):
        need = F.lit(flag).cast("string")
        code = F.concat(F.lit(f"{flag}_"), F.col("branch_cd")) if flag else F.col("branch_cd")
        return F.struct(need.alias("need_flag"), code.alias("ccd"))

    itself = F.struct(F.lit(None).cast("string").alias("need_flag"), F.col("concept_cd").alias("ccd"))
    plain = F.array(itself, row(None))
    rows = F.when(F.col("is_vf"), F.concat(plain, F.array(row(HIGH), row(LOW)))).otherwise(plain)
    return branch_map.select(F.col("concept_cd").alias("from_cd"), F.inline(rows)).distinct()


def patient_concepts(
    facts: DataFrame,
    active: DataFrame,
    expansion: DataFrame,
    partitions: int | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Distinct ``(pn, ccd)``: raw codes, branch codes and flagged branch codes in one fact pass.

    With ``partitions`` the result is hash partitioned by patient into that many parts. When the
    expansion is small it is broadcast over triples that are already partitioned by patient, so
    the last ``distinct`` needs no shuffle of the (larger) expanded rows.
    """
    return expanded(fact_triples(facts, active, partitions), expansion, small, facts, partitions)


def expanded(
    triples: DataFrame,
    expansion: DataFrame,
    small: bool | None = None,
    facts: DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Distinct ``(pn, ccd)`` that the ``(pn, concept_cd, flag)`` count for.

    Hot codes are found in ``facts``, which are as many rows or more and need no shuffle to be counted.
    ``partitions`` is the number of parts by patient that the triples have and the result gets: an expansion
    that is not small is joined as one row for each code, and the triples meet their codes as a list, which is
    shuffled once and made rows by patient.
    """
    if small is None:
        small = fits_broadcast(expansion)
    if partitions and not small:
        listed = expansion.groupBy("from_cd").agg(F.collect_list(F.struct("need_flag", "ccd")).alias("_codes"))
        met = F.filter("_codes", lambda c: c["need_flag"].isNull() | (c["need_flag"] == F.col("flag")))
        found = F.transform(met, lambda c: F.coalesce(c["ccd"], F.col("concept_cd")))
        on = [("concept_cd", "from_cd")]
        return (
            hot_key_join(triples, listed, on, "left", ["pn"], None, False, facts, partitions=partitions)
            .select("pn", F.when(F.size(found) > 0, found).otherwise(F.array("concept_cd")).alias("_found"))
            .repartition(partitions, "pn")
            .select("pn", F.explode("_found").alias("ccd"))
            .distinct()
        )
    flag_met = F.col("need_flag").isNull() | (F.col("need_flag") == F.col("flag"))
    return (
        hot_key_join(
            triples, expansion, [("concept_cd", "from_cd")], "left", ["pn"], flag_met, small, facts
        )
        .select("pn", F.coalesce("ccd", "concept_cd").alias("ccd"))
        .distinct()
    )


def concept_names(branches: DataFrame, concepts: DataFrame) -> DataFrame:
    """One name per code: the smallest over branch nodes and the concept dimension."""
    both = branches.select(F.col("c_basecode").alias("concept_cd"), F.col("c_name").alias("name")).union(
        concepts.select(
            F.nullif("concept_cd", F.lit("")), F.nullif("name_char", F.lit(""))
        )
    )
    return both.where("concept_cd is not null").groupBy("concept_cd").agg(F.min("name").alias("name"))


def _with_branches(
    branch_map: DataFrame, triples: DataFrame, small: bool | None, facts: DataFrame, partitions: int | None
) -> DataFrame:
    """``pn, flag, branch_cd``, partitioned like :func:`expanded`."""
    renamed, on = branch_map.withColumnRenamed("concept_cd", "from_cd"), [("concept_cd", "from_cd")]
    if small is None:
        small = fits_broadcast(renamed)
    if small or not partitions:
        return hot_key_join(triples, renamed, on, "inner", ["pn"], None, small, facts).select("pn", "flag", "branch_cd")
    listed = renamed.groupBy("from_cd").agg(F.collect_list("branch_cd").alias("_branches"))
    return (
        hot_key_join(triples, listed, on, "inner", ["pn"], None, False, facts, partitions=partitions)
        .select("pn", "flag", "_branches")
        .repartition(partitions, "pn")
        .select("pn", "flag", F.explode("_branches").alias("branch_cd"))
    )
