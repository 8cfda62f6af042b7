"""Which stored patient sets lie inside others: pruned by size and hashed bits, then checked member by member."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlift.operators.joins import fits_broadcast

#: Words of 64 bits in a signature.
WORDS = 16
_NAMES = [f"bits_{i}" for i in range(WORDS)]


def signatures(patient_sets: DataFrame) -> DataFrame:
    """``result_instance_id, n, bits_0 .. bits_15``: distinct members of each set, and the bits of their hashes."""
    h = F.pmod(F.xxhash64("patient_num"), F.lit(64 * WORDS))
    word, bit = (h / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (h % 64).cast("int"))
    members = patient_sets.select("result_instance_id", "patient_num").distinct()
    members = members.select("result_instance_id", word.alias("word"), bit.alias("bit"))
    none = F.lit(0).cast("bigint")
    bits = [F.bit_or(F.when(F.col("word") == i, F.col("bit")).otherwise(none)).alias(n) for i, n in enumerate(_NAMES)]
    return members.groupBy("result_instance_id").agg(F.count("*").alias("n"), *bits)


def subsets_of(patient_sets: DataFrame, signed: DataFrame, references: list[int]) -> DataFrame:
    """``reference_set, subset, n``: for each reference the other sets all of whose members it holds.

    Raw memberships are compared, whether active or not. A set that is larger than the reference, or has a bit that
    the reference lacks, is out. Members are read of the sets left and of the references only, each once.
    """
    rows = signed.where(F.col("result_instance_id").isin(references)).collect()
    if not rows:
        return _nothing(patient_sets)
    wanted = F.array(
        *[
            F.struct(F.lit(r.result_instance_id).alias("reference_set"), F.lit(r.n).alias("most"),
                     *[F.lit(r[name]).alias(f"of_{name}") for name in _NAMES])
            for r in rows
        ]
    )

    def inside(name: str) -> Column:
        return F.col(name).bitwiseAND(F.bitwise_not(F.col(f"of_{name}"))) == 0

    candidates = (
        signed.select("*", F.inline(wanted))
        .where((F.col("result_instance_id") != F.col("reference_set")) & (F.col("n") <= F.col("most")))
        .where(reduce(lambda a, b: a & b, map(inside, _NAMES)))
        .select("reference_set", F.col("result_instance_id").alias("subset"), "n")
    )
    few = F.broadcast(candidates) if fits_broadcast(candidates) else candidates
    members = patient_sets.select(F.col("result_instance_id").alias("subset"), "patient_num")
    found = members.join(few, "subset").distinct()
    ids = [r.result_instance_id for r in rows]
    held = patient_sets.where(F.col("result_instance_id").isin(ids)).select(
        F.col("result_instance_id").alias("reference_set"), "patient_num"
    )
    return (
        found.join(held.distinct(), ["reference_set", "patient_num"])
        .groupBy("reference_set", "subset", "n")
        .agg(F.count("*").alias("n_inside"))
        .where("n_inside = n")
        .select("reference_set", "subset", "n")
    )


def _nothing(patient_sets: DataFrame) -> DataFrame:
    return patient_sets.sparkSession.createDataFrame([], "reference_set bigint, subset bigint, n bigint")
