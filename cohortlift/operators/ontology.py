"""Ontology branch nodes and the concept -> branch map behind the hierarchy roll-up."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlift.functions import codes
from cohortlift.operators.joins import hot_key_join

# LIKE patterns of the usual branch and value-flag nodes.
BRANCH_PATTERNS = [
    ("c_basecode", "ICD9:___"),
    ("c_basecode", "ICD9:___._"),
    ("c_name", "[_____]%"),
]
VALUE_FLAG_PATTERNS = [
    ("c_basecode", "LOINC:_____-_"),
    ("c_basecode", "LOINC:____-_"),
    ("c_basecode", "LOINC:___-_"),
]

Predicate = Column | str | bool | list[tuple[str, str]]

#: Concepts whose paths are cut into prefixes by one task.
CONCEPTS_PER_TASK = 20_000
MOST_TASKS = 20_000


def procedure_nodes(root: str, separator: str = "\\") -> tuple[str, str]:
    """The branch pattern of procedure categories, nine characters from ``A`` on below a site's ``root`` path."""
    return ("c_fullname", f"{root}Meta%{separator}A________{separator}")


def predicate(rule: Predicate) -> Column:
    """A rule as a Column: a Column, a Spark SQL condition, LIKE patterns to OR, or True/False."""
    if isinstance(rule, Column):
        return rule
    if isinstance(rule, bool):
        return F.lit(rule)
    if isinstance(rule, str):
        return F.expr(rule)
    return reduce(lambda a, b: a | b, [codes.like(F.col(c), p) for c, p in rule], F.lit(False))


def populated_folders(min_totalnum: int = 10) -> Column:
    """The rule for every branch node: coded folders with more than ``min_totalnum`` patients."""
    return (
        (F.col("c_totalnum") > min_totalnum)
        & F.col("c_visualattributes").startswith("F")
        & F.col("c_basecode").isNotNull()
    )


def ontology_branches(
    ontology: DataFrame,
    branch: Predicate = BRANCH_PATTERNS,
    value_flag: Predicate = VALUE_FLAG_PATTERNS,
    every_branch: Predicate | None = None,
) -> DataFrame:
    """Ontology rows that meet ``(branch or value_flag) and every_branch``, with ``is_vf``."""
    text = ["c_basecode", "c_dimcode", "c_name", "c_fullname", "c_visualattributes"]
    ontology = ontology.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in text})
    every = populated_folders() if every_branch is None else predicate(every_branch)
    return (
        ontology.where(every)
        .withColumn("is_vf", F.coalesce(predicate(value_flag), F.lit(False)))
        .where(F.col("is_vf") | predicate(branch))
        .select(*text, "c_totalnum", "is_vf")
    )


def concept_branch_map(
    branches: DataFrame,
    concepts: DataFrame,
    separator: str = "\\",
    match: str = "prefix",
    small: bool | None = None,
) -> DataFrame:
    """``(concept_cd, branch_cd, is_vf)``: the concepts whose path starts with a branch's dimcode.

    A path is turned into its candidate prefixes - one per level, plus one per length of the
    dimcodes that end inside a level - and these are joined to the dimcodes by equality, so the
    prefix match never becomes a nested loop. With ``match='like'``, ``%`` and ``_`` in a dimcode
    are wildcards: the text before the first one is the join key and LIKE decides on the rest.
    Null and empty dimcodes match nothing. Concepts are dealt out by their code before they are cut, in tasks
    of bounded size, so the many prefixes are made distinct where they are and not shuffled for it.
    """
    if match not in ("prefix", "like"):
        raise ValueError(f"match must be 'prefix' or 'like', not {match!r}")
    dim = F.col("c_dimcode")
    nodes = (
        branches.where((dim != "") & (F.col("c_basecode") != ""))
        .groupBy("c_dimcode", "c_basecode")
        .agg(F.max("is_vf").alias("is_vf"))
        .withColumn("head", codes.literal_head(dim) if match == "like" else dim)
    )
    odd_lengths = (
        nodes.where(~F.endswith(F.col("head"), F.lit(separator)))
        .agg(F.collect_set(F.length("head")))
        .scalar()
    )
    path = F.col("concept_path")
    inner_cuts = F.transform(
        F.filter("odd_lengths", lambda n: n <= F.length(path)),
        lambda n: F.substring(path, F.lit(1), n),
    )
    placed = concepts.where((path != "") & (F.col("concept_cd") != "")).select("concept_cd", "concept_path")
    shuffle = int(concepts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(shuffle, min(MOST_TASKS, math.ceil(placed.count() / CONCEPTS_PER_TASK)))
    prefixes = (
        placed.repartition(tasks, "concept_cd")
        .select("concept_cd", "concept_path", odd_lengths.alias("odd_lengths"))
        .withColumn(
            "prefix_path",
            F.explode(F.array_union(codes.ancestor_paths(path, separator), inner_cuts)),
        )
    )
    if match == "prefix":
        prefixes = prefixes.select("concept_cd", "prefix_path").distinct()
        rest, spread_by = None, ["concept_cd"]
    else:
        rest = (dim == F.col("head")) | codes.like(path, F.concat(dim, F.lit("%")))
        spread_by = ["concept_path"]
    return (
        hot_key_join(
            prefixes, nodes, [("prefix_path", "head")], "inner", spread_by, rest, small
        )
        .groupBy("concept_cd", F.col("c_basecode").alias("branch_cd"))
        .agg(F.max("is_vf").alias("is_vf"))
    )
