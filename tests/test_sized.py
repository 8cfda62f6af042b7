"""Work by patient is cut by the number of facts, and facts are shuffled once, whatever the size of the code map."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlift.operators import concepts as cc
from cohortlift.operators import counts as ct
from cohortlift.operators import joins
from cohortlift.operators import ontology as on
from cohortlift.operators import refresh as rf
from cohortlift.plans import study as st

FACTS = "patient_num bigint, concept_cd string, valueflag_cd string"
MAP = "concept_cd string, branch_cd string, is_vf boolean"


@pytest.fixture(scope="module")
def star(spark):
    rng = random.Random(3)
    data = [(rng.randrange(30), f"c{rng.randrange(60)}", rng.choice(["H", "L", "N", None])) for _ in range(1_500)]
    data += [(7, "c1", "H")] * 2_000 + [(None, "c1", None), (3, None, None), (3, "", "H"), (4, "loose", None)]
    mapped = [(f"c{i}", f"b{i % 7}", i % 2 == 0) for i in range(50)] + [(f"c{i}", "top", False) for i in range(50)]
    active = spark.createDataFrame([(p,) for p in range(0, 30, 2)] + [(7,)], "pn bigint")
    return spark.createDataFrame(data, FACTS).repartition(4), spark.createDataFrame(mapped, MAP), active


def partitions_of(df):
    return {r["pn"]: r["n"] for r in df.withColumn("_p", F.spark_partition_id()).groupBy("pn").agg(F.countDistinct("_p").alias("n")).collect()}


def test_buckets_hold_a_bounded_number_of_facts():
    """refreshed_counts, key_violations: 12 buckets for 55 million facts of 900,000 patients were too large."""
    assert st.choose_buckets(870_000, 12, 12, 55_000_000) == 92
    assert st.choose_buckets(870_000, 12, 100, 55_000_000) == 100
    assert st.choose_buckets(5_200_000, 12, 600, 330_000_000) == 600
    assert st.choose_buckets(10, 12, 12, 10**12) == st.MOST_BUCKETS


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("hot", [False, True])
def test_pairs_by_patient_are_the_same_with_any_plan(star, rows, monkeypatch, small, hot):
    facts, branch_map, active = star
    if hot:
        monkeypatch.setattr(cc, "HOT_SHARE", 1.0)
        monkeypatch.setattr(cc, "LEAST_HOT_ROWS", 500)
    expansion = cc.code_expansion(branch_map)
    want = rows(cc.patient_concepts(facts, active, expansion, None, True))
    found = cc.patient_concepts(facts, active, expansion, 5, small)
    assert rows(found) == want and len(want) == len(set(want))
    assert (4, "loose") in want and set(partitions_of(found).values()) == {1}
    for of in (cc.concept_rollup, cc.abnormal_flags):
        assert rows(of(branch_map, facts, active, small, 5)) == rows(of(branch_map, facts, active, True)) != []


def test_facts_are_shuffled_once(star, plan, monkeypatch):
    """domain_list, chi2_scores: three shuffles for pairs with a large code map, where there were five."""
    facts, branch_map, active = star
    spark, key = facts.sparkSession, "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    monkeypatch.setattr(joins, "fits_broadcast", lambda *_: False)
    try:
        text = plan(cc.patient_concepts(facts, active, cc.code_expansion(branch_map), 5, False))
        assert text.count("Exchange hashpartitioning(pn") == 3  # facts, active patients, pairs
        assert "ShuffledHashJoin [pn" in text
        text = plan(cc.concept_rollup(branch_map, facts, active, False, 5))
        assert text.count("Exchange hashpartitioning(pn") == 3
    finally:
        spark.conf.set(key, before)


def test_repeated_keys_are_counted_after_the_shuffle(star, rows, plan):
    facts, keys = star[0], ["patient_num", "concept_cd"]
    found = ct.key_violations("facts", facts, keys, 6)
    assert rows(found) == rows(ct.key_violations("facts", facts, keys))
    text = plan(ct.duplicate_keys(facts, keys, 6))
    scan_side = text[text.rindex("Exchange hashpartitioning(patient_num") :]
    assert "HashAggregate" not in scan_side and ", 6)" in scan_side.splitlines()[0]


def test_many_new_rows_are_merged(star, rows, plan, monkeypatch):
    facts = star[0]
    loaded = rf.known_facts(facts, 3)
    part = loaded.where("pn % 3 = 0")
    hashed = rows(rf.new_rows(loaded, [part], 3))
    assert "ShuffledHashJoin" in plan(rf.new_rows(loaded, [part], 3))
    monkeypatch.setattr(rf, "MOST_HASHED", 1)
    assert rows(rf.new_rows(loaded, [part], 3)) == hashed != []
    assert "ShuffledHashJoin" not in plan(rf.new_rows(loaded, [part], 3))


def test_prefixes_are_made_distinct_without_a_shuffle(spark, rows, monkeypatch):
    """concept_rollup: a task held all prefixes of a file of concepts."""
    monkeypatch.setattr(on, "CONCEPTS_PER_TASK", 1)
    nodes = [("/a/", "A", True), ("/a/b/", "AB", False), ("/a/b/x", "ABX", False)]
    branches = spark.createDataFrame(nodes, "c_dimcode string, c_basecode string, is_vf boolean")
    data = [(f"/a/b/x{i}/", f"c{i % 40}") for i in range(400)] + [("/z/", "c1"), (None, "c2"), ("/a/", "")]
    concepts = spark.createDataFrame(data, "concept_path string, concept_cd string")
    found = on.concept_branch_map(branches, concepts, "/")
    assert rows(found) == sorted((f"c{i}", code, vf) for i in range(40) for _, code, vf in nodes)
    # The whole text: the plan of a subquery within it ends in an initial plan too.
    text = found._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in text.splitlines() if "Exchange hashpartitioning(concept_cd" in line]
    assert any(", 401), REPARTITION_BY_NUM" in line for line in shuffles)
    assert not any("prefix_path" in line for line in shuffles)
