"""Cohort counts by words of 64 patients equal those by pairs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortlift import StageTables, Study
from cohortlift.operators import bitmaps as bm
from cohortlift.sources import retail
from tests.test_study import RULES, small_star

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def study(spark):
    stage = StageTables(spark)
    return Study(spark, retail.retail_star(spark, DATA, stage), retail.retail_rules(), stage)


def test_numbers_are_dense_in_each_bucket(spark):
    active = spark.range(1_000).select((F.col("id") * 7_919).alias("pn"))
    rows = bm.numbered(active, 3).collect()
    assert len({(r.word, r.bit) for r in rows}) == 1_000
    by_word = {}
    for r in rows:
        by_word.setdefault(r.word, []).append(r.bit & (2**64 - 1))
    full = [sum(bits) == 2**64 - 1 for bits in by_word.values()]
    assert sum(not f for f in full) <= 3 and len(by_word) <= 1_000 // 64 + 3


@pytest.mark.parametrize("by_words", [None, [], ["A", "B", "C", "D"], ["B", "C"]])
def test_counts_equal_those_by_pairs(study, by_words):
    sets = {"A": retail.BUILDING, "B": retail.MACHINERY, "C": retail.ONE_CUSTOMER, "D": retail.NOBODY}
    want = sorted(map(tuple, study.compute_cohorts(sets).collect()))
    found = study.compute_cohorts_by_words(sets, by_words=by_words)
    assert found.columns == study.compute_cohorts(sets).columns
    assert sorted(map(tuple, found.collect())) == want


def test_words_and_rare_pairs_share_the_codes(study):
    b = study.bitmaps()
    common = {r.ccd for r in b["common"].collect()}
    assert common and {r.ccd for r in b["words"].select("ccd").distinct().collect()} == common
    assert not common & {r.ccd for r in b["rare_pairs"].select("ccd").distinct().collect()}
    bits = b["words"].agg(F.sum(F.bit_count("bits"))).first()[0]
    assert bits + b["rare_pairs"].count() == study.patient_concepts().count()
    assert b["words"].count() < 0.5 * bits


def test_large_cohorts_take_words():
    assert bm.worth_words(50_000, 100_000, 2_000_000, 40_000_000)
    assert not bm.worth_words(500, 100_000, 2_000_000, 40_000_000)
    assert not bm.worth_words(0, 0, 0, 0)


def test_words_are_not_shuffled(study, plan):
    before = study.spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        study.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        text = plan(study.compute_cohorts_by_words({"A": retail.BUILDING}, by_words=["A"]))
    finally:
        study.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = text[text.index("ShuffledHashJoin [word") :]
    assert "Exchange" not in scan[: scan.index("_words[")]


def test_no_common_codes(spark):
    study = Study(spark, small_star(spark, [(100, p) for p in range(6)]), RULES)
    study.population_counts()
    b = study.bitmaps()
    found = study.compute_cohorts_by_words({"M1_I10_R100": 100}, by_words=["M1_I10_R100"])
    want = study.compute_cohorts({"M1_I10_R100": 100})
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert b["numbers"].count() == 30
