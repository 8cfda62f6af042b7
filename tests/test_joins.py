"""The join of large facts with a dimension, where one key holds a third of all rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlift.operators import concepts as cc
from cohortlift.operators import joins


@pytest.fixture
def tasks(spark):
    conf = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield 16
    for k, v in before.items():
        spark.conf.set(k, v)


def skewed(spark, n):
    """A third of the rows have one mapped code, a third one unmapped code, some none."""
    i = F.col("id")
    code = (
        F.when(i % 3 == 0, "hot").when(i % 3 == 1, "unmapped").when(i % 300 == 2, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("c"), (F.xxhash64("id") % 3_000).cast("string")))
    )
    return spark.range(n).select(i.alias("pn"), code.alias("concept_cd"))


def branches(spark):
    rows = [(f"c{i}", f"b{i % 50}") for i in range(-2_999, 3_000)] + [("hot", "b1"), ("hot", "b2"), ("spare", "b3")]
    return spark.createDataFrame(rows, "from_cd string, branch string")


def sizes(df):
    """Rows of each task that the join gives."""
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


@pytest.mark.parametrize("keys_fit", [True, False])
def test_largest_task_is_within_twice_the_median(spark, tasks, monkeypatch, keys_fit):
    if not keys_fit:
        monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    left, right = skewed(spark, 300_000), branches(spark)
    on = [("concept_cd", "from_cd")]
    joined = joins.hot_key_join(left, right, on, "inner", ["pn"], small=False, least_hot=1_000)
    by_task = sizes(joined)
    assert len(by_task) == tasks and by_task[-1] <= 2 * by_task[tasks // 2]
    plain = sizes(left.join(right, F.col("concept_cd") == F.col("from_cd")))
    assert plain[-1] > 5 * plain[tasks // 2]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("keys_fit", [True, False])
@pytest.mark.parametrize("least", [0, 1_000, 10**9])
def test_all_ways_give_the_same_rows(spark, monkeypatch, how, keys_fit, least):
    left, right = skewed(spark, 20_000), branches(spark)
    on, odd = [("concept_cd", "from_cd")], F.col("branch") != "b7"

    def counted(df):
        return Counter(tuple(r) for r in df.select("pn", "concept_cd", "from_cd", "branch").collect())

    want = counted(joins.hot_key_join(left, right, on, how, ["pn"], odd, small=True))
    if not keys_fit:
        monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    assert counted(joins.hot_key_join(left, right, on, how, ["pn"], odd, False, least_hot=least)) == want


def test_hot_keys_are_measured(spark, tasks):
    found = {r["concept_cd"]: r["_parts"] for r in joins.hot_keys(skewed(spark, 30_000), ["concept_cd"], 1_000).collect()}
    # 29,900 rows have a code; a task's share is cut into 32 parts.
    assert found == {"hot": 172, "unmapped": 172}
    assert joins.hot_keys(skewed(spark, 30_000), ["concept_cd"], 10_000).count() == 0
    assert joins.hot_keys(skewed(spark, 0), ["concept_cd"], 0).count() == 0


def test_pairs_of_a_hot_code(spark, tasks):
    """Distinct pairs are equal with a broadcast and with a split expansion."""
    rng = random.Random(5)
    rows = [(p, "hot", rng.choice("HLN")) for p in range(400) for _ in range(3)]
    rows += [(rng.randrange(400), f"c{rng.randrange(40)}", "H") for _ in range(900)]
    facts = spark.createDataFrame(rows, "patient_num bigint, concept_cd string, valueflag_cd string")
    active = spark.range(390).withColumnRenamed("id", "pn")
    mapped = spark.createDataFrame([("hot", "b", True), ("c1", "b", False)], "concept_cd string, branch_cd string, is_vf boolean")
    expansion = cc.code_expansion(mapped)
    one, other = (
        sorted(map(tuple, cc.patient_concepts(facts, active, expansion, 4, small).collect())) for small in (True, False)
    )
    assert one == other and len(one) == len(set(one))
