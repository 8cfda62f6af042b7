"""Places and pages of a whole ranking, both ends of many cohorts, and sets inside others."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cohortlift import StageTables, Study
from cohortlift.operators import compare as cmp
from cohortlift.operators import containment as cn
from cohortlift.plans import study as st
from cohortlift.sources import retail
from cohortlift.sources.ranked import Ranked, write_ranked
from tests.test_study import RULES, small_star

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def study(spark):
    stage = StageTables(spark)
    return Study(spark, retail.retail_star(spark, DATA, stage), retail.retail_rules(), stage)


def plans(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("shards", [1, 7, None])
@pytest.mark.parametrize("n", [0, 1, 5_000])
def test_places_count_the_rows_before(spark, tmp_path, shards, n):
    rng = random.Random(n)
    data = [(i, rng.choice([None, 0.5, 1.0, 2.0, rng.random()])) for i in range(n)]
    df = spark.createDataFrame(data, "ccd bigint, odds double")
    order = [F.col("odds").desc_nulls_first(), F.col("ccd")]
    stored = write_ranked(df, order, f"{tmp_path}/r", shards)
    want = sorted(data, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    found = stored.placed().collect()
    assert sorted((r.place, r.ccd, r.odds) for r in found) == [(i, *r) for i, r in enumerate(want, 1)]
    again = Ranked(spark, f"{tmp_path}/r")
    assert len(again) == n
    for first, last in ((1, 10), (4_990, 6_000), (2_000, 2_000), (9_000, 9_100), (-5, 3), (10, 5)):
        page = [(r.place, r.ccd) for r in again.page(first, last).collect()]
        assert page == [(i, r[0]) for i, r in enumerate(want, 1) if first <= i <= last]


def test_a_page_opens_the_files_of_its_places(spark, tmp_path):
    stored = write_ranked(spark.range(20_000), [F.col("id").desc()], f"{tmp_path}/r", 16)
    one = stored.page(10_001, 10_050)
    assert len(one.inputFiles()) == 1 and one.count() == 50
    assert len(stored.page(1, 20_000).inputFiles()) == 16
    assert stored.page(30_000, 30_010).inputFiles() == []


def test_no_task_numbers_all_rows(study, tmp_path):
    run = study.run(patient_set=retail.BUILDING, rank_by="chisq")
    stored = run.write_ranked(f"{tmp_path}/r", 4)
    placed = stored.placed()
    text = plans(placed)
    assert "Window" not in text and "SinglePartition" not in text
    want = [(r.ccd, r.place) for r in cmp.placed(run.result, "chisq").collect()]
    assert sorted((r.ccd, r.place) for r in placed.collect()) == sorted(want)
    with pytest.raises(ValueError, match="not found"):
        study.run(patient_set=77).write_ranked(f"{tmp_path}/none")


@pytest.mark.parametrize("rank_by", ["odds_ratio", "chisq"])
@pytest.mark.parametrize("options", [{"limit": 4}, {"limit": 0}, {"limit": 9, "patterns": ["LOINC:"], "cutoff": 5}, {}])
def test_many_cohorts_equal_a_request_for_each(study, rank_by, options):
    sets = [r.result_instance_id for r in study.star.query_results.where("result_type_id = 1").limit(25).collect()]
    runs = study.run_many(*sets, 77, rank_by=rank_by, **options)
    assert runs.unknown == [77] and set(runs.cohort_ids) == set(sets)
    rows = runs.result.collect()
    for patient_set in sets[:6]:
        own = [tuple(r)[1:] for r in rows if r.cohort_id == runs.cohort_ids[patient_set]]
        assert own == [tuple(r) for r in study.run(patient_set=patient_set, rank_by=rank_by, **options).result.collect()]
    assert [r.cohort_id for r in rows] == sorted(r.cohort_id for r in rows)


def test_many_cohorts_keep_few_rows_before_the_shuffle(study):
    runs = study.run_many(*range(1, 6), limit=3)
    text = plans(runs.result)
    assert text.count("WindowGroupLimit") >= 4 and ", Partial" in text
    with pytest.raises(ValueError):
        cmp.compare_many(runs.result, study.schemes(), -1)
    nothing = study.run_many(77)
    assert nothing.result is None and nothing.unknown == [77]


def test_many_cohorts_are_read_in_one_scan(study):
    ids = study.ensure_cohorts(*range(1, 6))
    store = study.store()
    stored = [store.get(c) for c, _ in ids.values()]
    both = store.counts_of(stored)
    assert plans(both).split("== Physical Plan ==")[1].count("FileScan") == len({s.written for s in stored})
    one = {tuple(r) for s in stored for r in store.counts(s).select("cohort_id", "ccd", "cnt").collect()}
    assert {tuple(r) for r in both.select("cohort_id", "ccd", "cnt").collect()} == one


def random_sets(seed):
    rng = random.Random(seed)
    big = rng.sample(range(5_000), 900)
    rows = [(1, p) for p in big] + [(2, p) for p in rng.sample(range(60), 40)]
    for s in range(3, 60):
        of = rng.choice([big, range(60), range(5_000)])
        rows += [(s, p) for p in rng.sample(list(of), rng.randint(1, min(30, len(of))))]
    rows += [(60, p) for p in big] + [(61, p) for p in big] + [(61, 9_999)] + rows[::7]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_subsets_equal_brute_force(spark, seed):
    rows = random_sets(seed)
    sets = spark.createDataFrame(rows, "result_instance_id bigint, patient_num bigint")
    of = {}
    for s, p in rows:
        of.setdefault(s, set()).add(p)
    signed = cn.signatures(sets)
    assert {r.result_instance_id: r.n for r in signed.collect()} == {s: len(m) for s, m in of.items()}
    references = [1, 2, 60, 61, 77]
    found = {tuple(r) for r in cn.subsets_of(sets, signed, references).collect()}
    want = {(r, s, len(of[s])) for r in references if r in of for s in of if s != r and of[s] <= of[r]}
    assert found == want and (1, 60, 900) in want and (60, 1, 900) in want and len(want) > 10
    assert cn.subsets_of(sets, signed, [77]).count() == 0


def test_signatures_prune_before_members_are_read(spark, monkeypatch):
    sets = spark.createDataFrame(random_sets(3), "result_instance_id bigint, patient_num bigint")
    seen = []
    monkeypatch.setattr(cn, "fits_broadcast", lambda df: seen.append(df.count()) or True)
    found = cn.subsets_of(sets, cn.signatures(sets), [1]).count()
    assert found <= seen[0] <= found + 3  # of 60 sets


def test_subsets_of_a_study(spark, tmp_path):
    star = small_star(spark, [(100, 1), (100, 2), (100, 99), (105, 2), (200, 2), (200, 3)])
    assert {tuple(r) for r in Study(spark, star, RULES).subsets_of(100, 200).collect()} == {(100, 105, 1), (200, 105, 1)}
    assert st.cmp is cmp
