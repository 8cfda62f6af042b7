"""Changed inputs are noticed, and added facts are added to the tables without reading the old ones."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cohortlift import Rules, StageTables, Study, read_star
from cohortlift.operators import refresh as rf
from cohortlift.plans import study as st
from cohortlift.sources import snapshot
from cohortlift.sources.star import SCHEMAS, TABLE_NAMES, growing_facts
from tests.test_study import RULES, count_of, small_star

MEMBERS = [(100, p) for p in range(12)] + [(105, p) for p in range(0, 40, 3)] + [(200, p) for p in range(40)]


def append(spark, path, facts, table="facts", format="parquet"):
    spark.createDataFrame(facts, SCHEMAS[table]).coalesce(1).write.mode("append").format(format).save(path)


def some_facts(rng, n):
    codes = ["V:in", "A:1", "A:2", "LAB:1", "LAB:1", "RARE:1", ""]
    return [(rng.randrange(40), rng.choice(codes), rng.choice(["H", "L", "N", None])) for _ in range(n)]


def tables_of(study):
    pairs = sorted(tuple(r) for r in study.patient_concepts().select("pn", "ccd").collect())
    population = sorted(map(str, study.population_counts().collect()))
    ids = study.ensure_cohorts(100, 105, 200)
    from cohortlift.operators import counts as ct

    store, cohorts = study.store(), {}
    for r, (c, n) in ids.items():
        rows = ct.with_zeros(store.cohort(c), study.population_counts(), [c]).collect()
        cohorts[r] = (n, sorted((x.ccd, x.cnt, round(x.frc, 9)) for x in rows))
    return pairs, population, cohorts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_refresh_equals_a_full_build(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(st, "MOST_PARTS", 2)  # the third refresh writes the parts as one
    rng, path = random.Random(seed), str(tmp_path / "facts")
    rules = replace(RULES, min_total=3)
    append(spark, path, some_facts(rng, 60))
    base = small_star(spark, MEMBERS)
    study = Study(spark, growing_facts(base, spark, path), rules, StageTables(spark), incremental=True)
    for load in range(4):
        if load:
            append(spark, path, some_facts(rng, [25, 1, 0, 40][load]))
            assert study.follow()
        got = tables_of(study)
        whole = Study(spark, growing_facts(base, spark, path), rules, StageTables(spark))
        assert got == tables_of(whole)
        assert len(got[0]) == len(set(got[0]))
        assert not study.follow()
    entries = study._entries()
    assert [bool(e["earlier"]) for e in entries] == [True, True, True, False]
    assert [len(study.tables.keyed(e["keys"]).parts("pairs")) for e in entries] == [2, 1, 2, 1]


def test_only_added_facts_are_read(spark, tmp_path):
    """A refresh works where the facts as a whole cannot be read any more, and counts cohorts by the difference."""
    path = str(tmp_path / "facts")
    append(spark, path, [(p, "V:in", None) for p in range(20)] + [(p, "A:1", None) for p in range(30)])
    star = growing_facts(small_star(spark, MEMBERS), spark, path)

    def unreadable():
        broken = star.facts.select(
            F.raise_error(F.lit("old facts were read")).cast("bigint").alias("patient_num"), "concept_cd", "valueflag_cd"
        )
        return replace(star, facts=broken, reread=unreadable)

    study = Study(spark, star, RULES, StageTables(spark), incremental=True)
    study.ensure_cohorts(100, 200)
    assert count_of(study.run(patient_set=200), "A:1") == 20
    study.star = replace(study.star, reread=unreadable)
    calls = []
    count = study.compute_cohorts
    study.compute_cohorts = lambda *a, **k: calls.append(a) or count(*a, **k)
    # Patient 25 becomes active and brings an old code with it; a fact that is there already adds nothing.
    append(spark, path, [(25, "V:in", None), (3, "B:1", None), (4, "A:1", "H"), (5, "A:1", None)])
    run = study.run(patient_set=200)
    assert run.ok and run.result.first().test == 21 and count_of(run, "A:1") == 21
    assert not calls  # counted from the stored counts and the added pairs
    added = {tuple(r) for r in study.tables.parts("more_pairs")[0].collect()}
    assert added == {(25, "V:in"), (25, "A:1"), (3, "B:1")}
    files = study.star.facts_from(snapshot.added(*[study.tables.keyed(e["keys"]).parts("files")[0] for e in study._entries()[::-1]]))
    assert len(files.inputFiles()) == 1
    # A set that was not counted before is counted as a whole.
    study.ensure_cohorts(105)
    assert len(calls) == 1


def test_parts_are_not_shuffled(spark, tmp_path, plan):
    path = str(tmp_path / "facts")
    append(spark, path, [(p, "V:in", None) for p in range(30)])
    study = Study(spark, growing_facts(small_star(spark, MEMBERS), spark, path), RULES, StageTables(spark), incremental=True)
    study.population_counts()
    append(spark, path, [(p, "A:1", None) for p in range(30)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        study.follow()
        study.population_counts()
        assert len(study.tables.parts("pairs")) == 2
        text = plan(study.compute_cohorts({"M1_I10_R100": 100}))
        loaded, earlier = study.tables.parts("loaded")[0], study.tables.keyed(study._entries()[1]["keys"])
        key = "spark.sql.requireAllClusterKeysForCoPartition"
        spark.conf.set(key, "false")
        fresh = plan(rf.new_rows(loaded, earlier.parts("triples")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    for part in text.split("ShuffledHashJoin [pn")[1:]:
        assert "Exchange" not in part[: part.index("_pairs[")] or "more_pairs[" in part
    assert "Exchange" not in fresh


def test_changed_or_removed_files_are_built_anew(spark, tmp_path):
    path = str(tmp_path / "facts")
    append(spark, path, [(p, "V:in", None) for p in range(30)] + [(p, "A:1", None) for p in range(20)])
    star = growing_facts(small_star(spark, MEMBERS), spark, path)
    study = Study(spark, star, RULES, StageTables(spark), incremental=True)
    assert count_of(study.run(patient_set=200), "A:1") == 20
    spark.createDataFrame([(p, "V:in", None) for p in range(25)] + [(p, "A:1", None) for p in range(15)], SCHEMAS["facts"]).write.mode("overwrite").parquet(path)
    run = study.run(patient_set=200)
    assert run.result.first().test == 25 and count_of(run, "A:1") == 15
    assert study._entries()[0]["earlier"] is None


def test_added_facts_are_noticed_without_a_call(spark, tmp_path):
    """In a running study, in a later one, and unchanged ones build nothing."""
    root, stage = str(tmp_path / "star"), str(tmp_path / "stage")
    star = small_star(spark, MEMBERS)
    for t, name in TABLE_NAMES.items():
        getattr(star, t).write.parquet(f"{root}/{name}")

    def open_study():
        return Study(spark, read_star(spark, root), RULES, StageTables(spark, "site", stage))

    study = open_study()
    assert count_of(study.run(patient_set=100), "A:1") == 6
    names = study.tables.files.names(study.tables.folder)
    assert count_of(study.run(patient_set=100), "A:1") == 6 and not study.follow()
    assert open_study().tables.files.names(study.tables.folder) == names
    append(spark, f"{root}/observation_fact", [(1, "A:1", None)])
    assert count_of(study.run(patient_set=100), "A:1") == 7
    append(spark, f"{root}/observation_fact", [(3, "A:1", None)])
    later = open_study()
    assert count_of(later.run(patient_set=100), "A:1") == 8
    assert later.tables.build == study.tables.build
    # New sets are found too, and nothing is built for them.
    names = later.tables.files.names(later.tables.folder)
    append(spark, f"{root}/qt_patient_set_collection", [(100, 20)], "patient_sets")
    assert count_of(later.run(patient_set=100), "A:1") == 9
    assert later.tables.files.names(later.tables.folder) == names


def test_versions_stand_for_inputs_without_files(spark):
    stage, members = StageTables(spark), [(100, p) for p in range(6)]
    first = Study(spark, replace(small_star(spark, members), versions={"facts": "load 1"}), RULES, stage)
    assert count_of(first.run(patient_set=100), "A:1") == 3
    more = replace(small_star(spark, members, [(1, "A:1", None)]), versions={"facts": "load 2"})
    assert count_of(Study(spark, more, RULES, stage).run(patient_set=100), "A:1") == 4
    assert count_of(Study(spark, replace(more, versions={"facts": "load 1"}), RULES, stage).run(patient_set=100), "A:1") == 3


def test_other_rules_share_what_does_not_depend_on_them(spark):
    stage = StageTables(spark)
    star = small_star(spark, MEMBERS)
    study = Study(spark, star, RULES, stage)
    study.run(patient_set=100)
    files = study.tables.files

    def made(rules):
        before = set(files.names(study.tables.folder))
        other = Study(spark, star, rules, stage)
        other.schemes()
        return {n.rsplit("_", 1)[0] for n in set(files.names(study.tables.folder)) - before if n.endswith(".json")}

    assert made(replace(RULES, denominator=99)) == {"population", "schemes"}
    assert made(replace(RULES, strip="anywhere")) == {"population", "schemes"}
    assert made(replace(RULES, match="like")) == {"branch_map", "pairs", "population", "schemes"}
    assert made(Rules(active="concept_cd LIKE 'A:%'")) == {"active", "pairs", "population", "schemes"}
    assert made(RULES) == set()
    # Stored cohorts do not depend on the denominator.
    other = Study(spark, star, replace(RULES, denominator=99), stage)
    assert other.run(patient_set=100, only_existing=True).ok


def test_outdated_members_are_told(spark):
    stage = StageTables(spark)
    study = Study(spark, small_star(spark, [(100, p) for p in range(6)] + [(105, p) for p in range(6)]), RULES, stage)
    study.run(patient_set=100)
    study.run(patient_set=105)
    changed = [(100, p) for p in range(20)] + [(105, p) for p in range(20)]
    again = Study(spark, small_star(spark, changed), RULES, stage)
    for run in (again.run(patient_set=100, only_existing=True), again.export(100)):
        assert run.status == st.OUTDATED_SET.format(100) and run.result is None
    assert again.run(query_master=1, only_existing=True).status == st.OUTDATED_QUERY.format(1)
    assert count_of(again.run(patient_set=100), "A:1") == 10
    assert again.export(100).ok
