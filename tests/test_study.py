import json

import pytest
from pyspark.sql import functions as F

from cohortlift import Rules, Star, StageTables, Study, catalog_star, read_star
from cohortlift.operators import counts as ct
from cohortlift.plans import study as st
from cohortlift.sources import retail
from cohortlift.sources.stage import shared_folder
from cohortlift.sources.star import SCHEMAS, TABLE_NAMES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def study(spark):
    stage = StageTables(spark)
    return Study(spark, retail.retail_star(spark, DATA, stage), retail.retail_rules(), stage)


def codes_of(df):
    return [r.ccd for r in df.collect()]


def test_shared_tables_hold_their_keys(study):
    assert study.key_violations().collect() == []


def test_invariants(study):
    counts = study.compute_cohorts({"A": retail.BUILDING, "B": retail.NOBODY})
    counts = ct.with_zeros(counts, study.population_counts(), ["A", "B"])
    joined = counts.join(study.population_counts(), "ccd")
    bad = joined.where("cnt > total or frc < 0 or frc > 1 or frc_total <= 0 or frc_total > 1")
    assert bad.count() == 0
    assert joined.count() == 2 * study.population_counts().count()


@pytest.mark.parametrize("partitions", [2, 50])
@pytest.mark.parametrize("broadcast", ["-1", "10m"])
@pytest.mark.parametrize("per_bucket", [0, 1_000_000])
def test_cohorts_do_not_shuffle_the_pairs(study, plan, monkeypatch, partitions, broadcast, per_bucket):
    """With more or fewer shuffle partitions than buckets, hashed or sorted."""
    study.population_counts()
    monkeypatch.setattr(ct, "MEMBERS_PER_BUCKET", per_bucket)
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.autoBroadcastJoinThreshold": broadcast,
    }
    before = {key: study.spark.conf.get(key) for key in conf}
    try:
        for key, value in conf.items():
            study.spark.conf.set(key, value)
        text = plan(study.compute_cohorts({"A": retail.BUILDING}))
    finally:
        for key, value in before.items():
            study.spark.conf.set(key, value)
    if per_bucket == 0 and broadcast == "10m":
        assert "BroadcastHashJoin [pn" in text  # AQE found the few members to be small
        return
    join = "ShuffledHashJoin [pn" if per_bucket else "SortMergeJoin [pn"
    scan = text[text.index(join) : text.index("_pairs[")]
    assert "Exchange" not in scan
    assert "Bucketed: true" in text


def test_active_filter_reaches_the_files(study, plan):
    from cohortlift.operators.concepts import active_patients

    text = plan(active_patients(study.star.facts, study.rules.active))
    assert "StartsWith(concept_cd" in text.replace("#", "(").replace("StringStartsWith", "StartsWith")
    assert "valueflag_cd" not in text


def test_patient_set_against_population(study):
    run = study.run(patient_set=retail.BUILDING, limit=10)
    assert run.ok and run.cohort_id == "M11_I101_R1"
    found = codes_of(run.result)
    assert found[0] == "TOTAL" and len(found) == len(set(found)) == 21
    everything = study.run(patient_set=retail.BUILDING, limit="ALL").result
    ordered = codes_of(everything)
    assert ordered[1:11] == found[1:11]
    assert set(found) <= set(ordered)
    body = json.loads(run.payload())
    assert body["status"] == st.DONE and len(body["rows"]) == 21
    with pytest.raises(ValueError, match="write_payload"):
        run.payload(most_rows=20)


def test_whole_payload_of_many_domains(spark, tmp_path):
    from cohortlift.sources import sinks

    result = spark.range(12_000).select(F.col("id").cast("string").alias("ccd"))
    schemes = spark.range(12_000).select(
        F.concat(F.lit("D"), "id").alias("c_name"), F.lit("a domain").alias("c_description")
    )
    sinks.write_payload(result, schemes, "fine", f"{tmp_path}/payload")
    lines = sinks.read_payload(spark, f"{tmp_path}/payload").groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in lines} == {"rows": 12_000, "prefixes": 12_000, "status": 1}


def test_buckets_for_any_number_of_patients():
    assert st.choose_buckets(1_000_000, 8, 40) == 40
    assert st.choose_buckets(1_000_000, 8, 200) == st.choose_buckets(1_000_000, 8, 4) == 10
    assert st.choose_buckets(10**9, 1_000, 200) == 10_000
    assert st.choose_buckets(10**10, 1_000, 200) == st.choose_buckets(10**12, 1_000, 90_000) == 20_000


def test_small_cohorts(study):
    one = study.run(patient_set=retail.ONE_CUSTOMER, limit=3)
    assert one.ok and one.result.first().test == 1
    nobody = study.run(patient_set=retail.NOBODY, limit=3)
    assert nobody.ok and nobody.result.first().test == 0
    assert {r.test for r in nobody.result.collect()} == {0}


def test_pair_of_sets(study):
    run = study.run(test=retail.BUILDING_NEAR, reference=retail.BUILDING, limit=5, cutoff=2)
    assert run.ok
    total = run.result.first()
    assert (total.ccd, total.frc_ref, total.frc_test) == ("TOTAL", 1.0, 1.0)
    assert total.ref > total.test > 0
    assert all(r.ref >= r.test and r.ref >= 2 for r in run.result.collect())


def test_refusals(study):
    def status(**request):
        run = study.run(**request)
        assert run.result is None and not run.ok
        assert json.loads(run.payload())["rows"] == []
        return run.status

    assert status(test=1, reference=1) == st.IDENTICAL
    assert status(test=retail.MACHINERY, reference=retail.BUILDING) == st.NOT_A_SUBSET
    assert status(patient_set=77) == st.UNKNOWN_SET.format(77)
    assert status(query_master=77) == st.UNKNOWN_QUERY.format(77)
    assert status(query_master=14) == st.UNKNOWN_QUERY.format(14)  # its set has no members
    with pytest.raises(ValueError):
        study.run()
    with pytest.raises(ValueError):
        study.run(test=1)
    with pytest.raises(ValueError):
        study.run(patient_set=retail.BUILDING, limit="few")


def small_star(spark, members, extra_facts=()):
    facts = [(p, "V:in", None) for p in range(30)] + [(p, "A:1", None) for p in range(0, 30, 2)]
    facts += [(p, "LAB:1", "H") for p in range(12)] + [(p, "LAB:1", None) for p in range(12, 25)]
    facts += list(extra_facts)
    data = {
        "facts": facts,
        "concepts": [("\\l\\1\\x\\", "LAB:1", "leaf lab"), ("\\a\\", "A:1", "an a")],
        "ontology": [("LOINC:123-4", "\\l\\1\\", "lab", "\\l\\1\\", 25, "FA")],
        "schemes": [("LOINC:", "LOINC", "labs")],
        "query_masters": [(1,), (2,)],
        "query_instances": [(10, 1), (11, 1), (20, 2)],
        "query_results": [(100, 10, 1), (105, 11, 1), (200, 20, 1)],
        "patient_sets": members,
    }
    return Star(**{t: spark.createDataFrame(rows, SCHEMAS[t]) for t, rows in data.items()})


RULES = Rules(active="concept_cd LIKE 'V:%'")


def poison(study, cohort_id):
    """Change a stored count, to see whether the stored result is used."""
    stored = study.store().cohort(cohort_id)
    study.store().write(stored.withColumn("cnt", F.when(F.col("ccd") == "A:1", 9).otherwise(F.col("cnt"))))


def count_of(run, code):
    return {r.ccd: r.test for r in run.result.collect()}[code]


def test_stored_results_are_used_while_their_members_hold(spark):
    members = [(100, p) for p in range(6)] + [(105, p) for p in range(10)]
    stage = StageTables(spark)
    study = Study(spark, small_star(spark, members), RULES, stage)

    absent = study.run(patient_set=100, only_existing=True)
    assert absent.status == st.NO_STORED_SET.format(100)
    assert study.export(100).status == absent.status
    assert study.run(query_master=1, only_existing=True).status == st.NO_STORED_QUERY.format(1)
    assert study.run(test=100, reference=105, only_existing=True).status == st.NO_STORED_SET.format(105)

    assert count_of(study.run(patient_set=100), "A:1") == 3
    assert study.run(test=100, reference=105, only_existing=True).status == st.NO_STORED_SET.format(105)
    poison(study, "M1_I10_R100")
    assert count_of(study.run(patient_set=100), "A:1") == 9
    assert count_of(study.run(patient_set=100, only_existing=True), "A:1") == 9
    assert study.export(100).ok

    # Another member set under the same id: counted again, and only that cohort.
    study.run(patient_set=105)
    poison(study, "M1_I11_R105")
    changed = [(100, p) for p in range(1, 7)] + [(105, p) for p in range(10)]
    again = Study(spark, small_star(spark, changed), RULES, stage)
    assert count_of(again.run(patient_set=100), "A:1") == 3
    assert count_of(again.run(patient_set=105), "A:1") == 9


def test_query_master_uses_its_latest_set_or_an_equal_stored_one(spark):
    members = [(100, p) for p in range(6)] + [(105, p) for p in range(6)]
    stage = StageTables(spark)
    study = Study(spark, small_star(spark, members), RULES, stage)
    assert study.run(query_master=2).status == st.UNKNOWN_QUERY.format(2)
    study.run(patient_set=100)
    # The latest set 105 has the same members as the stored 100.
    assert study.run(query_master=1).cohort_id == "M1_I10_R100"
    grown = Study(spark, small_star(spark, members + [(105, 8)]), RULES, stage)
    run = grown.run(query_master=1)
    assert run.cohort_id == "M1_I11_R105"
    assert run.result.first().test == 7
    assert grown.run(query_master=1, only_existing=True).cohort_id == "M1_I11_R105"


@pytest.mark.parametrize("mode", ["static", "dynamic"])
def test_rebuild_follows_changed_facts(spark, mode):
    members = [(100, p) for p in range(6)]
    stage = StageTables(spark)
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, mode)
        study = Study(spark, small_star(spark, members), RULES, stage)
        assert count_of(study.run(patient_set=100), "A:1") == 3
        old = study.population_counts()
        more = Study(spark, small_star(spark, members, [(1, "A:1", None)]), RULES, stage)
        assert count_of(more.run(patient_set=100), "A:1") == 3
        more.rebuild()
        assert more.store().newest(result=100) is None
        assert count_of(more.run(patient_set=100), "A:1") == 4
        counted = {r.ccd: r.total for r in more.population_counts().collect()}
        assert counted["A:1"] == 16 and {r.ccd: r.total for r in old.collect()}["A:1"] == 15
        more.tables.clean()
        assert count_of(more.run(patient_set=100), "A:1") == 4
    finally:
        spark.conf.set(key, before)


def test_another_session_finds_the_tables_and_changed_rules_make_others(spark, tmp_path):
    members = [(100, p) for p in range(6)]
    star = small_star(spark, members)
    first = Study(spark, star, RULES, StageTables(spark, "site", str(tmp_path)))
    assert count_of(first.run(patient_set=100), "A:1") == 3

    def nothing():
        raise AssertionError("built again")

    other = spark.newSession()
    for name in [t for t in other.catalog.listTables() if t.name.startswith("cohortlift_")]:
        other.sql(f"DROP TABLE {name.name}")  # as in another application, whose catalog is empty
    again = Study(other, star, RULES, StageTables(other, "site", str(tmp_path)))
    for table in ("active", "branch_map", "pairs", "population"):
        assert again.tables.table(table, nothing).count() > 0
    assert again.tables.bucket_count("pairs") == first.tables.bucket_count("pairs")
    assert again.store().newest(result=100).n == 6
    stricter = Study(other, star, Rules(active=RULES.active, min_total=20), StageTables(other, "site", str(tmp_path)))
    assert "A:1" not in codes_of(stricter.population_counts())
    assert "A:1" in codes_of(again.population_counts())


def test_requests_read_one_stored_cohort(spark, plan):
    members = [(r, p) for r in range(100, 130) for p in range(r % 7)]
    data = small_star(spark, members)
    star = Star(
        **{t: getattr(data, t) for t in SCHEMAS if t not in ("query_instances", "query_results")},
        query_instances=spark.createDataFrame([(10, 1)], SCHEMAS["query_instances"]),
        query_results=spark.createDataFrame([(r, 10, 1) for r in range(100, 130)], SCHEMAS["query_results"]),
    )
    study = Study(spark, star, RULES)
    study.ensure_cohorts(*range(100, 130))
    assert len(study.store().find(master=1)) == 30
    stored = study.store().newest(result=104)
    assert (stored.cohort_id, stored.n) == ("M1_I10_R104", 6)
    files = study.store().counts(stored).inputFiles()
    assert files and all("cohort_id=M1_I10_R104/" in f for f in files)


def test_the_reserved_code_is_refused(spark):
    members = [(100, p) for p in range(6)]
    study = Study(spark, small_star(spark, members, [(p, "TOTAL", None) for p in range(20)]), RULES)
    with pytest.raises(ValueError, match="reserved"):
        study.run(patient_set=100)


def test_one_master_reads_its_own_memberships(study, plan):
    from cohortlift.operators import cohorts as co

    t = study.star
    resolved = co.resolve_query(t.query_masters, t.query_instances, t.query_results, t.patient_sets, 11)
    text = plan(resolved)
    assert "PushedFilters: [In(result_instance_id, [1,2])" in text.replace("IsNotNull(result_instance_id), ", "")
    assert resolved.count() == 1


def test_inactive_members_do_not_count(spark):
    members = [(100, 0), (100, 1), (100, 77)]
    study = Study(spark, small_star(spark, members), RULES)
    assert study.run(patient_set=100).result.first().test == 2


def test_readers_give_the_same_star(spark, tmp_path):
    star = small_star(spark, [(100, p) for p in range(6)])
    for fmt, options in (("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"header": True})):
        root = str(tmp_path / fmt)
        for t, name in TABLE_NAMES.items():
            df = getattr(star, t).withColumn("not_used", F.lit(1))
            df.write.format(fmt).options(**options).save(f"{root}/{name}")
        back = read_star(spark, root, fmt, **options)
        for t in TABLE_NAMES:
            got, want = getattr(back, t), getattr(star, t)
            assert got.schema.simpleString() == want.schema.simpleString()
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), (fmt, t)
    # Only the needed columns are read.
    text = read_star(spark, str(tmp_path / "parquet")).facts._jdf.queryExecution().executedPlan().toString()
    assert "not_used" not in text


def test_catalog_reader_and_missing_columns(spark, tmp_path):
    star = small_star(spark, [(100, p) for p in range(6)])
    spark.sql(f"CREATE DATABASE IF NOT EXISTS crc LOCATION '{tmp_path}/crc'")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS meta LOCATION '{tmp_path}/meta'")
    names = {**TABLE_NAMES, "ontology": "terms"}
    for t, name in names.items():
        home = "meta" if t in ("ontology", "schemes") else "crc"
        getattr(star, t).write.mode("overwrite").saveAsTable(f"{home}.{name}")
    back = catalog_star(spark, "crc", "meta", {"ontology": "terms"})
    assert back.ontology.count() == 1
    assert Study(spark, back, RULES).run(patient_set=100).result.first().test == 6
    for home in ("crc", "meta"):
        spark.sql(f"DROP DATABASE {home} CASCADE")
    tables = {t: getattr(star, t) for t in SCHEMAS}
    with pytest.raises(ValueError, match="no column valueflag_cd"):
        Star(**{**tables, "facts": star.facts.drop("valueflag_cd")})


class FakeSession:
    """A session as far as the choice of the shared folder goes."""

    def __init__(self, master, named=None, made=None):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self
        self.master = master
        self.made = made

    def getCheckpointDir(self):
        return self.made

    def setCheckpointDir(self, folder):
        self.made = f"file:{folder}/id"


def test_shared_folder(spark):
    assert shared_folder(FakeSession("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert shared_folder(FakeSession("yarn", None, "hdfs:///made")) == "hdfs:///made"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(FakeSession("yarn"))
    local = FakeSession("local[2]")
    assert shared_folder(local) == shared_folder(local) == local.made
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")


def test_settings_hold_only_while_a_table_is_written(spark):
    key = "spark.sql.codegen.aggregate.map.twolevel.enabled"
    before = spark.conf.get(key)
    seen = []

    def build():
        seen.append(spark.conf.get(key))
        return spark.range(3)

    stage = StageTables(spark)
    assert stage.table("t", build, conf={key: "false"}).count() == 3
    assert stage.table("t", build, conf={key: "false"}).count() == 3
    assert seen == ["false"] and spark.conf.get(key) == before
    stage.drop("t")
    assert not stage.exists("t")
