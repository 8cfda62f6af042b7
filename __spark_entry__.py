"""

All queries run over the whole tables of one star (``cohortlift.sources.retail``). The tables shared
by many of them are written once per application and data folder, as a site would do, and then read.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import sql_equivalents  # noqa: E402
from cohortlift import StageTables, Study  # noqa: E402
from cohortlift.operators import cohorts, compare, concepts, counts, ontology, report  # noqa: E402
from cohortlift.sources import retail, sinks  # noqa: E402
from cohortlift.sources.ranked import Ranked  # noqa: E402
from cohortlift.sources.stage import shared_folder  # noqa: E402
from cohortlift.sources.star import growing_facts  # noqa: E402

try:
    import cohortlift.llm.registry as llm  # noqa: E402
except ModuleNotFoundError as error:
    if not (error.name or "").startswith("cohortlift.llm"):
        raise
    llm = None
try:
    import corpus_pipeline  # noqa: E402
except ModuleNotFoundError as error:
    if error.name != "corpus_pipeline" and not (error.name or "").startswith("cohortlift.llm"):
        raise
    corpus_pipeline = None

SETS = {
    "M11_I101_R1": retail.BUILDING,
    "M11_I102_R2": retail.BUILDING_NEAR,
    "M12_I103_R3": retail.MACHINERY,
    "M13_I104_R4": retail.ONE_CUSTOMER,
    "M14_I105_R5": retail.NOBODY,
}
BUILDING = "M11_I101_R1"
BUILDING_NEAR = "M11_I102_R2"

_studies: dict[tuple[str, str, str], Study] = {}


def study(spark: SparkSession, sf_dir: str) -> Study:
    """The study over one data folder; its shared tables live as long as the application."""
    key = (spark.sparkContext.applicationId, shared_folder(spark), sf_dir)
    if key not in _studies:
        stage = StageTables(spark)
        star = retail.retail_star(spark, sf_dir, stage)
        _studies[key] = Study(spark, star, retail.retail_rules(), stage)
    return _studies[key]


def site_study(spark: SparkSession, sf_dir: str, **rules) -> Study:
    """The study over the star with every kind of code; studies of one folder share its tables."""
    key = (spark.sparkContext.applicationId, shared_folder(spark), f"site of {sf_dir}")
    if key not in _studies:
        stage = StageTables(spark)
        _studies[key] = Study(spark, retail.site_star(spark, sf_dir, stage), retail.site_rules(), stage)
    first = _studies[key]
    return Study(spark, first.star, replace(first.rules, **rules), first.stage) if rules else first


def _rounded(df: DataFrame) -> DataFrame:
    """Round doubles, so that the last bits of either engine do not count."""
    digits = {"chisq": 6}
    return df.withColumns(
        {
            name: F.round(F.col(name), digits.get(name, 8))
            for name, kind in df.dtypes
            if kind == "double"
        }
    )


def _counts(s: Study, *cohort_ids: str) -> DataFrame:
    return s.compute_cohorts({c: SETS[c] for c in cohort_ids}).drop("members_hash")


def _scores(s: Study, cutoff: float | None = None) -> DataFrame:
    """Scores of the BUILDING customers, from their stored counts."""
    cohort_id, size = s.ensure_cohorts(retail.BUILDING)[retail.BUILDING]
    return compare.concept_scores(
        s.population_counts(), s.store().cohort(cohort_id), None, cutoff, size
    )


def active_patients(s: Study) -> DataFrame:
    return concepts.active_patients(s.star.facts, s.rules.active)


def ontology_branches(s: Study) -> DataFrame:
    return s.branches().select("c_basecode", "c_dimcode", "c_name", "c_totalnum", "is_vf")


def concept_branch_map(s: Study) -> DataFrame:
    return ontology.concept_branch_map(s.branches(), s.star.concepts, s.rules.separator)


def concept_rollup(s: Study) -> DataFrame:
    return concepts.concept_rollup(s.branch_map(), s.star.facts, s.active(), partitions=s.fact_partitions())


def abnormal_flags(s: Study) -> DataFrame:
    return concepts.abnormal_flags(s.branch_map(), s.star.facts, s.active(), partitions=s.fact_partitions())


def patient_concepts(s: Study) -> DataFrame:
    expansion = concepts.code_expansion(s.branch_map())
    return concepts.patient_concepts(s.star.facts, s.active(), expansion, s.fact_partitions())


def concept_names(s: Study) -> DataFrame:
    return s.concept_names()


def population_counts(s: Study) -> DataFrame:
    return _rounded(
        counts.population_counts(s.patient_concepts(), s.concept_names(), s.n_active())
    )


def concept_schemes(s: Study) -> DataFrame:
    return counts.concept_schemes(s.population_counts(), s.star.schemes)


def domain_list(s: Study) -> DataFrame:
    return compare.domain_list(s.schemes())


def scheme_filter(s: Study) -> DataFrame:
    return compare.scheme_filter(s.schemes(), ["PRIO:", "LAB|1"])


def resolve_query(s: Study) -> DataFrame:
    t = s.star
    return cohorts.resolve_query(t.query_masters, t.query_instances, t.query_results, t.patient_sets)


def resolve_patient_set(s: Study) -> DataFrame:
    t = s.star
    return cohorts.resolve_patient_set(t.query_masters, t.query_instances, t.query_results)


def cohort_members(s: Study) -> DataFrame:
    return cohorts.cohort(s.star.patient_sets, s.active(), retail.BUILDING)


def cohort_counts(s: Study) -> DataFrame:
    return _rounded(counts.with_zeros(_counts(s, *SETS), s.population_counts(), list(SETS)))


def counts_wide(s: Study) -> DataFrame:
    ids = [BUILDING, BUILDING_NEAR]
    return _rounded(counts.counts_wide(s.population_counts(), _counts(s, *ids), ids))


def subset_check(s: Study) -> DataFrame:
    def check(test: int, reference: int) -> DataFrame:
        return cohorts.subset_check(s.star.patient_sets, test, reference).select(
            F.lit(test).alias("test_set"), F.lit(reference).alias("reference_set"), "n_missing"
        )

    return check(retail.BUILDING_NEAR, retail.BUILDING).union(
        check(retail.MACHINERY, retail.BUILDING)
    )


def duplicate_keys(s: Study) -> DataFrame:
    return counts.duplicate_keys(s.star.facts, ["patient_num", "concept_cd"], s.fact_partitions())


def key_violations(s: Study) -> DataFrame:
    """The shared tables, which hold their keys, and the facts, where patient and code do repeat."""
    keys = ["patient_num", "concept_cd"]
    facts = counts.key_violations("facts", s.star.facts, keys, s.fact_partitions())
    return s.key_violations().unionByName(facts)


def chi2_scores(s: Study) -> DataFrame:
    return _rounded(_scores(s))


def compare_population(s: Study) -> DataFrame:
    return _rounded(compare.placed(compare.compare(_scores(s), s.schemes(), limit=10)))


def compare_filtered(s: Study) -> DataFrame:
    return _rounded(compare.compare(_scores(s, cutoff=50), s.schemes(), None, ["LOINC:", "SEG"]))


def compare_by_chisq(s: Study) -> DataFrame:
    result = compare.compare(_scores(s), s.schemes(), limit=25, rank_by="chisq")
    return _rounded(compare.placed(result, "chisq"))


def compare_cohorts(s: Study) -> DataFrame:
    """The two-set request as a user runs it: subset check, stored counts, comparison."""
    run = s.run(test=retail.BUILDING_NEAR, reference=retail.BUILDING, limit=15)
    return _rounded(compare.placed(run.result))


def compare_query(s: Study) -> DataFrame:
    """The query-master request: its latest patient set against the population."""
    return _rounded(compare.placed(s.run(query_master=11, limit=12).result))


def existing_cohort(s: Study) -> DataFrame:
    s.ensure_cohorts(retail.BUILDING, retail.MACHINERY)
    store = s.store()
    found = store.newest(result=retail.MACHINERY)
    return _rounded(counts.with_zeros(store.counts(found), s.population_counts(), [found.cohort_id]))


def export_whole(s: Study) -> DataFrame:
    """The preset of the CSV export: stored result, no limit, every domain, cutoff 1."""
    s.ensure_cohorts(retail.MACHINERY)
    return _rounded(s.export(retail.MACHINERY).result)


def report_table(s: Study) -> DataFrame:
    result = compare.compare(_scores(s), s.schemes(), limit=10)
    table = report.report_table(result, "All customers", "Building")
    # Shortest-digits text of a double is a matter of the engine, so it is checked as a number.
    return table.withColumn("odds_ratio", F.round(F.col("odds_ratio").try_cast("double"), 8))


_RESULT_SCHEMA = (
    "prefix string, ccd string, name string, ref bigint, frc_ref double, test bigint, "
    "frc_test double, chisq double, odds_ratio double, dir int"
)


def _new_path(s: Study, name: str) -> str:
    return f"{s.tables.folder}/{name}_{uuid.uuid4().hex[:8]}"


def write_csv(s: Study) -> DataFrame:
    """A whole comparison written as CSV and read back."""
    path = _new_path(s, "result_csv")
    sinks.write_csv(compare.compare(_scores(s), s.schemes()), path, mode="overwrite")
    return _rounded(sinks.read_csv(s.spark, path, _RESULT_SCHEMA))


def write_json(s: Study) -> DataFrame:
    """A whole comparison written as JSON lines and read back."""
    path = _new_path(s, "result_json")
    sinks.write_json(compare.compare(_scores(s), s.schemes()), path, mode="overwrite")
    return _rounded(s.spark.read.schema(_RESULT_SCHEMA).json(path))


def payload_rows(s: Study) -> DataFrame:
    """The whole payload of a request, any number of rows and domains, written and read back."""
    path = _new_path(s, "payload")
    s.run(patient_set=retail.BUILDING).write_payload(path)
    schema = "ccd string, name string, ref bigint, test bigint"
    none = [F.lit(None).cast("bigint").alias(c) for c in ("ref", "test")]
    rows = s.spark.read.schema(schema).json(f"{path}/rows")
    prefixes = s.spark.read.schema("name string, description string").json(f"{path}/prefixes")
    status = s.spark.read.schema("status string").json(f"{path}/status")
    parts = [
        rows.select(F.lit("rows").alias("kind"), F.col("ccd").alias("item"), F.col("name").alias("label"), "ref", "test"),
        prefixes.select(F.lit("prefixes"), "name", "description", *none),
        status.select(F.lit("status"), "status", F.lit(None).cast("string"), *none),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def _placed_result(s: Study) -> Ranked:
    """The whole comparison of the BUILDING customers, stored in shards."""
    return s.run(patient_set=retail.BUILDING).write_ranked(_new_path(s, "ranked"), shards=8)


def compare_all_placed(s: Study) -> DataFrame:
    """Every code with its place in the whole ranking."""
    return _rounded(_placed_result(s).placed())


def result_page(s: Study) -> DataFrame:
    """Places 101 to 300 of the stored ranking."""
    return _rounded(_placed_result(s).page(101, 300))


def compare_many(s: Study) -> DataFrame:
    """Both ends of every named set in one plan."""
    return _rounded(s.run_many(*SETS.values(), limit=10).result)


def subsets_of(s: Study) -> DataFrame:
    """The patient sets (segments, and customers of a supplier and year) inside two of the segments."""
    return s.subsets_of(retail.BUILDING, retail.MACHINERY)


def cohort_counts_by_words(s: Study) -> DataFrame:
    """The counts of the named sets, common codes by bitmaps."""
    found = s.compute_cohorts_by_words(SETS, by_words=list(SETS)).drop("members_hash")
    return _rounded(counts.with_zeros(found, s.population_counts(), list(SETS)))


def refreshed_counts(s: Study) -> DataFrame:
    """Population and cohort counts after two loads of facts: the second is added to the tables of the first."""
    path = _new_path(s, "growing_facts")
    later = F.xxhash64("patient_num", "concept_cd") < 0
    s.star.facts.where(~later).write.mode("append").parquet(path)
    star = growing_facts(s.star, s.spark, path)
    growing = Study(s.spark, star, s.rules, StageTables(s.spark), incremental=True)
    growing.ensure_cohorts(retail.BUILDING, retail.MACHINERY)
    s.star.facts.where(later).write.mode("append").parquet(path)
    ids = [c for c, _ in growing.ensure_cohorts(retail.BUILDING, retail.MACHINERY).values()]
    store, population = growing.store(), growing.population_counts()
    counted = counts.with_zeros(store.counts_of([store.get(c) for c in ids]), population, ids)
    return _rounded(counted.join(population.select("ccd", "total", "frc_total"), "ccd"))


def fixed_denominator(s: Study) -> DataFrame:
    """Population counts divided by a number that the site gives."""
    other = Study(s.spark, s.star, replace(s.rules, denominator=5_000), s.stage)
    return _rounded(other.population_counts())


def site_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population counts with ICD9 nodes of both lengths, procedure categories by path, LOINC and registry codes."""
    return _rounded(site_study(spark, sf_dir).population_counts())


def strip_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with flags stripped anywhere in a code to find its name and domain."""
    return _rounded(site_study(spark, sf_dir, strip="anywhere").population_counts())


def like_match(s: Study) -> DataFrame:
    """The code map with paths taken as patterns."""
    return ontology.concept_branch_map(s.branches(), s.star.concepts, s.rules.separator, "like")


_QUERIES = [
    active_patients, ontology_branches, concept_branch_map, concept_rollup, abnormal_flags,
    patient_concepts, concept_names, population_counts, concept_schemes, domain_list,
    scheme_filter, resolve_query, resolve_patient_set, cohort_members, cohort_counts,
    counts_wide, subset_check, duplicate_keys, key_violations, chi2_scores, compare_population,
    compare_filtered, compare_by_chisq, compare_cohorts, compare_query, existing_cohort,
    export_whole, report_table, write_csv, write_json, payload_rows, fixed_denominator, like_match,
    compare_all_placed, result_page, compare_many, subsets_of, refreshed_counts,
    cohort_counts_by_words,
]


#: Queries over the star with every kind of code.
_SITE_QUERIES = [site_rules, strip_anywhere]


def entry(spark: SparkSession) -> DataFrame:
    """What sets the BUILDING customers apart from all active customers."""
    return compare_population(study(spark, "/root/testdata/sf0.001"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on_study(query: Callable[[Study], DataFrame]):
        return lambda spark, sf_dir: query(study(spark, sf_dir))

    found: dict[str, Callable] = {q.__name__: on_study(q) for q in _QUERIES}
    found |= {q.__name__: q for q in _SITE_QUERIES}
    if llm:
        found |= llm.queries()
    if corpus_pipeline:
        found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    found = sql_equivalents.build()
    if llm:
        found |= llm.oracle_sql()
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
