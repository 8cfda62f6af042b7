"""A study: the shared tables over one star, and the comparisons run on them."""

from __future__ import annotations

import hashlib
import json
import math
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.functions.codes import TOTAL
from cohortlift.operators import bitmaps as bm
from cohortlift.operators import cohorts as co
from cohortlift.operators import compare as cmp
from cohortlift.operators import concepts as cc
from cohortlift.operators import containment as cn
from cohortlift.operators import counts as ct
from cohortlift.operators import ontology as on
from cohortlift.operators import refresh as rf
from cohortlift.sources import sinks, snapshot
from cohortlift.sources.ranked import Ranked, write_ranked
from cohortlift.sources.stage import CohortStore, StageTables, Stored
from cohortlift.sources.star import Star, conform

# The status texts of a run.
DONE = "Done, chi success!"
IDENTICAL = "Job canceled, identical patient sets"
NOT_A_SUBSET = "Job canceled, all patients in test subset must be in the reference set"
NO_STORED_SET = "No data for PSID {0}, try running without only_existing"
NO_STORED_QUERY = "No data for QMID {0}, try running without only_existing"
OUTDATED_SET = "Outdated data for PSID {0}, its members have changed, try running without only_existing"
OUTDATED_QUERY = "Outdated data for QMID {0}, its members have changed, try running without only_existing"
UNKNOWN_SET = "ERROR, patient set (PSID={0}) not found in QT tables"
UNKNOWN_QUERY = "ERROR, QMID {0} has no patient set result instance"

#: A patient has about a hundred pairs, of about 20 bytes each in a file: about 200 MB a bucket.
PATIENTS_PER_BUCKET = 100_000
#: Facts whose codes and branches a task holds by patient, in a few hundred MB.
FACTS_PER_BUCKET = 600_000
#: More patients than that make larger buckets, whose joins sort and spill; the result is the same.
MOST_BUCKETS = 20_000

#: Parts that a refreshed table has at most before it is written as one.
MOST_PARTS = 8

# What each shared table is made from: rules and inputs. Made from something else it is another table.
_ACTIVE = ("active",)
_MAP = ("branch", "value_flag", "every_branch", "separator", "match")
_MAP_INPUTS = ("ontology", "concepts")
_DEPENDS = {
    "files": ((), ("facts",)),
    "active": (_ACTIVE, ("facts",)),
    "branch_map": (_MAP, _MAP_INPUTS),
    "pairs": (_ACTIVE + _MAP, ("facts", *_MAP_INPUTS)),
    "cohorts": ((*_ACTIVE, *_MAP, "min_total"), ("facts", *_MAP_INPUTS)),
    "population": ((*_ACTIVE, *_MAP, "min_total", "denominator", "strip"), ("facts", *_MAP_INPUTS)),
    "schemes": ((*_ACTIVE, *_MAP, "min_total", "denominator", "strip"), ("facts", *_MAP_INPUTS, "schemes")),
    "signatures": ((), ("patient_sets",)),
    "refresh": (_ACTIVE + _MAP, _MAP_INPUTS),  # what must be equal for a refresh by added facts
}
_LIKE_PAIRS = ("numbers", "words", "common", "rare_pairs", "triples", "totals", "loaded", "more_triples", "newly_active", "candidates", "more_pairs")

# Nearly all keys of the distinct facts are new, so a small first-level hash map only costs time.
MANY_KEYS = {"spark.sql.codegen.aggregate.map.twolevel.enabled": "false"}


@dataclass(frozen=True)
class Rules:
    """What a site calls an active patient and which ontology nodes count as branches."""

    active: on.Predicate
    branch: on.Predicate = field(default_factory=lambda: on.BRANCH_PATTERNS)
    value_flag: on.Predicate = field(default_factory=lambda: on.VALUE_FLAG_PATTERNS)
    every_branch: on.Predicate | None = None
    separator: str = "\\"
    match: str = "prefix"
    min_total: int = 10
    denominator: int | None = None
    strip: str = "leading"


@dataclass(frozen=True)
class Run:
    """Outcome of a request. ``result`` is None unless ``status`` is :data:`DONE`."""

    status: str
    result: DataFrame | None = None
    cohort_id: str | None = None
    limit: int | None = None
    schemes: DataFrame | None = None
    rank_by: str = "odds_ratio"

    @property
    def ok(self) -> bool:
        return self.status == DONE

    def payload(self, most_rows: int = sinks.REPORT_ROWS) -> str:
        """The report as one JSON text, of at most ``most_rows`` rows; :meth:`write_payload` has no bound."""
        return sinks.payload(self.result, self.status, self.limit, most_rows)

    def write_payload(self, path: str) -> None:
        """The whole result and its domains as JSON lines, of any size."""
        if self.result is None:
            raise ValueError(self.status)
        sinks.write_payload(self.result, self.schemes, self.status, path)

    def write_ranked(self, path: str, shards: int | None = None) -> Ranked:
        """The whole result in shards of consecutive places, of which pages are read."""
        if self.result is None:
            raise ValueError(self.status)
        return write_ranked(self.result, cmp.result_order(self.rank_by), path, shards)


@dataclass(frozen=True)
class Runs:
    """Outcome of a request for many cohorts: their rows with a ``cohort_id``, and the sets that do not exist."""

    result: DataFrame | None
    cohort_ids: dict[int, str]
    unknown: list[int]


class Study:
    """Shared tables are written when first needed and read from then on.

    A table is named by the rules and the state of the inputs that it is made from, so other rules share what does
    not depend on them, and changed input files make new tables, whether they change between applications or while
    one runs: every request looks. Inputs without files or version (:class:`Star`) are taken not to change.

    An ``incremental`` study keeps the distinct facts of all patients as well. If facts were only added since its
    newest tables, it reads the added ones alone, and adds to pairs, counts and stored cohorts.
    """

    def __init__(
        self,
        spark: SparkSession,
        star: Star,
        rules: Rules,
        stage: StageTables | None = None,
        incremental: bool = False,
    ):
        self.spark = spark
        self.star = star
        self.rules = rules
        self.stage = stage or StageTables(spark)
        self.incremental = incremental
        self.tables = self.stage.variant("shared")
        self._settle(self._digests())

    # Inputs

    def _digests(self) -> dict[str, str]:
        return snapshot.digests(self.spark, self.star.sources, self.star.versions)

    def _settle(self, inputs: dict[str, str]) -> None:
        """Use the tables of this state of the inputs."""
        self._inputs = inputs
        keys = {}
        for name, (rules, tables) in _DEPENDS.items():
            made_from = [repr(getattr(self.rules, r)) for r in rules] + [inputs.get(t, "") for t in tables]
            keys[name] = hashlib.sha256("\n".join(made_from).encode()).hexdigest()[:12]
        self.tables = self.tables.keyed(keys | {name: keys["pairs"] for name in _LIKE_PAIRS})
        self._n_active: int | None = None
        self._n_facts: int | None = None
        self._checked = False

    def follow(self) -> bool:
        """Look whether inputs have changed, and if so use tables made from them; every request does this."""
        if not self.star.sources:
            return False
        now = self._digests()
        if now == self._inputs:
            return False
        self._reread()
        self._settle(now)
        return True

    def _reread(self) -> None:
        if self.star.reread:
            self.star = self.star.reread()

    # Refresh by added facts

    def _grow(self) -> None:
        """Make active patients, pairs and totals of an incremental study: from the newest ones, if facts were added."""
        if not self.incremental or self.tables.exists("totals"):
            return
        # First the list of files, then the facts: what comes in between is met again by the next refresh.
        files = self._fact_files()
        self._reread()
        earlier = self._earlier(files)
        if earlier is None:
            self._make_whole()
        else:
            self._make_more(*earlier)
        entry = {"refresh": self.tables.keys["refresh"], "keys": self.tables.keys}
        entry["earlier"] = earlier[0].keys if earlier else None
        self.tables.files.create(f"{self._history()}/{time.time_ns():020d}_{uuid.uuid4().hex[:8]}", json.dumps(entry))

    def _fact_files(self) -> DataFrame | None:
        if "facts" not in self.star.sources:
            return None
        return self.tables.table("files", lambda: snapshot.files(self.spark, self.star.sources["facts"]))

    def _history(self) -> str:
        return f"{self.tables.folder}/history"

    def _entries(self) -> list[dict]:
        """How tables were made, newest first."""
        files = self.tables.files
        return [json.loads(files.read(f"{self._history()}/{n}")) for n in reversed(files.names(self._history()))]

    def _earlier(self, files: DataFrame | None) -> tuple[StageTables, list[str]] | None:
        """The newest tables of the same rules whose fact files are still there, and the files added since."""
        if files is None or self.star.facts_from is None:
            return None
        for entry in self._entries():
            if entry["refresh"] == self.tables.keys["refresh"]:
                tables = self.tables.keyed(entry["keys"])
                added = snapshot.added(tables.parts("files")[0], files)
                return None if added is None else (tables, added)
        return None

    def _make_whole(self) -> None:
        active = self.tables.table("active", lambda: cc.active_patients(self.star.facts, self.rules.active))
        buckets, expansion = self.buckets(), cc.code_expansion(self.branch_map())
        triples = self.tables.table(
            "triples", lambda: rf.known_facts(self.star.facts, buckets), "pn", buckets, MANY_KEYS
        )
        active = active.repartition(buckets, "pn").hint("shuffle_hash")
        pairs = self.tables.table(
            "pairs",
            lambda: cc.expanded(triples.join(active, "pn", "left_semi"), expansion, partitions=buckets),
            "pn",
            buckets,
            MANY_KEYS,
        )
        self.tables.table("totals", lambda: ct.pair_totals(pairs))

    def _make_more(self, earlier: StageTables, files: list[str]) -> None:
        facts = conform(self.star.facts_from(files), "facts") if files else self.star.facts.limit(0)
        t, buckets, expansion = self.tables, earlier.bucket_count("pairs"), cc.code_expansion(self.branch_map())

        def bucketed(name: str, build) -> DataFrame:
            return t.table(name, build, "pn", buckets, rf.IN_BUCKETS)

        loaded = bucketed("loaded", lambda: rf.known_facts(facts, buckets))
        more = bucketed("more_triples", lambda: rf.new_rows(loaded, earlier.parts("triples"), buckets))
        before = reduce(DataFrame.union, earlier.parts("active"))
        newly = t.table(
            "newly_active", lambda: cc.active_patients(facts, self.rules.active).join(before, "pn", "left_anti")
        )
        active = t.table("active", lambda: before.union(newly))
        candidates = bucketed(
            "candidates",
            lambda: rf.pairs_to_add(more, earlier.parts("triples"), active, newly, expansion, buckets),
        )
        more_pairs = bucketed("more_pairs", lambda: rf.new_rows(candidates, earlier.parts("pairs"), buckets))
        for name, added in (("triples", more), ("pairs", more_pairs)):
            parts = earlier.parts(name)
            if len(parts) < MOST_PARTS:
                t.join_parts(name, [(earlier, name), (t, f"more_{name}")])
            else:
                bucketed(name, lambda p=parts, a=added: reduce(DataFrame.union, [*p, a]).repartition(buckets, "pn"))
        totals = reduce(DataFrame.union, earlier.parts("totals"))
        t.table("totals", lambda: rf.added_up(totals, ct.pair_totals(more_pairs), ["ccd"], "total"))

    def _carry_cohorts(self, wanted: dict[str, int], sizes: dict[str, tuple[int, int]]) -> None:
        """Store counts of cohorts that were counted on the tables before, with the pairs added since.

        Holds for cohorts whose members are those of then, but for patients who became active.
        """
        entry = next((e for e in self._entries() if e["keys"] == self.tables.keys), None)
        if not entry or not entry["earlier"]:
            return
        earlier = self.tables.keyed(entry["earlier"])
        old = {c: s for c in wanted if (s := self._store_of(earlier).get(c))}
        if not old:
            return
        sets = {c: wanted[c] for c in old}
        then = co.cohort_members(self.star.patient_sets, earlier.parts("active")[0], sets)
        then = ct.measure_cohorts(then, list(sets))
        old = {c: s for c, s in old.items() if (s.n, s.members_hash) == then[c]}
        if not old:
            return
        sizes = {c: sizes[c] for c in old}
        counted = [self._store_of(earlier).counts(s).where(F.col("ccd") != TOTAL) for s in old.values()]
        more = ct.cohort_hits(
            self.tables.parts("more_pairs"),
            self.members({c: wanted[c] for c in old}),
            sizes,
            self.tables.bucket_count("more_pairs"),
        )
        hits = rf.added_up(reduce(DataFrame.union, counted), more, ["cohort_id", "ccd"], "cnt")
        self.store().write(ct.cohort_fractions(hits, sizes))

    # Shared tables

    def active(self) -> DataFrame:
        self._grow()
        return self.tables.table(
            "active", lambda: cc.active_patients(self.star.facts, self.rules.active)
        )

    def n_active(self) -> int:
        if self._n_active is None:
            self._n_active = self.tables.parts("active")[0].count() if self.tables.exists("active") else self.active().count()
        return self._n_active

    def branches(self) -> DataFrame:
        r = self.rules
        return on.ontology_branches(self.star.ontology, r.branch, r.value_flag, r.every_branch)

    def branch_map(self) -> DataFrame:
        return self.tables.table(
            "branch_map",
            lambda: on.concept_branch_map(
                self.branches(), self.star.concepts, self.rules.separator, self.rules.match
            ),
        )

    def patient_concepts(self) -> DataFrame:
        """Bucketed by patient, so that cohorts of any size are counted without shuffling it."""
        self._grow()

        def build() -> DataFrame:
            return cc.patient_concepts(
                self.star.facts, self.active(), cc.code_expansion(self.branch_map()), self.buckets()
            )

        buckets = None if self.tables.exists("pairs") else self.buckets()
        return self.tables.table("pairs", build, "pn", buckets, MANY_KEYS)

    def buckets(self) -> int:
        """Buckets that keep every core busy and hold a bounded number of patients and of facts each.

        A shuffle setting of like size is taken as it is, so that joins by patient need no other one.
        """
        cores = self.spark.sparkContext.defaultParallelism
        shuffle = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return choose_buckets(self.n_active(), cores, shuffle, self.n_facts())

    def n_facts(self) -> int:
        if self._n_facts is None:
            self._n_facts = self.star.facts.count()
        return self._n_facts

    def fact_partitions(self) -> int:
        """Tasks for work on all facts, so that one holds a bounded number of them."""
        shuffle = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(shuffle, min(MOST_BUCKETS, math.ceil(self.n_facts() / FACTS_PER_BUCKET)))

    def concept_names(self) -> DataFrame:
        return cc.concept_names(self.branches(), self.star.concepts)

    def population_counts(self) -> DataFrame:
        population = self.tables.table("population", self._population)
        if not self._checked:
            if population.where(F.col("ccd") == TOTAL).limit(2).count() > 1:
                self.tables.drop("population")
                raise ValueError(f"{TOTAL!r} is reserved for the row of all patients, but facts have it as a code")
            self._checked = True
        return population

    def _population(self) -> DataFrame:
        r, pairs = self.rules, self.patient_concepts()
        totals = self.tables.parts("totals")[0] if self.incremental else ct.pair_totals(pairs)
        return ct.population_of_totals(
            totals, self.concept_names(), self.n_active(), r.denominator, r.min_total, r.strip
        )

    def schemes(self) -> DataFrame:
        return self.tables.table(
            "schemes", lambda: ct.concept_schemes(self.population_counts(), self.star.schemes)
        )

    def store(self) -> CohortStore:
        """Counts of cohorts on the present tables; others have their own."""
        return self._store_of(self.tables)

    def _store_of(self, tables: StageTables) -> CohortStore:
        return CohortStore(self.spark, f"{tables.folder}/cohorts_{tables.keys['cohorts']}")

    def rebuild(self) -> None:
        """Build the shared tables and the cohorts counted on them anew, for inputs whose changes do not show."""
        self.tables.rebuild()
        self._reread()
        self._settle(self._digests())

    def key_violations(self) -> DataFrame:
        """Rows that break the key of a shared table; empty for sound tables."""
        checks = {
            "active": (self.active(), ["pn"]),
            "pairs": (self.patient_concepts(), ["ccd", "pn"]),
            "population": (self.population_counts(), ["ccd"]),
        }
        found = [ct.key_violations(name, df, keys) for name, (df, keys) in checks.items()]
        return found[0].unionByName(found[1]).unionByName(found[2])

    # Cohorts

    def members(self, sets: dict[str, int]) -> DataFrame:
        return co.cohort_members(self.star.patient_sets, self.active(), sets)

    def compute_cohorts(
        self, sets: dict[str, int], sizes: dict[str, tuple[int, int]] | None = None
    ) -> DataFrame:
        """Counts of several patient sets ``{cohort id: patient set}`` in one pass, not stored.

        Those of an incremental study hold every code, as another may be in the population after a refresh.
        """
        members = self.members(sets)
        sizes = sizes or ct.measure_cohorts(members, list(sets))
        population = self.population_counts()
        hits = ct.cohort_hits(self.tables.parts("pairs"), members, sizes, self.tables.bucket_count("pairs"))
        return ct.cohort_fractions(hits, sizes, None if self.incremental else population)

    # Cohorts by bitmaps

    def bitmaps(self) -> dict[str, DataFrame]:
        """Numbers of the patients, common codes, their words, and the pairs of all other codes; made once."""
        t, pairs = self.tables, self.patient_concepts()
        buckets = t.bucket_count("pairs")
        totals = t.table("totals", lambda: ct.pair_totals(pairs))
        common = t.table("common", lambda: bm.common_codes(totals, self.n_active()))
        numbers = t.table("numbers", lambda: bm.numbered(self.active(), buckets), "pn", buckets)
        words = t.table("words", lambda: bm.code_words(pairs, numbers, common), "word", buckets)
        rare = t.table("rare_pairs", lambda: pairs.join(common, "ccd", "left_anti").select("pn", "ccd"), "pn", buckets)
        return {"numbers": numbers, "common": common, "words": words, "rare_pairs": rare, "totals": totals}

    def compute_cohorts_by_words(
        self, sets: dict[str, int], sizes: dict[str, tuple[int, int]] | None = None, by_words: list[str] | None = None
    ) -> DataFrame:
        """:meth:`compute_cohorts`, with the same rows: common codes by words where a cohort meets fewer of them.

        ``by_words`` names the cohorts that are counted so; the others take the pairs.
        """
        b = self.bitmaps()
        members = self.members(sets)
        sizes = sizes or ct.measure_cohorts(members, list(sets))
        if by_words is None:
            pairs = b["totals"].join(b["common"], "ccd", "left_semi").agg(F.sum("total")).first()[0] or 0
            words = b["words"].count()
            by_words = [c for c, (n, _) in sizes.items() if bm.worth_words(n, self.n_active(), words, pairs)]
        buckets, population = self.tables.bucket_count("pairs"), self.population_counts()
        hits = []
        large = {c: s for c, s in sizes.items() if c in by_words}
        small = {c: s for c, s in sizes.items() if c not in by_words}
        if large:
            chosen = members.where(F.col("cohort_id").isin(list(large)))
            met = bm.cohort_words(chosen, b["numbers"]).repartition(buckets, "word").hint("shuffle_hash")
            hits += [bm.word_hits(b["words"], met), ct.cohort_hits([b["rare_pairs"]], members, large, buckets)]
        if small:
            hits.append(ct.cohort_hits(self.tables.parts("pairs"), members, small, buckets))
        hits = reduce(DataFrame.union, hits)
        return ct.cohort_fractions(hits, sizes, None if self.incremental else population)

    def cohort_ids(self, *patient_sets: int) -> dict[str, int]:
        """``{cohort id: patient set}`` of the patient sets that exist."""
        s = self.star
        found = co.resolve_patient_set(
            s.query_masters, s.query_instances, s.query_results, list(patient_sets)
        ).collect()
        return {row.cohort_id: row.result_instance_id for row in found}

    def ensure_cohorts(self, *patient_sets: int) -> dict[int, tuple[str, int]]:
        """Store the counts of these patient sets unless they are stored already.

        A stored result is used only if the size and the id hash of its members still hold. All
        sets that need work share one pass over the patient x concept table. Gives the cohort id
        and size of every patient set that exists.
        """
        self.follow()
        return self._ensure(self.cohort_ids(*patient_sets))

    def _ensure(self, wanted: dict[str, int]) -> dict[int, tuple[str, int]]:
        if not wanted:
            return {}
        sizes = ct.measure_cohorts(self.members(wanted), list(wanted))
        store = self.store()

        def not_stored(cohorts: dict[str, int]) -> dict[str, int]:
            stored = {c: (s.n, s.members_hash) for c in cohorts if (s := store.get(c))}
            return {c: r for c, r in cohorts.items() if stored.get(c) != sizes[c]}

        missing = not_stored(wanted)
        if missing and self.incremental:
            self.population_counts()
            self._carry_cohorts(missing, sizes)
            missing = not_stored(missing)
        if missing:
            store.write(self.compute_cohorts(missing, {c: sizes[c] for c in missing}))
        return {r: (c, sizes[c][0]) for c, r in wanted.items()}

    # Requests

    def run(
        self,
        query_master: int | None = None,
        patient_set: int | None = None,
        test: int | None = None,
        reference: int | None = None,
        **options,
    ) -> Run:
        """One request: a query master or a patient set against the population, or two sets."""
        if query_master is not None:
            return self.run_query(query_master, **options)
        if patient_set is not None:
            return self.run_patient_set(patient_set, **options)
        if test is not None and reference is not None:
            return self.run_pair(test, reference, **options)
        raise ValueError("name a query master, a patient set, or a test and a reference set")

    def run_query(self, query_master: int, only_existing: bool = False, **options) -> Run:
        """Compare the latest patient set of a query master with the population."""
        self.follow()
        s = self.star
        found = co.resolve_query(
            s.query_masters, s.query_instances, s.query_results, s.patient_sets, query_master
        ).first()
        if found is None:
            return Run(UNKNOWN_QUERY.format(query_master))
        old = self.store().newest(master=query_master)
        if old is None:
            if only_existing:
                return Run(NO_STORED_QUERY.format(query_master))
        elif self._still_holds(old, found.cohort_id, found.result_instance_id):
            return self._compared((old.cohort_id, old.n), None, **options)
        elif only_existing:
            return Run(OUTDATED_QUERY.format(query_master))
        ensured = self._ensure({found.cohort_id: found.result_instance_id})
        return self._compared(ensured[found.result_instance_id], None, **options)

    def run_patient_set(self, patient_set: int, only_existing: bool = False, **options) -> Run:
        """Compare a patient set with the population."""
        self.follow()
        return self._run_sets(patient_set, None, only_existing, options)

    def run_pair(
        self, test: int, reference: int, only_existing: bool = False, **options
    ) -> Run:
        """Compare a patient set with another one that holds all of its patients."""
        if test == reference:
            return Run(IDENTICAL)
        self.follow()
        if co.subset_check(self.star.patient_sets, test, reference).first().n_missing > 0:
            return Run(NOT_A_SUBSET)
        return self._run_sets(test, reference, only_existing, options)

    def export(self, patient_set: int, reference: int | None = None) -> Run:
        """The stored result as a whole: no limit, every domain, reference count at least 1."""
        options = {"only_existing": True, "cutoff": 1}
        if reference is None:
            return self.run_patient_set(patient_set, **options)
        return self.run_pair(patient_set, reference, **options)

    def _run_sets(
        self, test: int, reference: int | None, only_existing: bool, options: dict
    ) -> Run:
        wanted = [test] if reference is None else [reference, test]
        if only_existing:
            found: dict[int, tuple[str, int]] = {}
            for patient_set in wanted:
                newest = self.store().newest(result=patient_set)
                if newest is None:
                    return Run(NO_STORED_SET.format(patient_set))
                if not self._still_holds(newest, newest.cohort_id, patient_set):
                    return Run(OUTDATED_SET.format(patient_set))
                found[patient_set] = (newest.cohort_id, newest.n)
        else:
            found = self._ensure(self.cohort_ids(*wanted))
            for patient_set in wanted:
                if patient_set not in found:
                    return Run(UNKNOWN_SET.format(patient_set))
        return self._compared(found[test], found.get(reference), **options)

    def _still_holds(self, old: Stored, cohort_id: str, patient_set: int) -> bool:
        """Whether a patient set has the members that a stored cohort was counted on; no pairs are read."""
        now = ct.measure_cohorts(self.members({cohort_id: patient_set}), [cohort_id])[cohort_id]
        return (old.n, old.members_hash) == now

    def _compared(
        self,
        test: tuple[str, int],
        reference: tuple[str, int] | None,
        limit: int | str | None = None,
        patterns: list[str] | str | None = None,
        cutoff: float | None = None,
        rank_by: str = "odds_ratio",
    ) -> Run:
        limit = cmp.parse_limit(limit)
        store = self.store()
        scored = cmp.concept_scores(
            self.population_counts(),
            store.cohort(test[0]),
            None if reference is None else store.cohort(reference[0]),
            cutoff,
            test[1],
        )
        result = cmp.compare(scored, self.schemes(), limit, patterns, rank_by)
        return Run(DONE, result, test[0], limit, self.schemes(), rank_by)

    def run_many(
        self,
        *patient_sets: int,
        limit: int | str | None = None,
        patterns: list[str] | str | None = None,
        cutoff: float | None = None,
        rank_by: str = "odds_ratio",
    ) -> Runs:
        """Compare many patient sets with the population in one plan; rows equal those of a request for each."""
        limit = cmp.parse_limit(limit)
        found = self.ensure_cohorts(*patient_sets)
        unknown = [s for s in patient_sets if s not in found]
        if not found:
            return Runs(None, {}, unknown)
        store = self.store()
        counts = store.counts_of([store.get(c) for c, _ in found.values()])
        scored = cmp.scores_of_many(self.population_counts(), counts, dict(found.values()), None, cutoff)
        result = cmp.compare_many(scored, self.schemes(), limit, patterns, rank_by)
        return Runs(result, {r: c for r, (c, _) in found.items()}, unknown)

    # Containment

    def set_signatures(self) -> DataFrame:
        """Sizes and hashed bits of all patient sets; stored if changes of the sets would show."""
        sets = self.star.patient_sets
        if "patient_sets" not in self._inputs:
            return cn.signatures(sets)
        return self.tables.table("signatures", lambda: cn.signatures(sets))

    def subsets_of(self, *references: int) -> DataFrame:
        """``reference_set, subset, n``: the patient sets inside each reference."""
        self.follow()
        return cn.subsets_of(self.star.patient_sets, self.set_signatures(), list(references))


def choose_buckets(patients: int, cores: int, shuffle: int, facts: int = 0) -> int:
    """Buckets for a table by patient: enough for every core, of bounded size, never more than Spark allows."""
    sized = max(math.ceil(patients / PATIENTS_PER_BUCKET), math.ceil(facts / FACTS_PER_BUCKET))
    least = min(MOST_BUCKETS, max(cores, sized))
    return shuffle if least <= shuffle <= min(4 * least, MOST_BUCKETS) else least
