"""Stages of the corpus pipeline on small tables, and the whole of it on the smallest data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cohortlift.llm import decontamination, secrets
from cohortlift.llm.common import Scratch
from tests.llm.rows import empty, odd

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_handle_odd_and_no_rows(spark, name, stage):
    for docs in (odd(spark), empty(spark)):
        found = stage(spark, docs, SMALL)
        assert found.columns[: len(docs.columns)] == docs.columns
        assert found.columns[len(docs.columns) :] == (["mix_rate"] if name == "mixing" else [])
        rows = found.collect()
        if name == "simhash_near_dedup" and rows:
            # 1, 1 and 2 have one text; 3, 4 and 5 have no word; 6 and 7 are unlike all others.
            assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 3, 6, 7, 8, 8, 9]
        elif rows:
            assert len(rows) == docs.count()


def test_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    scratch = Scratch(spark, "t")
    seen = {}
    for name, stage in pipeline.STAGES:
        after = scratch.write(stage(spark, docs, SMALL), name)
        seen[name] = (docs, after)
        docs = after

    before, after = seen["toxicity"]
    kept = {r["doc_id"] for r in after.select("doc_id").collect()}
    clean = [i for i, toxic in labels.items() if toxic == 0]
    assert sum(i in kept for i in clean) >= 0.9 * len(clean)

    before, after = seen["simhash_near_dedup"]
    texts = [r["text"] for r in after.select("text").collect()]
    assert len(texts) == len(set(texts))
    assert {r["text"] for r in before.select("text").collect()} >= set(texts)

    before, after = seen["benchmark_decontamination"]
    bench = [decontamination.words(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    holds = lambda t: any(" ".join(b) in " ".join(decontamination.words(t)) for b in bench)
    expected = {r["doc_id"] for r in before.collect() if not holds(r["text"])}
    assert {r["doc_id"] for r in after.collect()} == expected

    before, after = seen["secret_scan"]
    assert before.count() == after.count()
    again = secrets.scan(after, secrets.BASE + secrets.MORE, Scratch(spark, "t"))
    assert again.where(F.size("spans") > 0).count() == 0
    assert after.where("n_chars <> char_length(text)").count() == 0

    before, after = seen["mixing"]
    assert before.count() == after.count() and after.where("mix_rate < 0 or mix_rate is null").count() == 0


def test_registered_and_run(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is pipeline.run
    assert pipeline.run(spark, SMALL).columns[-1] == "mix_rate"
