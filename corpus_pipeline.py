"""A training corpus from raw documents: five stages, each written as Parquet and read again.

1. toxicity: documents that the network rejects go.
2. near duplicates: of documents linked by SimHash (shingle length and radius of ``op5_simhash``) one stays, that
   of least id.
3. decontamination: documents that leak a test item go.
4. secrets: what the scan finds is replaced by its kind; no document goes.
5. mixing: every document gets the rate ``mix_rate`` at which it enters the mix.

Defined results for all stages: a null text is kept as it is, but for the second stage, where all texts without
a word (null, empty, white space) have fingerprint zero and are one group; rows without id are documents like
others; whole rows that repeat (same id and text) are near duplicates of each other, and one stays; an empty
table gives an empty one; further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.llm import decontamination, mixing, secrets, simhash, toxicity
from cohortlift.llm.common import Scratch, fold, packed, row_key, table, unpacked, without

#: Score from which a document is rejected.
TOXIC = 0.5
#: Shares of tokens in the mix, by the quality that ``labels`` marks.
TARGETS = {"q1": 0.92, "q0": 0.08}


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score ``TOXIC`` or more; labels of fold 0 of 5 are not learned from."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels.where(fold("doc_id", 5) != 0))
    scored = toxicity.score(packed(docs), model, ["row", "text"])
    return unpacked(scored.where(F.col("score") < TOXIC), docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near duplicates the document of least id."""
    scratch = Scratch(spark, "near_duplicates")
    keyed = docs.select(row_key().alias("key"), F.col("doc_id").cast("bigint").alias("id"), "text")
    groups = simhash.grouped(
        keyed.select(F.col("key").alias("doc_id"), "text"), simhash.WORDS, simhash.RADIUS, scratch
    )
    groups = groups.groupBy(F.col("doc_id").alias("key")).agg(F.first("component_id").alias("group"))
    ids = keyed.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    members = scratch.write(groups.join(ids, "key"), "members")
    kept = members.groupBy("group").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "key")).alias("k"))
    dropped = members.join(kept, "group").where(F.col("key") != F.col("k.key")).select("key")
    rest = without(packed(docs), dropped, scratch, "dropped")
    if members.where("copies > 1").limit(1).count():
        rest = rest.withColumn("key", row_key()).dropDuplicates(["key"]).drop("key")
    return unpacked(rest, docs.columns)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that leak an item of ``benchmark``."""
    items = decontamination.question_and_answer(table(spark, sf_dir, "benchmark"))
    keyed = docs.select(row_key().alias("doc_id"), "text")
    leaks = decontamination.find_leaks(keyed, items).select(F.col("doc_id").alias("key"))
    return unpacked(without(packed(docs), leaks, Scratch(spark, "leaks"), "leaks"), docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by their kind; ``n_chars`` follows."""
    rules = secrets.BASE + secrets.MORE
    clean = secrets.redacted(secrets.scan(packed(docs), rules, Scratch(spark, "secrets")))
    out = unpacked(clean, docs.columns)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        length = F.char_length("text").cast(kind)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their rate in a mix of the quality domains of ``labels``."""
    labels = table(spark, sf_dir, "labels")
    domains = labels.select("doc_id", F.concat(F.lit("q"), F.col("quality")).alias("domain"))
    rows = packed(docs)
    classifier, steps, _ = mixing.mix(rows, domains, TARGETS, Scratch(spark, "mixing"))
    if classifier is None:
        return unpacked(rows, docs.columns, F.lit(1.0).alias("mix_rate"))
    rate = mixing.rate_after(steps, len(classifier.domains))
    return unpacked(mixing.with_posteriors(rows, classifier), docs.columns, rate.alias("mix_rate"))


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_near_dedup", remove_near_duplicates),
    ("benchmark_decontamination", remove_leaks),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
]

#: SQL has neither the network nor XXH64; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
