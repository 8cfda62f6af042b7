"""Mixing to target weights with soft membership.

A naive Bayes classifier learned from a labelled table gives each document a posterior over domains. Each
document gets a rate, at least 0, such that the expected tokens of each domain (rate x tokens x posterior,
summed over documents) come as near to the targets as they can: least squares by projected gradient from
rates of 1, with the residuals whitened by the Gram matrix of the posteriors, so that few steps do. A step
is one aggregation over all documents to a number for each domain. A document's rate follows from its
posterior and the steps so far; it is written down every ``STORED_STEPS`` steps.

Everything is DataFrame expressions. Defined results: null and empty texts have no tokens and the prior
for posterior; repeated rows count each; labels that are null, of other domains or without document are
ignored; a target of a domain without labelled document is left out and the others fill its place;
without any labelled document, or without tokens, every posterior is 0 and every rate is 1.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.llm.common import Scratch, least_of_each, one_text_each, table, whole_text

#: Hash buckets of words and word endings.
BUCKETS = 4_096
STORED_STEPS = 8


@dataclass(frozen=True)
class Settings:
    #: Labelled documents that are learned from at most, of each domain: those of least hash of the id.
    rows_per_domain: int = 2_000
    #: A document's mean evidence counts as that of so many features at most; more would make
    #: posteriors of long texts all but certain.
    evidence: int = 100
    #: Log-likelihood ratios nearer to 0 than this are noise and taken for 0.
    least_ratio: float = 0.25
    steps: int = 40
    #: Greatest residual, as a share of all tokens, at which steps end.
    tolerance: float = 1e-6
    #: Tokens of the mix as a share of the tokens there are.
    size: float = 1.0


@dataclass(frozen=True)
class Classifier:
    domains: list[str]
    priors: list[float]
    #: For each domain and bucket the log-likelihood less that of the first domain, the most frequent.
    evidence: list[list[float]]
    settings: Settings


def _array(values: list, kind: str) -> Column:
    """A constant array, folded once by the optimiser."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def _buckets(tokens: Column) -> Column:
    """The bucket of each word and of each word's last two letters."""
    endings = F.transform(tokens, lambda w: F.concat(F.lit("~"), F.right(w, F.lit(2))))
    return F.transform(
        F.concat(tokens, endings), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")
    )


def _sum_at(places: str, values: Column) -> Column:
    return F.aggregate(places, F.lit(0.0), lambda a, i: a + F.get(values, i))


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], s: Settings) -> Classifier | None:
    """A classifier from ``labelled`` (doc_id, domain); the driver gets ``BUCKETS`` counts for each domain."""
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    once = known.groupBy("doc_id").agg(F.max("domain").alias("domain"))
    priors = {r["domain"]: r["count"] for r in once.groupBy("domain").count().collect()}
    texts = one_text_each(docs, least_of_each(once, "domain", "doc_id", s.rows_per_domain))
    counts = (
        texts.select("domain", F.explode(_buckets(_tokens(F.col("text")))).alias("bucket"))
        .groupBy("domain", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    seen = sorted({r["domain"] for r in counts})
    if not seen:
        return None
    table_ = {d: [1.0] * BUCKETS for d in seen}
    for r in counts:
        table_[r["domain"]][r["bucket"]] += r["n"]
    logs = {}
    for d in seen:
        total = math.log(sum(table_[d]))
        logs[d] = [math.log(n) - total for n in table_[d]]
    # Against the most frequent domain, so that what tells nothing leaves the prior.
    seen.sort(key=lambda d: (-priors[d], d))
    ratios = [[a - b for a, b in zip(logs[d], logs[seen[0]], strict=True)] for d in seen]
    evidence = [[x if abs(x) >= s.least_ratio else 0.0 for x in row] for row in ratios]
    total = sum(priors[d] for d in seen)
    return Classifier(seen, [priors[d] / total for d in seen], evidence, s)


def posterior_columns(domains: list[str]) -> list[str]:
    return [f"_p{i}" for i in range(len(domains))]


def with_posteriors(docs: DataFrame, c: Classifier) -> DataFrame:
    """``docs`` with ``_tokens`` (a number) and the posterior of each domain."""
    kept = [F.col(f"`{name}`") for name in docs.columns]
    words = docs.select(*kept, _tokens(whole_text()).alias("_words"))
    hashed = words.select(*kept, F.size("_words").alias("_tokens"), _buckets(F.col("_words")).alias("_at"))
    sums = [F.lit(0.0)]
    for evidence in c.evidence[1:]:
        sums.append(_sum_at("_at", _array([round(x, 6) for x in evidence], "array<double>")))
    number = F.size("_at")
    weight = F.when(number > 0, F.least(number, F.lit(c.settings.evidence)) / number).otherwise(0.0)
    logs = [weight * x + math.log(p) for x, p in zip(sums, c.priors, strict=True)]
    names = [f"_l{i}" for i in range(len(logs))]
    scored = hashed.select(*kept, "_tokens", *[x.alias(n) for x, n in zip(logs, names, strict=True)])
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    raised = scored.select(*kept, "_tokens", *[F.exp(F.col(n) - top).alias(n) for n in names])
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    shares = [(F.col(n) / total).alias(p) for n, p in zip(names, posterior_columns(names), strict=True)]
    return raised.select(*kept, "_tokens", *shares)


def rate_after(steps: list[list[float]], domains: int, start: Column | None = None) -> Column:
    """A document's rate after the given steps (a number for each domain), from its posteriors."""
    start = F.lit(1.0) if start is None else start
    if not steps:
        return start
    p = [F.col(f"_p{i}") for i in range(domains)]

    def step(rate: Column, h: Column) -> Column:
        move = sum((p[i] * F.get(h, F.lit(i)) for i in range(1, domains)), p[0] * F.get(h, F.lit(0)))
        return F.greatest(F.lit(0.0), rate - move)

    return F.aggregate(_array(steps, "array<array<double>>"), start, step)


def _inverse(m: list[list[float]]) -> list[list[float]]:
    """Of a small symmetric positive matrix, by elimination."""
    n = len(m)
    rows = [[*m[i], *(float(i == j) for j in range(n))] for i in range(n)]
    for i in range(n):
        pivot = rows[i][i]
        rows[i] = [x / pivot for x in rows[i]]
        for j in range(n):
            if j != i:
                factor = rows[j][i]
                rows[j] = [a - factor * b for a, b in zip(rows[j], rows[i], strict=True)]
    return [r[n:] for r in rows]


def fit_rates(
    weighed: DataFrame, targets: list[float], scratch: Scratch, s: Settings
) -> tuple[list[list[float]], DataFrame]:
    """The steps of projected gradient over ``weighed`` (``_tokens``, ``_p0``, ...), and its ``rate``."""
    k = len(targets)
    share = F.col("_tokens").cast("double")
    gram = [F.sum(share * F.col(f"_p{i}") * F.col(f"_p{j}")) for i in range(k) for j in range(k)]
    total, *products = weighed.agg(F.sum(share), *gram).first()
    state = weighed.withColumn("rate", F.lit(1.0))
    if not total:
        return [], state
    wanted = [s.size * t / sum(targets) for t in targets]
    m = [[products[i * k + j] / total + (1e-6 if i == j else 0) for j in range(k)] for i in range(k)]
    whiten = _inverse(m)
    steps: list[list[float]] = []
    pending: list[list[float]] = []
    while True:
        rated = state.withColumn("rate", rate_after(pending, k, F.col("rate")))
        if len(pending) == STORED_STEPS:
            state, pending = scratch.write(rated, f"rates_{len(steps)}"), []
            rated = state
        got = rated.agg(*[F.sum(share * F.col("rate") * F.col(f"_p{i}")) for i in range(k)]).first()
        residual = [g / total - w for g, w in zip(got, wanted, strict=True)]
        if len(steps) == s.steps or max(map(abs, residual)) <= s.tolerance:
            return steps, rated
        pending.append([sum(a * r for a, r in zip(row, residual, strict=True)) for row in whiten])
        steps.append(pending[-1])


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], scratch: Scratch, s: Settings = Settings()  # noqa: B008
) -> tuple[Classifier | None, list[list[float]], DataFrame | None]:
    """The classifier, the steps that give rates, and (doc_id, _tokens, posteriors, rate)."""
    classifier = learn(docs, labelled, sorted(targets), s)
    if classifier is None:
        return None, [], None
    weighed = scratch.write(with_posteriors(docs.select("doc_id", "text"), classifier).drop("text"), "weighed")
    steps, rated = fit_rates(weighed, [targets[d] for d in classifier.domains], scratch, s)
    return classifier, steps, rated


#: Domains of the labelled table: quality and toxicity; the mix holds these shares of tokens of each.
TARGETS = {"q1t0": 0.85, "q0t0": 0.10, "q1t1": 0.04, "q0t1": 0.01}


def label_domains(labels: DataFrame) -> DataFrame:
    return labels.select(
        "doc_id", F.concat(F.lit("q"), F.col("quality"), F.lit("t"), F.col("toxic")).alias("domain")
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors and rate of every document for a mix of quality and toxicity domains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = label_domains(table(spark, sf_dir, "labels"))
    classifier, _, rated = mix(docs, labels, TARGETS, Scratch(spark, "op10"))
    domains = sorted(TARGETS)
    if classifier is None or rated is None:
        zeros = [F.lit(0.0).alias(f"p_{d}") for d in domains]
        return docs.select("doc_id", F.size(_tokens(whole_text())).alias("n_tokens"), *zeros, F.lit(1.0).alias("rate"))
    at = {d: F.col(f"_p{i}") for i, d in enumerate(classifier.domains)}
    return rated.select(
        "doc_id",
        F.col("_tokens").alias("n_tokens"),
        *[at.get(d, F.lit(0.0)).alias(f"p_{d}") for d in domains],
        "rate",
    )
