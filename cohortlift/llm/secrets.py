"""Secret scans by a trigram inverted index.

Each rule's regex yields a Boolean query over trigrams that any match must contain. An inverted index
of those trigrams is built over all texts, its postings are intersected to candidates per rule, and
only candidates are scanned with the regex. A rule without mandatory trigrams scans every text.

Defined results: a null text is empty and has no spans; equal rows are scanned each; ids may be null
or repeated, as rows are matched by a hash of id and text (a clash only scans one text in vain).
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as ops
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.llm.common import Scratch, row_key, table, whole_text, within
from cohortlift.llm.spans import by_start, count_of, find_spans, keep, listed, redact, spans_if


@dataclass(frozen=True)
class Rule:
    """A regex without look-around, in the syntax that Python and Java share, and what a hit must be."""

    kind: str
    pattern: str
    #: Least length of the hit, or of its group ``group``.
    least: int = 0
    group: int = 0


_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

BASE = [
    Rule("assign", rf"(?i:password|passwd|secret|token|api_?key){_VALUE}", least=6, group=1),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    # Runs of at least 24: what a run of any length, kept if it has 24, gives.
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: Public token formats that the base rules do not name.
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
]
BASE_KINDS = [r.kind for r in BASE]
#: More alternatives than this are not spelled out; such a part of a regex demands nothing.
MOST_ALTERNATIVES = 64


def _alternatives(nodes) -> list[list[str]]:
    """The literal runs, in order, of each way to match ``nodes``; "" marks a gap between runs."""
    ways: list[list[str]] = [[""]]
    for op, arg in nodes:
        if op is ops.LITERAL:
            ways = [[*w[:-1], w[-1] + chr(arg).lower()] for w in ways]
            continue
        if op is ops.SUBPATTERN:
            parts = _alternatives(arg[-1])
        elif op is ops.BRANCH:
            parts = [way for branch in arg[1] for way in _alternatives(branch)]
        elif op is ops.IN and len(arg) <= 8 and all(x[0] is ops.LITERAL for x in arg):
            parts = [[chr(x[1]).lower()] for x in arg]
        elif op is ops.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
            parts = [[""], *_alternatives(arg[2])]
        elif op is ops.MAX_REPEAT and arg[0] >= 1:
            inner = _alternatives(arg[2])
            parts = inner if arg[0] == arg[1] == 1 else [[*way, ""] for way in inner]
        else:
            parts = [["", ""]]
        if len(ways) * len(parts) > MOST_ALTERNATIVES:
            parts = [["", ""]]
        ways = [[*w[:-1], w[-1] + p[0], *p[1:]] for w in ways for p in parts]
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of lower-case trigrams, one of which any match contains whole; None if none is certain."""
    clauses = {
        frozenset(run[i : i + 3] for run in way for i in range(len(run) - 2))
        for way in _alternatives(_parser.parse(pattern))
    }
    if frozenset() in clauses:
        return None
    least = [c for c in clauses if not any(other < c for other in clauses)]
    return sorted(least, key=sorted)


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, row) of the given trigrams over all texts in lower case."""
    lowered = docs.select(row_key().alias("row"), F.lower(whole_text()).alias("low"))
    held = F.array_compact(
        F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])
    )
    return lowered.select("row", F.explode(held).alias("trigram"))


def candidates(spark: SparkSession, postings: DataFrame, rules: list[Rule]) -> DataFrame:
    """(row, rules): the rules of which some clause has all its trigrams in the row's postings."""
    clauses = [
        (rule.kind, f"{rule.kind}/{n}", trigram, len(clause))
        for rule in rules
        for n, clause in enumerate(trigram_query(rule.pattern) or [])
        for trigram in sorted(clause)
    ]
    asked = spark.createDataFrame(clauses, "rule string, clause string, trigram string, need int")
    return (
        postings.join(F.broadcast(asked), "trigram")
        .groupBy("row", "rule", "clause", "need")
        .agg(F.size(F.collect_set("trigram")).alias("have"))
        .where("have = need")
        .groupBy("row")
        .agg(F.collect_set("rule").alias("rules"))
    )


def _spans(text: Column, rule: Rule) -> Column:
    found = find_spans(text, rule.kind, rule.pattern)
    if not rule.least:
        return found
    value = lambda hit: F.regexp_extract(hit, rule.pattern, rule.group)
    return keep(found, lambda hit: F.char_length(value(hit)) >= rule.least)


def scan(docs: DataFrame, rules: list[Rule], scratch: Scratch) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``spans``, by start and then in the order of the rules."""
    spark = docs.sparkSession
    indexed = [r for r in rules if trigram_query(r.pattern)]
    trigrams = sorted({t for r in indexed for c in trigram_query(r.pattern) for t in c})
    postings = scratch.write(trigram_index(docs, trigrams), "postings")
    found = scratch.write(candidates(spark, postings, indexed), "candidates")
    found = within(found.select(F.col("row").alias("_row"), F.col("rules").alias("_rules")))
    joined = docs.withColumn("_key", row_key()).join(found, F.col("_key") == F.col("_row"), "left")
    text = whole_text()
    each = [
        spans_if(F.array_contains("_rules", r.kind), _spans(text, r)) if r in indexed else _spans(text, r)
        for r in rules
    ]
    spans = by_start(F.concat(*each), [r.kind for r in rules])
    return joined.withColumn("spans", spans).drop("_key", "_row", "_rules")


def redacted(scanned: DataFrame) -> DataFrame:
    """The scanned documents with each secret replaced by its kind in brackets."""
    mark = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    text = F.when(F.size("spans") > 0, redact(F.col("text"), F.col("spans"), mark))
    return scanned.withColumn("text", text.otherwise(F.col("text")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document, base kinds counted and hashed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, BASE + MORE, Scratch(spark, "op9")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def python_pattern(rule: Rule) -> str:
    """The rule for Python's ``re``: the same, as letters in either case are ASCII letters there too."""
    return re.sub(r"^\(\?i:", "(?ai:", rule.pattern)
