"""Personal data, and the terms near it that give it away.

Base spans are found by regular expressions. Each value found is a protected entity. How strongly a
term reveals an entity is its pointwise mutual information with it, as a share of the entity's own
information content, both estimated from document counts over the whole corpus:

    share = log(N * n(t, e) / (n(t) * n(e))) / log(N / n(e))

n(t, e) counts documents that hold both, however far apart, n(t) and n(e) those with t or e. A term that
occurs with e alone has share 1 and is removed; one above the threshold is generalised, both wherever they
stand in the documents that hold e. A pair counts only if it is in ``support`` documents that amount to ``evidence``.

Most entities are in one or two documents, which say too little. So what entities have in common, the domain of
addresses and the network of ips, is protected likewise: a name that recurs beside addresses of one domain, each
of them rare, is found by their domain.

Everything is DataFrame expressions. Defined results: a null text is empty; equal rows (id and text)
count as one document in the estimates and each get their spans; ids may be null or repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.llm.common import Scratch, row_key, table, whole_text, within
from cohortlift.llm.spans import (
    between,
    by_start,
    count_of,
    find_spans,
    keep,
    listed,
    no_spans,
    redact,
    spans_if,
)
from cohortlift.operators.joins import fits_broadcast

KINDS = ["email", "ip", "card", "phone"]
TERM_KINDS = ["remove", "general"]

# Possessive repeats and starts at the head of a run give the same matches as plain ones, in linear
# time and without recursion on long runs.
_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Runs of at least 16 digits: what a run of any length, kept if it has 16, gives.
CARD = r"[0-9](?:[ -]?[0-9]){15,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

IN_WORD = r"[\p{L}\p{N}]"
#: Characters of a word that may be a term.
LEAST = 3
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class Disclosure:
    """When a term gives an entity away."""

    #: Share of the entity's information from which a term is generalised.
    share: float = 0.9
    #: Documents in which both must occur together; fewer say nothing about how they relate.
    support: int = 3
    #: What these documents must amount to: their number times the information (in nats) that one has the entity.
    #: Of terms and entities that have nothing to do with each other one in ten thousand reaches it by chance.
    evidence: float = 9.2


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.char_length(number))
    value = lambda i: F.substring(number, -i, F.lit(1)).cast("int")
    doubled = lambda i: value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)
    each = F.transform(places, lambda i: F.when(i % 2 == 0, doubled(i)).otherwise(value(i)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """The spans by kind as listed, then start."""
    n_digits = lambda hit: F.char_length(digits(hit))
    email = spans_if(F.contains(text, F.lit("@")), find_spans(text, "email", EMAIL))
    ip = keep(find_spans(text, "ip", IP), lambda h: h.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    card = keep(
        find_spans(text, "card", CARD), lambda h: n_digits(h).between(16, 19) & luhn(digits(h))
    )
    phone = spans_if(F.contains(text, F.lit("+")), find_spans(text, "phone", PHONE))
    phone = keep(phone, lambda h: n_digits(h).between(8, 15))
    return F.concat(email, ip, card, phone)


def _entity(span: Column) -> Column:
    value = F.when(span["kind"] == "email", F.lower(span["hit"])).otherwise(
        F.when(span["kind"] == "ip", span["hit"]).otherwise(digits(span["hit"]))
    )
    return F.concat_ws(":", span["kind"], value)


def _group(span: Column) -> Column:
    """What an entity shares with others of its owner: the domain of an address, the network of an ip."""
    email, ip = span["kind"] == "email", span["kind"] == "ip"
    domain = F.concat(F.lit("domain:"), F.lower(F.substring_index(span["hit"], "@", -1)))
    return F.when(email, domain).when(ip, F.concat(F.lit("network:"), F.substring_index(span["hit"], ".", 3)))


def _small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is measured to be small in rows and bytes."""
    return F.broadcast(df) if fits_broadcast(df) else df


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces for its spans, in the order of start, so that all else keeps its place."""

    def merge(acc: Column, s: Column) -> Column:
        blank = F.greatest(s["end"] - F.greatest(acc["at"], s["start"]), F.lit(0)).cast("int")
        gap = between(text, acc["at"], s["start"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(acc["out"], gap, F.repeat(F.lit(" "), blank)).alias("out"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], between(text, acc["at"], F.char_length(text)))
    return F.aggregate(spans, start, merge, rest)


def words_of(text: Column) -> Column:
    """The distinct words of a text as written."""
    return F.filter(F.array_distinct(F.split(text, BETWEEN_WORDS)), lambda w: F.char_length(w) >= LEAST)


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.transform(words_of(text), F.lower))


def find_base(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base, entities, rest): base spans, their entities and groups, and the text without them."""
    text = whole_text()
    found = docs.select("doc_id", row_key().alias("row"), text.alias("t"), base_spans(text).alias("base"))
    rest = F.when(F.size("base") > 0, blanked(F.col("t"), by_start(F.col("base"), KINDS)))
    groups = F.array_compact(F.transform("base", _group))
    entities = F.array_distinct(F.concat(F.transform("base", _entity), groups))
    return found.select("doc_id", "row", "base", entities.alias("entities"), rest.alias("rest"))


def known_entities(base: DataFrame, rule: Disclosure, scratch: Scratch) -> DataFrame:
    """(row, entity, n_entity) of the entities in at least ``support`` distinct rows."""
    held = scratch.write(base.select("row", F.explode("entities").alias("entity")).distinct(), "held")
    counts = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    counts = _small(scratch.write(counts.where(F.col("n_entity") >= rule.support), "entities"))
    return scratch.write(held.join(counts, "entity").select("row", "entity", "n_entity"), "known")


def disclosures(
    docs: DataFrame, rows: DataFrame, known: DataFrame, n_rows: int, rule: Disclosure, scratch: Scratch
) -> DataFrame:
    """(entity, term, share) of the pairs at or above the threshold."""
    n = F.lit(n_rows).cast("double")
    information = F.log(n / F.col("n_entity"))

    def share(n_term: str | Column, n_both: str = "n_both") -> Column:
        mutual = F.log(n * F.col(n_both) / (F.col(n_term) if isinstance(n_term, str) else n_term) / F.col("n_entity"))
        # In a corpus whose every document has the entity there is nothing left to disclose.
        return F.when(information > 0, mutual / information)

    # A term is in at least as many documents as have it beside any entity. Where even that many make its
    # share too small, it need not be counted: not for an entity whose every document has it, and not in
    # the corpus.
    near = rows.select("row", F.explode(terms_of(F.col("rest"))).alias("term"))
    counts = near.groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    most = F.lit(known.agg(F.max("n_entity")).first()[0]).cast("bigint")
    counts = counts.where(F.col("n_near") >= rule.support).withColumn("n_entity", most)
    at_most = share("n_near", "n_entity") >= rule.share - 1e-9
    # For all but the entities of more than a third of the documents, a greater count allows more.
    often = F.col("n_entity") * 3 > n
    counts = _small(scratch.write(counts.where(at_most | often).select("term", "n_near"), "counts"))
    together = (
        near.join(counts, "term")
        .join(_small(known), "row")
        .where(at_most)
        .groupBy("entity", "term", "n_entity", "n_near")
        .agg(F.count(F.lit(1)).alias("n_both"))
        .where((F.col("n_both") >= rule.support) & (F.col("n_both") * information >= rule.evidence))
        .where(share("n_near") >= rule.share)
    )
    together = scratch.write(together, "together")
    terms = _small(scratch.write(together.select("term").distinct(), "terms"))
    in_docs = (
        docs.select(F.explode(terms_of(whole_text())).alias("term"))
        .join(terms, "term", "left_semi")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n_term"))
    )
    # A word that only a base span sets off is not among the words of the plain text.
    n_term = F.greatest("n_term", "n_near")
    found = together.join(in_docs, "term", "left").select("entity", "term", share(n_term).alias("share"))
    return found.where(F.col("share") >= rule.share)


def occurrences(text: Column, kinds: Column) -> Column:
    """Spans of all whole words of ``text`` that are keys of the map ``kinds``, by start."""
    one = F.concat(F.lit(rf"(?s).*?(?:(?<!{IN_WORD})(?:"), F.array_join(F.map_keys(kinds), "|"))
    cuts = F.regexp_extract_all(text, F.concat(one, F.lit(rf")(?!{IN_WORD})|\z)")), F.lit(0))

    def step(acc: Column, cut: Column) -> Column:
        end = (acc["at"] + F.char_length(cut)).cast("bigint")
        hit = F.regexp_extract(cut, rf"(?<!{IN_WORD}){IN_WORD}++\z", 0)
        kind = F.try_element_at(kinds, hit)
        span = F.struct(kind.alias("kind"), (end - F.char_length(hit)).alias("start"), end.alias("end"), hit.alias("hit"))
        more = F.when(kind.isNotNull(), F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(end.alias("at"), more.alias("found"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), no_spans().alias("found"))
    return F.aggregate(cuts, start, step, lambda acc: acc["found"])


def sanitise(docs: DataFrame, scratch: Scratch, rule: Disclosure = Disclosure()) -> DataFrame:  # noqa: B008
    """(doc_id, row, spans): base spans by kind, then terms to remove and to generalise, by start."""
    base = scratch.write(find_base(docs), "base")
    known = known_entities(base, rule, scratch)
    of_rows = within(scratch.write(known.select("row").distinct(), "of_rows"))
    rows = base.where(F.size("base") > 0).select("row", "rest").join(of_rows, "row", "left_semi")
    rows = scratch.write(rows.dropDuplicates(["row"]), "rows")
    told = disclosures(docs, rows, known, base.count(), rule, scratch)
    told = _small(scratch.write(told, "told"))
    kind = F.when(F.max("share") >= 1 - 1e-9, "remove").otherwise("general")
    kinds = (
        rows.select("row", F.explode(words_of(F.col("rest"))).alias("hit"))
        .join(told.withColumnRenamed("term", "t"), F.lower("hit") == F.col("t"))
        .join(_small(known), ["row", "entity"])
        .groupBy("row", "hit")
        .agg(kind.alias("kind"))
        .groupBy("row")
        .agg(F.map_from_entries(F.collect_list(F.struct("hit", "kind"))).alias("kinds"))
    )
    terms = rows.join(kinds, "row").select("row", occurrences(F.col("rest"), F.col("kinds")).alias("terms"))
    of = lambda k: F.filter("terms", lambda s: s["kind"] == k)
    added = F.coalesce(F.concat(*[of(k) for k in TERM_KINDS]), no_spans())
    return base.join(terms, "row", "left").select("doc_id", "row", F.concat("base", added).alias("spans"))


def sanitised_text(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text): entities replaced by their kind, terms by what they are, or removed."""
    what = lambda s: F.when(s["hit"].rlike("^[0-9]+$"), "[NUMBER]").otherwise("[WORD]")
    mark = lambda s: (
        F.when(s["kind"] == "remove", "")
        .when(s["kind"] == "general", what(s))
        .otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    )
    spans = by_start(F.col("spans"), KINDS + TERM_KINDS)
    keyed = docs.select("doc_id", whole_text().alias("text"), row_key().alias("row"))
    once = found.dropDuplicates(["row"]).select("row", "spans")
    return keyed.join(once, "row").select("doc_id", redact(F.col("text"), spans, mark).alias("text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every document and the terms that disclose it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sanitise(docs, Scratch(spark, "op8"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return found.select(
        "doc_id",
        *[count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
