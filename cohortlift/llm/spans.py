"""Spans of regular expressions in texts as native expressions: find, filter, list, replace.

A span is a struct (kind, start, end, hit); positions are code points, the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:bigint,end:bigint,hit:string>>"


def find_spans(text: Column, kind: str, pattern: str) -> Column:
    """All leftmost non-overlapping matches of ``pattern``, a Java regex without look-ahead.

    The text is cut after each match, in one pass and in time linear in its length; the cuts then
    give positions. ``pattern`` may use ``\\G`` for the end of the match before.
    """
    cuts = F.regexp_extract_all(text, F.lit(rf"(?s).*?(?:{pattern}|\z)"), F.lit(0))

    def step(acc: Column, cut: Column) -> Column:
        end = acc["at"] + F.char_length(cut)
        hit = F.regexp_extract(cut, f"(?s){pattern}", 0)
        found = F.struct(
            F.lit(kind).alias("kind"),
            (end - F.char_length(hit)).cast("bigint").alias("start"),
            end.cast("bigint").alias("end"),
            hit.alias("hit"),
        )
        more = F.when(hit != "", F.concat(acc["found"], F.array(found))).otherwise(acc["found"])
        return F.struct(end.cast("bigint").alias("at"), more.alias("found"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), no_spans().alias("found"))
    return F.aggregate(cuts, start, step, lambda acc: acc["found"])


def no_spans() -> Column:
    return F.from_json(F.lit("[]"), SPAN)


def spans_if(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(no_spans())


def keep(spans: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(spans, lambda s: test(s["hit"]))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, in the order given."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def by_start(spans: Column, kinds: list[str]) -> Column:
    """In the order of start, then of ``kinds``."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("a"), rank[s["kind"]].alias("b"), s.alias("s"))
    )
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def redact(text: Column, spans: Column, placeholder: Callable[[Column], Column]) -> Column:
    """``text`` with each span, in the order of start, replaced; what overlaps is replaced as one."""

    def merge(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = between(text, acc["at"], s["start"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(inside, acc["out"])
            .otherwise(F.concat(acc["out"], gap, placeholder(s)))
            .alias("out"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        spans,
        start,
        merge,
        lambda acc: F.concat(acc["out"], between(text, acc["at"], F.char_length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
