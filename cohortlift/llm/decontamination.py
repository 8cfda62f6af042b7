"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

The words of each test item, in segments of at most ``SEGMENT`` words, are indexed; a posting's impact is
its BM25 share of its segment's own score, so a passage that holds the whole segment scores 1. Every
passage of every document (windows of ``PASSAGE`` words, half overlapping, so that each segment-long run
of words lies whole in one) is a query. Block-max WAND retrieves all segments that score at least
``threshold``, and these are verified: an item counts as leaked if a document's passages hold at least
``overlap`` of the words of its question, and of its answer. A word is held if it stands there with one of
its neighbours in the item, so that a changed word costs itself and not the words around it. Items without
an answer of their own are verified as a whole.

WAND runs only in the live blocks of a passage: the greatest impacts of its rarer terms in the block, with
the most that frequent terms give any segment there, reach the threshold. No other block can hold a hit.

The index is held by each task. It grows with the test items, not with the documents, and is cut into
shards of at most ``SHARD`` segments, each of which is a pass over the documents.

Defined results: null and empty texts leak nothing; items without words are never leaked; an empty answer
needs no overlap; repeated documents are searched each; repeated items are found each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.llm.common import table, whole_text

SEGMENT, PASSAGE = 64, 128
SHARD = 20_000
#: Segments of a block, and the share of them from which a term is frequent.
BLOCK = 8
FREQUENT = 0.04
K1, B = 1.2, 0.75
#: Words are neighbours up to this distance: past one word that is changed, left out or put in.
REACH = 2

_WORDS = re.compile(r"\w+")


@dataclass(frozen=True)
class Rule:
    #: Share of a segment's own BM25 score from which it is retrieved.
    threshold: float = 0.7
    #: Share of the words of question and answer that a document must hold.
    overlap: float = 0.8


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def pairs(of: list[str]) -> Iterator[tuple[tuple[str, ...], tuple[int, ...]]]:
    """Neighbours in their order, and their places."""
    for i in range(len(of)):
        for j in range(i + 1, min(i + REACH + 1, len(of))):
            yield (of[i], of[j]), (i, j)


@dataclass
class Part:
    """A question or an answer: its length, and the places of its pairs; a lone word stands for itself."""

    size: int
    places: list[tuple[tuple[str, ...], tuple[int, ...]]]

    @classmethod
    def of(cls, found: list[str]) -> Part:
        return cls(len(found), [((found[0],), (0,))] if len(found) == 1 else list(pairs(found)))

    def share(self, held: set[int]) -> float:
        return len(held) / self.size if self.size else 1.0


@dataclass
class Postings:
    """The segments that hold a term, ascending, with impacts and the greatest of each block."""

    segments: list[int] = field(default_factory=list)
    impacts: list[float] = field(default_factory=list)
    block_max: list[float] = field(default_factory=list)
    most: float = 0.0


@dataclass
class Index:
    terms: dict[str, int]
    postings: list[Postings]
    #: Of each segment its item; of each item its id, question and answer.
    item_of: list[int]
    items: list[tuple[int | None, Part, Part]]
    #: Of each rarer term (block, greatest impact there); None for frequent terms.
    rare: list[list[tuple[int, float]] | None] = field(default_factory=list)
    #: The most that frequent terms give a segment of each block.
    frequent: list[float] = field(default_factory=list)


def segments(of: list[str]) -> list[list[str]]:
    return [of[i : i + SEGMENT] for i in range(0, len(of), SEGMENT)]


def build(items: list[tuple], idf: dict[str, float], mean_length: float) -> Index:
    """An index of (item_id, question, answer), with term weights of the whole benchmark."""
    index = Index({}, [], [], [])
    for item_id, question, answer in items:
        q, a = words(question), words(answer)
        index.items.append((item_id, Part.of(q), Part.of(a)))
        for segment in segments(q + a):
            scale = K1 * (1 - B + B * len(segment) / mean_length)
            counts = Counter(segment)
            impact = {t: idf[t] * n * (K1 + 1) / (n + scale) for t, n in counts.items()}
            own = sum(impact.values())
            for t, x in impact.items():
                at = index.terms.setdefault(t, len(index.terms))
                if at == len(index.postings):
                    index.postings.append(Postings())
                index.postings[at].segments.append(len(index.item_of))
                index.postings[at].impacts.append(x / own)
            index.item_of.append(len(index.items) - 1)
    total = len(index.item_of)
    common = [0.0] * total
    for p in index.postings:
        blocks: dict[int, float] = {}
        rare = len(p.segments) <= max(1, FREQUENT * total)
        for segment, impact in zip(p.segments, p.impacts, strict=True):
            if rare:
                blocks[segment // BLOCK] = max(impact, blocks.get(segment // BLOCK, 0.0))
            else:
                common[segment] += impact
        index.rare.append(sorted(blocks.items()) if rare else None)
    index.frequent = [max(common[i : i + BLOCK]) for i in range(0, total, BLOCK)]
    for p in index.postings:
        p.block_max = [max(p.impacts[i : i + BLOCK]) for i in range(0, len(p.impacts), BLOCK)]
        p.most = max(p.block_max)
    return index


def live_blocks(index: Index, terms: set[int], threshold: float) -> list[int]:
    """The blocks that may hold a segment of at least ``threshold`` for a passage's rarer terms."""
    bound: dict[int, float] = {}
    for t in terms:
        for block, most in index.rare[t]:
            bound[block] = bound.get(block, 0.0) + most
    least = threshold - 1e-9
    return [b for b, x in bound.items() if x + index.frequent[b] >= least]


def search(
    index: Index, terms: set[int], threshold: float, low: int = 0, high: int | None = None
) -> list[tuple[int, float]]:
    """Block-max WAND: all (segment, score) in [low, high) of at least ``threshold`` for ``terms``."""
    high = len(index.item_of) if high is None else high
    cursors = []
    for t in terms:
        segs = index.postings[t].segments
        at = bisect_left(segs, low)
        if at < len(segs) and segs[at] < high:
            cursors.append([segs[at], at, index.postings[t]])
    found = []
    least = threshold - 1e-9

    def move(cursor: list, to: int) -> None:
        segs = cursor[2].segments
        cursor[1] = bisect_left(segs, to, cursor[1])
        cursor[0] = segs[cursor[1]] if cursor[1] < len(segs) and segs[cursor[1]] < high else -1

    while cursors:
        cursors.sort(key=lambda c: c[0])
        bound, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            bound += c[2].most
            if bound >= least:
                pivot = i
                break
        if pivot < 0:
            break
        at = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
            pivot += 1
        # The blocks in which each list would hold the pivot, if it does.
        places = [bisect_left(c[2].segments, at, c[1]) for c in cursors[: pivot + 1]]
        block_bound = sum(
            c[2].block_max[i // BLOCK] for c, i in zip(cursors, places, strict=False) if i < len(c[2].segments)
        )
        if block_bound >= least:
            score = sum(
                c[2].impacts[i]
                for c, i in zip(cursors, places, strict=False)
                if i < len(c[2].segments) and c[2].segments[i] == at
            )
            if score >= least:
                found.append((at, score))
            to = at + 1
        else:
            # No segment up to the nearest end of these blocks, or the next list's, can do better.
            ends = [
                c[2].segments[min((i // BLOCK + 1) * BLOCK, len(c[2].segments)) - 1] + 1
                for c, i in zip(cursors, places, strict=False)
                if i < len(c[2].segments)
            ]
            following = [cursors[pivot + 1][0]] if pivot + 1 < len(cursors) else []
            to = max(at + 1, min(ends + following))
        for c in cursors[: pivot + 1]:
            move(c, to)
        cursors = [c for c in cursors if c[0] >= 0]
    return found


@dataclass
class _Hit:
    score: float = 0.0
    start: int = 0
    end: int = 0
    question: set = field(default_factory=set)
    answer: set = field(default_factory=set)


def leaks(index: Index, text: str | None, rule: Rule) -> list[tuple]:
    """(item_id, score, question_overlap, answer_overlap, word_start, word_end) of each leaked item."""
    found = words(text)
    known, is_rare = index.terms, index.rare
    rare = [(i, known[w]) for i, w in enumerate(found) if w in known and is_rare[known[w]] is not None]
    # Blocks that frequent terms alone may bring to the threshold are live in every passage.
    always = [b for b, x in enumerate(index.frequent) if x >= rule.threshold - 1e-9]
    hits: dict[int, _Hit] = {}
    half = PASSAGE // 2
    first = 0
    for start in range(0, max(1, len(found) - half), half):
        while first < len(rare) and rare[first][0] < start:
            first += 1
        last = bisect_left(rare, start + PASSAGE, first, key=lambda x: x[0])
        live = live_blocks(index, {t for _, t in rare[first:last]}, rule.threshold)
        live = sorted({*live, *always})
        if not live:
            continue
        terms = {known[w] for w in found[start : start + PASSAGE] if w in known}
        retrieved = [
            hit for b in live for hit in search(index, terms, rule.threshold, b * BLOCK, (b + 1) * BLOCK)
        ]
        if not retrieved:
            continue
        end = min(start + PASSAGE, len(found))
        held: dict[int, set] = {}
        for segment, score in retrieved:
            item = index.item_of[segment]
            hit = hits.setdefault(item, _Hit(start=start))
            hit.score, hit.end = max(hit.score, score), end
            _, question, answer = index.items[item]
            # The rest of a longer item stands around the passage of one segment.
            n = question.size + answer.size
            more = n if n > SEGMENT else 0
            if more not in held:
                passage = found[max(0, start - more) : end + more]
                held[more] = {p for p, _ in pairs(passage)} | {(w,) for w in passage}
            for part, seen in ((question, hit.question), (answer, hit.answer)):
                for pair, places in part.places:
                    if pair in held[more]:
                        seen.update(places)
    out = []
    for item, hit in sorted(hits.items()):
        item_id, question, answer = index.items[item]
        q, a = question.share(hit.question), answer.share(hit.answer)
        if q >= rule.overlap and a >= rule.overlap:
            out.append((item_id, hit.score, q, a, hit.start, hit.end))
    return out


def shards(items: DataFrame) -> Iterator[Index]:
    """Indexes of (item_id, question, answer), of at most about ``SHARD`` segments each."""
    columns = items.select(F.col("item_id").cast("bigint"), "question", "answer")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            cut = [s for _, q, a in rows for s in segments(words(q) + words(a))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(set(s)) for s in cut], pa.list_(pa.string())), pa.array(map(len, cut), pa.int64())],
                names=["terms", "size"],
            )

    cut = columns.mapInArrow(counted, "terms array<string>, size bigint")
    n, mean = cut.agg(F.count(F.lit(1)), F.avg("size")).first()
    if not n:
        return
    parts = -(-n // SHARD)
    part = F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(parts))
    in_docs = cut.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for k in range(parts):
        mine = columns.where(part == k)
        terms = mine.mapInArrow(counted, "terms array<string>, size bigint")
        needed = terms.select(F.explode("terms").alias("term")).distinct()
        idf = in_docs.join(needed, "term").select(
            "term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
        )
        rows = sorted((tuple(r) for r in mine.collect()), key=lambda r: (r[0] is not None, r))
        yield build(rows, {r["term"]: r["idf"] for r in idf.collect()}, mean)


def find_leaks(docs: DataFrame, items: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """(doc_id, item_id, score, question_overlap, answer_overlap, word_start, word_end) of every leak."""
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "word_start", "word_end"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
    schema = (
        "doc_id bigint, item_id bigint, score double, question_overlap double, "
        "answer_overlap double, word_start int, word_end int"
    )
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))

    def one_pass(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)
                rows = [(i, *leak) for i, text in texts for leak in leaks(index, text, rule)]
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        return plain.mapInArrow(run, schema)

    passes = [one_pass(index) for index in shards(items)]
    empty = docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.union, passes) if passes else empty


def question_and_answer(benchmark: DataFrame) -> DataFrame:
    """Items of plain texts, which have no answer of their own: the question is the whole text."""
    return benchmark.select("item_id", whole_text().alias("question"), F.lit("").alias("answer"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items that each document leaks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, question_and_answer(table(spark, sf_dir, "benchmark")))
