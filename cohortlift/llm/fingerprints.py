"""Document fingerprints by consistent weighted sampling.

The terms of a document are its lower-cased words, weighted by their counts. For each of ``samples``
independent samplers a term draws r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) from a hash of term and
sampler, and with weight w

    t = floor(ln w / r + b),   ln y = r (t - b),   ln a = ln c - ln y - r;

the sample is the (term, t) of least a. Two documents agree on a sample with a probability equal to
the generalised Jaccard similarity of their weights (sum of minima over sum of maxima). A signature
keeps 16 bits of each sample; likeness is the share of equal samples, corrected for chance.

Defined results: a null text is empty; texts without words all have the fingerprint of zeros, and are
like each other with likeness 1. Rows are ordered by id, nulls first, then by a hash of the text, so repeated ids
and rows are neighbours of each other. The only row of a table is its own next document.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from cohortlift.llm.common import Scratch, batched, table, whole_text

SAMPLES = 64
#: Characters of text whose terms are sampled together, and terms sampled at a time (in cache).
BATCH_CHARS = 8_000_000
BATCH_TERMS = 2_048

_GOLDEN = np.uint32(0x9E3779B9)
_MIX = (np.uint32(0x7FEB352D), np.uint32(0x846CA68B))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 32-bit mixer: two rounds of shift, xor and multiply."""
    x = (x ^ (x >> np.uint32(16))) * _MIX[0]
    x = (x ^ (x >> np.uint32(15))) * _MIX[1]
    return x ^ (x >> np.uint32(16))


def _uniform(keys: np.ndarray) -> np.ndarray:
    """A number in (0, 1) from each hash, to 23 bits."""
    return ((keys >> np.uint32(9)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-23)


def term_hashes(terms: list[str]) -> np.ndarray:
    """Two independent 32-bit hashes of each term."""
    found = np.fromiter(
        (xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in terms),
        dtype=np.uint64,
        count=len(terms),
    )
    return found.view(np.uint32).reshape(-1, 2)


def sample_keys(hashes: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """For each weighted term and sampler a key, least for the least ln a, whose low half names (term, t)."""
    salts = _mixed(np.arange(1, 6 * samples + 1, dtype=np.uint32)).reshape(6, samples)
    # Both hashes enter each draw, so that two terms share their draws only if all 64 bits agree.
    first, second = hashes[:, :1], hashes[:, 1:] * _GOLDEN
    draw = lambda k: _mixed(_mixed(first ^ salts[k]) + second)
    r = -np.log(_uniform(draw(0)) * _uniform(draw(1)))
    c = -np.log(_uniform(draw(2)) * _uniform(draw(3)))
    b = _uniform(draw(4))
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
    ln_a = np.log(c) - r * (t - b) - r
    # ln a lies within (-64, 64) but for terms that cannot be the least of any sample.
    high = np.clip((ln_a + np.float32(64)) * np.float32(2.0**24), 0, 2.0**31 - 256).astype(np.int64)
    name = _mixed(draw(5) ^ (t.astype(np.int32).view(np.uint32) * _GOLDEN))
    return (high << np.int64(32)) | name.astype(np.int64)


def signatures(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    """One row of ``samples`` 16-bit numbers for each text."""
    out = np.zeros((len(texts), samples), dtype=np.uint16)
    ids: dict[str, int] = defaultdict(count().__next__)
    terms, weights, edges, rows = array("q"), array("q"), [0], []
    for i, text in enumerate(texts):
        counts = Counter(text.lower().split())
        if counts:
            terms.extend(map(ids.__getitem__, counts))
            weights.extend(counts.values())
            edges.append(len(terms))
            rows.append(i)
    if not rows:
        return out
    pair = np.frombuffer(terms, dtype=np.int64) << 32 | np.frombuffer(weights, dtype=np.int64)
    unique, where = np.unique(pair, return_inverse=True)
    hashes = term_hashes(list(ids))[unique >> 32]
    keys = np.empty((len(unique), samples), dtype=np.int64)
    for at in range(0, len(unique), BATCH_TERMS):
        part = slice(at, at + BATCH_TERMS)
        keys[part] = sample_keys(hashes[part], unique[part] & 0xFFFFFFFF, samples)
    for row, start, end in zip(rows, edges, edges[1:], strict=False):
        least = np.full(samples, np.iinfo(np.int64).max)
        for at in range(start, end, BATCH_TERMS):
            np.minimum(least, keys[where[at : min(at + BATCH_TERMS, end)]].min(axis=0), out=least)
        out[row] = least & 0xFFFF
    return out


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimate of the generalised Jaccard similarity: equal samples, less those equal by chance."""
    equal = float(np.count_nonzero(a == b)) / len(a)
    return max(0.0, (equal - 2.0**-16) / (1 - 2.0**-16))


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) of every row of ``docs``, for general use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in batched(texts, BATCH_CHARS):
                found = pa.array([as_text(s) for s in signatures(texts[a:b], samples)])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), found], names=["doc_id", "fingerprint"]
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        run, f"doc_id {kind}, fingerprint string"
    )


def edited_text(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the head of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_ROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
_EDGE = pa.schema(
    [("part", pa.int32()), ("head", pa.bool_()), ("edge_id", pa.int64()), ("edge_text", pa.string())]
)
_WALKED = pa.schema([*_ROW, *_EDGE])

Chain = list[tuple[int | None, str]]


def _compared(chain: Chain, samples: int) -> list[dict]:
    """Every document of ``chain`` but the last, each with its next one."""
    texts = [t for _, t in chain]
    edited = [edited_text(t, n) for t, n in zip(texts, texts[1:], strict=False)]
    found = signatures(texts + edited, samples)
    own, changed = found[: len(texts)], found[len(texts) :]
    return [
        {
            "doc_id": chain[i][0],
            "n_chars": len(texts[i]),
            "edited_sha256": hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(),
            "fingerprint": as_text(own[i]),
            "edited_fingerprint": as_text(changed[i]),
            "near_edited": likeness(own[i], changed[i]),
            "near_next": likeness(own[i], own[i + 1]),
        }
        for i, e in enumerate(edited)
    ]


def with_next(docs: DataFrame, scratch: Scratch, samples: int = SAMPLES) -> DataFrame:
    """Each document compared with its edited text and with the next document.

    The texts are shuffled once, by ranges of the id. Each task walks its sorted range and hands on its
    first and last document; those few are then linked from range to range.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def edge(head: bool, row: tuple) -> dict:
            return {"part": part, "head": head, "edge_id": row[0], "edge_text": row[1]}

        chain: Chain = []
        started = False
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for a, b in batched(texts, BATCH_CHARS):
                chain += zip(ids[a:b], texts[a:b], strict=True)
                rows = [] if started else [edge(True, chain[0])]
                started = True
                yield pa.RecordBatch.from_pylist(rows + _compared(chain, samples), _WALKED)
                chain = chain[-1:]
        if chain:
            yield pa.RecordBatch.from_pylist([edge(False, chain[0])], _WALKED)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chain = [(row["edge_id"], row["edge_text"]), (None, row["next_text"])]
                yield pa.RecordBatch.from_pylist(_compared(chain, samples), _ROW)

    ranged = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
        # The hash stands for the text, so that the sample of the range bounds holds no texts.
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    walked = scratch.write(ranged.mapInArrow(walk, from_arrow_schema(_WALKED)), "walked")

    # Which range follows which: a row of two numbers for each range that has documents.
    heads = walked.where("head").select("part", "edge_text")
    in_order = Window.orderBy("part")
    after = heads.select("part").select(
        "part", F.coalesce(F.lead("part").over(in_order), F.first("part").over(in_order)).alias("next")
    )
    links = (
        walked.where("not head")
        .select("part", "edge_id", "edge_text")
        .join(after, "part")
        .join(heads.toDF("next", "next_text"), "next")
        .select("edge_id", "edge_text", "next_text")
    )
    inner = walked.where("part is null").select(*_ROW.names)
    return inner.unionByName(links.mapInArrow(link, from_arrow_schema(_ROW)))


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_next(docs, Scratch(spark, "op1"))
