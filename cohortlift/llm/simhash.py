"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the hashes of the text's word shingles. For radius r
every bit position i gets a vector m(i) of r + 1 bits; table v, one for each non-zero vector of r + 1
bits, keeps the positions whose m(i) has an odd product with v. Whatever r positions differ, some v is
orthogonal to their vectors, so every pair within the radius agrees on all kept bits of some table.

Only distinct fingerprints enter the tables. A bucket of up to ``BUCKET`` of them is compared at once
and emits a spanning set of links, not all pairs. A larger one is dealt out by the points halfway: two
fingerprints within the radius have a point between them, so each one emits the points within half of it,
by flips of bits that the table ignores, and those that meet in a point are linked. No bucket is capped.

Defined results: a null text is empty; a text without words has fingerprint zero and is linked like any
other; rows without id keep their fingerprint, and ids that repeat count as one document for each text.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.llm.common import Scratch, table, whole_text, within
from cohortlift.llm.components import connected_components

SEED = 42
#: Words of a shingle, and bits in which linked fingerprints differ at most.
WORDS, RADIUS = 3, 2
#: Distinct fingerprints of a bucket that are compared in one task: a second or so of work. Points halfway are
#: thousands for each fingerprint at a radius of 6, so they pay only for buckets that are larger still.
BUCKET = 32_768
#: Bytes of text cut into words, and shingles whose bits are counted, at a time.
PIECE_BYTES = 4_000_000
PIECE_SHINGLES = 100_000
_SPACE = b" \t\n\v\f\r"


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces that end at white space."""
    start = 0
    while len(data) - start > PIECE_BYTES:
        end = start + PIECE_BYTES
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles, repeats included, in pieces."""
    digest, carried, any_yet = xxhash.xxh64_intdigest, [], False
    for piece in _pieces(text.encode("utf-8", "surrogatepass").lower()):
        found = carried + piece.split()
        if len(found) >= words:
            any_yet = True
            parts = zip(*(found[k:] for k in range(words)), strict=False)
            n = len(found) - words + 1
            yield np.fromiter((digest(b" ".join(p), SEED) for p in parts), np.uint64, n)
        carried = found[max(0, len(found) - words + 1) :]
    if not any_yet and carried:
        yield np.array([digest(b" ".join(carried), SEED)], dtype=np.uint64)


def simhashes(texts: list[str], words: int) -> list[int]:
    """The fingerprints as signed numbers of 64 bits."""
    totals = np.zeros((len(texts), 64), dtype=np.int64)
    sizes = np.zeros(len(texts), dtype=np.int64)
    held: list[tuple[int, np.ndarray]] = []

    def count() -> None:
        if not held:
            return
        bits = np.unpackbits(np.concatenate([h for _, h in held]).view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.cumsum([0, *(len(h) for _, h in held[:-1])])
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        np.add.at(totals, [i for i, _ in held], sums)
        held.clear()

    waiting = 0
    for i, text in enumerate(texts):
        for piece in shingle_hashes(text, words):
            sizes[i] += len(piece)
            for at in range(0, len(piece), PIECE_SHINGLES):
                part = piece[at : at + PIECE_SHINGLES]
                held.append((i, part))
                waiting += len(part)
                if waiting >= PIECE_SHINGLES:
                    count()
                    waiting = 0
    count()
    set_bits = totals * 2 > sizes[:, None]
    # The bytes were counted as they lie in memory, lowest first.
    return np.packbits(set_bits, axis=1).reshape(-1).view("<i8").tolist()


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp) for every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(simhashes(batch["text"].to_pylist(), words), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], found], names=["doc_id", "fp"])

    plain = docs.select("doc_id", whole_text().alias("text"))
    return plain.mapInArrow(run, f"doc_id {kind}, fp bigint")


def covering_masks(radius: int) -> list[int]:
    """The bits that each table keeps, as signed numbers.

    The vectors of the positions all have the top bit and are dealt out evenly, so that up to a radius of 6
    every table keeps half of the bits. The table of the top bit alone would keep all of them, and is left out:
    fingerprints that agree on all bits are one.
    """
    top = 2**radius
    mixed = random.Random(radius).sample(range(top, 2 * top), top)
    of_bit = [mixed[i % top] for i in range(64)]
    tables = [v for v in range(1, 2 * top) if v != top]
    kept = (sum(1 << i for i in range(64) if (of_bit[i] & v).bit_count() % 2) for v in tables)
    return [m - (1 << 64) if m >> 63 else m for m in kept]


def _star_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning set of the links within ``radius`` among a bucket's fingerprints."""
    root = np.arange(len(fps))
    bits = fps.view(np.uint64)  # bits of a signed number would be counted in its absolute value
    links = []
    for i in range(1, len(fps)):
        near = np.flatnonzero(np.bitwise_count(bits[:i] ^ bits[i]) <= radius)
        if not len(near):
            continue
        groups = root[near]
        root[i] = groups[0]
        links.append((int(fps[i]), int(fps[near[0]])))
        for other in np.unique(groups[groups != groups[0]]):  # one link to each group that i joins
            links.append((int(fps[i]), int(fps[near[np.argmax(groups == other)]])))
            root[root == other] = groups[0]
    return links


def links_within(distinct: DataFrame, radius: int, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links among distinct fingerprints ``fp`` that connect all pairs within ``radius`` bits."""
    masks = covering_masks(radius)
    of_table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("mask")) for n, m in enumerate(masks)])
    # One number names table and kept bits, the table in its low bits; should two buckets get one number,
    # their fingerprints are compared in vain.
    low = (1 << len(masks).bit_length()) - 1
    kept = F.xxhash64(F.col("fp").bitwiseAND(F.col("t.mask")), F.col("t.n"))
    key = kept.bitwiseAND(F.lit(~low)).bitwiseOR(F.col("t.n"))
    placed = distinct.select("fp", F.explode(of_table).alias("t")).select("fp", key.alias("key"))
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = scratch.write(sizes, "buckets")
    small = (
        placed.join(within(sizes.where(F.col("size") <= bucket).select("key")), "key")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for fps in batch["fps"].to_pylist() for x in _star_links(np.array(fps, dtype=np.int64), radius)]
            u, v = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"]
            )

    near = small.select("fps").mapInArrow(compare, "u bigint, v bigint")
    large = placed.join(within(sizes.where(F.col("size") > bucket).select("key")), "key")
    mask = F.get(F.lit(masks), F.col("key").bitwiseAND(F.lit(low)).cast("int"))
    return near.union(_halfway_links(large.select("fp", mask.alias("mask")), radius))


def _halfway_links(placed: DataFrame, radius: int) -> DataFrame:
    """Links of large buckets. Of a pair within the radius one is within half of it, rounded down, of some
    point, and the other within the rest; all that reach a point are linked to the least so near to it."""
    near, far = radius // 2, radius - radius // 2
    flips = [sum(1 << i for i in c) for k in range(far + 1) for c in itertools.combinations(range(64), k)]
    signed = [f - (1 << 64) if f >> 63 else f for f in flips]
    # A pair of the same bucket differs only in bits that its table ignores.
    usable = F.filter(F.lit(signed), lambda f: f.bitwiseAND(F.col("mask")) == 0)
    points = placed.select("fp", F.explode(usable).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), (F.bit_count("flip") <= near).alias("near")
    )
    least = points.where("near").groupBy("point").agg(F.min("fp").alias("v"))
    return points.join(least, "point").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def grouped(docs: DataFrame, words: int, radius: int, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id): the least id reachable by links within ``radius`` bits."""
    prints = scratch.write(fingerprints(docs, words), "prints")
    distinct = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    links = links_within(distinct.select("fp"), radius, scratch, bucket)
    roots = scratch.write(connected_components(links, scratch), "roots")
    linked = distinct.join(roots, distinct["fp"] == roots["node"])
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = linked.join(least, "root").select("fp", "component_id")
    of_print = distinct.join(of_print, "fp", "left").select(
        "fp", F.coalesce("component_id", "first_id").alias("component_id")
    )
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles and the components of links within 2 bits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = grouped(docs, words=WORDS, radius=RADIUS, scratch=Scratch(spark, "op5"))
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
