"""Hashed word and character n-gram features, and a linear softmax over their averaged embeddings.

The features of a text are its words (runs without white space), the pairs of words that follow one
another (a word that follows itself is one feature, whatever the word) and the character n-grams of each
word, with the white space beside it as the mark of its ends; each is hashed to a bucket. A document is the
mean of its features' learned vectors, and a softmax over a linear map of that mean gives the classes.
Both are trained by stochastic gradient descent. As the map is linear, scoring adds up for each feature
the product of its vector and the map, which gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.common import batched, least_of_each, one_text_each

#: Characters whose features are hashed at a time; a longer text is cut at white space.
BATCH_CHARS = 1_000_000
_PRIME = np.uint32(0x01000193)


@dataclass(frozen=True)
class Features:
    grams: tuple[int, ...] = (2, 3, 4)
    #: Whether pairs of words are features.
    pairs: bool = True
    #: Buckets shared by all kinds of features, a power of two.
    buckets: int = 1 << 15
    #: Whether letters in upper case are other letters.
    cased: bool = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, a space before and after each, and where each text starts."""
    joined = " ".join(["", *texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return codes, starts


def is_space(codes: np.ndarray) -> np.ndarray:
    return (codes <= 32) | (codes == 0x85) | (codes == 0xA0) | (codes == 0x3000) | (
        (codes >= 0x2000) & (codes <= 0x200A)
    )


def word_hashes(codes: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and a hash of its letters and their order."""
    word = ~space
    first = word & np.concatenate([[True], space[:-1]])
    at = np.flatnonzero(first)
    if not len(at):
        return at, np.zeros(0, dtype=np.uint32)
    number = np.cumsum(first) - 1
    place = (np.arange(len(codes)) - at[np.maximum(number, 0)]).astype(np.uint32)
    letter = _mixed(codes + place * np.uint32(0x9E3779B9))
    letter[space] = 0
    return at, _mixed(np.add.reduceat(letter, at, dtype=np.uint32))


def gram_hashes(codes: np.ndarray, space: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the n letters from each place on, and whether that is an n-gram of one word."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=bool)
    letters = np.where(space, np.uint32(32), codes)
    found = np.full(size, np.uint32(n))
    for k in range(n):
        found = found * _PRIME + letters[k : k + size]
    valid = np.ones(size, dtype=bool)
    for k in range(1, n - 1):
        valid &= ~space[k : k + size]
    if n == 2:
        valid = ~(space[:size] & space[1 : size + 1])
    return _mixed(found), valid


def pieces(text: str, limit: int = BATCH_CHARS) -> Iterator[str]:
    """``text`` in pieces of about ``limit`` characters, cut at white space (a run without any is cut)."""
    start = 0
    while len(text) - start > limit:
        end = start + limit
        while end < min(len(text), start + 2 * limit) and not text[end].isspace():
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def summed(texts: list[str], f: Features, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of ``values`` (a row for each bucket) over its features, and their number."""
    total = np.zeros((len(texts), values.shape[1]))
    number = np.zeros(len(texts))
    parts = [(i, p) for i, t in enumerate(texts) for p in pieces(t if f.cased else t.lower())]
    owners = np.array([i for i, _ in parts], dtype=np.int64)
    strings = [p for _, p in parts]
    for a, b in batched(strings, BATCH_CHARS):
        codes, starts = code_points(strings[a:b])
        space = is_space(codes)
        for kept, buckets in _found(codes, space, starts, f):
            edges = np.searchsorted(kept, starts)
            count = np.diff(edges)
            np.add.at(number, owners[a:b], count)
            full = np.flatnonzero(count)
            if len(full):
                for k in range(values.shape[1]):
                    sums = np.add.reduceat(values[buckets, k], edges[:-1][full])
                    np.add.at(total[:, k], owners[a:b][full], sums)
    return total, number


def _found(
    codes: np.ndarray, space: np.ndarray, starts: np.ndarray, f: Features
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature the places and buckets."""
    mask = np.uint32(f.buckets - 1)
    at, words = word_hashes(codes, space)
    yield at, words & mask
    if f.pairs:
        of_text = np.searchsorted(starts, at, "right")
        same_text = of_text[1:] == of_text[:-1]
        pair = _mixed(words[:-1] * _PRIME + words[1:])
        pair[words[:-1] == words[1:]] = 0
        yield at[1:][same_text], pair[same_text] & mask
    for n in f.grams:
        hashes, valid = gram_hashes(codes, space, n)
        kept = np.flatnonzero(valid)
        yield kept, hashes[kept] & mask


def sparse_counts(text: str, f: Features) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's features and how often each occurs."""
    total = np.zeros(f.buckets, dtype=np.int64)
    for piece in pieces(text if f.cased else text.lower()):
        codes, starts = code_points([piece])
        for _, buckets in _found(codes, is_space(codes), starts, f):
            total += np.bincount(buckets, minlength=f.buckets)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass(frozen=True)
class Model:
    classes: list
    features: Features
    #: Of each bucket its vector times the map, a column for each class.
    table: np.ndarray
    bias: np.ndarray
    #: What logits are divided by, so that probabilities are calibrated.
    temperature: float = 1.0
    #: Of the rows kept apart that were predicted rightly, the probabilities of their class, ascending.
    confident: tuple[float, ...] = ()

    def probabilities(self, texts: list[str]) -> np.ndarray:
        total, number = summed(texts, self.features, self.table)
        return softmax((total / np.maximum(number, 1)[:, None] + self.bias) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Training:
    #: Labelled rows of a class that are learned from at most, those of least hash of the id.
    rows_per_class: int = 1_500
    #: Classes that the driver may hold; more label values are an error.
    classes: int = 256
    dimensions: int = 12
    epochs: int = 12
    rate: float = 8.0
    batch: int = 32
    seed: int = 7


def training_rows(labelled: DataFrame, t: Training) -> DataFrame:
    """(doc_id, label): the bounded sample of the labelled rows that training may see; of two labels the greater."""
    known = labelled.where("doc_id is not null and label is not null").select("doc_id", "label")
    once = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    return least_of_each(once, "label", "doc_id", t.rows_per_class)


def fit(docs: DataFrame, labelled: DataFrame, f: Features, t: Training) -> Model | None:
    """Learn the classes of ``labelled`` (doc_id, label); None if there is no labelled document.

    Executors turn the sampled texts, whole, into counts of at most ``f.buckets`` numbers; the driver
    gets at most ``rows_per_class`` such rows of each class, one for each id however many documents have it. All label values are learned, or none: more than
    ``classes`` raise a ValueError, as a document of one left out would get a wrong label.
    """
    values = labelled.where("label is not null").select("label").distinct().limit(t.classes + 1).count()
    if values > t.classes:
        raise ValueError(f"more than {t.classes} label values; raise Training.classes to learn them all")
    if not values:
        return None
    sample = training_rows(labelled, t)
    kind = dict(sample.dtypes)["label"]

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sparse_counts(text, f) for text in batch["text"].to_pylist()]
            at = pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32()))
            n = pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["label"], at, n], names=["label", "at", "n"])

    rows = one_text_each(docs, sample).select("label", "text").mapInArrow(featurize, f"label {kind}, at array<int>, n array<int>")
    table = rows.toArrow()
    labels = table["label"].to_pylist()
    classes = sorted(set(labels))
    at = [np.asarray(x, dtype=np.int64) for x in table["at"].to_pylist()]
    n = [np.asarray(x, dtype=np.float64) for x in table["n"].to_pylist()]
    # The order in which rows arrive is not fixed; training must not depend on it.
    order = sorted(range(len(at)), key=lambda i: (str(labels[i]), len(at[i]), at[i].tobytes(), n[i].tobytes()))
    return train(
        [at[i] for i in order], [n[i] for i in order], [classes.index(labels[i]) for i in order], classes, f, t
    )


def train(at: list, n: list, labels: list[int], classes: list, f: Features, t: Training) -> Model:
    """Stochastic gradient descent; a tenth of the rows is kept apart to calibrate the temperature."""
    rng = np.random.default_rng(t.seed)
    y = np.array(labels)
    vectors = rng.normal(0, 1 / t.dimensions, (f.buckets, t.dimensions))
    weights = np.zeros((t.dimensions, len(classes)))
    weights[:] = rng.normal(0, 0.1, weights.shape)
    bias = np.zeros(len(classes))
    # Classes weigh alike, however many rows each has.
    balance = len(y) / (len(classes) * np.maximum(np.bincount(y, minlength=len(classes)), 1))
    order = rng.permutation(len(y))
    apart = order[: len(order) // 10] if len(order) >= 50 else order[:0]
    learn = order[len(apart) :]
    share = [c / max(1, c.sum()) for c in n]

    def mean(i: int) -> np.ndarray:
        return share[i] @ vectors[at[i]]

    steps, done = max(1, t.epochs * -(-len(learn) // t.batch)), 0
    for _ in range(t.epochs):
        rng.shuffle(learn)
        for start in range(0, len(learn), t.batch):
            rate = t.rate * (1 - done / steps)
            done += 1
            rows = learn[start : start + t.batch]
            hidden = np.stack([mean(i) for i in rows])
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error *= balance[y[rows], None] / len(rows)
            back = error @ weights.T
            weights -= rate * 0.1 * hidden.T @ error
            bias -= rate * 0.1 * error.sum(axis=0)
            for g, i in zip(back, rows, strict=True):
                # Shares are small, so their square root keeps rare features learning.
                vectors[at[i]] -= rate * np.sqrt(share[i])[:, None] * g
    table = vectors @ weights
    temperature, confident = 1.0, []
    if len(apart):
        logits = np.stack([share[i] @ table[at[i]] for i in apart]) + bias
        loss = lambda d: -np.log(softmax(logits / d)[np.arange(len(apart)), y[apart]] + 1e-12).mean()
        temperature = float(min(np.geomspace(0.25, 4, 33), key=loss))
        chances = softmax(logits / temperature)
        confident = np.sort(chances.max(axis=1)[chances.argmax(axis=1) == y[apart]]).tolist()
    return Model(list(classes), f, table, bias, temperature, tuple(confident))
