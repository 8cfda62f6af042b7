"""Spelling variants against brute force over all pairs of words, and against SQL."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlift.llm import registry, spelling
from cohortlift.llm.common import Scratch
from tests.llm.rows import ODD, empty, odd
from tests.oracle_check import differences, run_sql


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= 7
    return {w: n for w, n in found.items() if n >= 2}


def brute(docs):
    n = counted(docs)
    found, close = {}, defaultdict(list)
    for a in n:
        close[a] = [b for b in n if abs(len(a) - len(b)) <= 1 and near(a, b)]
    for a, others in close.items():
        best = min(others, key=lambda b: (-n[b], b), default=None)
        found[a] = best if best and n[best] >= 10 * n[a] else None
    out = []
    for a in n:
        root = a
        while found[root]:
            root = found[root]
        out.append((a, found[a], root, n[a], len(close[a]), n[found[a]] if found[a] else None))
    return sorted(out)


def noisy(seed):
    """Documents of few words with many variants of each, of unlike frequency."""
    rng = random.Random(seed)
    letters = "abcdeéßÿ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(12)]
    stems += [stems[0][:4] + "".join(rng.choice(letters) for _ in range(4)) for _ in range(60)]
    docs = []
    for i in range(150):
        text = []
        for _ in range(40):
            w = list(stems[min(int(rng.expovariate(0.12)), len(stems) - 1)])
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at, c = rng.randrange(len(w)), rng.choice(letters)
                w[at : at + rng.randint(0, 1)] = rng.choice([[], [c]])
            text.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        # A variant of a variant.
        text += ["chainedx"] * 2 + ["chainfdx"] * (i < 24) + ["chaiffdx"] * (i < 2)
        docs.append((i if i % 50 else None, rng.choice([" ", "-", "3", "Ðı"]).join(text)))
    return docs


def rows_of(frame):
    assert dict(frame.dtypes) == {
        "word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint",
    }
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_variants_equal_brute_force(spark, crowd):
    docs = noisy(crowd)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = brute(docs)
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])
    assert rows_of(spelling.variants(frame, Scratch(spark, "t"), crowd)) == want


def test_odd_and_no_rows(spark):
    docs = [(r[0], r[1]) for r in ODD]
    assert rows_of(spelling.variants(odd(spark), Scratch(spark, "t"))) == brute(docs)
    assert spelling.variants(empty(spark), Scratch(spark, "t")).count() == 0


def test_paths_are_followed_to_their_ends(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(18)] + [(f"v{i}", "w3") for i in range(40)]
    found = spelling.roots(spark.createDataFrame(links, "word string, form string"), Scratch(spark, "t"))
    assert {r["root"] for r in found.collect()} == {"w18"} and found.count() == 58


@pytest.mark.parametrize("crowd", [0, 2, 10_000])
def test_every_near_pair_of_a_crowd(spark, crowd):
    """Words of one shape share most chunks; each pair within one edit is found once."""
    rng = random.Random(crowd)
    vocabulary = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 10))) for _ in range(300)}
    frame = spark.createDataFrame([(w, 2) for w in vocabulary], "word string, n bigint")
    table = Scratch(spark, "t").write(frame, "vocabulary")
    found = spelling.near_pairs(table, Scratch(spark, "t"), crowd).select("a", "b").collect()
    pairs = [tuple(sorted(r)) for r in found]
    want = {(a, b) for a in vocabulary for b in vocabulary if a < b and near(a, b)}
    assert len(pairs) == len(want) and set(pairs) == want


def test_crowded_chunks_are_not_paired_directly(spark):
    """2,000 words with one first half: the refined keys meet far fewer pairs than the chunk has."""
    rng = random.Random(7)
    vocabulary = {"common" + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2_000)}
    frame = spark.createDataFrame([(w, 2) for w in vocabulary], "word string, n bigint")
    chunk, gram = spelling.chunks(frame), spelling.grams(frame)
    whole = chunk.join(gram, "key").count()
    left = spelling._refined(chunk, True).select("key", F.col("word").alias("a"))
    right = spelling._refined(gram, False).select("key", F.col("word").alias("b"))
    met = left.join(right, "key").where("a <> b").count()
    assert whole > len(vocabulary) ** 2 and met < 0.01 * whole


def test_op12_equals_its_sql(spark):
    for data in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        columns, rows = run_sql(data, registry.oracle_sql()["op12_spelling"])
        assert differences(registry.queries()["op12_spelling"](spark, data), columns, rows) == ""
