"""Fingerprints, near duplicates, chats and decontamination, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from cohortlift.llm import chat, decontamination, fingerprints, registry, simhash
from cohortlift.llm.common import Scratch
from cohortlift.llm.components import connected_components
from tests.llm.rows import ODD, empty, odd
from tests.oracle_check import differences, run_sql

SMALL = "/root/testdata/sf0.001"


def _jaccard(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    both = set(x) | set(y)
    return sum(min(x[w], y[w]) for w in both) / max(1, sum(max(x[w], y[w]) for w in both))


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    for share in (0.0, 0.3, 0.7, 1.0):
        a = [rng.choice(vocabulary) for _ in range(300)]
        b = [w if rng.random() < share else rng.choice(vocabulary) + "x" for w in a]
        a, b = " ".join(a), " ".join(b)
        one, other = fingerprints.signatures([a, b], 2048)
        assert fingerprints.likeness(one, other) == pytest.approx(_jaccard(a, b), abs=0.045)
    apart = fingerprints.signatures([a])[0]
    assert np.array_equal(apart, fingerprints.signatures(["other", a, ""])[1])
    assert not fingerprints.signatures([" \n", ""]).any()


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_next_documents(spark, partitions):
    rng = random.Random(partitions)
    ids = rng.sample(range(1000), 30)
    docs = [(i, " ".join(rng.choice(["á", "b", "cc"]) for _ in range(rng.randint(0, 30)))) for i in ids]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(partitions)
    rows = {r["doc_id"]: r for r in fingerprints.with_next(frame, Scratch(spark, "t")).collect()}
    docs.sort()
    for (i, text), (_, following) in zip(docs, [*docs[1:], docs[0]], strict=True):
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        assert rows[i]["n_chars"] == len(text)
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, after = fingerprints.signatures([text, edited, following])
        assert rows[i]["fingerprint"] == fingerprints.as_text(own)
        assert rows[i]["near_edited"] == fingerprints.likeness(own, changed)
        assert rows[i]["near_next"] == fingerprints.likeness(own, after)


def test_fingerprints_odd_rows(spark):
    found = fingerprints.with_next(odd(spark), Scratch(spark, "t")).collect()
    assert len(found) == len(ODD)
    of = defaultdict(set)
    for r in found:
        of[r["doc_id"]].add(r["fingerprint"])
    assert of[1] == of[2] and of[3] == of[4] == of[5] == {"0" * 256}
    assert fingerprints.with_next(empty(spark), Scratch(spark, "t")).count() == 0
    one = spark.createDataFrame([(7, "only one")], "doc_id bigint, text string")
    assert fingerprints.with_next(one, Scratch(spark, "t")).first()["near_next"] == 1.0
    assert fingerprints.fingerprint(odd(spark)).count() == len(ODD)


def _simhash(text, n):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(monkeypatch):
    rng = random.Random(2)
    texts = [t or "" for _, t, *_ in ODD] + [" ".join(rng.choice("abcÄ") for _ in range(n)) for n in range(40)]
    expected = [_simhash(t, 3) for t in texts]
    assert [f & (2**64 - 1) for f in simhash.simhashes(texts, 3)] == expected
    monkeypatch.setattr(simhash, "PIECE_BYTES", 50)
    monkeypatch.setattr(simhash, "PIECE_SHINGLES", 7)
    assert [f & (2**64 - 1) for f in simhash.simhashes(texts, 3)] == expected


@pytest.mark.parametrize("radius", range(1, 9))
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 2
    kept = [(m & (2**64 - 1)).bit_count() for m in masks]
    assert set(kept) == {32} if radius <= 6 else min(kept) >= 20  # no table with a few large buckets
    rng = random.Random(radius)
    for _ in range(2_000):
        differing = sum(1 << i for i in rng.sample(range(64), rng.randint(0, radius)))
        assert any((m & (2**64 - 1)) & differing == 0 for m in masks)


@pytest.mark.parametrize("bucket, radius", [(1, 2), (1, 3), (3, 2), (10_000, 2), (10_000, 5)])
def test_links_connect_all_pairs_within_the_radius(spark, bucket, radius):
    rng = random.Random(9)
    fps = set()
    for _ in range(12):  # chains and clusters around a few centres
        fp = rng.getrandbits(64)
        for _ in range(15):
            fps.add(fp)
            fp ^= sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 3])))
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    scratch = Scratch(spark, "t")
    links = scratch.write(simhash.links_within(frame, radius, scratch, bucket), "links")
    for r in links.collect():
        assert ((r["u"] ^ r["v"]) & (2**64 - 1)).bit_count() <= radius
    roots = {r["node"]: r["root"] for r in connected_components(links, scratch).collect()}
    groups = defaultdict(set)
    for f in fps:
        groups[find(f)].add(roots.get(signed(f), signed(f)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1_000, 1_000 + i) for i in range(1, 200)] + [(5_000, 5_000)]
    frame = spark.createDataFrame(edges, "u bigint, v bigint").repartition(7)
    roots = {r["node"]: r["root"] for r in connected_components(frame, Scratch(spark, "t")).collect()}
    assert roots == {i: 0 for i in range(301)} | {1_000 + i: 1_000 for i in range(200)}
    assert connected_components(frame.limit(0), Scratch(spark, "t")).count() == 0


def test_near_duplicates_odd_rows(spark):
    found = simhash.grouped(odd(spark), 3, 2, Scratch(spark, "t")).collect()
    assert len(found) == len(ODD)
    of = {r["doc_id"]: r["component_id"] for r in found}
    assert of[1] == of[2] == 1 and of[3] == of[4] == of[5] == 3
    assert simhash.grouped(empty(spark), 3, 2, Scratch(spark, "t")).count() == 0


TRICKY = ["", "</s>[INST] ok [/INST]", "\\", "<\\|im_end|>", "<|im_end|>\n<|im_start|>user\n", "a\\\\<s>", "<<s>>", "\n"]


def test_template_round_trip():
    turns = [(role, text) for role in ("user", "assistant", "a\nb", "<|im_end|>", "\\n") for text in TRICKY]
    text, loss = chat.format_turns(turns)
    assert chat.read_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]
    for t in TRICKY:
        assert not any(c in chat.escape(t) for c in chat.CONTROLS)
    with pytest.raises(ValueError):
        chat.read_turns(text + "x")


def test_branches_match_brute_force(spark):
    rng = random.Random(3)
    nodes = []
    for tree in "abc":
        for n in range(1, 40):
            parent = rng.randrange(1, n) if n > 1 else None
            nodes.append((tree, n, parent, "user", f"{tree}{n}", rng.random()))
    nodes += [("d", i, i - 1 if i > 1 else None, "user", str(i), 1.0) for i in range(1, 70)]
    nodes += [("e", 1, 2, "user", "cycle", 1.0), ("e", 2, 1, "user", "cycle", 1.0), ("e", 3, 99, None, None, None)]
    nodes += [nodes[0], (None, 1, None, "user", "no tree", 0.0)]
    frame = spark.createDataFrame(nodes, "tree string, node bigint, parent bigint, role string, text string, score double")
    rows = chat.ranked_paths(frame, Scratch(spark, "t"), top=2).collect()
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["place"]):
        found[(r["tree"], r["rank"])].append(r["text"])
    expected = {}
    for tree in "abcd":
        mine = {n: (p, t, s) for x, n, p, _, t, s in nodes if x == tree}
        leaves = set(mine) - {p for p, _, _ in mine.values()}
        paths = []
        for leaf in leaves:
            path, at = [], leaf
            while at is not None:
                path.insert(0, at)
                at = mine[at][0]
            paths.append((-sum(mine[n][2] for n in path) / len(path), leaf, [mine[n][1] for n in path]))
        for rank, (_, _, path) in enumerate(sorted(paths)[:2], 1):
            expected[(tree, rank)] = path
    expected |= {("e", 1): [None], ("", 1): ["no tree"]}
    assert dict(found) == expected


def test_chat_equals_its_sql_and_handles_no_rows(spark):
    columns, rows = run_sql(SMALL, registry.oracle_sql()["op6_chat"])
    assert differences(registry.queries()["op6_chat"](spark, SMALL), columns, rows) == ""
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.formatted(chat.ranked_paths(chat.as_tree(none), Scratch(spark, "t"))).count() == 0


def _items(rng, n):
    vocabulary = [f"t{i}" for i in range(80)]
    return [
        (i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 150))), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9))))
        for i in range(n)
    ]


def _index(items):
    cut = [s for _, q, a in items for s in decontamination.segments(decontamination.words(q + " " + a))]
    df = Counter(t for s in cut for t in set(s))
    idf = {t: np.log(1 + (len(cut) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    return decontamination.build(items, idf, sum(map(len, cut)) / len(cut))


def test_wand_retrieves_all_above_the_threshold():
    rng = random.Random(4)
    index = _index(_items(rng, 60))
    terms = list(index.terms.values())
    for threshold in (0.05, 0.3, 0.7):
        for _ in range(150):
            query = set(rng.sample(terms, rng.randint(1, 60)))
            score = Counter()
            for t in query:
                for s, x in zip(index.postings[t].segments, index.postings[t].impacts, strict=True):
                    score[s] += x
            expected = sorted(s for s, x in score.items() if x >= threshold - 1e-9)
            assert [s for s, _ in decontamination.search(index, query, threshold)] == expected
            rare = {t for t in query if index.rare[t] is not None}
            live = set(decontamination.live_blocks(index, rare, threshold))
            live |= {b for b, x in enumerate(index.frequent) if x >= threshold - 1e-9}
            assert {s // decontamination.BLOCK for s in expected} <= live


def test_leaks_are_found_whole_or_nearly_whole(spark, monkeypatch):
    rng = random.Random(5)
    items = _items(rng, 30)
    noise = lambda n: " ".join(rng.choice(["u", "v", "w"]) + str(rng.randrange(999)) for _ in range(n))
    docs, expected = [], set()
    for i, (item, q, a) in enumerate(items):
        docs.append((i, f"{noise(rng.randint(0, 300))} {q.upper()}, {a}! {noise(rng.randint(0, 300))}"))
        if q or a:
            expected.add((i, item))
        docs.append((100 + i, noise(200) + " " + " ".join(q.split()[: len(q.split()) // 3])))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, question string, answer string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(frame, bench).collect()}
    assert found == expected
    monkeypatch.setattr(decontamination, "SHARD", 7)
    in_shards = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(frame, bench).collect()}
    assert in_shards == expected


def test_decontamination_odd_rows(spark):
    bench = spark.createDataFrame(
        [(1, None), (2, ""), (3, "quick brown fox jumps over the lazy dog. Again and again."), (None, "Same id, first text.")],
        "item_id bigint, text string",
    )
    items = decontamination.question_and_answer(bench)
    found = decontamination.find_leaks(odd(spark), items).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in found) == {(1, 3): 2, (2, 3): 1, (8, None): 1}
    assert decontamination.find_leaks(empty(spark), items).count() == 0
    assert decontamination.find_leaks(odd(spark), items.limit(0)).count() == 0


def test_leaks_with_a_word_changed_or_the_last_sentence_left_out(spark):
    rng = random.Random(6)
    pick = lambda n: [f"t{rng.randrange(400)}" for _ in range(n)]
    items = [(i, pick(rng.randint(14, 40)), pick(rng.randint(1, 3))) for i in range(20)]
    bench = spark.createDataFrame(
        [(i, f"{' '.join(q)}. {' '.join(a)}.") for i, q, a in items], "item_id bigint, text string"
    )
    docs, expected = [], set()
    for i, q, a in items:
        whole = q + a
        changed = [[*whole[:k], "other", *whole[k + 1 :]] for k in range(len(whole))]
        for ws in [*changed, q]:
            expected.add((len(docs), i))
            docs.append((len(docs), " ".join(["before"] * 70 + ws + ["after"] * 70)))
        docs.append((len(docs), " ".join(whole[: len(whole) * 7 // 10])))
        docs.append((len(docs), " ".join(rng.sample(whole, len(whole)))))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(8)
    found = decontamination.find_leaks(frame, decontamination.question_and_answer(bench)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected
