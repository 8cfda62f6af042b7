"""Classifiers: gradients, windows, held-out accuracy, odd rows."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pytest

from cohortlift.llm import common, language, quality, subword, toxicity
from tests.llm.rows import empty, odd

FEATURES = subword.Features(buckets=1 << 12)
TRAINING = subword.Training(rows_per_class=60, epochs=10)


def _brute_features(text, f):
    """Words, pairs and n-grams of a text one by one, in the hashes of single-word texts."""
    total = np.zeros(f.buckets)
    codes, starts = subword.code_points([text])
    for _, buckets in subword._found(codes, subword.is_space(codes), starts, f):
        np.add.at(total, buckets, 1)
    return total


def test_sums_do_not_depend_on_the_batch_or_on_cuts(monkeypatch):
    rng = np.random.default_rng(0)
    values = rng.normal(size=(FEATURES.buckets, 2))
    texts = ["", "a", "one two two three", " lead and trail ", "ÄÖ ü \U0001f600", "same same same", "\n"]
    total, number = subword.summed(texts, FEATURES, values)
    for i, text in enumerate(texts):
        counts = _brute_features(text, FEATURES)
        assert total[i] == pytest.approx(counts @ values)
        assert number[i] == counts.sum()
        alone, _ = subword.summed([text], FEATURES, values)
        assert alone[0] == pytest.approx(total[i])
    at, n = subword.sparse_counts("one two two three", FEATURES)
    assert np.array_equal(np.flatnonzero(_brute_features("one two two three", FEATURES)), at)
    long = " ".join(f"w{i % 97}" for i in range(2_000))
    whole, _ = subword.summed([long], subword.Features(pairs=False), np.ones((1 << 15, 1)))
    monkeypatch.setattr(subword, "BATCH_CHARS", 100)
    monkeypatch.setattr(subword.pieces, "__defaults__", (100,))
    cut, _ = subword.summed([long], subword.Features(pairs=False), np.ones((1 << 15, 1)))
    assert abs(whole[0, 0] - cut[0, 0]) <= 4 * len(long) / 100  # n-grams at the cuts


def _labelled(spark, n=240):
    rng = random.Random(2)
    good, bad = ["river", "stone", "cloud", "tree", "bird"], ["CLICK!!", "buy%%%", "|", "now***"]
    docs = [
        (i, " ".join(rng.choice(good if i % 3 else bad) for _ in range(rng.randint(3, 60))))
        for i in range(n)
    ]
    labels = [(i, int(i % 3 > 0)) for i in range(n)]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, label int"),
    )


def test_quality_on_held_out_rows(spark):
    docs, labels = _labelled(spark)
    model = subword.fit(docs, labels.where("doc_id < 160"), FEATURES, TRAINING)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert len(scores) == 240
    assert np.mean([(scores[i] >= 0.5) == (i % 3 > 0) for i in range(160, 240)]) > 0.95
    assert all(0 <= s <= 1 for s in scores.values())
    again = subword.fit(docs.repartition(5), labels.where("doc_id < 160"), FEATURES, TRAINING)
    assert np.array_equal(model.table, again.table)  # whatever order the rows come in


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (8, None), (77, 0)], "doc_id bigint, label int")
    model = subword.fit(odd(spark), labels, FEATURES, TRAINING)
    rows = quality.score(odd(spark), model).collect()
    assert len(rows) == odd(spark).count()
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[1] == by_id[2] and by_id[3] == by_id[4] == by_id[5]
    assert quality.score(empty(spark), model).count() == 0
    assert subword.fit(odd(spark), labels.limit(0), FEATURES, TRAINING) is None
    assert {r["score"] for r in quality.score(odd(spark), None).collect()} == {0.5}


def test_language_on_held_out_rows(spark):
    rng = random.Random(6)
    syllables = {"en": ["the", "ing", "and", "ou"], "de": ["sch", "ung", "die", "ü"], "fr": ["eau", "que", "é", "les"]}
    langs = sorted(syllables)
    rows = []
    for i in range(300):
        lang = langs[i % 3]
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(20)]
        rows.append((i, " ".join(words), lang))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string")
    model = subword.fit(docs, docs.where("doc_id < 200"), language.FEATURES, TRAINING)
    found = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert np.mean([found[i]["lang_pred"] == langs[i % 3] for i in range(200, 300)]) > 0.97
    strange = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... !"), (4, "é1")], "doc_id bigint, text string")
    und = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(strange, model).collect()}
    assert und[1] == und[2] == und[3] == ("und", 0.0)
    assert und[4][0] in langs
    assert {r["lang_pred"] for r in language.predict(odd(spark), None).collect()} == {"und"}
    assert language.predict(empty(spark), model).count() == 0


def test_network_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.new_params(rng).items()}
    w = toxicity.corpus(["ab cd ef gh " * 4, "one two", "", "ab one one"], [1, 0, 0, 1])
    rows = np.arange(len(w.text))
    k, there = w.take(rows)
    y = w.toxic[w.text]
    _, gradient = toxicity.loss_gradient(p, k, there, y)
    for name in ("word", "gram"):
        at, values = gradient[name]
        gradient[name] = np.zeros_like(p[name])
        gradient[name][at] = values
    places = {"word": [(int(k.words[0]), 2)], "gram": [(int(k.grams[0]), 3)]}
    for name, values in p.items():
        for i in places.get(name) or [tuple(rng.integers(0, n) for n in values.shape) for _ in range(3)]:
            before = values[i]
            losses = []
            for change in (1e-3, -1e-3):
                values[i] = before + change
                losses.append(toxicity.loss_gradient(p, k, there, y)[0])
            values[i] = before
            assert gradient[name][i] == pytest.approx((losses[0] - losses[1]) / 2e-3, abs=2e-5)


def _plain_logit(p, words):
    """One window, word by word and number by number, by the equations of the network."""
    h = toxicity.HIDDEN
    inputs = []
    for word in words:
        t = toxicity.tokens([word])
        grams = [p["gram"][g] for g in t.grams]
        inputs.append(np.concatenate([p["word"][t.words[0]], np.mean(grams, axis=0) if grams else np.zeros(8)]))

    def unit(side, order):
        states, state = {}, np.zeros(h)
        for i in order:
            x, back = inputs[i] @ p[f"x_{side}"] + p[f"x_b_{side}"], state @ p[f"u_{side}"]
            z, r = (1 / (1 + np.exp(-(x[k * h : (k + 1) * h] + back[k * h : (k + 1) * h]))) for k in (0, 1))
            new = np.tanh(x[2 * h :] + r * back[2 * h :])
            state = states[i] = (1 - z) * new + z * state
        return states

    forth, back = unit("f", range(len(words))), unit("b", reversed(range(len(words))))
    both = [np.concatenate([forth[i], back[i]]) for i in range(len(words))]
    if not both:
        return float(p["out_b"][0])
    weight = np.exp([np.tanh(s @ p["att"] + p["att_b"]) @ p["att_v"] for s in both])
    return float((weight / weight.sum()) @ np.array(both) @ p["out"] + p["out_b"][0])


def test_every_overlapping_window_is_scored(monkeypatch):
    """Against windows that slide by one word, each scored by itself."""
    p = toxicity.new_params(np.random.default_rng(1))
    rng = random.Random(8)
    size = toxicity.WINDOW
    texts = [
        " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(n))
        for n in (0, 1, size - 1, size, 0, size + 1, 33, 100, 2)
    ]
    want = [
        [_plain_logit(p, words[s : s + size]) for s in range(max(1, len(words) - size + 1))]
        for words in (text.split() for text in texts)
    ]
    monkeypatch.setattr(toxicity, "BATCH_WINDOWS", 17)
    t = toxicity.tokens(texts)
    assert toxicity.window_logits(p, t) == pytest.approx([x for each in want for x in each], abs=1e-4)
    assert toxicity.logits(p, t) == pytest.approx([max(each) for each in want], abs=1e-4)
    assert toxicity._all_logits(p, toxicity.corpus(texts, [0] * 9)) == pytest.approx(
        [x for each in want for x in each], abs=1e-4
    )
    monkeypatch.setattr(toxicity, "BATCH_CHARS", 100)
    cut = [toxicity.logits(p, toxicity.tokens([part]))[0] for part in toxicity.parts(texts[-2])]
    assert len(cut) > 2 and max(cut) == pytest.approx(max(want[-2]), abs=1e-4)
    both = [x for each in want for x in each]
    assert toxicity._all_logits(p, toxicity.corpus(texts, [0] * 9)) == pytest.approx(both, abs=1e-4)


def test_first_look_finds_the_telling_words():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(40)) for _ in range(60)]
    texts[:15] = [t[:30] + "vile " + t[30:] for t in texts[:15]]
    w = toxicity.corpus(texts, [1] * 15 + [0] * 45)
    found = toxicity._first_look(w, np.ones(60, dtype=bool))
    for i in range(15):
        at = np.flatnonzero(w.text == i)
        best = w.first[at[np.argmax(found[at])]] - w.tokens.edges[i]
        assert "vile" in texts[i].split()[best : best + toxicity.WINDOW]


def test_one_text_of_an_id_is_learned_from(spark, monkeypatch):
    """3,000 documents share an id; of each id one text reaches the driver, whatever the order of the rows."""
    rows = [(1, f"text {i % 7}") for i in range(3_000)] + [(i, f"other text {i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id bigint, label int")
    few = replace(TRAINING, rows_per_class=10)
    seen = []
    collect = type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: seen.append(collect(df)) or seen[-1])
    subword.fit(docs, labels, FEATURES, few)
    toxicity.training_corpus(docs, labels, few)
    assert [t.num_rows for t in seen] == [20, 20]
    each = subword.one_text_each(docs, labels).collect()
    assert len(each) == 59
    again = subword.one_text_each(docs.repartition(3), labels).collect()
    assert {tuple(r) for r in each} == {tuple(r) for r in again}


@pytest.mark.parametrize("most", [1, 600, 1_500, 5_000])
def test_least_hashes_of_each_group(spark, most):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 40 == 0, "b").otherwise("a").alias("label"))
    found = common.least_of_each(rows, "label", "doc_id", most)
    hashed = rows.withColumn("h", F.xxhash64("doc_id")).collect()
    want = set()
    for label in "ab":
        want |= {r.doc_id for r in sorted((r.h, r) for r in hashed if r.label == label)[:most] for r in [r[1]]}
    assert {r.doc_id for r in found.collect()} == want
    text = found._jdf.queryExecution().toString()
    assert "Window" not in text  # no task sorts a whole class
    assert common.least_of_each(rows.limit(0), "label", "doc_id", most).count() == 0


def test_acceptance_lets_through_its_share():
    model = subword.Model(["a"], FEATURES, np.zeros((1, 1)), np.zeros(1), 1.0, tuple(np.linspace(0.5, 1, 101)))
    bound = language.acceptance(model, 0.9)
    assert sum(x >= bound for x in model.confident) == 91
    assert language.acceptance(replace(model, confident=())) == 0.0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(["calm", "green", "walk", "house", "letter", "song"]) + rng.choice("abc") for _ in range(80)]
        if i % 4 == 0:
            words[rng.randrange(80)] = rng.choice(["nasty", "awfulness"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame(labels, "doc_id bigint, label int")
    model = toxicity.fit(docs, labels.where("doc_id < 300"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert np.mean([(scores[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400)]) > 0.95

    rows = toxicity.score(odd(spark), model, ["key", "text", "doc_id"]).collect()
    assert len(rows) == odd(spark).count()
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[1] == pytest.approx(by_id[2], abs=1e-5) and by_id[3] == by_id[4] == by_id[5]
    assert toxicity.score(empty(spark), model, ["doc_id"]).count() == 0
    assert toxicity.fit(docs, labels.where("label = 0")) is None
    assert {r["score"] for r in toxicity.score(odd(spark), None, ["doc_id"]).collect()} == {0.0}


def test_more_label_values_than_may_be_learned_are_an_error(spark):
    rows = [(i, f"word{i % 3} " * 9, f"l{i % 3}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string")
    three = replace(TRAINING, classes=3)
    assert subword.fit(docs, docs.select("doc_id", "label"), FEATURES, three).classes == ["l0", "l1", "l2"]
    with pytest.raises(ValueError, match="label values"):
        subword.fit(docs, docs.select("doc_id", "label"), FEATURES, replace(three, classes=2))
