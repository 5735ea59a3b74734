"""Toxicity, quality and language."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from medlar.llm import importance, language, toxicity
from medlar.llm.shared import mix64, span_hashes, text_bytes


def plain_models(texts, toxic):
    """The two models of small texts by the formulas, word for word, as functions of (class, word before, word)."""
    words = [re.findall("[a-z]+", t.lower()) for t in texts]
    single = [Counter(w for x, y in zip(words, toxic, strict=True) if y == c for w in set(x)) for c in (0, 1)]
    double = [Counter(p for x, y in zip(words, toxic, strict=True) if y == c for p in set(zip(["", *x], x, strict=False))) for c in (0, 1)]
    d, vocabulary = toxicity.DISCOUNT, set(single[0]) | set(single[1])
    spread = len(single[0]) + len(single[1])

    def shared(w):
        own = lambda x: max((single[0][x] > 0) + (single[1][x] > 0) - d, 0) / spread
        return own(w) + (1 - sum(map(own, vocabulary))) / (len(vocabulary) + 1)

    def unigram(c, w):
        total = sum(single[c].values())
        left = 1 - sum(max(n - d, 0) for n in single[c].values()) / total
        return max(single[c][w] - d, 0) / total + left * shared(w)

    often = {p for p in set(double[0]) | set(double[1]) if double[0][p] + double[1][p] >= toxicity.PAIR_TEXTS}

    def bigram(c, v, w):
        total = sum(n for (x, _), n in double[c].items() if x == v)
        kept = {y: max(double[c][v, y] - d, 0) / max(total, 1) for x, y in often if x == v}
        return kept.get(w, 0) + (1 - sum(kept.values())) * unigram(c, w)

    return unigram, bigram, vocabulary


def test_toxicity_models_against_the_formulas(spark):
    good, bad = ["The cat sat on the mat", "the dog sat on the log", "a cat and a dog", "the cat sat", "on the mat the dog"], ["a vile rotten cat", "you vile dog", "the rotten log you vile"]
    texts = [f"{t} w{chr(97 + i)}" for i in range(12) for t in good + bad]
    rows = [(i, t, int(any(x in t for x in bad))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic")).value
    part = docs.selectExpr("text", "toxic", "pmod(xxhash64(18, text), 5) = 0 AS held").collect()
    learned = [r for r in part if not r["held"]]
    unigram, bigram, vocabulary = plain_models([r["text"] for r in learned], [r["toxic"] for r in learned])
    for c in (0, 1):
        assert sum(unigram(c, w) for w in vocabulary) + unigram(c, "nowhere") == pytest.approx(1)
    for text in ["the cat sat on vile mats", "You VILE rotten thing, you vile!", "nowhere", ""]:
        words = re.findall("[a-z]+", text.lower())
        for order, share in [(1, 0.01), (2, 0.001), (2, 0.03)]:
            seen = set(words) if order == 1 else set(zip(["", *words], words, strict=False))
            p = lambda c, e: unigram(c, e) if isinstance(e, str) else bigram(c, *e)
            sides = [sum(math.log(p(0, e)) for e in seen), sum(math.log(share * p(1, e) + (1 - share) * p(0, e)) for e in seen)]
            expected = (sides[1] - sides[0]) / max(len(seen), 1)
            assert model.text_evidence(pa.array([text]), [(order, share)])[0, 0] == pytest.approx(expected, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize(("sf", "least"), [("0.01", 0.75), ("0.1", 0.9)])
def test_toxicity_on_held_out_rows(spark, sf, least):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity_scores(documents, labels)
    assert scored.count() == documents.count()
    met = scored.join(labels, "doc_id").where("held_out").groupBy("toxic").agg({"predicted": "avg"}).collect()
    share = {r["toxic"]: r["avg(predicted)"] for r in met}
    assert (share[1] + 1 - share[0]) / 2 > least  # a model that gives one answer has a half


def test_toxicity_edges(edge, none, labels):
    rows = toxicity.toxicity_scores(edge, labels).collect()
    assert len(rows) == edge.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert toxicity.toxicity_scores(none, labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity_scores(edge, labels.limit(0)).collect()} == {0}
    scored, name = toxicity.with_score(edge, toxicity.fit(edge, labels))
    assert name == "toxic_score_"
    assert scored.columns == [*edge.columns, name]


def test_importance_selects_the_largest_keys(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    sampled = importance.importance_sample(documents, labels, keep=0.4)
    rows = sorted(sampled.collect(), key=lambda r: -r["gumbel_key"])
    assert len(rows) == documents.count()
    assert [r["selected"] for r in rows] == [i < 400 for i in range(len(rows))]
    again = importance.importance_sample(documents.repartition(5), labels, keep=0.4)
    assert sampled.select("doc_id", "selected").exceptAll(again.select("doc_id", "selected")).isEmpty()
    split = importance.importance_sample(documents, labels).join(labels, "doc_id").groupBy("quality").agg({"log_weight": "avg"}).collect()
    mean = {r["quality"]: r["avg(log_weight)"] for r in split}
    assert mean[1] > 0 > mean[0]


def test_importance_weights_against_plain_counts(spark):
    """Bucket counts of words and pairs, ratios and sums of them, one word after another."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"W{k}" if k % 2 else f"v{k}" for k in rng.integers(0, 60, rng.integers(0, 30)))) for i in range(80)] + [(80, None), (81, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 80, 2)], "doc_id long, quality int")

    def buckets(text):
        words = [w.lower().encode() for w in (text or "").split()]
        hashes = [int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]
        pairs = [int(mix64(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], np.uint64))[0]) for a, b in zip(hashes, hashes[1:], strict=False)]
        return [h % importance.BUCKETS for h in hashes + pairs]

    raw = Counter(b for _, t in rows for b in buckets(t))
    own = Counter(b for i, t in rows if i < 80 and i % 6 == 0 for b in buckets(t))
    all_raw, all_own = (sum(x.values()) + importance.SMOOTHING * importance.BUCKETS for x in (raw, own))
    weight = lambda b: math.log((own[b] + importance.SMOOTHING) / all_own) - math.log((raw[b] + importance.SMOOTHING) / all_raw)
    got = {r["doc_id"]: r for r in importance.importance_sample(docs, labels).collect()}
    for i, t in rows:
        assert got[i]["n_features"] == len(buckets(t))
        assert got[i]["log_weight"] == pytest.approx(sum(map(weight, buckets(t))), abs=1e-9)


def test_importance_keeps_many_equal_rows_together(spark, monkeypatch):
    monkeypatch.setattr(importance, "TIES", 5)
    docs = spark.createDataFrame([(None, "")] * 60 + [(i, "a b c") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    rows = sorted(importance.importance_sample(docs, labels, keep=0.5).collect(), key=lambda r: -r["gumbel_key"])
    kept = [r["selected"] for r in rows]
    assert kept == sorted(kept, reverse=True)
    equal = {r["selected"] for r in rows if r["doc_id"] is None}
    assert len(equal) == 1


def test_importance_narrows_down_to_the_last_row(spark, documents, monkeypatch):
    monkeypatch.setattr(importance, "TIES", 3)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = sorted(importance.importance_sample(documents, labels, keep=0.123).collect(), key=lambda r: -r["gumbel_key"])
    assert [r["selected"] for r in rows] == [i < 123 for i in range(len(rows))]


def test_importance_edges(edge, none, labels):
    rows = importance.importance_sample(edge, labels, keep=1.0).collect()
    assert len(rows) == edge.count()
    assert all(r["selected"] for r in rows)
    assert not any(r["selected"] for r in importance.importance_sample(edge, labels, keep=0.0).collect())
    assert importance.importance_sample(none, labels).count() == 0
    assert {r["log_weight"] for r in importance.importance_sample(edge, labels.limit(0)).collect()} == {0.0}


def test_posteriors_against_the_plain_recursion():
    rng = np.random.default_rng(0)
    counts, k = np.array([0, 3, 130, 1, 65, 0]), 3
    emission, transition = rng.normal(size=(counts.sum(), k)), rng.normal(size=(k, k))
    got, at, step = language.posteriors(counts, emission, transition), 0, np.exp(transition)
    for n in counts:
        e = np.exp(emission[at : at + n])
        ahead, back, v = np.zeros((n, k)), np.ones((n, k)), np.full(k, 1 / k)
        for t in range(n):
            v = (v @ step) * e[t]
            v /= v.sum()
            ahead[t] = v
        v = np.ones(k)
        for t in range(n - 2, -1, -1):
            v = step @ (e[t + 1] * v)
            v /= v.sum()
            back[t] = v
        expected = ahead * back
        if n:
            np.testing.assert_allclose(got[at : at + n], expected / expected.sum(1, keepdims=True), rtol=1e-9)
        at += n


def test_pairs_of_neighbours_against_the_plain_recursion():
    rng = np.random.default_rng(7)
    n, k = 9, 3
    emission, transition = rng.normal(size=(n, k)), rng.normal(size=(k, k))
    every = np.array(np.meshgrid(*[range(k)] * n, indexing="ij")).reshape(n, -1)
    score = sum(emission[t, every[t]] for t in range(n)) + sum(transition[every[t], every[t + 1]] for t in range(n - 1))
    # the chain's start takes a step from a uniform label
    score = score + np.log(np.exp(transition).sum(0))[every[0]]
    weight = np.exp(score - score.max())
    expected = np.zeros((k, k))
    for t in range(n - 1):
        np.add.at(expected, (every[t], every[t + 1]), weight / weight.sum())
    p = language.posteriors(np.array([n]), emission, transition)
    np.testing.assert_allclose(language.pair_mass(p[:-1], p[1:], transition), expected, rtol=0.02)


def test_code_switched_text_is_labelled_by_word():
    de, en = "der und die ung keit schon", "the and thing tion was with"
    model = language.LanguageField.fit(pa.array([de * 3, en * 3] * 60), ["de", "en"] * 60)
    text = pa.array([f"{de} {de} {en} {en}"])
    _, _, counts, p = next(iter(model.label(text)))
    assert [model.languages[i] for i in p.argmax(1)] == ["de"] * 12 + ["en"] * 12
    words = language.Words.of(*text_bytes(text))
    assert counts.tolist() == words.counts.tolist() == [24]


def test_language_on_held_out_rows(documents):
    report = language.language_report(documents)
    assert report.count() == documents.count()
    met = report.join(documents, "doc_id").where("held_out")
    assert met.selectExpr("avg(int(lang = lang_pred)) AS right").first()["right"] > 0.95


def test_a_long_text_does_not_end_the_sample(spark):
    """Wherever it stands in the order, a text that is too long for the sample leaves the others in it."""
    words = {"de": "der und die ung keit schon", "en": "the and thing tion was with"}
    for i in range(3):
        rows = [(i, f"{words[lang]} {i}", lang) for i in range(100) for lang in words]
        df = spark.createDataFrame([*rows, (1_000 + i, "das ist sehr lang " * 60_000, "de")], "doc_id long, text string, lang string")
        model = language.fit(df, most_bytes=1 << 20, seed=i).value
        assert model.languages == ["de", "en"]
        assert np.abs(model.weights).max() > 0
    only = spark.createDataFrame([(1, "eins zwei drei " * 30_000, "de"), (2, "one two", "en"), (3, "three four", "en")], "doc_id long, text string, lang string")
    assert language.fit(only, most_bytes=4 << 20).value.languages == ["de", "en"]
    assert language.fit(only, most_bytes=1 << 18).value.languages == ["en"]


def test_language_edges(edge, none):
    rows = language.language_report(edge).collect()
    assert len(rows) == edge.count()
    blank = [r for r in rows if r["doc_id"] in (3, 4, 5, 8)]
    assert {r["lang_pred"] for r in blank} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language.language_report(none).count() == 0
    unlabelled = edge.withColumn("lang", edge["lang"].substr(9, 1)).where("false").unionByName(edge.selectExpr(*[("CAST(NULL AS STRING) AS lang" if c == "lang" else c) for c in edge.columns]))
    assert {r["lang_pred"] for r in language.language_report(unlabelled).collect()} == {"und"}
    labelled, name = language.with_language(edge, language.fit(edge))
    assert labelled.columns == [*edge.columns, "language_"] == [*edge.columns, name]
