"""Token counts and language-model scores."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from medlar.llm import lm_scoring, shared, token_counts
from medlar.llm.recurrent import CLASSES, OUTPUTS, GatedModel

PATH, PATTERN = str(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN


def check_tokens(df):
    library = Tokenizer.from_file(PATH)
    texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    expected = Counter((i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts)
    rows = token_counts.token_report(df, PATH, PATTERN).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)


def test_tokens_as_the_library_counts_them(documents, edge, none):
    check_tokens(documents)
    check_tokens(edge)
    assert token_counts.token_report(none, PATH, PATTERN).count() == 0
    assert token_counts.with_token_counts(edge, PATH, PATTERN)[1] == "n_tokens_"


def test_tokens_with_a_full_cache(documents, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 10)
    encoder = token_counts.Encoder(PATH, PATTERN)
    texts = ["one two", "three <|endoftext|> four", "  five\n\n six's ՘ 日本", ""]
    for _ in range(3):
        assert encoder.counts(texts, {" two": 1}) == encoder.whole(texts)


def test_long_pretokens_are_counted_and_not_kept():
    encoder = token_counts.Encoder(PATH, PATTERN)
    texts = ["x" * 5_000 + " one", "x" * 5_000, "one " + "ab" * 40]
    for _ in range(2):
        assert encoder.counts(texts, {}) == encoder.whole(texts)
    assert max(map(len, encoder.known)) <= token_counts.KEPT


def test_the_table_is_bounded_and_from_all_documents(spark):
    df = spark.createDataFrame([("aa bb " * 5,)] * 200 + [("cc " * 50 + "d" * 100,)] * 200, "text string").repartition(4)
    table = token_counts.frequent_lengths(df, PATH, PATTERN, entries=3, sample=400).value
    assert set(table) == {" cc", " bb", " aa"}
    assert len(token_counts.frequent_lengths(df, PATH, PATTERN, sample=400).value) < 12


def test_hashes_do_not_depend_on_place_or_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    buf = rng.integers(1, 255, 5_000).astype(np.uint8)
    cuts = np.sort(rng.choice(5_000, 60, replace=False))
    cuts = cuts[np.concatenate([[True], np.diff(cuts) > 1])]
    starts, ends = np.append(0, cuts), np.append(cuts, 5_000)
    whole = shared.span_hashes(buf, starts, ends)
    monkeypatch.setattr(shared, "_PIECE", 100)
    assert (shared.span_hashes(buf, starts, ends) == whole).all()
    alone = [shared.span_hashes(buf[a:b], np.array([0]), np.array([b - a]))[0] for a, b in zip(starts, ends, strict=True)]
    assert (np.array(alone) == whole).all()


def test_gradients():
    rng = np.random.default_rng(2)
    model = GatedModel(1, hidden=5)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    inputs, targets = rng.integers(0, OUTPUTS, (4, 3)), rng.integers(0, OUTPUTS, (4, 3))
    inputs[2, 1] = 0
    h = rng.normal(size=(3, 5))
    _, g, _ = model._window(h, inputs, targets)
    for name in model.p:
        flat = model.p[name].reshape(-1)
        if name == "x":
            picks = [int(inputs[1, 0]) * 15 + 3, int(inputs[2, 1]) * 15 + 7]
        elif name in ("w", "wb"):
            per = flat.size // CLASSES
            picks = [int(targets[0, 0] // CLASSES) * per + 2]
        else:
            picks = rng.integers(0, flat.size, 3)
        for i in picks:
            old = flat[i]
            losses = []
            for d in (1e-5, -1e-5):
                flat[i] = old + d
                losses.append(model._window(h, inputs, targets)[2])
            flat[i] = old
            assert g[name].reshape(-1)[i] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-6)


def test_probabilities_sum_to_one_and_state_is_carried():
    rng = np.random.default_rng(3)
    model = GatedModel(1, hidden=6)
    h = rng.normal(size=(2, 6)).astype(np.float32)
    every = np.stack([np.exp(model.log_probability(h, np.full(2, t))) for t in range(OUTPUTS)])
    np.testing.assert_allclose(every.sum(0), 1, rtol=1e-3)
    counts = np.array([70, 1, 0, 33])
    tokens = rng.integers(0, OUTPUTS, counts.sum()).astype(np.int32)
    got, at = model.text_log_probabilities(tokens, counts, side=2, window=16), 0
    for n, value in zip(counts, got, strict=True):
        h, last, total = np.zeros((1, 6), np.float32), np.array([0]), 0.0
        for t in tokens[at : at + n]:
            h = model.step(h, last)[0]
            last = np.array([t])
            total += float(model.log_probability(h, last)[0])
        assert value == pytest.approx(total, rel=1e-4)
        at += n


def test_training_lowers_the_loss():
    rng = np.random.default_rng(4)
    losses = GatedModel(2).fit(np.tile(rng.integers(0, 50, 40), 400).astype(np.int32), epochs=25)
    assert losses[-1] < 0.5 * losses[0]


def check_scores(df, rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(r["doc_id"], [*re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(low)), "\0"]) for r in df.collect()]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    count = Counter(w for i, words in texts for w in words if not held(i))
    n, v = sum(count.values()), len(count)
    base = lambda words: round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), 4)
    expected = Counter((i, held(i), len(w), sum(count[x] > 0 for x in w), n, base(w)) for i, w in texts)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == expected


@pytest.mark.parametrize("frequent", [500_000, 2_000])
def test_scores_over_whole_corpus_counts(documents, frequent):
    rows = lm_scoring.lm_scores(documents, frequent=frequent, rows=300).collect()
    check_scores(documents, rows)
    assert all(r["score"] < 0 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_step_by_step(spark, monkeypatch):
    """The whole way of a text's score, one word after another: class and output of each, a sort's share by count."""
    kept = {}
    train = lm_scoring._train
    monkeypatch.setattr(lm_scoring, "_train", lambda encoded, size, scorer, seed: (train(encoded, size, scorer, seed), kept.update(scorer=scorer)))
    texts = [" ".join(f"w{(i * i + k * (i % 7)) % 1500}" for k in range(i % 40)) for i in range(300)] + ["", "Unseen-Word w1 W1 unseen-word"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lm_scoring.lm_scores(df, frequent=700, rows=50).collect()}
    scorer, low = kept["scorer"], str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = {i: t.translate(low).split() for i, t in enumerate(texts)}
    count = Counter(w for i, words in split.items() for w in words if zlib.crc32(str(i).encode()) % 5 != 1)
    for i, words in split.items():
        h, last, total = np.zeros((1, lm_scoring.GatedModel().hidden), np.float32), np.array([0]), 0.0
        for w in [*words, None]:
            token, share = np.array([0]), 0.0
            if w is not None:
                _, hashed, sort = lm_scoring._words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
                token = scorer.lookup(hashed, sort)[1].astype(int)
                if token[0] >= OUTPUTS - lm_scoring.BUCKETS:
                    share = math.log10(count[w] + 0.5) - scorer.rest[sort[0]]
            h = scorer.model.step(h, last)[0]
            total += float(scorer.model.log_probability(h, token)[0]) / math.log(10) + share
            last = token
        assert rows[i]["score"] == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_score_edges(edge, none):
    rows = lm_scoring.lm_scores(edge, frequent=5).collect()
    assert len(rows) == edge.count()
    assert all(math.isfinite(r["score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    check_scores(edge, rows)
    assert lm_scoring.lm_scores(none).count() == 0


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    df = spark.createDataFrame([(i, "a b a") for i in ids], "doc_id long, text string")
    rows = lm_scoring.lm_scores(df).collect()
    check_scores(df, rows)
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in rows} == {(0, 0, 0.0)}
    assert all(math.isfinite(r["score"]) for r in rows)


def test_every_text_is_learned_from(spark, monkeypatch):
    """Without a sample to start from, as where one text is larger than all of it, the model still learns the order of words."""
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", 100_000)
    df = spark.createDataFrame([(i, " ".join(f"w{(i + k) % 40}" for k in range(300))) for i in range(400)], "doc_id long, text string")
    held = [r for r in lm_scoring.lm_scores(df, most_bytes=1).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.5 * sum(r["base_score"] for r in held)


def test_a_long_text_does_not_end_the_sample(spark):
    texts = spark.createDataFrame([("lang " * 2_000,), *((f"w{i} " * 5,) for i in range(50))], "text string")
    words = np.zeros(0, np.uint64)
    seen = []
    model = GatedModel(1)
    model.fit = seen.append
    scorer = lm_scoring.Scorer(words, np.zeros(0, np.int64), np.zeros(0, np.int32), 1, 1, 1, np.zeros(256), model)
    lm_scoring._start(texts, 51, scorer, 1_000, 4_000, 10)
    assert len(seen[0]) > 50 * 6
