"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary text, give each expression of a text a probability. A model discounts its
class's own counts and backs off to counts that both share: in how many of the two classes an expression occurs at all, as
Kneser-Ney counts contexts. So what neither class knows weighs nearly the same in both, and one that a class has often
gets its own weight. An expression is a word, or a word after the one before it, which backs off to the word. Toxic text
is mostly ordinary words around some toxic ones: its likelihood mixes in the toxic model with a small share. The
difference of the two log-likelihoods, each divided by the text's length in distinct expressions, is the evidence, and a
logistic curve turns it into a score. The share and whether words are seen after the ones before them are chosen, and the
curve is fitted, on labelled rows that the counts don't come from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medlar.llm.shared import chunks, cut, fold, free_name, mix64, span_hashes, spans, text_bytes

DISCOUNT = 0.75
#: Shares of the toxic model, and numbers of words of an expression, that are tried.
SHARES = (0.001, 0.003, 0.01, 0.03)
ORDERS = (1, 2)
#: Texts that a pair of words must be in for a count of its own.
PAIR_TEXTS = 5
#: Words and pairs that the model holds, the most frequent ones: 24 and 24 bytes each.
MOST_WORDS = 1_000_000
MOST_PAIRS = 1_000_000
_U = np.uint64

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = _FOLD != 0x20


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(before * _U(0x9E3779B97F4A7C15) + word)


def expressions(col: pa.Array) -> Iterator[tuple]:
    """By chunks of texts: (first text, end text, and for words and for pairs: text, hash of the word, hash of the word
    before, hash of the expression, each once a text). 0 stands before a text's first word."""
    buf, off = text_bytes(col)
    for a, b in chunks(off, 1 << 20):
        part, at = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        starts, ends = spans(part, at, _LETTER)
        text = np.searchsorted(at, starts, "right") - 1
        word = span_hashes(_FOLD[part], starts, ends, lower=False)
        before = np.concatenate([np.zeros(1, _U), word[:-1]])[: len(word)]
        before[np.flatnonzero(np.diff(text, prepend=-1))] = 0
        kinds = []
        for key in (word, pair_hash(before, word)):
            order = np.lexsort((key, text))
            new = np.ones(len(key), bool)
            new[1:] = (text[order][1:] != text[order][:-1]) | (key[order][1:] != key[order][:-1])
            first = order[new]
            kinds.append((text[first], word[first], before[first], key[first]))
        yield a, b, *kinds


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


@dataclass
class Words:
    """Words in order of hash, with each class's probability of them; of any other word the last entry's. Classes are rows:
    ordinary, toxic."""

    keys: np.ndarray
    probability: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, totals: np.ndarray, spread: int, distinct: int) -> Words:
        """From counts of texts by class and word. ``totals`` are sums over all words, ``spread`` is the number of pairs of a
        word and a class that has it, ``distinct`` that of words, also of those that aren't among ``keys``."""
        order = np.argsort(keys)
        keys, counts = keys[order], counts[:, order].astype(np.float64)
        classes = (counts > 0).sum(0)
        own = np.maximum(classes - DISCOUNT, 0) / max(spread, 1)
        shared = np.append(own, 0) + (1 - own.sum()) / (distinct + 1)
        own = np.maximum(counts - DISCOUNT, 0) / np.maximum(totals, 1)[:, None]
        rest = 1 - own.sum(1)
        return cls(keys, np.concatenate([own, np.zeros((2, 1))], 1) + rest[:, None] * shared)

    def of_words(self, word: np.ndarray) -> np.ndarray:
        at, known = _find(self.keys, word)
        return self.probability[:, np.where(known, at, len(self.keys))]


@dataclass
class Pairs:
    """Frequent pairs with each class's discounted share of the word before, and those words with what is left for backing
    off; a word that no pair of a class starts with leaves everything."""

    keys: np.ndarray
    own: np.ndarray
    before: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, first: np.ndarray, counts: np.ndarray, before: np.ndarray, totals: np.ndarray) -> Pairs:
        """From counts of texts by class and pair, and sums by class and word before, over all pairs."""
        order, begins = np.argsort(keys), np.argsort(before)
        keys, first, counts, before, totals = keys[order], first[order], counts[:, order], before[begins], totals[:, begins]
        at, known = _find(before, first)
        known = known if len(before) else np.zeros(len(first), bool)
        keys, at, counts = keys[known], at[known], counts[:, known]
        own = np.maximum(counts - DISCOUNT, 0) / np.maximum(totals[:, at], 1)
        rest = np.stack([1 - np.bincount(at, x, len(before)) for x in own])
        return cls(keys, own, before, rest)

    def after(self, before: np.ndarray, pair: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Probabilities of words after the ones before them, from those of the words."""
        at, known = _find(self.before, before)
        rest = np.where(known, self.rest[:, at] if len(self.before) else 1.0, 1.0)
        here, seen = _find(self.keys, pair)
        return np.where(seen, self.own[:, here] if len(self.keys) else 0.0, 0.0) + rest * words


@dataclass
class KneserNeyPair:
    """The two models, the share of the toxic one in toxic text, and the curve from evidence to score."""

    words: Words
    pairs: Pairs
    order: int = 1
    share: float = SHARES[0]
    slope: float = 1.0
    offset: float = 0.0

    def text_evidence(self, col: pa.Array, forms: list[tuple[int, float]] | None = None) -> np.ndarray:
        """Difference of the length-normalised log-likelihoods of each text, a row for each form (order, share); 0 for a
        text without letters."""
        forms = forms or [(self.order, self.share)]
        out = np.zeros((len(forms), len(col)))
        for a, b, *kinds in expressions(col):
            for order in {n for n, _ in forms}:
                text, word, before, key = kinds[order - 1]
                p = self.words.of_words(word)
                if order > 1:
                    p = self.pairs.after(before, key, p)
                size = np.maximum(np.bincount(text, minlength=b - a), 1)
                for i, (n, share) in enumerate(forms):
                    if n == order:
                        out[i, a:b] = np.bincount(text, np.log1p(share * (p[1] / p[0] - 1)), b - a) / size
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -30, 30)))

    def choose(self, evidence: np.ndarray, label: np.ndarray, forms: list[tuple[int, float]]) -> None:
        """Keep the form, a column of ``evidence``, whose curve has the least loss on labelled texts."""
        best = math.inf
        for i, (order, share) in enumerate(forms):
            self.calibrate(evidence[:, i], label)
            p = np.clip(self.score(evidence[:, i]), 1e-12, 1 - 1e-12)
            loss = -float(np.mean(np.log(np.where(label > 0, p, 1 - p)))) if len(label) else 0.0
            if loss < best:
                best, kept = loss, (order, share, self.slope, self.offset)
        self.order, self.share, self.slope, self.offset = kept

    def calibrate(self, evidence: np.ndarray, label: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> None:
        """Logistic regression on one variable by Newton steps; constant labels leave a flat curve."""
        if not len(label) or label.min() == label.max():
            share = (label.sum() + 0.5) / (len(label) + 2)
            self.slope, self.offset = 1.0, math.log(share / (1 - share))
            return
        scale = np.std(evidence) or 1.0
        x = np.stack([evidence / scale, np.ones(len(label))], 1)
        w = np.zeros(2)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag([ridge, ridge])
            step = np.linalg.solve(curve, x.T @ (label - p) - ridge * w)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.offset = float(w[0] / scale), float(w[1])


def _most(df: DataFrame, rows: int) -> DataFrame:
    """The rows of largest count, of equal ones all or none, ``rows`` at most."""
    steps = df.groupBy(F.least(F.col("ordinary") + F.col("toxic"), F.lit(1 << 12)).alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("n")).collect()
    least, sum_ = 1 << 62, 0
    for n, more in steps:
        sum_ += more
        if sum_ > rows:
            break
        least = n
    return df.where(F.col("ordinary") + F.col("toxic") >= least)


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    got = df.select(*names).toArrow()
    return [got[c].to_numpy().view(_U) if c in ("key", "before") else got[c].to_numpy() for c in names]


def fit(docs: DataFrame, labels: DataFrame, rows: Column | None = None, max_rows: int = 20_000, seed: int = 17) -> Broadcast:
    """Train on labelled documents and send the model to the executors.

    ``docs`` needs doc_id and text, ``labels`` needs doc_id and toxic. ``rows``, on doc_id, restricts what is learned
    from. About ``max_rows`` labelled documents at most are used, chosen by a seeded hash of their ids, equal texts once:
    that bounds the fit and the broadcast list of ids; the model holds MOST_WORDS words and MOST_PAIRS pairs at most. One
    in five texts chooses the form and fits the curve. Rows with a null id or label are not used; of several labels of a
    document or a text the largest counts. Without labels every text scores low.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).dropna()
    if rows is not None:
        known = known.withColumnRenamed("_id", "doc_id").where(rows).withColumnRenamed("doc_id", "_id")
    known = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    part = min(1.0, max_rows / max(known.count(), 1))
    draw = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1_000_000))
    known = known.where(draw < int(part * 1_000_000))
    sample = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(known), "_id").where("text IS NOT NULL")
    sample = sample.groupBy("text").agg(F.max("_toxic").alias("toxic")).withColumn("calibrate", F.pmod(F.xxhash64(F.lit(seed + 1), "text"), F.lit(5)) == 0)
    sample = cut(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy() > 0
            for a, b, *kinds in expressions(batch.column("text")):
                for order, (text, _, before, key) in enumerate(kinds, 1):
                    u, first, inverse = np.unique(key, return_index=True, return_inverse=True)
                    n = [np.bincount(inverse, toxic[a:b][text] == side, len(u)).astype(np.int64) for side in (False, True)]
                    begin = before[first] if order > 1 else np.zeros(len(u), _U)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), order, np.int32)), pa.array(u.view(np.int64)), pa.array(begin.view(np.int64)), *map(pa.array, n)], ["order", "key", "before", "ordinary", "toxic"])

    counted = sample.where("NOT calibrate").mapInArrow(count, "order int, key long, before long, ordinary long, toxic long")
    sums = [F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")]
    counted = cut(counted.groupBy("order", "key", "before").agg(*sums))
    single, double = counted.where("order = 1"), counted.where("order = 2")
    both = (F.col("ordinary") > 0).cast("int") + (F.col("toxic") > 0).cast("int")
    ordinary, toxic, spread, distinct = (int(x or 0) for x in single.agg(F.sum("ordinary"), F.sum("toxic"), F.sum(both), F.count("*")).first())
    key, one, two = _columns(_most(single, MOST_WORDS), "key", "ordinary", "toxic")
    words = Words.of(key, np.stack([one, two]), np.array([ordinary, toxic]), spread, distinct)
    often = cut(_most(double.where(F.col("ordinary") + F.col("toxic") >= PAIR_TEXTS), MOST_PAIRS))
    begins = double.join(F.broadcast(often.select("before").distinct()), "before", "left_semi").groupBy("before").agg(*sums)
    pair, first, own, foreign = _columns(often, "key", "before", "ordinary", "toxic")
    before, all_own, all_foreign = _columns(begins, "before", "ordinary", "toxic")
    model = KneserNeyPair(words, Pairs.of(pair, first, np.stack([own, foreign]), before, np.stack([all_own, all_foreign])))

    forms = [(order, share) for order in ORDERS for share in SHARES]
    send = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = send.value.text_evidence(batch.column("text"), forms)
            yield pa.RecordBatch.from_arrays([pa.array(list(found.T), pa.list_(pa.float64())), batch.column("toxic").cast(pa.float64())], ["e", "y"])

    held = sample.where("calibrate").mapInArrow(weigh, "e array<double>, y double").toArrow()
    label = held["y"].to_numpy()
    evidence = np.array(held["e"].to_pylist()).reshape(len(label), len(forms))
    model.choose(evidence, label, forms)
    send.unpersist()
    return docs.sparkSession.sparkContext.broadcast(model)


def with_score(docs: DataFrame, model: Broadcast, text: str = "text", name: str = "toxic_score") -> tuple[DataFrame, str]:
    """``docs`` with a score from 0 to 1 in one more column, whose name is returned too; whole texts, one pass, no shuffle.

    Null and empty texts and texts without letters have no evidence and score low. If ``docs`` has a column called
    ``name``, the new one gets underscores at its end.
    """
    name = free_name(docs, name)
    fields = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.value.score(model.value.text_evidence(batch.column(text))[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, name])

    return docs.mapInArrow(score, fields), name


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted (score of 0.5 or more) of each document, learned outside the held-out fold."""
    model = fit(docs, labels, fold(F.col("doc_id"), folds) != held_out, max_rows)
    scored, name = with_score(docs.select("doc_id", "text"), model)
    score = F.col(name)
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
