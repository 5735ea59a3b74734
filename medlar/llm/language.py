"""Language identification by a linear-chain conditional random field over words.

A word's evidence for each language comes from its affixes and other byte n-grams of up to four bytes, hashed, and from a
lexicon of frequent words; learned transitions tie the labels of neighbouring words, so a code-switched text is labelled
word by word. Posteriors come from forward-backward over the whole text: a text's words are cut into blocks whose
transfer matrices are multiplied first, which gives exact messages at every border, and then all blocks run at once.
A text's language is the one with the largest sum of posteriors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medlar.llm.shared import chunks, fold, free_name, mix64, span_hashes, spans, text_bytes

#: Hashed features, besides the lexicon's.
FEATURES = 1 << 16
LEXICON = 4_096
LONGEST = 4
#: Words of a block of forward-backward.
BLOCK = 64
#: Bounds of what is learned from: languages, documents of each, and bytes of all texts together. A language has an equal
#: share of the bytes, and a text of more than about a sixteenth of that isn't drawn if the language has shorter ones.
LANGUAGES = 1_000
ROWS_PER_LANGUAGE = 400
BYTES = 24 << 20
EPOCHS = 3
UND = "und"
_U = np.uint64

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = _FOLD != 0x20


@dataclass
class Words:
    """The words of some texts: number of each text, distinct word of each, and the distinct words' features."""

    counts: np.ndarray
    word: np.ndarray
    hashes: np.ndarray
    feature: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, buf: np.ndarray, off: np.ndarray) -> Words:
        folded = _FOLD[buf]
        starts, ends = spans(buf, off, _LETTER)
        counts = np.diff(np.searchsorted(starts, off))
        hashes, first, word = np.unique(span_hashes(folded, starts, ends, lower=False), return_index=True, return_inverse=True)
        a, b = starts[first], ends[first]
        size = b - a + 2
        at = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(at[-1]) - np.repeat(at[:-1], size)
        flat = np.where(place == 0, 1, 2).astype(_U)
        inside = (place > 0) & (place < np.repeat(size - 1, size))
        flat[inside] = folded[(np.repeat(a - 1, size) + place)[inside]]
        owner = np.repeat(np.arange(len(a)), size)
        features, owners = [], []
        key = flat
        for n in range(1, LONGEST + 1):
            if n > 1:
                key = key[:-1] * _U(256) + flat[n - 1 :]
            fits = place[: len(key)] + n <= np.repeat(size, size)[: len(key)]
            features.append((mix64(key[fits] + _U(n << 40)) % _U(FEATURES)).astype(np.int64))
            owners.append(owner[: len(key)][fits])
        return cls(counts, word, hashes, np.concatenate(features), np.concatenate(owners))


def _blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of each block; a text's blocks follow one another."""
    of = -(-counts // BLOCK)
    text = np.repeat(np.arange(len(counts)), of)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(of) - of, of)
    begin = (np.cumsum(counts) - counts)[text] + turn * BLOCK
    return text, begin, np.minimum(counts[text] - turn * BLOCK, BLOCK)


def posteriors(counts: np.ndarray, emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """P(label of each word | all words of its text), by exact forward-backward."""
    k = emission.shape[1]
    if not len(emission):
        return np.zeros((0, k))
    text, begin, size = _blocks(counts)
    n = len(text)
    step = np.exp(transition - transition.max())
    likely = np.exp(emission - emission.max(1, keepdims=True))
    where = np.minimum(begin[:, None] + np.arange(BLOCK), len(emission) - 1)
    inside = np.arange(BLOCK) < size[:, None]
    padded = likely[where]
    product = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(BLOCK):
        live = inside[:, t]
        m = (product[live].reshape(-1, k) @ step).reshape(-1, k, k) * padded[live, t][:, None, :]
        product[live] = m / m.max((1, 2), keepdims=True)
    first = np.searchsorted(text, np.arange(len(counts)))
    of = np.bincount(text, minlength=len(counts))
    came, comes = np.full((n, k), 1.0 / k), np.ones((n, k))
    for j in range(1, int(of.max())):
        at = first[of > j] + j
        v = np.einsum("nk,nkl->nl", came[at - 1], product[at - 1])
        came[at] = v / v.sum(1, keepdims=True)
        last = first[of > j] + of[of > j] - 1 - j
        v = np.einsum("nkl,nl->nk", product[last + 1], comes[last + 1])
        comes[last] = v / v.sum(1, keepdims=True)
    ahead = np.empty((n, BLOCK, k))
    v = came
    for t in range(BLOCK):
        new = (v @ step) * padded[:, t]
        new /= new.sum(1, keepdims=True)
        v = np.where(inside[:, t][:, None], new, v)
        ahead[:, t] = v
    v = comes
    for t in range(BLOCK - 1, -1, -1):
        ahead[:, t] *= v
        new = (padded[:, t] * v) @ step.T
        v = np.where(inside[:, t][:, None], new / new.sum(1, keepdims=True), v)
    out = ahead[inside]
    return out / out.sum(1, keepdims=True)


class LanguageField:
    """Weights of the field: features (hashed, then lexicon) by languages, and transitions."""

    def __init__(self, languages: list[str], lexicon: np.ndarray):
        self.languages, self.lexicon = languages, lexicon
        k = len(languages)
        self.weights = np.zeros((FEATURES + len(lexicon) + 1, k), np.float32)  # the last row is for words outside the lexicon
        self.transition = np.zeros((k, k))

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The feature that stands for the whole word."""
        if not len(self.lexicon):
            return np.full(len(hashes), FEATURES)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return FEATURES + np.where(self.lexicon[at] == hashes, at, len(self.lexicon))

    def emission(self, words: Words) -> np.ndarray:
        """Evidence of each distinct word."""
        own = self.weights[self.known(words.hashes)].astype(np.float64)
        for j in range(own.shape[1]):
            own[:, j] += np.bincount(words.owner, self.weights[words.feature, j], len(own))
        return own

    @classmethod
    def fit(cls, texts: pa.Array, labels: list[str], epochs: int = EPOCHS, rate: float = 0.3, seed: int = 6) -> LanguageField:
        """Likelihood of the texts' labels, given to all their words, by AdaGrad over batches of texts."""
        languages = sorted(set(labels))
        buf, off = text_bytes(texts)
        target = np.searchsorted(languages, labels)
        everything = Words.of(buf, off)
        frequency = np.bincount(everything.word, minlength=len(everything.hashes))
        model = cls(languages, np.sort(everything.hashes[np.argsort(-frequency, kind="stable")[:LEXICON]]))
        k = len(languages)
        if k < 2:
            return model
        rng = np.random.default_rng(seed)
        square, square_t = np.full(model.weights.shape, 1e-6, np.float32), np.full((k, k), 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for pick in np.array_split(order, max(1, len(order) // 16)):
                part, at = text_bytes(texts.take(pa.array(pick)))
                words = Words.of(part, at)
                if not len(words.word):
                    continue
                label = np.repeat(target[pick], words.counts)
                p = posteriors(words.counts, model.emission(words)[words.word], model.transition)
                wrong = -p
                wrong[np.arange(len(label)), label] += 1
                one = np.stack([np.bincount(words.word, wrong[:, j], len(words.hashes)) for j in range(k)], 1)
                gradient = np.zeros(model.weights.shape, np.float32)
                np.add.at(gradient, model.known(words.hashes), one.astype(np.float32))
                for j in range(k):
                    gradient[:FEATURES, j] += np.bincount(words.feature, one[words.owner, j], FEATURES)
                gradient /= len(label)
                square += gradient**2
                model.weights += rate * gradient / np.sqrt(square) * (gradient != 0)
                # pairs of neighbours: seen ones against independent posteriors of the two
                inner = np.ones(len(label), bool)
                inner[np.cumsum(words.counts)[words.counts > 0] - 1] = False
                here = np.flatnonzero(inner)
                seen = np.bincount(label[here] * k + label[here + 1], minlength=k * k).reshape(k, k)
                g = (seen - pair_mass(p[here], p[here + 1], model.transition)) / len(label) - 1e-3 * model.transition
                square_t += g**2
                model.transition += 0.3 * g / np.sqrt(square_t)
        return model

    def label(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """By chunks of texts: (first text, end text, words of each text, posteriors of all words)."""
        buf, off = text_bytes(texts)
        for a, b in chunks(off, 1 << 20):
            words = Words.of(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            yield a, b, words.counts, posteriors(words.counts, self.emission(words)[words.word], self.transition)


def pair_mass(one: np.ndarray, two: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Sums of P(label, next label | text) over neighbouring words, from the posteriors of both.

    A pair's joint distribution has the two posteriors as its margins and the transitions' ratios inside, so it is found by
    scaling rows and columns in turn.
    """
    joint = one[:, :, None] * np.exp(transition - transition.max())[None] * two[:, None, :]
    for _ in range(3):
        joint *= (one / np.maximum(joint.sum(2), 1e-300))[:, :, None]
        joint *= (two / np.maximum(joint.sum(1), 1e-300))[:, None, :]
    return joint.sum(0)


def fit(docs: DataFrame, rows: Column | None = None, per_language: int = ROWS_PER_LANGUAGE, most_bytes: int = BYTES, seed: int = 6) -> Broadcast:
    """Train on documents with a language and send the model to the executors.

    ``docs`` needs doc_id, text and lang; ``rows`` restricts what is learned from. Of each language about
    ``per_language`` documents are used, chosen by a seeded hash of id and text, equal texts once, whole texts of about
    ``most_bytes`` together, an equal share for each language; the model's size is fixed. Texts that are long for a share
    are passed over for others; where a language has no others, its shortest that fit the share are used. Not used are
    null texts and languages, languages beyond the LANGUAGES most frequent, and those without a text that fits the share.
    """
    step = F.floor(F.log2(F.octet_length("text") + 1)).cast("int").alias("step")
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), step).dropna(subset=["text", "lang"])
    if rows is not None:
        known = known.where(rows)
    sizes: dict[str, dict[int, int]] = {}
    steps = known.groupBy("lang", "step").agg(F.count("*").alias("n"))
    kept = steps.groupBy("lang").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "lang").limit(LANGUAGES)
    for lang, at, n in steps.join(F.broadcast(kept), "lang").select("lang", "step", "n").collect():  # 31 of each at most
        sizes.setdefault(lang, {})[at] = n
    share = most_bytes // max(len(sizes), 1)
    plan = []
    for lang, of in sorted(sizes.items()):
        top = max((at for at in of if 2 ** (at + 1) <= share // 16), default=min(of))
        if 2**top <= share:
            plan.append((lang, top, sum(n for at, n in of.items() if at <= top)))
    plan = docs.sparkSession.createDataFrame(plan, "lang string, top int, n long")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1_000_000))
    drawn = known.join(F.broadcast(plan), "lang").where((F.col("step") <= F.col("top")) & (draw * F.col("n") < per_language * 1_000_000))
    # ids and sizes are put in order, texts are fetched afterwards
    key = F.xxhash64(F.lit(seed + 1), "text")
    short = drawn.select("lang", key.alias("key"), F.octet_length("text").alias("bytes")).distinct()
    order = Window.partitionBy("lang").orderBy("key", "bytes").rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("ahead", F.coalesce(F.sum("bytes").over(order), F.lit(0))).where(F.col("ahead") < share)
    drawn = known.withColumn("key", key).join(F.broadcast(short.select("lang", "key")), ["lang", "key"]).groupBy("lang", "key").agg(F.first("text").alias("text"))
    got = drawn.orderBy("key", "lang").select("text", "lang").toArrow()
    model = LanguageField.fit(got["text"].combine_chunks() if len(got) else pa.array([], pa.string()), got["lang"].to_pylist())
    return docs.sparkSession.sparkContext.broadcast(model)


def with_language(docs: DataFrame, model: Broadcast, text: str = "text", name: str = "language") -> tuple[DataFrame, str]:
    """``docs`` with a struct column more, whose name is returned too: lang (und if the text is null or has no letter, or
    nothing was learned), score (share of the posteriors), words and switched (words that another language is likelier
    for). If ``docs`` has a column called ``name``, the new one gets underscores at its end."""
    name = free_name(docs, name)
    kind = T.StructType.fromDDL("lang string, score double, words long, switched long")
    fields = T.StructType([*docs.schema.fields, T.StructField(name, kind)])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = np.array([*model.value.languages, UND], object)
        for batch in batches:
            col = batch.column(text)
            best, score = np.full(len(col), len(languages) - 1), np.zeros(len(col))
            words, switched = np.zeros(len(col), np.int64), np.zeros(len(col), np.int64)
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False))
            if len(languages) > 1:
                for a, b, counts, p in model.value.label(col):
                    owner = np.repeat(np.arange(b - a), counts)
                    mass = np.stack([np.bincount(owner, p[:, j], b - a) for j in range(p.shape[1])], 1)
                    top = mass.argmax(1)
                    fine = (counts > 0) & letters[a:b]
                    best[a:b] = np.where(fine, top, len(languages) - 1)
                    score[a:b] = np.where(fine, np.minimum(mass.max(1) / np.maximum(counts, 1), 1), 0)
                    words[a:b] = counts
                    switched[a:b] = np.bincount(owner, p.argmax(1) != top[owner], b - a)
            found = pa.StructArray.from_arrays([pa.array(languages[best], pa.string()), pa.array(score), pa.array(words), pa.array(switched)], ["lang", "score", "words", "switched"])
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return docs.mapInArrow(label, fields), name


def language_report(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words and n_switched of each document, learned outside the held-out fold."""
    model = fit(docs, fold(F.col("doc_id"), folds) != held_out)
    labelled, name = with_language(docs.select("doc_id", "text"), model)
    held = (fold(F.col("doc_id"), folds) == held_out).alias("held_out")
    x = F.col(name)
    return labelled.select("doc_id", held, x["lang"].alias("lang_pred"), x["score"].alias("score"), x["words"].alias("n_words"), x["switched"].alias("n_switched"))
