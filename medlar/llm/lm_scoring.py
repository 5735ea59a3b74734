"""Scores of whole texts by a gated recurrent language model over corpus-wide word counts.

Words are counted over all training texts. The most frequent are outputs of the model; every other word belongs to a sort,
which is an output too, and has its share of the sort by its count. The model is started on a bounded sample and then trained
on all training texts: they are dealt to shards by hash, and in each of a few rounds every shard goes on from the mean of
all shards' parameters with texts of its own that were not used before. Parameters are summed on executors. Counts of frequent words go to the executors as a bounded table; those of the rest are joined by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlar.llm.recurrent import BUCKETS, END, OUTPUTS, Adam, GatedModel
from medlar.llm.shared import _ASCII_LOWER, NOT_SPACE, chunks, cut, fold, mix64, span_hashes, spans, text_bytes

#: Words whose counts are broadcast, 16 bytes each.
FREQUENT = 500_000
#: Bounds of the sample that the recurrent model is started on.
ROWS = 4_000
BYTES = 12 << 20
#: Bytes of text that a shard learns, rounds between which the shards' parameters are averaged, and the first one's rate.
SHARD_BYTES = 32 << 20
ROUNDS = 4
RATE = 0.004
#: Tokens that a task holds, and slices that parameters are summed by.
HELD = 1 << 20
SLICES = 64
_U = np.uint64


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, hash of each word, sort of each word)."""
    starts, ends = spans(buf, off, NOT_SPACE)
    last = _ASCII_LOWER[buf[ends - 1]].astype(_U)
    before = np.where(ends - starts > 1, _ASCII_LOWER[buf[np.maximum(ends - 2, 0)]], 0).astype(_U)
    sort = mix64(last * _U(65536) + before * _U(256) + (np.minimum(ends - starts, 12) // 4).astype(_U)) % _U(BUCKETS)
    return np.diff(np.searchsorted(starts, off)), span_hashes(buf, starts, ends), sort.astype(np.int64)


def _texts(col: pa.Array, most: int = 1 << 20) -> Iterator[tuple]:
    buf, off = text_bytes(col)
    for a, b in chunks(off, most):
        yield a, b, *_words(buf[off[a] : off[b]], off[a : b + 1] - off[a])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, sort, n): hash, sort and count of every word of the one column of ``texts``; summed before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            word, sort, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, inverse = np.unique(word, return_index=True, return_inverse=True)
            return u, sort[first], np.bincount(inverse, n, len(u)).astype(np.int64)

        def batch_of(x: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], ["word", "sort", "n"])

        for batch in batches:
            for _, _, _, word, sort in _texts(batch.column(0)):
                u, first, n = np.unique(word, return_index=True, return_counts=True)
                held.append((u, sort[first], n))
                if sum(len(h[0]) for h in held) > 1_000_000:
                    held[:] = [merged()]
                    if len(held[0][0]) > 500_000:
                        yield batch_of(held.pop())
        if held:
            yield batch_of(merged())

    return texts.mapInArrow(count, "word long, sort int, n long").groupBy("word").agg(F.first("sort").alias("sort"), F.sum("n").alias("n"))


@dataclass
class Scorer:
    """What executors need: frequent words in order of hash with counts and outputs, sums of the rest, and the model."""

    words: np.ndarray
    counts: np.ndarray
    outputs: np.ndarray
    total: int
    distinct: int
    ends: int
    rest: np.ndarray  # log10 of each sort's denominator
    model: GatedModel

    def lookup(self, word: np.ndarray, sort: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, or -1 if the word isn't in the table; output) of each word."""
        u, inverse = np.unique(word, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, u), max(len(self.words) - 1, 0))
        known = (self.words[at] == u) if len(self.words) else np.zeros(len(u), bool)
        count = np.where(known, self.counts[at], -1)[inverse] if len(self.words) else np.full(len(word), -1)
        output = np.where(known, self.outputs[at], -1)[inverse] if len(self.words) else np.full(len(word), -1)
        return count, np.where(output < 0, OUTPUTS - BUCKETS + sort, output)

    def tokens(self, col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(outputs of the texts behind one another, each ended by END; their lengths) by chunks of texts."""
        for x in self.encode(col):
            yield x["tokens"], x["n"]

    def encode(self, col: pa.Array) -> Iterator[dict[str, np.ndarray]]:
        """By chunks of texts: outputs, lengths, what is known of base and score without rare words and the recurrent model,
        and the rare words with their numbers."""
        floor = np.log10(self.total + 0.5 * (self.distinct + 1))
        end = np.log10(self.ends + 0.5)
        for a, b, counts, word, sort in _texts(col):
            count, output = self.lookup(word, sort)
            owner = np.repeat(np.arange(b - a), counts)
            rare = count < 0
            heavy = np.where(rare, 0, np.log10(np.maximum(count, 0) + 0.5))
            base = np.bincount(owner, heavy, b - a) + end - (counts + 1) * floor
            known = np.bincount(owner, count > 0, b - a).astype(np.int64) + (self.ends > 0)
            spread = output >= OUTPUTS - BUCKETS
            share = np.bincount(owner, np.where(spread, heavy - self.rest[sort], 0), b - a)
            tokens = np.full(len(word) + b - a, END, np.uint16)
            tokens[np.arange(len(word)) + owner] = output
            whose, rest = owner[rare], word[rare]
            order = np.lexsort((rest, whose))
            whose, rest = whose[order], rest[order]
            new = np.ones(len(rest), bool)
            new[1:] = (rest[1:] != rest[:-1]) | (whose[1:] != whose[:-1])
            at = np.flatnonzero(new)
            yield {"tokens": tokens, "n": counts + 1, "base": base, "known": known, "share": share, "whose": whose[at], "word": rest[at], "times": np.diff(np.append(at, len(rest)))}


def _start(texts: DataFrame, total: int, scorer: Scorer, rows: int, most_bytes: int, seed: int) -> None:
    """Fit the recurrent model on a sample of the texts, up to ``most_bytes`` together. Of a text the first sixteenth of
    that many characters counts at most, so that no text ends the sample or fills it."""
    key = F.xxhash64(F.lit(seed), "text")
    drawn = texts.where(F.pmod(key, F.lit(1_000_000)) < F.lit(min(1.0, rows / max(total, 1)) * 1_000_000)).select(key.alias("key"), F.substring("text", 1, most_bytes // 16).alias("text"))
    # keys and sizes are put in order, texts are fetched afterwards
    sizes = drawn.select("key", F.octet_length("text").alias("bytes")).distinct().limit(4 * rows)
    order = Window.orderBy(F.xxhash64(F.lit(seed + 1), "key"), "key").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("sum", F.sum("bytes").over(order)).where(F.col("sum") <= most_bytes)
    drawn = drawn.join(F.broadcast(sizes.select("key")), "key").groupBy("key").agg(F.first("text").alias("text")).orderBy("key")
    got = drawn.select("text").toArrow()["text"].combine_chunks()
    rows_of = [x for x, _ in scorer.tokens(got)] if len(got) else []
    scorer.model.fit(np.concatenate([np.array([END], np.int32), *rows_of]).astype(np.int32))


def _train(encoded: DataFrame, size: int, scorer: Scorer, seed: int) -> None:
    """Go on with the recurrent model over all of the encoded texts (key, tokens), of ``size`` bytes as text."""
    sc = encoded.sparkSession.sparkContext
    names, shapes = list(scorer.model.p), [x.shape for x in scorer.model.p.values()]
    borders = np.cumsum([int(np.prod(x)) for x in shapes])
    shards = max(1, -(-size // SHARD_BYTES))
    dealt = cut(encoded.select("key", "tokens").repartition(shards, "key").sortWithinPartitions("key", "tokens"))

    for turn in range(ROUNDS):
        flat = np.concatenate([x.reshape(-1) for x in scorer.model.p.values()])
        send, rate = sc.broadcast(flat), RATE * (1 - turn / ROUNDS)

        def learn(batches: Iterator[pa.RecordBatch], send=send, rate=rate) -> Iterator[pa.RecordBatch]:
            model, seen, held = GatedModel(seed), 0, []
            model.p = {k: x.reshape(shape).copy() for k, x, shape in zip(names, np.split(send.value, borders[:-1]), shapes, strict=True)}
            adam = Adam(model.p)
            for batch in batches:
                held.append(text_bytes(batch.column(0))[0].view(np.uint16).astype(np.int32))
                if sum(map(len, held)) >= HELD:
                    tokens, held = np.concatenate(held), []
                    for a in range(0, len(tokens), HELD):
                        model.learn(tokens[a : a + HELD], adam, rate)
                    seen += len(tokens)
            if sum(map(len, held)):
                model.learn(np.concatenate(held), adam, rate)
                seen += sum(map(len, held))
            if seen:
                # Differences: those of outputs that a small shard doesn't hold are 0 and take no room in the shuffle.
                parts = np.array_split(np.concatenate([x.reshape(-1) for x in model.p.values()]) - send.value, SLICES)
                shard = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([shard] * SLICES, pa.int32()), pa.array([seen] * SLICES, pa.int64()), pa.array(parts, pa.list_(pa.float32()))], ["slice", "shard", "seen", "moves"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for k, seen, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                    own = sums.setdefault(k, [0, 0.0])
                    own[0] += seen
                    own[1] = own[1] + seen * x.values.to_numpy().astype(np.float64)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1] for x in sums.values()], pa.list_(pa.float64()))], ["slice", "seen", "sums"])

        learned = dealt.where(F.pmod("key", F.lit(ROUNDS)) == turn).select("tokens").mapInArrow(learn, "slice int, shard int, seen long, moves array<float>")
        got = learned.repartition(8, "slice").sortWithinPartitions("slice", "shard").mapInArrow(add, "slice int, seen long, sums array<double>").toArrow().sort_by("slice").to_pylist()
        if got:
            flat = (flat + np.concatenate([np.array(x["sums"]) / x["seen"] for x in got])).astype(np.float32)
            scorer.model.p = {k: x.reshape(shape) for k, x, shape in zip(names, np.split(flat, borders[:-1]), shapes, strict=True)}
        send.unpersist()


def lm_scores(docs: DataFrame, folds: int = 5, held_out: int = 1, frequent: int = FREQUENT, rows: int = ROWS, most_bytes: int = BYTES, seed: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document of ``docs`` (doc_id, text).

    Tokens are runs of other characters than ASCII white space, A-Z in lower case, and an end after them; null texts are
    empty. ``base_score`` is the sum of log10((c + 0.5) / (N + 0.5 (V + 1))), ``score`` the log10 probability of the whole
    text by the model. Counts are of all texts outside the held-out fold; without any, every count is 0 and N is 0.
    """
    out = fold(F.col("doc_id"), folds) == held_out
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(F.lit(seed + 2), "doc_id", text)
    learned = docs.where(~out).select(text.alias("text"))
    vocabulary = cut(word_counts(learned.select("text")))
    ends, size = learned.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    sums = vocabulary.groupBy("sort").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    in_sort, types = np.zeros(BUCKETS), np.zeros(BUCKETS)
    in_sort[sums["sort"].to_numpy()], types[sums["sort"].to_numpy()] = sums["n"].to_numpy(), sums["v"].to_numpy()
    total, distinct = int(in_sort.sum()) + ends, int(types.sum()) + (ends > 0)

    steps = vocabulary.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("v")).orderBy(F.desc("n")).toArrow()
    fits = np.cumsum(steps["v"].to_numpy()) <= frequent
    least = int(steps["n"].to_numpy()[fits][-1]) if fits.any() else 1 << 62
    table = vocabulary.where(F.col("n") >= least).toArrow()
    word = table["word"].to_numpy().view(_U)
    order = np.argsort(word)
    word, count, sort = word[order], table["n"].to_numpy()[order], table["sort"].to_numpy()[order]
    named = np.lexsort((word, -count))[: OUTPUTS - BUCKETS - 1]
    outputs = np.full(len(word), -1, np.int32)
    outputs[named] = np.arange(1, len(named) + 1)
    own = np.zeros(OUTPUTS)
    own[END], own[1 : len(named) + 1] = ends, count[named]
    in_sort -= np.bincount(sort[named], count[named], BUCKETS)
    types -= np.bincount(sort[named], minlength=BUCKETS)
    own[OUTPUTS - BUCKETS :] = in_sort
    model = GatedModel(seed)
    model.start(own)
    scorer = Scorer(word, count, outputs, total, distinct, ends, np.log10(in_sort + 0.5 * (types + 1)), model)
    sc, kind = docs.sparkSession.sparkContext, docs.schema["doc_id"].dataType.simpleString()
    known = sc.broadcast(scorer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in known.value.encode(batch.column("text")):
                n = len(x["n"])
                offsets = np.concatenate([[0], np.cumsum(2 * x["n"])])
                packed = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(x["tokens"])]).cast(pa.binary())
                begin = np.searchsorted(x["whose"], np.arange(n + 1)).astype(np.int32)
                rare = pa.StructArray.from_arrays([pa.array(x["word"].view(np.int64)), pa.array(x["times"].astype(np.int64))], ["word", "times"])
                own = [batch.column(c).slice(at, n) for c in ("doc_id", "text_hash", "key")]
                columns = [*own, pa.array(x["n"].astype(np.int64)), pa.array(x["known"]), pa.array(x["base"]), pa.array(x["share"]), packed, pa.ListArray.from_arrays(pa.array(begin), rare)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "key", "n", "known", "base", "share", "tokens", "rare"])
                at += n

    fields = f"doc_id {kind}, text_hash long, key long, n long, known long, base double, share double"
    encoded = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"), key.alias("key"))
    encoded = cut(encoded.mapInArrow(encode, f"{fields}, tokens binary, rare array<struct<word: long, times: long>>"))
    _start(learned.select("text"), ends, scorer, rows, most_bytes, seed)
    _train(encoded.where(~out), size, scorer, seed)
    send = sc.broadcast(scorer.model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = text_bytes(batch.column("tokens"))[0].view(np.uint16).astype(np.int32)
            found = send.value.text_log_probabilities(tokens, batch.column("n").to_numpy()) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], [*batch.schema.names[:-1], "score"])

    scored = encoded.select("doc_id", "text_hash", "n", "known", "base", "share", "tokens")
    scored = scored.mapInArrow(score, f"{fields.replace('key long, ', '')}, score double")
    rare = encoded.where(F.size("rare") > 0).select("text_hash", F.explode("rare").alias("x")).select("text_hash", "x.word", "x.times").distinct()
    few = vocabulary.where(F.col("n") < least).select("word", F.col("n").alias("c"))
    found = rare.join(few, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    heavy = F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("heavy")
    found = found.groupBy("text_hash").agg(heavy, F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"))
    whole = scored.join(found, "text_hash", "left")
    more = F.coalesce("heavy", F.lit(0.0))
    return whole.select(
        "doc_id", out.alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + F.col("share") + more).alias("score"),
    )
