"""Quality by importance resampling: how much likelier a text is under a model of target text than of raw text.

Both models are distributions over hashed words and pairs of neighbouring words. A document's log importance weight is
the sum of the logarithms of their ratio; adding Gumbel noise, which a seeded hash gives, and keeping the k largest sums
draws k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlar.llm.shared import cut, hashed_words, mix64

#: Hash buckets of n-grams.
BUCKETS = 1 << 14
#: Added to the counts of every bucket.
SMOOTHING = 0.5
#: Labelled documents that the target model is learned from, about; 16 bytes each are broadcast.
TARGET_ROWS = 20_000
SEED = 4
#: Rows that may be sorted together to find the last one that is kept.
TIES = 10_000
_U = np.uint64


def ngram_buckets(counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each word and each pair of neighbouring words of a text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    same = owner[1:] == owner[:-1]
    pairs = mix64(words[:-1] * _U(0x9E3779B97F4A7C15) + words[1:])[same]
    return (np.concatenate([words, pairs]) % _U(BUCKETS)).astype(np.int64), np.concatenate([owner, owner[1:][same]])


def log_ratios(docs: DataFrame, labels: DataFrame, max_rows: int = TARGET_ROWS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """(ln of the ratio of the models in each bucket, share of labelled documents that are target text).

    The raw model counts all documents; the target model those labelled of quality 1, about ``max_rows`` of them at most,
    drawn by a seeded hash of their ids. Without any, the ratio is 1 everywhere and the share 1. Of several labels of a
    document the least counts; null ids and labels count for nothing.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("q")).dropna().groupBy("_id").agg(F.min("q").alias("q"))
    sums = known.agg(F.count("*"), F.sum("q")).first()
    good = int(sums[1] or 0)
    draw = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1_000_000))
    target = known.where((F.col("q") > 0) & (draw < int(min(1.0, max_rows / max(good, 1)) * 1_000_000))).select("_id", F.lit(True).alias("_target"))
    marked = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(target), "_id", "left").select("text", F.coalesce("_target", F.lit(False)).alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, own = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            chosen = batch.column("target").to_numpy(zero_copy_only=False)
            for a, b, counts, words in hashed_words(batch.column("text")):
                bucket, text = ngram_buckets(counts, words)
                raw += np.bincount(bucket, minlength=BUCKETS)
                own += np.bincount(bucket, chosen[a:b][text], BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at].astype(np.int64)), pa.array(own[at].astype(np.int64))], ["b", "raw", "own"])

    got = marked.mapInArrow(count, "b int, raw long, own long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("own").alias("own")).toArrow()
    raw, own = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    raw[got["b"].to_numpy()] += got["raw"].to_numpy()
    own[got["b"].to_numpy()] += got["own"].to_numpy()
    if not got["own"].to_numpy().sum():
        return np.zeros(BUCKETS), 1.0
    return np.log(own / own.sum()) - np.log(raw / raw.sum()), good / sums[0]


def _last_kept(keyed: DataFrame, k: int) -> tuple | None:
    """The k-th of the rows in order of falling key and rising order column, by histograms that close in on it."""
    low, high, n = keyed.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if not n or k >= n:
        return None
    inside, left = keyed, k
    while n > TIES and high > low:
        bucket = F.least(F.lit(1023), F.floor((F.lit(high) - F.col("key")) / ((high - low) / 1024))).cast("int")
        parts = inside.groupBy(bucket.alias("b")).agg(F.count("*"), F.min("key"), F.max("key")).orderBy("b").collect()
        for _, n, low, high in parts:  # noqa: B007
            if left <= n:
                break
            left -= n
        inside = keyed.where(F.col("key").between(low, high))
    if n > TIES:  # one key: rows of one tie are kept together
        for tie, of in inside.groupBy("tie").agg(F.count("*")).orderBy("tie").toLocalIterator():
            if left <= of:
                return low, tie
            left -= of
    return tuple(inside.orderBy(F.desc("key"), "tie").limit(left).orderBy("key", F.desc("tie")).first())


def importance_sample(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, log_weight, gumbel_key and selected of each document of ``docs`` (doc_id, text).

    The selected are those of the k largest keys, k being ``keep`` of all documents; by default that is the share of
    target text among labels. Null and empty texts have no n-grams and a weight of 0. Ties go by a hash of id and text;
    rows that are equal in both are selected together. An empty table gives an empty result.
    """
    ratio, share = log_ratios(docs, labels, seed=seed)
    table = docs.sparkSession.sparkContext.broadcast(ratio)
    draw = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for a, b, counts, words in hashed_words(batch.column("text")):
                bucket, text = ngram_buckets(counts, words)
                weight[a:b] = np.bincount(text, table.value[bucket], b - a)
                size[a:b] = np.bincount(text, minlength=b - a)
            tie = batch.column("tie").to_numpy().view(_U)
            uniform = ((mix64(tie) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
            key = weight - np.log(-np.log(uniform))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(weight), pa.array(key), batch.column("tie")], ["doc_id", "n_features", "log_weight", "key", "tie"])

    keyed = cut(docs.select("doc_id", "text", draw.alias("tie")).mapInArrow(weigh, f"doc_id {kind}, n_features long, log_weight double, key double, tie long"))
    k = round((share if keep is None else keep) * keyed.count())
    last = _last_kept(keyed.select("key", "tie"), k) if k else None
    if last:
        chosen = (F.col("key") > last[0]) | ((F.col("key") == last[0]) & (F.col("tie") <= last[1]))
    else:
        chosen = F.lit(k > 0)
    return keyed.select("doc_id", "n_features", "log_weight", F.col("key").alias("gumbel_key"), chosen.alias("selected"))
