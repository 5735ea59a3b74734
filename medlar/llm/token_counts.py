"""Token counts by a two-tier lookup of pre-tokens, without a shuffle.

A table of the lengths of frequent pre-tokens, counted where they stand in a seeded sample of all documents and bounded in
entries and bytes, is broadcast. A worker splits its texts into pre-tokens with the tokenizer's own pattern, takes their
lengths from the table and encodes what the table misses, each once, keeping it in a bounded cache; long pre-tokens are
encoded each time and never kept. What the table holds never changes a count.
"""

from __future__ import annotations

import os
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medlar.llm.shared import free_name

#: Entries of the broadcast table, and of what a worker keeps besides it.
TABLE = 32_768
CACHE = 200_000
#: Characters of a pre-token that is kept, at most: with the numbers of entries this bounds bytes.
KEPT = 64
#: Documents that the table is made from, about, and pre-tokens that a task counts at once.
SAMPLE = 2_000
COUNTED = 500_000
SEED = 5
#: Up to here the pattern's classes are the same in every version of Unicode that libraries have.
_PLAIN = 0x530

_encoders: dict[str, Encoder] = {}


class Encoder:
    """A byte-level BPE tokenizer of the ``tokenizers`` library as a function from pre-tokens to numbers of tokens."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(pattern).findall
        self.strange = regex.compile(rf"[^\x00-\u{_PLAIN - 1:04x}]").search
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Encoder:
        """The worker's encoder for a file, loaded once."""
        key = f"{path}\n{pattern}"
        if key not in _encoders:
            _encoders[key] = cls(path, pattern)
        return _encoders[key]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def odd(self, text: str) -> bool:
        """Whether the library has to split the text: it holds special strings or characters that Unicode may yet assign."""
        if any(s in text for s in self.special):
            return True
        return bool(self.strange(text)) and any(unicodedata.category(c) == "Cn" for c in set(text))

    def counts(self, texts: list[str], table: dict[str, int]) -> list[int]:
        if not self.known or len(self.known) > len(table) + CACHE:
            self.known = dict(table)
        known, split = self.known, self.split
        odd = [self.odd(t) for t in texts]
        parts = [() if o else split(t) for t, o in zip(texts, odd, strict=True)]
        missing: set[str] = set()
        for p in parts:
            missing.update(p)
        new = list(missing.difference(known))
        sizes = dict(zip(new, self.whole(new), strict=True))
        known.update(sizes)
        found = [sum(map(known.__getitem__, p)) for p in parts]
        for t in new:
            if len(t) > KEPT:
                del known[t]
        at = [i for i, o in enumerate(odd) if o]
        for i, n in zip(at, self.whole([texts[i] for i in at]), strict=True):
            found[i] = n
        return found


def _batches(texts: list[str], most: int) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters together."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def frequent_lengths(docs: DataFrame, path: str, pattern: str, entries: int = TABLE, sample: int = SAMPLE, seed: int = SEED) -> Broadcast:
    """The first tier: lengths of the most frequent pre-tokens of about ``sample`` documents, at most ``entries`` of them.

    The documents are drawn from all of ``docs`` by a seeded sample; their pre-tokens are counted by the tasks that read
    them and summed by pre-token, so no document leaves its task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder.of(path, pattern), Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["t", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and not encoder.odd(text):
                    seen.update(t for t in encoder.split(text) if len(t) <= KEPT)
                    if len(seen) > COUNTED:
                        yield counted()
                        seen.clear()
        if seen:
            yield counted()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder.whole(batch.column(0).to_pylist()), pa.int32())], ["t", "n"])

    drawn = docs.select("text").sample(fraction=min(1.0, sample / max(docs.count(), 1)), seed=seed)
    often = drawn.mapInArrow(count, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "t").limit(entries)
    got = often.select("t").mapInArrow(encode, "t string, n int").toArrow()
    return docs.sparkSession.sparkContext.broadcast(dict(zip(got["t"].to_pylist(), got["n"].to_pylist(), strict=True)))


def with_token_counts(docs: DataFrame, path: str, pattern: str, text: str = "text", name: str = "n_tokens") -> tuple[DataFrame, str]:
    """``docs`` with the number of tokens of each whole text as one more column, whose name is returned too.

    Null and empty texts have none. Special strings in a text count as the library's default has it, one token each; no
    tokens are added, nothing is cut off. If ``docs`` has a column called ``name``, the new one gets underscores at its end.
    """
    table = frequent_lengths(docs.select(F.col(text).alias("text")), path, pattern)
    name = free_name(docs, name)
    fields = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = Encoder.of(path, pattern), table.value
        for batch in batches:
            found = []
            for part in _batches([t or "" for t in batch.column(text).to_pylist()], 1 << 20):
                found += encoder.counts(part, lengths)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, name])

    return docs.mapInArrow(count, fields), name


def token_report(docs: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document."""
    narrow = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted, name = with_token_counts(narrow, path, pattern)
    return counted.select("doc_id", "n_bytes", F.col(name).alias("n_tokens"), (F.col(name) > limit).alias("over_limit"))
