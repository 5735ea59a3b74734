"""Helpers that several training-data operators use."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder that the cluster names; a local one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="medlar-checkpoint-")
        sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage; survives lost executors."""
    prepare(df.sparkSession)
    return df.checkpoint()


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids fall in fold 0 of an empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name starting with ``stem`` that ``df`` doesn't have, ignoring case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


#: Bytes of strings that are broadcast at once.
BROADCAST_BYTES = 64 << 20
#: Rows of equal id and text from which on they are spread by the rest of the row and by number.
EQUAL_ROWS = 1_000
_COPIES = 4_096


def narrow(df: DataFrame, rows: int = 1_000_000, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and ``most_bytes`` in its strings; else as it is."""
    wide = [c for c, t in df.dtypes if t in ("string", "binary")]
    size = F.sum(sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c in wide), F.lit(0)))
    n, held = df.agg(F.count("*"), size).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= most_bytes else df


def as_records(docs: DataFrame, most: int | None = None) -> DataFrame:
    """(row, salt): the rows of ``docs``, which needs doc_id and text, as one struct each, so that no name clashes.

    salt is empty but for rows of whose id and text there are more than ``most``: of these, equal rows are counted where
    they are and come back with a number each, and salt has a hash of the whole row and that number. So a partitioning
    by id, text and salt has no hot key, and reruns on equal rows give the same salts.
    """
    most = EQUAL_ROWS if most is None else most
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.xxhash64(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.coalesce("row.text", F.lit("")))
    hot = cut(rows.groupBy(same.alias("same")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("same"))
    if hot.isEmpty():
        return rows.select("row", F.lit("").alias("salt"))
    keyed, hot = rows.withColumn("same", same), narrow(hot)
    counted = keyed.join(hot, "same", "left_semi").groupBy("row").agg(F.count("*").alias("n"))
    tens = counted.withColumn("ten", F.explode(F.expr(f"sequence(0L, (n - 1) div {_COPIES})")))
    copies = tens.withColumn("copy", F.explode(F.expr(f"sequence(ten * {_COPIES}, least(n, (ten + 1) * {_COPIES}) - 1)")))
    salt = F.concat_ws(":", F.xxhash64(F.to_json("row")).cast("string"), F.col("copy").cast("string"))
    return keyed.join(hot, "same", "left_anti").select("row", F.lit("").alias("salt")).union(copies.select("row", salt.alias("salt")))


# --- words of Arrow string columns, hashed without a Python object per word ---

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that are hashed at once.
_PIECE = 1 << 19
_power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(_PIECE, _BASE, np.uint64))])
_inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(_PIECE, _INVERSE, np.uint64))])


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each text starts; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of runs of bytes that ``is_word`` marks; no run crosses a text's border."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[buf]
    border = np.zeros(n + 1, bool)
    border[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span, from the difference of prefix hashes; spans follow one another."""
    values = _BYTE[_ASCII_LOWER] if lower else _BYTE
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        a = int(starts[first])
        last = int(np.searchsorted(ends, a + _PIECE, "right"))
        if last <= first:  # a span longer than a piece
            total = 0
            for at in range(a, int(ends[first]), _PIECE):
                piece = values[buf[at : min(at + _PIECE, int(ends[first]))]]
                total += int((piece * _power[: len(piece)]).sum()) * pow(_BASE, at - a, 2**64)
            out[first], first = total % 2**64, first + 1
            continue
        piece = values[buf[a : int(ends[last - 1])]]
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(piece * _power[: len(piece)])])
        begin, end = starts[first:last] - a, ends[first:last] - a
        out[first:last] = (prefix[end] - prefix[begin]) * _inverse[begin]
        first = last
    return mix64(out + (ends - starts).astype(np.uint64))


def chunks(off: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together, or of one longer text."""
    first, n = 0, len(off) - 1
    while first < n:
        last = int(np.searchsorted(off, off[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


NOT_SPACE = ~_SPACE


def hashed_words(col: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, number of words of each text, hashes of all words) by chunks of texts."""
    buf, off = text_bytes(col)
    for a, b in chunks(off):
        part, at = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        starts, ends = spans(part, at, NOT_SPACE)
        counts = np.diff(np.searchsorted(starts, at))
        yield a, b, counts, span_hashes(part, starts, ends, lower)
