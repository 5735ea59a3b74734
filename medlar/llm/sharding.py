"""A global shuffle into shards in two passes.

The first pass scatters records uniformly into buckets that fit in memory, by a seeded hash. The second reads each bucket
as one partition, puts it in the order of the hash, so that a task which runs again sees the same, and shuffles it with
Fisher-Yates (Spark's ``shuffle``; Spark adds the partition's number, which is the bucket's, to the seed). The buckets behind one another are the shuffled data, and
shards are cut from it so that their counts are at most one apart. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medlar.llm.shared import as_records, cut, free_name

SHARDS = 8
SEED = 7
#: Bytes of text in a bucket, about: a task holds a few times as much. From FINE buckets on they grow, up to the larger size.
BUCKET_BYTES = (16 << 20, 256 << 20)
FINE = 20_000
#: Buckets up to this number are broadcast with their offsets, 16 bytes each.
BROADCAST_ROWS = 1_000_000


def text_size(text) -> F.Column:
    """UTF-8 bytes of the text, none for null, plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def bucket_count(total: int, shards: int, bucket_bytes: int | None = None) -> int:
    """How many buckets ``total`` bytes are scattered into: a shard has at least one."""
    least, most = BUCKET_BYTES
    size = bucket_bytes or min(most, max(least, total // FINE))
    return max(shards, -(-total // size))


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int | None = None, name: str = "place") -> DataFrame:
    """``docs``, which needs doc_id and text, with a struct column ``name`` more: bucket, shard and slot.

    Slots of a shard are gapless from 0, and shards' counts are at most one apart (with fewer rows than shards the rest
    stay empty). Reruns on equal rows agree. Null ids and texts count as empty; rows that are equal in everything may
    stand for each other, and many of them are spread over buckets as others are; an empty table gives an empty result. A
    column of ``docs`` called ``name`` is replaced: ``free_name`` gives one that it doesn't have.
    """
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    total = docs.agg(F.sum(text_size(F.col("text")))).first()[0] or 0
    buckets = bucket_count(total, shards, bucket_bytes)
    rows = as_records(docs.select([F.col(f"`{c}`") for c in columns]))
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.coalesce("row.text", F.lit("")))
    key = F.when(F.col("salt") == "", key).otherwise(F.xxhash64(key, F.col("salt")))
    bucket = F.pmod(key, F.lit(buckets)).cast("int")
    counts = cut(rows.select(bucket.alias("b")).groupBy("b").agg(F.count("*").alias("n")))
    n = counts.agg(F.sum("n")).first()[0] or 0
    before = F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("b", before.alias("before"))
    if buckets <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)

    scattered = rows.select(bucket.alias("b"), F.struct(key.alias("key"), "row").alias("record")).repartitionById(buckets, F.col("b"))
    whole = scattered.groupBy("b").agg(F.array_sort(F.collect_list("record")).alias("records"))
    mixed = whole.withColumn("records", F.expr(f"shuffle(records, {seed}L)"))
    spread = mixed.select("b", F.posexplode("records").alias("at", "record")).join(offsets, "b")
    spread = spread.withColumn("g", F.col("before") + F.col("at"))
    shard = F.expr(f"cast(g * {shards} div {max(n, 1)} as int)")
    spread = spread.withColumn("shard", shard)
    slot = F.col("g") - F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}")
    spread = spread.withColumn("slot", slot).select(F.col("record.row").alias("row"), F.struct(F.col("b").alias("bucket"), "shard", "slot").alias("place"))
    return spread.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], F.col("place").alias(name))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write the shuffled rows below ``path``, a folder for each shard, rows by slot. If ``docs`` has columns shard or slot,
    the new ones get underscores at their end."""
    name, shard, slot = (free_name(docs, c) for c in ("place", "shard", "slot"))
    placed = shuffled_shards(docs, shards, seed, name=name).withColumn(shard, F.col(f"{name}.shard")).withColumn(slot, F.col(f"{name}.slot")).drop(name)
    placed.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
