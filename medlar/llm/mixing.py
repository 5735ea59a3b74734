"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets are shares of all words by weight, held below a multiple of each source's size with the excess shared out again.
The words of the mix are dealt as blocks of equal length: every source has seats by highest quotients target / (2k + 1),
counted for one shard, two shards and so on, so that each shard's quota is the difference of two apportionments (more
seats never take one away). A source's documents stand in an order that a seeded hash gives; seats take their words from
the start of that order, again from the start after its end. Everything is in DataFrame expressions: no list of blocks
or seats is ever made, a document's part follows from where its words begin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlar.llm.shared import WORD, as_records, cut

WEIGHTS = (5, 2, 1)
#: Times a source's size that its target, and a document's size that its taken words, may reach.
MOST = 3
#: Words of a block.
BLOCK = 16
SHARDS = 8
SEED = 9
#: Rows of a source that are put in order together.
ROWS = 512
#: Buckets of a source whose words are summed up together.
RUN = 1_024
#: Sources up to this number are broadcast.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A hexadecimal hash that orders documents."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))


def _targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds place (by code point, null last), weight and target to (source, size, rows).

    In order of size by weight, a source stays at its limit if the level that the others would share reaches it.
    """
    big = "decimal(38,0)"
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    ranked = sources.withColumn("place", place).withColumn("weight", weight)
    ranked = ranked.withColumn("by", F.col("size") / F.col("weight"))
    order = Window.orderBy("by", "place")
    before = F.coalesce(F.sum(F.col("size") * most).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("total", F.sum("size").over(Window.partitionBy())).withColumn("before", before).withColumn("after", after)
    held = (F.col("size") * most).cast(big) * F.col("after") <= (F.col("total") - F.col("before")).cast(big) * F.col("weight")
    ranked = ranked.withColumn("held", held)
    every = Window.partitionBy()
    free = F.col("total") - F.sum(F.when(F.col("held"), F.col("size") * most).otherwise(0)).over(every)
    share = F.sum(F.when(F.col("held"), 0).otherwise(F.col("weight"))).over(every)
    ranked = ranked.withColumn("free", free).withColumn("share", share)
    target = F.when(F.col("held"), (F.col("size") * most).cast("double")).otherwise((F.col("weight") * F.col("free")).cast("double") / F.col("share"))
    return ranked.withColumn("target", target).select("source", "size", "rows", "place", "weight", "total", "target")


def quotas(sources: DataFrame, shards: int = SHARDS, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds place, weight, total, target and seats to (source, size, rows); seats has the blocks of the first shard, the
    first two and so on. The candidates for a seat are few: a source's count is within its share of sources / 2 + 1."""
    known = _targets(sources, weights, most).withColumn("sources", F.count("*").over(Window.partitionBy()))
    house = F.floor(F.ceil(F.col("total") / block) * F.col("shard") / shards).cast("long")
    dealt = known.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn("house", house)
    part = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0)
    mid, half = part * F.col("house"), part * F.col("sources") / 2 + 1
    dealt = dealt.withColumn("sure", F.greatest(F.lit(0), F.floor(mid - half)).cast("long")).withColumn("top", F.ceil(mid + half).cast("long"))
    dealt = dealt.withColumn("open", F.col("house") - F.sum("sure").over(Window.partitionBy("shard")))
    tried = dealt.withColumn("k", F.explode(F.sequence("sure", "top"))).withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("quotient"), "place", "k"))
    won = (F.col("rank") <= F.col("open")) & (F.col("target") > 0)
    counted = tried.withColumn("rank", rank).groupBy("place", "shard").agg((F.first("sure") + F.sum(F.when(won, 1).otherwise(0))).alias("seats"))
    seats = counted.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "seats"))), lambda x: x["seats"]).alias("seats"))
    return known.drop("sources").join(seats, "place")


def mix(docs: DataFrame, seed: int = SEED, shards: int = SHARDS, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, name: str = "mix") -> DataFrame:
    """``docs``, which needs doc_id, text and source, with a struct column ``name`` more: size (words of the text),
    source_size, target, taken (words that the mix takes, repeats counted), copies (whole repeats, the last one if it
    begins in the mix) and shard (where the first taken word goes; null if none is taken).

    Words are runs of other characters than ASCII white space; null and empty texts have none, and count as beginning
    where their bucket of the order does. A null source is a source of its own and the last in order. An empty table gives
    an empty result; a table without words takes none. Reruns agree: rows of equal id and text are alike, rows that are
    equal in everything may stand for each other, and many of them stand at as many places of the order. A column of
    ``docs`` that is called ``name`` is replaced: ``free_name`` gives one that it doesn't have.
    """
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    key = order_key(F.col("row.doc_id"), F.col("row.text"), seed)
    key = F.when(F.col("salt") == "", key).otherwise(F.md5(F.concat_ws(":", key, "salt")))
    rows = as_records(docs.select([F.col(f"`{c}`") for c in columns]))
    rows = rows.select("row", F.col("row.source").alias("source"), word_count(F.col("row.text")).alias("size"), key.alias("key"))
    rows = rows.withColumn("front", F.conv(F.substring("key", 1, 8), 16, 10).cast("long"))
    sized = cut(rows.select("source", "size", "front"))
    plan = cut(quotas(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), shards, block, weights, most))
    few = plan.count() <= BROADCAST_ROWS
    words = F.least(F.element_at("seats", -1) * block, F.col("size") * most)
    passes = F.when(F.col("size") > 0, F.expr("words div size")).otherwise(0)
    plan = plan.withColumn("words", words).withColumn("passes", passes)
    plan = plan.select(F.col("source").alias("of"), F.struct("place", "size", "rows", "target", "seats", "passes", (F.col("words") - F.col("passes") * F.col("size")).alias("extra")).alias("plan"))
    plan = F.broadcast(plan) if few else plan

    def placed(df: DataFrame) -> DataFrame:
        buckets = F.ceil(F.col("plan.rows") / ROWS).cast("long")
        return df.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("place", F.col("plan.place")).withColumn("bucket", F.shiftright(F.col("front") * buckets, 32))

    # words before a bucket: before its run of buckets, and in the run
    sums = placed(sized).groupBy("place", "bucket").agg(F.sum("size").alias("words")).withColumn("run", F.expr(f"bucket div {RUN}"))
    so_far = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sums.groupBy("place", "run").agg(F.sum("words").alias("words")).select("place", "run", so_far("words", "place", "run").alias("before"))
    sums = sums.withColumn("inside", so_far("words", "place", "run", "bucket")).join(runs, ["place", "run"])
    sums = sums.select("place", "bucket", (F.col("before") + F.col("inside")).alias("ahead"))

    rows = placed(rows).join(sums, ["place", "bucket"])
    # rows without words add nothing to each other's places, so they are spread
    part = F.when(F.col("size") > 0, 0).otherwise(1 + F.pmod(F.xxhash64("key"), F.lit(RUN)))
    inside = Window.partitionBy("place", "bucket", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", part).withColumn("start", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    start, size, extra = F.col("start"), F.col("size"), F.col("plan.extra")
    taken = F.col("plan.passes") * size + F.greatest(F.lit(0), F.least(size, extra - start))
    copies = F.col("plan.passes") + F.when(start < extra, 1).otherwise(0)
    shard = F.when(taken > 0, F.size(F.filter("plan.seats", lambda x: x <= F.floor(start / block))))
    done = F.struct(size.alias("size"), F.col("plan.size").alias("source_size"), F.col("plan.target").alias("target"), taken.cast("long").alias("taken"), copies.cast("long").alias("copies"), shard.alias("shard"))
    return rows.select("row", done.alias("done")).select(*[F.col(f"row.`{c}`").alias(c) for c in columns], F.col("done").alias(name))


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5(concat_ws(':', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS k
  FROM documents
), bysource AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS ssize FROM sized GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM bysource
), weighed AS (
  SELECT *, [5, 2, 1][CAST(place % 3 + 1 AS INT)] AS w, sum(ssize) OVER () AS total, count(*) OVER () AS n FROM placed
), levels AS (
  SELECT *,
    coalesce(sum(3 * ssize) OVER (ORDER BY ssize / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY ssize / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM weighed
), held AS (
  SELECT *, CAST(3 * ssize AS HUGEINT) * after <= CAST(total - before AS HUGEINT) * w AS at_limit FROM levels
), aimed AS (
  SELECT source, ssize, place, total, n, CASE WHEN at_limit THEN CAST(3 * ssize AS DOUBLE) ELSE
    CAST(w * (total - sum(CASE WHEN at_limit THEN 3 * ssize ELSE 0 END) OVER ()) AS DOUBLE)
      / sum(CASE WHEN at_limit THEN 0 ELSE w END) OVER () END AS target
  FROM held
), bounds AS (
  SELECT *, CAST(ceil(total / {BLOCK}) AS BIGINT) AS house,
    greatest(0, CAST(floor(target / total * ceil(total / {BLOCK}) - target / total * n / 2 - 1) AS BIGINT)) AS sure,
    CAST(ceil(target / total * ceil(total / {BLOCK}) + target / total * n / 2 + 1) AS BIGINT) AS top
  FROM aimed WHERE total > 0
), tried AS (
  SELECT place, house, target, sure, unnest(range(sure, top + 1)) AS kth FROM bounds
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY target / (2 * kth + 1) DESC, place, kth) AS rk FROM tried
), seated AS (
  SELECT b.place, any_value(b.sure) + count(*) FILTER (r.rk <= b.house - (SELECT sum(sure) FROM bounds) AND r.target > 0) AS seats
  FROM ranked r JOIN bounds b USING (place) GROUP BY b.place
), plan AS (
  SELECT a.*, least(coalesce(s.seats, 0) * {BLOCK}, 3 * a.ssize) AS words FROM aimed a LEFT JOIN seated s USING (place)
), cuts AS (
  SELECT *, CASE WHEN ssize > 0 THEN words // ssize ELSE 0 END AS passes, words - CASE WHEN ssize > 0 THEN words // ssize ELSE 0 END * ssize AS extra FROM plan
), stream AS (
  SELECT z.*, c.ssize, c.target, c.passes, c.extra,
    coalesce(sum(z.size) OVER (PARTITION BY c.place ORDER BY z.k, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized z JOIN cuts c ON z.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, size, ssize AS source_size, target, CAST(passes * size + greatest(0, least(size, extra - start)) AS BIGINT) AS taken FROM stream
"""
