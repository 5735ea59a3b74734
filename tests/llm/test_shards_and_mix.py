"""Sharding, mixing and the pipeline."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from medlar.llm import mixing, sharding


@pytest.mark.parametrize("size", [1 << 30, 200_000])
def test_shards_hold_every_row_once_and_are_level(documents, size):
    placed = sharding.shuffled_shards(documents, bucket_bytes=size)
    rows = placed.select("doc_id", "place.*").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in documents.collect())
    slots = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)]
    assert all(x == list(range(len(x))) for x in slots)
    assert max(map(len, slots)) - min(map(len, slots)) <= 1
    again = sharding.shuffled_shards(documents.repartition(3), bucket_bytes=size)
    assert placed.select("doc_id", "place").exceptAll(again.select("doc_id", "place")).isEmpty()
    other = sharding.shuffled_shards(documents, seed=99, bucket_bytes=size)
    assert placed.select("doc_id", "place").exceptAll(other.select("doc_id", "place")).count() > 900
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    rising = sum(a < b for a, b in zip(order, order[1:], strict=False))
    assert 400 < rising < 600


def test_buckets_grow_with_the_data_up_to_what_memory_holds():
    assert sharding.bucket_count(0, 8) == 8
    assert sharding.bucket_count(10 << 30, 8) == 640
    assert sharding.bucket_count(1 << 40, 8) <= sharding.FINE + 1
    assert sharding.bucket_count(100 << 40, 8) == (100 << 40) // (256 << 20)


def test_written_shards(documents, tmp_path, spark):
    path = str(tmp_path / "shards")
    sharding.write_shards(documents, path)
    assert spark.read.parquet(path).groupBy("shard").count().agg(F.min("count"), F.max("count")).first()[:] == (125, 125)


def test_shard_edges(edge, none):
    rows = sharding.shuffled_shards(edge).collect()
    assert len(rows) == edge.count()
    assert len({(r["place"]["shard"], r["place"]["slot"]) for r in rows}) == len(rows)
    assert sharding.shuffled_shards(none).count() == 0
    few = sharding.shuffled_shards(edge.limit(3)).select("place.*").collect()
    assert [r["slot"] for r in few] == [0, 0, 0]


def test_equal_rows_are_spread(spark, monkeypatch):
    """Rows without id and text, equal or told apart by other columns only, are no hot bucket of either operator."""
    monkeypatch.setattr(mixing, "ROWS", 64)
    equal = spark.range(50_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS STRING) AS text", "'a' AS source", "map('k', 1) AS tags")
    unlike = spark.range(5_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'' AS text", "'b' AS source", "map('k', int(id)) AS tags")
    words = spark.range(5_000).selectExpr("7 AS doc_id", "'one two three' AS text", "'c' AS source", "map('k', 1) AS tags")
    docs = equal.union(unlike).union(words)
    mixed = mixing.mix(docs)
    assert mixed.count() == 60_000
    got = {r["source"]: r for r in mixed.groupBy("source").agg(F.sum("mix.taken").alias("taken"), F.max("mix.target").alias("target"), F.countDistinct("tags").alias("tags")).collect()}
    assert abs(got["c"]["taken"] - got["c"]["target"]) <= 16
    assert got["b"]["tags"] == 5_000
    placed = sharding.shuffled_shards(docs.drop("tags"), bucket_bytes=4_000)
    sizes = placed.groupBy("place.bucket").count().agg(F.count("*").alias("n"), F.max("count").alias("most"), F.sum("count").alias("all")).first()
    assert sizes["all"] == 60_000
    assert sizes["most"] < 3 * 60_000 / sizes["n"]
    again = sharding.shuffled_shards(docs.drop("tags").repartition(3), bucket_bytes=4_000)
    assert placed.exceptAll(again).isEmpty()


def test_no_column_is_lost_or_changed(edge):
    mixed = mixing.mix(edge, name="other")
    assert mixed.drop("other").exceptAll(edge).isEmpty()
    assert mixed.columns == [*edge.columns, "other"]
    placed = sharding.shuffled_shards(edge, name="other")
    assert placed.columns == [*edge.columns, "other"]
    assert placed.drop("other").exceptAll(edge).isEmpty()


def seats_by_hand(targets, house):
    won = [0] * len(targets)
    for _ in range(house):
        best = max(range(len(targets)), key=lambda i: (targets[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_quotas_are_those_of_highest_quotients(spark):
    sizes = [("a", 5000), ("b", 300), ("c", 40), ("d", 9000), (None, 700), ("e", 0), ("f", 12)]
    table = spark.createDataFrame([(s, n, 1) for s, n in sizes], "source string, size long, rows long")
    rows = sorted(mixing.quotas(table).collect(), key=lambda r: r["place"])
    assert [r["source"] for r in rows] == ["a", "b", "c", "d", "e", "f", None]
    total = sum(n for _, n in sizes)
    assert sum(r["target"] for r in rows) == pytest.approx(total)
    assert all(r["target"] <= 3 * r["size"] + 1e-9 for r in rows)
    house = -(-total // mixing.BLOCK)
    for i in range(8):
        assert [r["seats"][i] for r in rows] == seats_by_hand([r["target"] for r in rows], house * (i + 1) // 8)


def test_targets_share_the_excess(spark):
    table = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 1000, 1)], "source string, size long, rows long")
    got = {r["source"]: r["target"] for r in mixing.quotas(table).collect()}
    assert got == {"a": 30.0, "b": pytest.approx(1980 * 2 / 3), "c": pytest.approx(1980 / 3)}


def test_mix_equals_its_sql(documents):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    mixed = mixing.mix(documents).select("doc_id", "mix.*")
    mine = sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixed.collect())
    assert mine == sorted(con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall())


def test_mix_edges(edge, none):
    rows = mixing.mix(edge).collect()
    assert len(rows) == edge.count()
    assert all(0 <= r["mix"]["taken"] <= 3 * r["mix"]["size"] for r in rows)
    assert {r["mix"]["size"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    assert mixing.mix(none).count() == 0
    wordless = mixing.mix(edge.where("doc_id IN (3, 4, 5)")).collect()
    assert [r["mix"]["taken"] for r in wordless] == [0, 0, 0]
    assert [c for c in mixing.mix(edge).columns if c != "mix"] == [c for c in edge.columns if c != "mix"]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = docs.limit(1).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "CAST(NULL AS STRING) AS source", "n_chars")
    docs = docs.union(extra).union(docs.limit(1))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "sharding":
            assert out.columns == [*columns, "shard", "slot"]
            assert out.count() == docs.count()
        else:
            assert out.columns == columns
        if name in ("toxicity", "near_duplicates", "decontamination"):
            assert out.exceptAll(docs).isEmpty()
            assert out.where("text IS NULL").count() == 1
        empty = stage(spark, docs.limit(0), folder)
        assert empty.count() == 0
        docs = out


def test_pipeline_stages_keep_clashing_names(spark, edge):
    import corpus_pipeline

    docs = edge.where("doc_id <= 10").withColumn("mix", F.lit("m")).withColumn("place", F.lit("p"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert [c for c in out.columns if c not in ("shard_", "slot_")] == docs.columns, name
        assert {tuple(r) for r in out.select(docs.columns).collect()} <= {tuple(r) for r in docs.collect()}, name


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
