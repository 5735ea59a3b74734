from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from medlar.llm import nearest as NN


def answers(df, **k):
    out = {}
    for r in sorted(NN.nearest_by_inner_product(df, **k).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def brute(rows, every, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = x @ x[i]
        keep = np.flatnonzero(ids != ids[i])
        order = keep[np.lexsort((ids[keep], -score[keep]))][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    expected = brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 20, 20)
    got = answers(df)
    assert got.keys() == expected.keys()
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in expected[q]}) for q in expected)
    assert hits >= 0.95 * sum(map(len, expected.values()))


def vectors(kind, n, width=64):
    """Rows of equal scale, with log-normal norms, or in clusters of 250."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, width))
    if kind == "clusters":
        return rng.normal(size=(n // 250, width))[np.arange(n) % (n // 250)] + 0.3 * x
    return x if kind == "gauss" else x / np.linalg.norm(x, axis=1)[:, None] * np.exp({"uneven": 0.5, "wild": 1.0}[kind] * rng.normal(size=(n, 1)))


@pytest.mark.parametrize(("kind", "n"), [("uneven", 16_000), ("gauss", 64_000), ("clusters", 16_000)])
def test_recall_over_shards(spark, kind, n):
    x = vectors(kind, n).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.reshape(-1), 64).cast(pa.list_(pa.float32()))}))
    got = answers(df)
    assert len(got) == n // 20
    hits = 0
    for q, found in got.items():
        score = (x @ x[q]).astype(np.float64)
        score[q] = -np.inf
        hits += len({v for v, _ in found} & set(np.argpartition(-score, 20)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(got)


@pytest.mark.parametrize("kind", ["uneven", "wild", "gauss", "clusters"])
def test_recall_in_a_full_shard(kind):
    x = vectors(kind, NN.SHARD_ROWS + 2_000).astype(np.float32)
    graph, q = NN.Graph(np.arange(NN.SHARD_ROWS), x[: NN.SHARD_ROWS]), x[NN.SHARD_ROWS :][:500]
    place, value = graph.search(q, 20)
    found = np.take_along_axis(place, np.argsort(-value, axis=1)[:, :20], 1)
    true = np.argpartition(-(q @ graph.vectors.T), 20, axis=1)[:, :20]
    assert sum(len(set(a) & set(b)) for a, b in zip(found.tolist(), true.tolist(), strict=True)) >= 0.9 * 20 * len(q)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_norms_copies_and_ties(spark, kind):
    rng = np.random.default_rng(3)
    some = rng.normal(size=(40, 6)) * rng.uniform(0.5, 3, (40, 1))
    some = some.astype(np.float32).astype(np.float64) if kind == "float" else some
    rows = [(i, some[0 if i % 3 == 0 else i % 40].tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got, expected = answers(df, every=10, k=30, least_shards=3), brute(rows, 10, 30)
    for q, want in expected.items():
        assert [v for v, _ in got[q]] == [v for v, _ in want]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], rel=1e-12)


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, score string, rank int, v int"
    bad = [(0, None), (20, []), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [1.0, float("nan")]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0]), (120, [1.0, 2.0, 3.0])]
    good = [(140, [1.0, 0.0]), (141, [2.0, 0.0]), (142, [-0.0, 1.0]), (143, [0.0, 1.0]), (160, [0.0, -1.0])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in bad + good], schema)
    got = answers(df)
    assert got == {140: [(141, 2.0), (142, 0.0), (143, 0.0), (160, 0.0)], 160: [(140, 0.0), (141, 0.0), (142, -1.0), (143, -1.0)]}
    assert answers(df.limit(0)) == {}
    assert answers(df.where("vec_id = 140")) == {}


def test_a_graph_survives_packing():
    rng = np.random.default_rng(5)
    graph = NN.Graph(np.arange(100), rng.normal(size=(100, 4)).astype(np.float32))
    other = NN.Graph.unpack(graph.pack())
    assert all((a == b).all() for a, b in zip(graph.links, other.links, strict=True))
    q = rng.normal(size=(7, 4))
    assert (graph.search(q, 5)[0] == other.search(q, 5)[0]).all()
