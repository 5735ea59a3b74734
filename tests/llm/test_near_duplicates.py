from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from medlar.llm import near_duplicates as ND

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^ \t-\r]+", text.translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Least id of each component of pairs of similarity 0.8 or more, and of equal word sequences."""
    sets = {i: shingles(t) for i, t in rows}
    index, parent = defaultdict(list), {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, _ in rows:
        both = Counter(j for g in sets[i] for j in index[g])
        for j, k in both.items():
            if k / (len(sets[i]) + len(sets[j]) - k) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for g in sets[i]:
            index[g].append(i)
    return {i: root(i) for i, _ in rows}


def classes(df):
    return {r["doc_id"]: r["class_id"] for r in ND.near_duplicate_classes(df).collect()}


def test_against_brute_force(documents):
    assert classes(documents) == brute([(r["doc_id"], r["text"]) for r in documents.collect()])


def family(n, edits, seed):
    """Copies of one text with some words changed, so that few of them are similar to all others."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ND, "BLOCK", 12)
    rows = family(150, 9, 3)
    assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_large_buckets_that_stay_apart_lose_no_link(spark, monkeypatch):
    """Texts that share a long notice, alike in many bands but not similar; some have a near copy among them."""
    monkeypatch.setattr(ND, "BLOCK", 12)
    monkeypatch.setattr(ND, "SPLIT", 1)
    dealt = []
    by_rare = ND._by_rare_shingles
    monkeypatch.setattr(ND, "_by_rare_shingles", lambda *a: dealt.append(by_rare(*a)) or dealt[-1])
    rng = random.Random(8)
    notice = " ".join(f"n{k}" for k in range(100))
    rows = []
    for i in range(160):
        own = [f"o{rng.randrange(10**6)}" for _ in range(50)]
        rows.append((10 * i, f"{notice} {' '.join(own)}"))
        if i % 4 == 0:
            own[rng.randrange(50)] = "changed"
            rows.append((10 * i + 1, f"{notice} {' '.join(own)}"))
        if i % 8 == 0:
            rows.append((10 * i + 2, f"{notice} {' '.join([*own, 'and', 'more'])}"))
    expected = brute(rows)
    assert len(set(expected.values())) == 160
    assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == expected
    assert dealt


def test_ids_of_any_kind_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(ND, "COPIES", 3)
    rows = [(f"id{i:03}", "one two three four five six" if i % 2 else f"{i} b c d e f g") for i in range(40)]
    got = classes(spark.createDataFrame(rows, "doc_id string, text string"))
    assert got == {i: "id001" if int(i[2:]) % 2 else i for i, _ in rows}
    kept = ND.one_of_each(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == ["id000", "id001", *(f"id{i:03}" for i in range(2, 40, 2))]


def test_registers_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(1)
    element = rng.integers(1, 2**63, 300, dtype=np.uint64)
    weight = rng.uniform(1, 3, 300)
    a, b = np.arange(0, 250), np.arange(50, 300)
    text = np.repeat([0, 1], 250)
    sig = ND.registers(text, np.concatenate([element[a], element[b]]), np.concatenate([weight[a], weight[b]]), 2, 4096)
    x, y = np.zeros(300), np.zeros(300)
    x[a], y[b] = weight[a], weight[b]
    shared = np.arange(50, 250)
    expected = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in shared)
    assert (sig[0] == sig[1]).mean() == pytest.approx(expected, abs=0.04)


@pytest.mark.parametrize("many", [1, 10**9])
def test_components(spark, monkeypatch, many):
    monkeypatch.setattr(ND, "MANY_LINKS", many)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 99), (99, 98), (5, 5)]
    got = {r["node"]: r["root"] for r in ND.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, 99: 98, 100: 98}
    assert ND.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edges(spark, edge, none):
    got = sorted(((r["doc_id"], r["class_id"]) for r in ND.near_duplicate_classes(edge).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8), (8, 8), (9, 9), (9, 9), (None, 9), (None, None), (10, 10)], key=str)
    assert ND.near_duplicate_classes(none).count() == 0
    kept = ND.one_of_each(edge)
    assert kept.columns == edge.columns
    texts = [r["text"] for r in kept.collect()]
    assert texts.count(None) == 2
    assert len([t for t in texts if t is not None]) == 8
    assert ND.one_of_each(none).count() == 0


def test_one_of_each_keeps_the_least_id(spark):
    rows = [(5, "a b c d e f g"), (2, "A b c d e f g"), (9, "h i j k l m n"), (3, None)]
    kept = ND.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 9]


def test_repeats_that_are_not_shared_hide_no_pair(spark):
    """96 shared shingles and a line of 20 words, 200 times in one copy: a plain similarity of 0.8 or a little more."""
    rows = []
    for i in range(40):
        base = " ".join(f"w{i}x{k}" for k in range(100))
        rows += [(2 * i, base), (2 * i + 1, base + (" " + " ".join(f"n{i}x{k}" for k in range(20))) * 200)]
    expected = brute(rows)
    assert all(expected[2 * i + 1] == 2 * i for i in range(40))
    assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == expected
