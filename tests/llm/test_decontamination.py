from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from medlar.llm import decontamination as D

ITEM = "Then Tom has 3.5 apples, and Mary Ann Smith bought 12 km of rope for 1,000 dollars. How many apples does old Tom have?"


def found(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in D.decontamination_matches(docs, items).collect()}


def test_template(spark):
    df = spark.createDataFrame([(ITEM,)], "t string")
    row = df.select(D.template(F.col("t")).alias("a"), D.template(F.col("t"), values=True).alias("b")).first()
    assert row["a"][:11] == ["then", "@", "has", "#", "apples", "and", "@", "bought", "#", "%", "of"]
    assert row["b"][3] == "#3.5"
    assert row["b"][9] == "%km"
    assert len(row["a"]) == len(row["b"])
    df = spark.createDataFrame([("Twenty-five men, one hundred thousand 3/4 cups and Bone stones",)], "t string")
    row = df.select(D.template(F.col("t")).alias("a"), D.template(F.col("t"), values=True).alias("b")).first()
    assert row["a"] == ["#", "men", "#", "#", "%", "and", "@", "stones"]
    assert row["b"] == ["#twenty", "men", "#one", "#3/4", "%cups", "and", "@bone", "stones"]


@pytest.mark.parametrize("piece", ["Les ", "!", "1,", "one ", "1.", "-", "5 km ", "a", "A", "é", "@", "# ", "Ab Cd. "])
def test_long_runs(spark, piece):
    df = spark.createDataFrame([("x Y " + piece * 100_000 + " z",)], "t string")
    row = df.select(F.size(D.template(F.col("t"))).alias("a"), F.size(D.template(F.col("t"), values=True)).alias("b")).first()
    assert row["a"] == row["b"] > 0


def test_new_numbers_and_names_are_caught_if_consistent(spark):
    assert set(found(spark, [(1, "A train leaves the old town at seven and runs thirty miles in two hours.")], [(1, "A train leaves the old town at nine and runs 45 miles in three hours.")])) == {(1, 1)}
    other = "x y. Then Bob has 7 apples, and Eve bought 4 miles of rope for 30 euros. How many apples does old {} have? z"
    got = found(spark, [(1, ITEM), (2, other.format("Bob")), (3, other.format("Carl")), (4, "Nothing of this kind is in here at all, as far as one can see.")], [(10, ITEM)])
    assert set(got) == {(1, 10), (2, 10)}
    assert got[(2, 10)]["slots"] >= 5


def test_a_number_in_two_roles_may_become_two(spark):
    form = "A farmer sells {} apples and {} pears at the old market, gives {} to {} and walks home with {} again."
    items = [(1, form.format(2, 2, 5, "Tom", "Tom"))]
    whole = "So it is. " + form.format(30, 51, 7, "Eve", "Eve") + " That was it."
    part = "So it is. A farmer sells 30 apples and 51 pears at the old market, then all is over."
    other = form.format(30, 51, 7, "Eve", "Bob")
    got = found(spark, [(1, whole), (2, part), (3, other)], items)
    assert set(got) == {(1, 1)}
    assert got[(1, 1)]["windows"] == got[(1, 1)]["item_windows"]
    assert got[(1, 1)]["consistent"] < D.CONSISTENT


def test_placeholders_alone_are_no_evidence(spark):
    assert found(spark, [(1, "1 2 3 4 5 6 7 8 9 10 11 12")], [(1, "9 8 7 6 5 4 3 2 1 0 1 2"), (2, "one two"), (3, None), (4, "")]) == {}


def test_short_items_match_whole(spark):
    got = found(spark, [(1, "so alpha beta gamma delta epsilon it goes"), (2, "alpha beta gamma delta"), (None, "Alpha, beta; gamma: delta epsilon!")], [(7, "alpha beta gamma delta epsilon")])
    assert set(got) == {(1, 7), (None, 7)}


def test_edges(spark, edge, none):
    items = spark.createDataFrame([(1, "zwei drei vier fünf sechs sieben acht neun zehn elf"), (1, "zwei drei vier fünf sechs sieben acht neun zehn elf")], "item_id long, text string")
    got = D.decontamination_matches(edge, items).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 9]
    assert D.decontamination_matches(none, items).count() == 0
    assert D.decontamination_matches(edge, items.limit(0)).count() == 0
    kept = D.without_contaminated(edge, items)
    assert kept.count() == edge.count() - 2
    assert kept.columns == edge.columns


def test_items_of_one_template_are_one_class(spark):
    form = "A farmer has {} sheep and buys {} more at the market in the town of {}, then sells {} of all these to the neighbours."
    items = [(i, form.format(i + 3, 2 * i + 1, f"Place{chr(97 + i % 26)}", i + 5)) for i in range(1_000)] + [(5_000, form.format(7, 7, "Lund", 9))]
    classes = D.template_classes(spark.createDataFrame(items, "item_id long, text string"))
    sizes = {r["class_item"]: r["count"] for r in classes.groupBy("class_item").count().collect()}
    assert sum(sizes.values()) == 1_001
    assert len(sizes) < 10
    docs = [(d, f"So {d}. " + form.format(d + 50, 900 + d, "Ystad", 4)) for d in range(20)]
    got = spark.createDataFrame(docs, "doc_id long, text string")
    rows = D.decontamination_matches(got, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"] for r in rows} == set(range(20))
    assert len(rows) <= 20 * len(sizes)
    assert max(r["items"] for r in rows) == max(sizes.values())


def test_recall_of_reparameterised_questions(spark):
    """Questions with other numbers and names, planted in other text; half have a name at a sentence's start."""
    rng = random.Random(5)
    words = [a + b for a in ("ban", "cor", "del", "fin", "gar", "hol", "jun", "kel", "lom", "mar") for b in ("ta", "ric", "do", "sel", "um", "ig", "en", "va", "os", "ly")]
    names = [w.capitalize() for w in ("anna", "bob", "carl", "dora", "emil", "frida", "georg", "hanna")]

    def question(form, numbers, own):
        return " ".join(str(numbers[w]) if isinstance(w, int) else own[w[1]] if isinstance(w, tuple) else w for w in form) + "."

    items, docs = [], []
    for i in range(200):
        form = [rng.choice(words) for _ in range(rng.randrange(14, 40))]
        for k in range(3):
            form[rng.randrange(2, len(form))] = k
        form[rng.randrange(4, len(form))] = ("name", 0)
        form[0] = ("name", 0) if i % 2 else form[0].capitalize() if isinstance(form[0], str) else "The"
        items.append((i, question(form, [rng.randrange(10, 99) for _ in range(3)], [rng.choice(names)])))
        docs.append((i, " ".join(rng.choices(words, k=50)) + ". " + question(form, [rng.randrange(100, 999) for _ in range(3)], [rng.choice(names)]) + " " + " ".join(rng.choices(words, k=50))))
        docs.append((1_000 + i, " ".join(rng.choices(words, k=150))))
    rows = D.decontamination_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    caught = {(r["doc_id"], r["item_id"]) for r in rows}
    assert all(d == i for d, i in caught)
    assert len(caught) >= 0.9 * 200


def test_against_brute_force(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")

    def words(text):
        return re.findall(r"[^\W\d_]+", text.lower())

    index = defaultdict(set)
    for r in items.collect():
        w = words(r["text"])
        for k in range(len(w) - 9):
            index[tuple(w[k : k + 10])].add(r["item_id"])
    expected = set()
    for r in documents.collect():
        w = words(r["text"])
        for k in range(len(w) - 9):
            expected |= {(r["doc_id"], i) for i in index.get(tuple(w[k : k + 10]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in D.decontamination_matches(documents, items).collect()}
    assert expected
    assert got == expected
