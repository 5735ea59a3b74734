"""The pipeline's rows against a plain version of its stages, one after another, on a small table."""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from test_near_duplicates import LOWER, brute
from test_shards_and_mix import seats_by_hand

from medlar.llm import mixing, toxicity

FOLDER = "/root/testdata/sf0.01"


def words_of(text):
    return re.findall(r"[a-z\u0080-\U0010ffff]+", text.translate(LOWER))


def plain_scorer(model, single, double):
    """A function from a text to its score, from counts of texts by class and word, and by class and pair; only share,
    order and curve are the model's."""
    d, vocabulary = toxicity.DISCOUNT, set(single[0]) | set(single[1])
    spread = len(single[0]) + len(single[1])
    own = lambda w: max((w in single[0]) + (w in single[1]) - d, 0) / spread
    rest = (1 - math.fsum(map(own, vocabulary))) / (len(vocabulary) + 1)
    totals = [sum(x.values()) for x in single]
    left = [1 - math.fsum(max(n - d, 0) for n in x.values()) / t for x, t in zip(single, totals, strict=True)]
    after = [defaultdict(dict), defaultdict(dict)]
    for c in (0, 1):
        for (v, w), n in double[c].items():
            after[c][v][w] = n

    def unigram(c, w):
        return max(single[c][w] - d, 0) / totals[c] + left[c] * (own(w) + rest)

    @functools.cache
    def kept(c, v):
        often = [w for w in set(after[0][v]) | set(after[1][v]) if after[0][v].get(w, 0) + after[1][v].get(w, 0) >= toxicity.PAIR_TEXTS]
        total = max(sum(after[c][v].values()), 1)
        return {w: max(after[c][v].get(w, 0) - d, 0) / total for w in often}

    def bigram(c, v, w):
        return kept(c, v).get(w, 0) + (1 - sum(kept(c, v).values())) * unigram(c, w)

    def score(text):
        words = words_of(text)
        seen = set(words) if model.order == 1 else set(zip(["", *words], words, strict=False))
        both = [(unigram(0, e), unigram(1, e)) if model.order == 1 else (bigram(0, *e), bigram(1, *e)) for e in seen]
        evidence = math.fsum(math.log(model.share * y + (1 - model.share) * x) - math.log(x) for x, y in both) / max(len(seen), 1)
        return 1 / (1 + math.exp(-(model.slope * evidence + model.offset)))

    return score


def plain_targets(sizes, weights, most):
    """Shares by weight; a source above its limit is held there and the others share the rest again."""
    held = {}
    while True:
        free = sum(sizes) - sum(held.values())
        share = sum(w for i, w in enumerate(weights) if i not in held)
        over = {i: float(most * sizes[i]) for i in range(len(sizes)) if i not in held and weights[i] * free / share > most * sizes[i]}
        if not over:
            return [held.get(i, weights[i] * free / share if share else 0.0) for i in range(len(sizes))]
        held |= over


def plain_copies(rows):
    """How often the mix takes each of the rows (doc_id, text, source): those whose first word it takes."""
    groups = defaultdict(list)
    for i, text, source in rows:
        n = len(re.findall(r"[^ \t-\r]+", text))
        groups[source].append((hashlib.md5(f"{mixing.SEED}:{i}:{text}".encode()).hexdigest(), n, i))
    names = sorted(groups)
    sizes = [sum(n for _, n, _ in groups[s]) for s in names]
    targets = plain_targets(sizes, [mixing.WEIGHTS[k % 3] for k in range(len(names))], mixing.MOST)
    seats = seats_by_hand(targets, -(-sum(sizes) // mixing.BLOCK))
    copies = {}
    for name, size, seat in zip(names, sizes, seats, strict=True):
        passes, extra = divmod(min(seat * mixing.BLOCK, size * mixing.MOST), size) if size else (0, 0)
        start = 0
        for _, n, i in sorted(groups[name]):
            copies[i] = passes + (start < extra)
            start += n
    return copies


def plain_contaminated(text, index):
    words = re.findall(r"[^\W\d_]+", text.lower())
    return any(tuple(words[k : k + 10]) in index for k in range(len(words) - 9))


@pytest.fixture(scope="module")
def whole(spark):
    import corpus_pipeline

    return corpus_pipeline.run(spark, FOLDER).select("doc_id", "text", "source", "shard", "slot").collect()


def test_rows_are_those_of_plain_stages(spark, whole):
    docs, labels, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = toxicity.fit(docs, labels).value
    sample = docs.join(labels.where("toxic IS NOT NULL"), "doc_id").selectExpr("text", "toxic", "pmod(xxhash64(18, text), 5) = 0 AS held").collect()
    toxic = defaultdict(int)
    for r in sample:
        if not r["held"]:
            toxic[r["text"]] = max(toxic[r["text"]], r["toxic"])
    single, double = (Counter(), Counter()), (Counter(), Counter())
    for text, c in toxic.items():
        words = words_of(text)
        single[c].update(set(words))
        double[c].update(set(zip(["", *words], words, strict=False)))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]

    score = plain_scorer(model, single, double)
    clean = [r for r in rows if score(r[1]) < 0.5]
    assert len(clean) < len(rows)
    first = brute([r[:2] for r in clean])
    single_rows = [r for r in clean if first[r[0]] == r[0]]
    assert len(single_rows) < len(clean)
    index = set()
    for r in items.collect():
        words = re.findall(r"[^\W\d_]+", r["text"].lower())
        index |= {tuple(words[k : k + 10]) for k in range(len(words) - 9)}
    apart = [r for r in single_rows if not plain_contaminated(r[1], index)]
    assert len(apart) < len(single_rows)
    copies = plain_copies(apart)
    expected = Counter({r: copies[r[0]] for r in apart})
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in whole) == +expected


def test_shards_are_level_and_gapless(whole):
    slots = defaultdict(list)
    for r in whole:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(8))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
