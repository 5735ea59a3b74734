"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text's elements are its distinct shingles of five words, all of weight 1. Every element is a Poisson process whose
arrivals, faster for heavier elements, each fall on a random register; a register keeps the element that comes first.
Two texts agree on a register with the probability of their probability Jaccard similarity, which with equal weights is
the plain one: weights by count would let what only one text repeats hide a pair that is to be linked. Arrivals are made in order
of time and stop as soon as none can come first any more. Bands of registers give buckets of candidates, and candidates
are linked if the plain Jaccard similarity of their shingle sets, counted exactly, reaches the threshold. Classes are
the connected components of links and exact copies.

Work is bounded everywhere: copies collapse before anything else, buckets with the same members are looked at once, and
a bucket above BLOCK members is dealt into blocks that are compared within themselves and with the bucket's hubs; what
is still apart after that is compared with every block. Where that is many, the bucket is first split by rare shingles:
two similar texts share one among the rarest of each, so no link of the threshold is lost, and texts that only have common
passages in common don't meet. A task returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlar.llm.shared import cut, free_name, hashed_words, mix64, narrow

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 20
ROWS = 4
#: Most members of a block, and hubs that each block of a larger bucket is compared with.
BLOCK = 256
HUBS = 8
#: Blocks of members that are apart from which on a bucket is split by rare shingles: every member would be dealt as often.
SPLIT = 64
#: Texts with more copies than this, and than a share of all rows, get their class by broadcast: so many at most.
COPIES = 256
MOST_COPIED = 500_000
#: Links from which both sides of a graph's joins are dealt anew, so that adaptive execution can split a hub's.
MANY_LINKS = 2_000_000

_U = np.uint64
_STEPS = np.array([pow(0xD1342543DE82EF95, k + 1, 2**64) for k in range(SHINGLE)], dtype=_U)


def shingle_sets(counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of each distinct shingle, by text and shingle, from the hashes of the texts' words.

    A text of fewer words than a shingle has one, of all its words; a text without words has none.
    """
    begin = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(counts)), counts)
    size = np.minimum(counts, SHINGLE)
    left = begin[1:][owner] - np.arange(len(words))  # words from here to the text's end
    first = left >= size[owner]
    total = np.zeros(len(words), _U)
    for k in range(SHINGLE):
        n = len(words) - k
        if n <= 0:
            break
        inside = k < size[owner[:n]]
        total[:n] += np.where(inside, words[k:] * _STEPS[k], _U(0))
    text, shingle = owner[first], mix64(total[first])
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    return text[at], shingle[at], np.ones(len(at))


def whole_hashes(counts: np.ndarray, words: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each text's sequence of words."""
    begin = np.concatenate([[0], np.cumsum(counts)])
    place = (np.arange(len(words)) - np.repeat(begin[:-1], counts)).astype(_U)
    mixed = mix64(words * _STEPS[salt] + mix64(place + _STEPS[salt + 2]))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mixed)])
    return mix64(sums[begin[1:]] - sums[begin[:-1]] + counts.astype(_U))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def registers(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """ProbMinHash: the element that comes first on each of m registers, one row per text; 0 for a text without any."""
    out = np.zeros((texts, m), _U)
    mass = np.bincount(text, weight, texts)
    todo = mass > 0
    spare = 3.0
    while todo.any():
        horizon = np.where(todo, m * (math.log(m) + spare) / np.maximum(mass, 1e-300), 0)
        first = np.full(texts * m, np.inf)
        alive = np.flatnonzero(todo[text])
        time = np.zeros(len(alive))
        turn = 0
        won: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(alive):
            turn += 1
            h = mix64(element[alive] + _U((turn * 0x9E3779B97F4A7C15) % 2**64))
            time = time - np.log(_uniform(h)) / weight[alive]
            owner = text[alive]
            still = time < horizon[owner]
            alive, time, owner, h = alive[still], time[still], owner[still], h[still]
            slot = owner * m + (mix64(h ^ _U(0xA5A5A5A5A5A5A5A5)) % _U(m)).astype(np.int64)
            np.minimum.at(first, slot, time)
            ahead = time <= first[slot]
            won.append((slot[ahead], time[ahead], element[alive[ahead]]))
            if turn % 4 == 0:  # nothing that comes after the last register's first arrival counts
                horizon = np.minimum(horizon, first.reshape(texts, m).max(1))
        filled = np.isfinite(first.reshape(texts, m)).all(1)
        slot, time, value = (np.concatenate(x) for x in zip(*won, strict=True))
        best = (time == first[slot]) & (filled & todo)[slot // m]
        out.reshape(-1)[slot[best]] = value[best]
        todo &= ~filled
        spare *= 2
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, two hashes of the text's words and the keys of its bands, for each text that isn't null."""
    for batch in batches:
        ids, col = batch.column(0), batch.column(1)
        ids, col = ids.filter(col.is_valid()), col.filter(col.is_valid())
        for a, b, counts, words in hashed_words(col):
            whole = [whole_hashes(counts, words, salt).view(np.int64) for salt in (0, 1)]
            sig = registers(*shingle_sets(counts, words), b - a, BANDS * ROWS).reshape(b - a, BANDS, ROWS)
            key = np.tile(np.arange(1, BANDS + 1, dtype=_U), (b - a, 1))
            for k in range(ROWS):
                key = mix64(key * _U(0x9FB21C651E98DF25) + sig[:, :, k])
            has = np.where(counts > 0, BANDS, 0)
            offsets = np.concatenate([[0], np.cumsum(has)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[counts > 0].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(whole[0]), pa.array(whole[1]), bands], ["id", "node", "check", "bands"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node and its sorted shingles, packed, where the text is the node's: ids may repeat."""
    for batch in batches:
        for a, b, counts, words in hashed_words(batch.column(1)):
            own = pa.array(whole_hashes(counts, words, 0).view(np.int64) == batch.column(0).slice(a, b - a).to_numpy())
            text, shingle, _ = shingle_sets(counts, words)
            at = np.searchsorted(text, np.arange(b - a + 1))
            packed = [shingle[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).filter(own), pa.array(packed, pa.binary()).filter(own)], ["node", "shingles"])


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a member: bucket, node, size, shingle."""
    for batch in batches:
        packed = batch.column("shingles")
        size = np.array([len(x) // 8 for x in packed.to_pylist()])
        each = np.concatenate([np.frombuffer(x, np.int64) for x in packed.to_pylist()] or [np.zeros(0, np.int64)])
        columns = [pa.array(np.repeat(batch.column(c).to_numpy(), size)) for c in ("bucket", "node")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(size, size)), pa.array(each)], ["bucket", "node", "size", "shingle"])


class _Group:
    """Members of one block with their shingles as small integers."""

    def __init__(self, packed: list[bytes]):
        sets = [np.frombuffer(x, _U) for x in packed]
        self.size = np.array([len(x) for x in sets])
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        values, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.flag = np.zeros(len(values), bool)

    def similar(self, i: int, start: int, threshold: float) -> np.ndarray:
        """Members from ``start`` on whose Jaccard similarity to member i reaches the threshold."""
        own = self.ids[self.at[i] : self.at[i + 1]]
        self.flag[own] = True
        hits = np.concatenate([[0], np.cumsum(self.flag[self.ids[self.at[start] :]])])
        both = np.diff(hits[self.at[start:] - self.at[start]])
        self.flag[own] = False
        return start + np.flatnonzero(both >= threshold * (self.size[i] + self.size[start:] - both) - 1e-9)


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _forest(nodes: list[int], lone: list[bool], labels: list[int] | None, packed: list[bytes], threshold: float) -> tuple[list[int], list[int]]:
    """Links that connect what is similar: without labels, of every member to the least one of its part. With labels, only
    pairs of a lone member and one of another label count."""
    group, n = _Group(packed), len(nodes)
    parent = list(range(n))
    if labels is not None:
        seen: dict[int, int] = {}
        for i, x in enumerate(labels):
            parent[i] = _root(parent, seen.setdefault(x, i))
    us, vs = [], []
    for i in range(n):
        if labels is not None and not lone[i]:
            continue
        for j in group.similar(i, i + 1 if labels is None else 0, threshold):
            a, b = _root(parent, i), _root(parent, int(j))
            if a != b:
                parent[b] = a
                us.append(nodes[i])
                vs.append(nodes[j])
    if labels is None and us:
        parts: dict[int, list[int]] = {}
        for i, node in enumerate(nodes):
            parts.setdefault(_root(parent, i), []).append(node)
        pairs = [(x, least) for part in parts.values() for least in [min(part)] for x in part if x != least]
        us, vs = [u for u, _ in pairs], [v for _, v in pairs]
    return us, vs


def _verifier(threshold: float, labelled: bool):
    """A function for partitions sorted by bucket and blocks: the links of each group of rows with equal keys."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> pa.RecordBatch:
            nodes, lone, labels, packed = (list(x) for x in zip(*held, strict=True))
            us, vs = _forest(nodes, lone, labels if labelled else None, packed, threshold)
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "part")), strict=True))
            rows = zip(*(batch.column(c).to_pylist() for c in ("node", "lone", "label", "shingles")), strict=True)
            for k, row in zip(keys, rows, strict=True):
                if k != key:
                    if len(held) > 1:
                        yield links()
                    key, held = k, []
                held.append(row)
        if len(held) > 1:
            yield links()

    return verify


def _few(df: DataFrame, rows: int) -> DataFrame:
    """The same rows in as many partitions as their number asks for, at most as many as there are."""
    return df.coalesce(max(8, rows // 100_000))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of an edge list (u, v): root is the least node of its component.

    Alternating large-star and small-star steps: every round is joins and sums that shrink, and the number of rounds
    grows with the logarithm of the components' diameter.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == last or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last, n = state, state[0]
        anew = cut if n > MANY_LINKS else lambda df: df
        both = _few(edges, n).union(_few(edges.select(F.col("v").alias("u"), F.col("u").alias("v")), n))
        least = anew(_few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n))
        large = _few(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), n)
        large = _few(large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct(), n)
        low = anew(_few(large.groupBy("u").agg(F.min("v").alias("m")), n))
        small = _few(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), n)
        edges = cut(_few(small.union(low.select("u", F.col("m").alias("v"))).distinct(), n))


def _ident(docs: DataFrame) -> Column:
    """The id, whole numbers as long."""
    return F.col("doc_id").cast("long") if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "void") else F.col("doc_id")


def _with_shingles(members: DataFrame, docs: DataFrame, spots: DataFrame) -> DataFrame:
    """Members with their shingles; ``spots`` says which document has a node's text."""
    spots = narrow(cut(spots.join(members.select("node").distinct(), "node", "left_semi")))
    texts = docs.select(_ident(docs).alias("id"), "text").join(spots, "id").select("node", "text")
    return members.join(texts.mapInArrow(_shingles, "node long, shingles binary"), "node")


def _by_rare_shingles(apart: DataFrame, docs: DataFrame, spots: DataFrame, threshold: float) -> DataFrame:
    """The members (bucket, n, node, label, main, k) of large buckets, dealt anew to smaller ones: a member goes where each of
    its rarest shingles is, as many as two similar texts can't all differ in. Rarity is by the bucket's members."""
    each = _with_shingles(apart.select("bucket", "node"), docs, spots).select("bucket", "node", "shingles")
    each = each.mapInArrow(_each_shingle, "bucket long, node long, size long, shingle long")
    times = each.groupBy("bucket", "shingle").agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy("bucket", "node").orderBy("times", "shingle"))
    first = each.join(times, ["bucket", "shingle"]).withColumn("place", place)
    first = first.where((F.col("place") <= F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1) & (F.col("times") > 1))
    dealt = cut(first.select("bucket", "node", F.xxhash64("bucket", "shingle").alias("part")).join(apart.select("bucket", "node", "label", "main"), ["bucket", "node"]))
    lone = F.sum(F.when(F.col("label") != F.col("main"), 1).otherwise(0))
    mark = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"), lone.alias("k"), *mark, F.min("label").alias("low"), F.max("label").alias("high"))
    parts = parts.where("low <> high AND k > 0").groupBy("n", "k", "x", "y").agg(F.min("part").alias("part"))
    return dealt.join(parts.select("part", "n", "k"), "part").select(F.col("part").alias("bucket"), "n", "node", "label", "main", "k")


def _links(members: DataFrame, threshold: float, labelled: bool) -> DataFrame:
    keys = ["bucket", "block", "part"]
    dealt = members.select(*keys, "node", "lone", "label", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_verifier(threshold, labelled), "u long, v long")


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) for each row of ``docs``, which needs doc_id (whole numbers come back as long) and text; class_id is
    the least id.

    Words are separated by ASCII white space and compared without regard to ASCII case. Texts of the same words are
    copies; a text without words is a copy of the others without. A null text has its own id as its class. Rows with
    a null id keep it and join the class of their text, if that has another row with an id, else their class is null.
    An empty table gives an empty result. Nodes of the graph are 64-bit hashes of whole texts.
    """
    ident = _ident(docs)
    kind = docs.select(ident.alias("id")).schema["id"].dataType.simpleString()
    marked = cut(docs.select(ident.alias("id"), "text").mapInArrow(_signatures, f"id {kind}, node long, check long, bands array<long>"))
    texts = marked.groupBy("node", "check").agg(F.min("id").alias("least"), F.count("*").alias("copies"))

    rows = cut(marked.select(F.explode("bands").alias("bucket"), "node").distinct())
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    buckets = buckets.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members = cut(rows.join(buckets, "bucket"))

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    spread = F.pmod(F.xxhash64("node", "bucket"), blocks).cast("int")
    plain = [F.lit(0).alias("part"), "node", F.lit(False).alias("lone"), F.lit(0).cast("long").alias("label")]
    first = members.select("bucket", spread.alias("block"), *plain)
    huge = members.where(F.col("n") > BLOCK)
    some = not huge.isEmpty()
    if some:
        weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
        salt = F.pmod(F.xxhash64("node"), F.lit(HUBS))
        hubs = huge.join(weight, "node").groupBy("bucket", "n", salt.alias("salt")).agg(F.max(F.struct("weight", "node")).alias("hub"))
        hubs = hubs.select("bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("hub.node").alias("node"))
        first = first.union(hubs.select("bucket", "block", *plain)).distinct()
    spots = texts.where("least IS NOT NULL").select("node", F.col("least").alias("id"))
    links = cut(_links(_with_shingles(first, docs, spots), threshold, False))
    found = components(links)

    if some:  # members of large buckets that are outside the bucket's largest component meet all others of it
        at = huge.join(found, "node", "left").select("bucket", "n", "node", F.coalesce("root", "node").alias("label"))
        at = cut(at)
        sizes = at.groupBy("bucket", "label").agg(F.count("*").alias("of"))
        main = sizes.groupBy("bucket").agg(F.max(F.struct("of", "label")).alias("main"), F.sum("of").alias("all")).where("main.of < all")
        apart = at.join(main.select("bucket", F.col("main.label").alias("main"), (F.col("all") - F.col("main.of")).alias("k")), "bucket")
        wide = apart.where(F.col("k") > SPLIT * BLOCK)
        if not wide.isEmpty():
            apart = apart.where(F.col("k") <= SPLIT * BLOCK).unionByName(_by_rare_shingles(wide, docs, spots, threshold))
        apart = cut(apart)
        parts = F.ceil(F.col("k") / BLOCK).cast("int")
        lone = apart.where("label <> main").select("bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.pmod(F.xxhash64("bucket", "node"), parts).cast("int").alias("part"), "node", F.lit(True).alias("lone"), "label")
        rest = apart.select("bucket", spread.alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "node", F.lit(False).alias("lone"), "label")
        more = lone.union(rest)
        links = links.union(_links(_with_shingles(cut(more), docs, spots), threshold, True))
        found = components(links)

    linked = cut(found.union(found.select(F.col("root").alias("node"), "root").distinct()).join(texts.drop("copies"), "node"))
    least = cut(linked.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("of")))
    total = marked.count()
    classes = _join_heavy(linked, least, ["root"], F.col("of") > max(COPIES, total // MOST_COPIED)).select("node", "check", "class_id")
    classes = cut(texts.join(classes, ["node", "check"], "left").select("node", "check", "copies", F.coalesce("class_id", "least").alias("class_id")))
    known = _join_heavy(marked.select(F.col("id").alias("doc_id"), "node", "check"), classes, ["node", "check"], F.col("copies") > max(COPIES, total // MOST_COPIED)).select("doc_id", "class_id")
    return known.union(docs.where("text IS NULL").select(ident.alias("doc_id"), ident.alias("class_id")))


def _join_heavy(rows: DataFrame, table: DataFrame, key: list[str], heavy: Column) -> DataFrame:
    """``rows`` joined with a table of one row a key, all of which are there. Keys that are ``heavy`` have so many rows that
    there are few of them: they are broadcast, and no task gets all rows of one."""
    few = F.broadcast(table.where(heavy))
    rest = rows.join(few.select(*key), key, "left_anti").join(table.where(~heavy), key)
    return rows.join(few, key).unionByName(rest)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the one with the least id stays, and every row with a
    null text. Where ids are null or repeat, a hash of id and text stands for the id, and of equal rows one stays."""
    ident = _ident(docs)
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        return _without(docs, ident, near_duplicate_classes(docs, threshold))
    ident = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text"))
    kept = _without(docs, ident, near_duplicate_classes(docs.select(ident.alias("doc_id"), "text"), threshold))
    name = free_name(docs, "__ident")
    whole = kept.where("text IS NOT NULL").withColumn(name, ident).dropDuplicates([name]).drop(name)
    return whole.union(kept.where("text IS NULL"))


def _without(docs: DataFrame, ident: Column, classes: DataFrame) -> DataFrame:
    name = free_name(docs, "__more")
    more = cut(classes.where("doc_id <> class_id").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(narrow(more), ident == F.col(name), "left_anti")


#: All pairs of documents with a shingle in common, and the closure of links: for small tables only.
ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8 * (nx.n + ny.n - c)
), reach AS (
  SELECT x, y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x
)
SELECT d.doc_id, least(d.doc_id, coalesce(min(reach.y), d.doc_id)) AS class_id FROM documents d LEFT JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id
"""
