"""Nearest vectors by inner product: a hierarchical navigable small-world graph per shard, results merged.

Equal vectors are one entry with the ids of its copies. Entries are dealt to shards by hash; a shard draws a geometric
level for each entry, links each entry on each of its levels, and stores the graph as flat arrays of neighbours in one
row. A quarter of an entry's places is for diverse entries of near direction, a quarter for those of largest inner product
with it, which lead to the entries of large norm that answer most queries, and the rest for entries that chose it. A
search walks down the levels with a small beam and over the lowest with one whose width a shard finds by itself: the
least of a doubling series that finds enough of the true neighbours of a fixed number of its own entries. A shard's graph
is read once, by the partition that all queries pass through. Scores are inner products of the original components in
double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medlar.llm.shared import cut

NEAREST = 20
#: Entries of a shard, at most about; shards there are at least.
SHARD_ROWS = 32_768
SHARDS = 8
#: Neighbours above the lowest level and on it, and candidates that each half of the chosen ones comes from.
LINKS = 16
LOW_LINKS = 32
CHOICE = 64
#: Least width of the search, share of true neighbours that a shard wants to find, and entries that it tries this on.
WIDTH = 64
FOUND = 0.97
TRIED = 256
#: Width of the walks on higher levels, entries that they hand down, and entries of a beam that are opened together.
HIGH_WIDTH = 16
HANDED = 8
OPENED = 4
#: Queries that walk a graph together.
QUERY_BLOCK = 512
SEED = 8


def _nearest_of_all(x: np.ndarray, y: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """For each row of ``x`` the k rows of ``y`` of largest inner product, that of the same place left out, best first."""
    out = np.empty((len(x), k), np.int32)
    for a in range(0, len(x), block):
        near = x[a : a + block] @ y.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        part = np.argpartition(-near, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable")
        out[a : a + block] = np.take_along_axis(part, order, 1)
    return out


def _choose_diverse(unit: np.ndarray, near: np.ndarray, chosen: np.ndarray, places: int) -> None:
    """Fill ``places`` of ``chosen``: a candidate is taken if no chosen one is nearer to it than the row that chooses."""
    filled = np.zeros(len(near), int)
    close = np.empty(near.shape, np.float32)
    for a in range(0, len(near), 4096):
        close[a : a + 4096] = np.einsum("nd,nkd->nk", unit[a : a + 4096], unit[near[a : a + 4096]])
    for j in range(near.shape[1]):
        room = np.flatnonzero(filled < places)
        if not len(room):
            break
        candidate, among = near[room, j], chosen[room, :places]
        between = np.einsum("nd,nkd->nk", unit[candidate], unit[np.maximum(among, 0)])
        blocked = ((between > close[room, j][:, None]) & (among >= 0)).any(1)
        free = room[~blocked]
        chosen[free, filled[free]] = near[free, j]
        filled[free] += 1


def _fill(chosen: np.ndarray, near: np.ndarray, places: int) -> None:
    """Fill ``chosen`` up to ``places`` with the nearest that it doesn't have yet."""
    filled = (chosen >= 0).sum(1)
    for j in range(near.shape[1]):
        room = np.flatnonzero(filled < places)
        if not len(room):
            break
        new = room[~(chosen[room] == near[room, j][:, None]).any(1)]
        chosen[new, filled[new]] = near[new, j]
        filled[new] += 1


def _level_graph(x: np.ndarray, links: int) -> np.ndarray:
    """Neighbours of each row, -1 for none: a quarter of the places for diverse rows of near direction, a quarter for rows
    of large inner product, the rest for those that chose the row and then for the nearest in direction again."""
    n = len(x)
    chosen = np.full((n, links), -1, np.int32)
    if n < 2:
        return chosen
    k = min(CHOICE, n - 1)
    unit = (x / np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None]).astype(np.float32)
    near = _nearest_of_all(unit, unit, k)
    _choose_diverse(unit, near, chosen, links // 4)
    _fill(chosen, _nearest_of_all(unit, x.astype(np.float32), k), links // 2)
    source, place = np.nonzero(chosen >= 0)
    target = chosen[source, place]
    mutual = (chosen[target] == source[:, None]).any(1)
    source, place, target = source[~mutual], place[~mutual], target[~mutual]
    order = np.lexsort((place, target))
    into, back = target[order], source[order]
    turn = np.arange(len(into)) - np.searchsorted(into, into)
    spot = (chosen >= 0).sum(1)[into] + turn
    fits = spot < links
    chosen[into[fits], spot[fits]] = back[fits]
    _fill(chosen, near, links)
    return chosen


class Graph:
    """The graph of one shard: on each level the places of its ``members`` and each one's neighbours, by number within the
    level. The lowest level has all entries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = SEED):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        draw = np.random.default_rng(seed).random(len(ids))
        height = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int)
        self.members = [np.flatnonzero(height >= level).astype(np.int32) for level in range(int(height.max(initial=0)) + 1)]
        self.links = [_level_graph(self.vectors[m], LOW_LINKS if level == 0 else LINKS) for level, m in enumerate(self.members)]
        self.width = WIDTH
        self._find_width()

    def _find_width(self, k: int = NEAREST) -> None:
        """Double the width until the walks of TRIED entries, spread evenly, find enough of their k nearest."""
        q = self.vectors[np.linspace(0, max(len(self.ids) - 1, 0), min(TRIED, len(self.ids)), dtype=int)]
        k = min(k, len(self.ids))
        value = q @ self.vectors.T
        least = -np.partition(-value, k - 1, axis=1)[:, k - 1]
        while self.width < len(self.ids):
            place, found = self.search(q, k)
            if ((found >= least[:, None]) & (place >= 0)).sum() >= FOUND * k * len(q):
                break
            self.width *= 2

    def pack(self) -> bytes:
        """Flat arrays behind one another, with their lengths in front."""
        head = [self.vectors.itemsize, self.width, len(self.ids), self.vectors.shape[1], len(self.members), *(len(m) for m in self.members)]
        parts = [np.array([len(head), *head], np.int64), self.ids.astype(np.int64), self.vectors]
        return b"".join(p.tobytes() for p in [*parts, *self.members, *self.links])

    @classmethod
    def unpack(cls, packed: bytes) -> Graph:
        self, at = cls.__new__(cls), 0

        def take(n: int, kind: type) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(packed, kind, n, at)
            at += got.nbytes
            return got

        wide, self.width, n, size, _, *sizes = (int(i) for i in take(int(take(1, np.int64)[0]), np.int64))
        self.ids, self.vectors = take(n, np.int64), take(n * size, np.float32 if wide == 4 else np.float64).reshape(n, size)
        self.members = [take(m, np.int32) for m in sizes]
        self.links = [take(m * (LOW_LINKS if i == 0 else LINKS), np.int32).reshape(m, -1) for i, m in enumerate(sizes)]
        return self

    def _walk(self, level: int, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(number within the level, inner product) of the best entries that a beam of ``width`` reaches from ``start``; -1
        for none. In a turn each query opens the best few of its beam that aren't open yet."""
        members, links = self.members[level], self.links[level]
        width = max(min(width, len(members)), start.shape[1])
        opened = min(OPENED, width)
        rows, columns = np.nonzero(start >= 0)
        place = np.full((len(q), width), -1, np.int64)
        value = np.full((len(q), width), -np.inf, q.dtype)
        place[rows, columns] = start[rows, columns]
        value[rows, columns] = np.einsum("nd,nd->n", q[rows], self.vectors[members[start[rows, columns]]])
        done = place < 0
        claimed = np.zeros((len(q), len(members)), np.int32)
        claimed[rows, start[rows, columns]] = 1
        while True:
            open_value = np.where(done, -np.inf, value)
            j = np.argpartition(-open_value, opened - 1, axis=1)[:, :opened]
            live = np.take_along_axis(open_value, j, 1) > -np.inf
            active = np.flatnonzero(live.any(1))
            if not len(active):
                return place, value
            j, live = j[active], live[active]
            node = np.where(live, place[active[:, None], j], -1)
            done[active[:, None], j] = True
            near = np.where((node >= 0)[:, :, None], links[np.maximum(node, 0)], -1).reshape(len(active), -1)
            r, c = np.nonzero((near >= 0) & (claimed[active[:, None], np.maximum(near, 0)] == 0))
            mark = np.arange(1, len(r) + 1, dtype=np.int32)
            claimed[active[r], near[r, c]] = mark  # of entries that several opened ones lead to, one stays
            own = claimed[active[r], near[r, c]] == mark
            r, c = r[own], c[own]
            found = np.full(near.shape, -np.inf, q.dtype)
            found[r, c] = np.einsum("nd,nd->n", q[active[r]], self.vectors[members[near[r, c]]])
            fresh = found > -np.inf
            all_value = np.concatenate([value[active], found], 1)
            all_place = np.concatenate([place[active], np.where(fresh, near, -1)], 1)
            all_done = np.concatenate([done[active], ~fresh], 1)
            keep = np.argpartition(-all_value, width - 1, axis=1)[:, :width]
            value[active], place[active], done[active] = (np.take_along_axis(z, keep, 1) for z in (all_value, all_place, all_done))

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, inner product) of about the k best entries of each query and more; place -1 where there are fewer."""
        q = queries.astype(self.vectors.dtype)
        top = len(self.members) - 1
        start = np.tile(np.arange(min(len(self.members[top]), HIGH_WIDTH)), (len(q), 1))
        for level in range(top, 0, -1):
            place, value = self._walk(level, q, start, HIGH_WIDTH)
            best = np.take_along_axis(place, np.argsort(-value, axis=1, kind="stable")[:, :HANDED], 1)
            below = np.searchsorted(self.members[level - 1], self.members[level][np.maximum(best, 0)])
            start = np.where(best >= 0, below, -1)
        return self._walk(0, q, start, max(self.width, k))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return np.asarray(col.flatten()).astype(np.float64).reshape(len(col), width)


def nearest_by_inner_product(vectors: DataFrame, every: int = 20, k: int = NEAREST, shard_rows: int = SHARD_ROWS, least_shards: int = SHARDS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that are found of all other rows, for rows with vec_id divisible by
    ``every``; ties by vec_id.

    ``vectors`` needs vec_id (integer) and embedding (array of numbers). Rows take no part whose id or vector is null,
    whose vector is empty, zero, holds null or non-finite components, or has another length than most. Every other row is
    indexed. Of rows with the same id any may stand for it. An empty table gives an empty result.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    exact = np.float32 if kind == "array<float>" else np.float64
    whole = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    fit = whole.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    widths = fit.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    width = widths["w"] if widths else 0
    normal = F.transform("v", lambda x: x + F.lit(0.0).cast(kind[6:-1]))  # -0.0 is 0.0
    fit = cut(fit.where(F.size("v") == width).select("id", normal.alias("v")).withColumn("h", F.xxhash64("v")))

    entries = fit.groupBy("h").agg(F.min("id").alias("entry"))
    copies = fit.join(entries, "h").select("entry", "id")
    # the first k + 1 ids of an entry are enough: ties go to the smaller id and only the query itself is left out
    salted = copies.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for by in (["entry", "salt"], ["entry"]):
        salted = salted.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("r") <= k + 1)
    copies = cut(salted.select("entry", "id"))
    items = cut(fit.join(entries.select(F.col("entry").alias("id")), "id").select(F.col("id").alias("entry"), "v", "h").dropDuplicates(["entry"]))

    shards = max(least_shards, -(-items.count() // shard_rows))
    dealt = items.select(F.pmod(F.xxhash64("entry"), F.lit(shards)).cast("int").alias("shard"), "entry", "v")

    def build(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(pieces)
        rows = pa.Table.from_batches(held) if held else None
        if rows is None or not len(rows):
            return
        shard = rows["shard"].to_numpy()
        for s in np.unique(shard):
            own = rows.filter(pa.array(shard == s)).combine_chunks()
            graph = Graph(own["entry"].to_numpy(), _matrix(own["v"].chunk(0), width).astype(exact))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([graph.pack()], pa.binary())], ["shard", "graph"])

    index = cut(dealt.repartitionById(shards, F.col("shard")).mapInArrow(build, "shard int, graph binary"))

    asked = fit.where(F.col("id") % every == 0).select("h", F.col("id").alias("query_id"))
    queries = asked.select("h").distinct().join(entries, "h").join(items.select("entry", "v"), "entry").select("entry", "v")
    queries = cut(queries)
    nothing = F.lit(None)
    questions = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "entry", "v", nothing.cast("binary").alias("graph"))
    graphs = index.select("shard", nothing.cast("long").alias("entry"), nothing.cast(kind).alias("v"), "graph")
    told = "asker long, entry long, score double"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for batch in batches:
            packed = batch.column("graph").drop_null()
            graph = Graph.unpack(packed[0].as_py()) if len(packed) else graph
            asks = batch.filter(batch.column("entry").is_valid())
            if graph is None or not asks.num_rows:
                continue
            names, q = asks.column("entry").to_numpy(), _matrix(asks.column("v"), width)
            for a in range(0, len(q), QUERY_BLOCK):
                place, _ = graph.search(q[a : a + QUERY_BLOCK], k + 1)
                r, c = np.nonzero(place >= 0)
                p = place[r, c]
                score = np.einsum("nd,nd->n", q[a + r], graph.vectors[p].astype(np.float64))
                order = np.lexsort((graph.ids[p], -score, r))
                r, p, score = r[order], p[order], score[order]
                first = np.arange(len(r)) - np.searchsorted(r, r) <= k
                yield pa.RecordBatch.from_arrays([pa.array(names[a + r[first]]), pa.array(graph.ids[p[first]]), pa.array(score[first])], ["asker", "entry", "score"])

    # a shard is a partition: its graph comes first and stays while the queries pass
    met = questions.union(graphs).repartitionById(shards, F.col("shard")).sortWithinPartitions(F.col("graph").isNull()).mapInArrow(walk, told)
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "entry"))).where(F.col("r") <= k + 1).drop("r")
    # ids for entries, then queries for askers; an asker's own ids may be among them
    named = best.join(copies, "entry").select("asker", F.col("id").alias("vec_id"), "score")
    place = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id"))
    named = named.withColumn("r", place).where(F.col("r") <= k + 1).drop("r")
    lists = cut(named.groupBy("asker").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("list")))
    answers = asked.join(entries.withColumnRenamed("entry", "asker"), "h").join(lists, "asker")
    own = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    answers = answers.select("query_id", F.posexplode(own).alias("p", "x"))
    return answers.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
