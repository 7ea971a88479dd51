"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample of the vectors (``most_sample``, lowest hashes of their ids) with spherical
k-means, ``branching`` children a node. Every vector descends to a leaf. Leaves that then hold more than PART rows are split again, on samples of
their own rows of the same bound together, until none does or the tree has ``most_leaves`` leaves. A query visits leaves best bin first: a priority queue holds
the nodes next to the path so far by the cosine of their centres. How many leaves a query visits is
calibrated: ``calibration`` queries are searched by brute force over all rows, and visits are widened until the leaves visited hold
``recall`` of what they should find. Within a leaf the search is exact, in double precision.

Identical vectors are searched once: as candidates only the k + 1 smallest ids of a batch's equal vectors can count, and equal queries
share a search for k + 1. Leaves are searched in shards of bounded size, at least some for each core; a leaf with still more rows is split by hash. A shard's
rows are copied only where more than QUERIES queries come to that shard, once for each so many.

Rows take no part whose id is null or whose vector is null, of another length than most (which has no cosine with the others), zero, or holds null or non-finite
components. Vectors are scaled by a power of two first, so that no finite component overflows; cosines stay the same. Of rows with one id the one with the least bytes counts; a query's own id is never its neighbour. An empty table gives no rows. Only the
two named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, release

#: Most rows of a shard: what one search takes.
PART = 8192
#: Queries of a block: each block of a shard's queries is searched by itself.
QUERIES = 20_000
_CLOSE = 1e-9


class Tree:
    """centres: one unit vector a node; children: a list a node, empty at leaves; leaf: the leaf's number or -1."""

    def __init__(self, x: np.ndarray, leaf_rows: int, branching: int, seed: int = 11):
        self.rng, self.branching = np.random.default_rng(seed), branching
        self.children: list[list[int]] = [[]]
        self.centres = _unit(x.mean(0, keepdims=True)) if len(x) else np.zeros((1, x.shape[1]))
        self.grow({0: x}, leaf_rows)

    def grow(self, rows: dict[int, np.ndarray], leaf_rows: int) -> bool:
        """Split leaf nodes by samples of their rows; whether any was."""
        centres, todo = list(self.centres), list(rows.items())
        while todo:
            node, own = todo.pop()
            label = _kmeans(own, min(self.branching, -(-len(own) // leaf_rows)), self.rng) if len(own) > leaf_rows else np.zeros(len(own), int)
            parts = [own[label == c] for c in np.unique(label)]
            if len(parts) < 2:
                continue
            for part in parts:
                self.children[node].append(len(centres))
                todo.append((len(centres), part))
                centres.append(_unit(part.mean(0, keepdims=True))[0])
                self.children.append([])
        grown = len(centres) > len(self.centres)
        self.centres = np.array(centres)
        self.leaves = [n for n, c in enumerate(self.children) if not c]
        self.leaf = [-1] * len(centres)
        for i, n in enumerate(self.leaves):
            self.leaf[n] = i
        self.n_leaves = len(self.leaves)
        return grown

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf numbers of unit vectors."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            best = np.argmax(x[rows] @ self.centres[kids].T, axis=1)
            todo += [(kid, rows[best == i]) for i, kid in enumerate(kids) if (best == i).any()]
        return out

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while kids := self.children[node]:
                near = self.centres[kids] @ q
                best = int(np.argmax(near))
                for i, kid in enumerate(kids):
                    if i != best:
                        heapq.heappush(queue, (-float(near[i]), kid))
                node = kids[best]
            yield self.leaf[node]


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        label = np.argmax(x @ centres.T, axis=1)
        for c in np.unique(label):
            centres[c] = x[label == c].mean(0)
        centres = _unit(centres)
    return np.argmax(x @ centres.T, axis=1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in an order of operations that doesn't depend on the other rows, so that equal vectors tie."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def nearest(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, seen: Callable[[slice], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, ids, scores): the k nearest rows by score, ties to the smaller id. seen, if given, tells for a slice of queries which rows count."""
    unit = _unit(rows)
    for a in range(0, len(queries), 256):
        block = queries[a : a + 256]
        rough = _unit(block) @ unit.T
        if seen is not None:
            rough[~seen(slice(a, a + 256))] = -np.inf
        least = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(block), -np.inf)
        for i in range(len(block)):
            at = np.flatnonzero((rough[i] >= least[i] - _CLOSE) & (rough[i] > -np.inf))
            score = cosine(np.broadcast_to(block[i], (len(at), block.shape[1])), rows[at])
            order = np.lexsort((ids[at], -score))[:k]
            yield a + i, ids[at][order], score[order]


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def valid_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id LONG, v ARRAY<DOUBLE>: the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual.n if usual else 0))


def _packed(rows: DataFrame, keep: int) -> DataFrame:
    """v as bytes, scaled by a power of two to a largest magnitude of 0.5 to 1; of equal vectors in a batch only the ``keep`` smallest ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, seen, at = b.column(0).to_numpy(), {}, []
            x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), "<f8").reshape(len(ids), -1)
            x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]).astype("<f8")
            raw = [r.tobytes() for r in x]
            for i in np.argsort(ids, kind="stable"):
                mine = seen.setdefault(raw[i], set())
                if len(mine) < keep and ids[i] not in mine:
                    mine.add(ids[i])
                    at.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([raw[i] for i in at], pa.binary())], ["id", "v"])

    return rows.mapInArrow(work, "id long, v binary")


def search(
    df: DataFrame, every: int = 50, k: int = 5, recall: float = 0.97, most_sample: int = 20_000, leaf_rows: int = 256, branching: int = 12,
    most_leaves: int = 65_536, calibration: int = 256, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by ``every``."""
    spark = df.sparkSession
    rows = valid_vectors(df, vec_id, embedding)
    n = rows.count()
    share = min(1.0, most_sample / max(n, 1))
    low = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)
    fitted = [r.v for r in _packed(rows.where(low), 1 << 30).select("v").limit(most_sample * 2).collect()]
    fitted = _unit(_matrix(fitted)) if fitted else np.zeros((0, 1))
    # leaves of about leaf_rows rows, down to 16 rows of the sample
    tree = Tree(fitted, max(16, int(leaf_rows * share)), branching)
    single = _packed(rows, k + 1).groupBy("id").agg(F.min("v").alias("v"))
    while True:
        shared = spark.sparkContext.broadcast(tree)

        def to_leaf(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    leaf = shared.value.assign(_unit(_matrix(b.column(1).to_pylist())))
                    yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), b.column(0), b.column(1)], ["leaf", "id", "v"])

        placed = materialise(single.mapInArrow(to_leaf, "leaf int, id long, v binary"))
        sizes = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}  # at most most_leaves and one splitting
        large = {leaf: c for leaf, c in sizes.items() if c > PART}
        if not large or tree.n_leaves >= most_leaves:
            break
        rate = min(1.0, most_sample / sum(large.values()))
        some = F.pmod(F.xxhash64("id", F.lit(tree.n_leaves)), F.lit(1 << 20)) < int(rate * (1 << 20)) + (rate == 1.0)
        own: dict[int, list[bytes]] = {}
        for r in placed.join(F.broadcast(spark.createDataFrame([(x,) for x in large], "leaf int")), "leaf").where(some).select("leaf", "v").limit(most_sample * 2).collect():
            own.setdefault(tree.leaves[r.leaf], []).append(bytes(r.v))
        if not tree.grow({node: _unit(_matrix(v)) for node, v in own.items()}, max(16, int(leaf_rows * rate))):
            break  # equal vectors
        release(placed)
    # leaves go into shards of up to PART rows, less where cores would idle; a leaf of more rows is spread over shards of its own
    part = max(leaf_rows, min(PART, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    shards: dict[int, tuple[int, int]] = {}
    last, room = -1, 0
    for leaf, n_rows in sorted(sizes.items()):
        n_parts = -(-n_rows // part)
        if n_rows > room:
            last, room = last + n_parts, part if n_parts == 1 else 0
            shards[leaf] = (last - n_parts + 1, n_parts)
        else:
            shards[leaf] = (last, 1)
        room -= n_rows

    raw = _packed(rows.where(F.pmod(F.col("id"), F.lit(every)) == 0), 1 << 30)
    asked = materialise(raw.groupBy("id").agg(F.min("v").alias("v")))
    once = asked.groupBy("v").agg(F.min("id").alias("query"))

    # how far to go: brute force for a few queries over all rows, in blocks
    few = sorted((r.query, bytes(r.v)) for r in once.orderBy(F.xxhash64("query")).limit(calibration).collect())
    visits = tree.n_leaves
    if few:
        asked_few = spark.sparkContext.broadcast((np.array([f[0] for f in few]), _matrix([f[1] for f in few])))

        def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, q = asked_few.value
            for b in batches:
                if not b.num_rows:
                    continue
                leaf, ids, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2).to_pylist())
                place = {i: p for p, i in enumerate(ids.tolist())}
                got = [(int(own[i]), int(j), float(s), int(leaf[place[j]])) for i, js, ss in nearest(q, ids, x, k + 1) for j, s in zip(js.tolist(), ss) if j != own[i]]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got)], ["query", "id", "score", "leaf"])

        first = W.partitionBy("query").orderBy(F.desc("score"), "id")
        true = placed.mapInArrow(brute, "query long, id long, score double, leaf long").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
        want: dict[int, list[int]] = {}
        for r in true.select("query", "leaf").collect():  # k rows for each of the few
            want.setdefault(r.query, []).append(r.leaf)
        depth = np.zeros(tree.n_leaves + 1)
        for (query, _), v in zip(few, _unit(asked_few.value[1])):
            turn = {leaf: i for i, leaf in enumerate(tree.visit(v), 1)}
            for leaf in want.get(query, ()):
                depth[turn[leaf]] += 1
        visits = max(1, int(np.searchsorted(np.cumsum(depth), recall * depth.sum())))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, leaves, who = [], [], []
            for i, v in enumerate(_unit(_matrix(b.column(0).to_pylist())) if b.num_rows else ()):
                mine: dict[int, list[int]] = {}
                for leaf in islice(shared.value.visit(v), visits):
                    first, n_parts = shards.get(leaf, (0, 0))
                    for s in range(first, first + n_parts):
                        mine.setdefault(s, []).append(leaf)
                shard += mine.keys()
                leaves += mine.values()
                who += [i] * len(mine)
            if who:
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(leaves, pa.list_(pa.int32())), b.column(1).take(pa.array(who)), b.column(0).take(pa.array(who))], ["shard", "leaves", "query", "v"])

    going = materialise(once.select("v", "query").mapInArrow(spread, "shard int, leaves array<int>, query long, v binary"))
    # shards that more than QUERIES queries visit: at most all visits / QUERIES
    busy = [(r.shard, -(-r["count"] // QUERIES)) for r in going.groupBy("shard").count().where(F.col("count") > QUERIES).collect()]
    blocks = F.broadcast(spark.createDataFrame(busy, "shard int, n_blocks int"))
    n_blocks = F.coalesce("n_blocks", F.lit(1))
    going = going.join(blocks, "shard", "left").withColumn("block", F.pmod(F.xxhash64("query"), n_blocks).cast("int")).drop("n_blocks")
    table = spark.createDataFrame([(leaf, *x) for leaf, x in shards.items()] or [(0, 0, 1)], "leaf int, first int, n int")
    there = placed.join(F.broadcast(table), "leaf").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    there = there.join(blocks, "shard", "left").select("shard", "leaf", "id", "v", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"))

    def within(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(left) and len(right):
            own, leaf = left.column("query").to_numpy(), right.column("leaf").to_numpy()
            here = np.unique(leaf)
            visited = np.zeros((len(left), len(here)), bool)
            for i, leaves in enumerate(left.column("leaves").to_pylist()):
                visited[i, np.searchsorted(here, leaves)] = True
            place = np.searchsorted(here, leaf)
            seen = lambda block: visited[block][:, place]
            found = [(np.full(len(i), own[q]), i, s) for q, i, s in nearest(_matrix(left.column("v").to_pylist()), right.column("id").to_numpy(), _matrix(right.column("v").to_pylist()), k + 1, seen)]
        cols = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    met = going.groupBy("shard", "block").cogroup(there.groupBy("shard", "block")).applyInArrow(within, "query long, id long, score double")
    met = met.groupBy("query", "id").agg(F.max("score").alias("score"))
    best = met.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1)
    found = asked.withColumnRenamed("id", "query_id").join(once, "v").select("query_id", "query").join(best, "query").where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.select("query_id", rank.alias("rank"), F.col("id").alias("vec_id"), "score").where(F.col("rank") <= k)
