"""N-gram Jaccard join by MinHash banding.

1. A document's set of ``N``-word shingles gives a digest and BANDS x ROWS minimum hashes. Documents with one digest have one set and make
   a node, so copies are joined by a group-by and never paired.
2. Bands are hashed; nodes that share a band meet in its bucket. A bucket is told to its members by its least node, the anchor.
   Every two nodes of a bucket so share an anchor.
3. The texts of an anchor's nodes meet in blocks of BLOCK by BLOCK nodes, where every pair's full shingle sets are intersected as a
   product of 0/1 matrices. A pair that shares several anchors counts at the least. A block tells each node how many documents
   it links to and the least node of its part; no pair leaves a block as a row.
4. Parts are joined into classes by least labels, with pointer jumping, to the end.

At a Jaccard similarity of exactly 0.8 a pair is missed with probability (1 - 0.8**6)**24 = 0.0007, at 0.85 with 5e-6. Shingles
are compared by 64-bit hashes. Texts of one to N - 1 words have one shingle, all their words. Texts without words, null or not, are
in no group and link to nothing. Null ids come after all others; repeated rows are copies of each other. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, hot_join, materialise, release, tidy

N, BANDS, ROWS, BLOCK = 5, 24, 6, 1024
LAST_ID = (1 << 63) - 1
_A = np.uint64(0x9E3779B97F4A7C15)
_RUN = 600_000
#: Anchors of several blocks up to which their table is broadcast; a row has some 40 bytes.
BROADCAST_ANCHORS = 100_000


class _Hashes(dict):
    """Word -> 64-bit hash; keeps a bounded number."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 150_000:
            self[word] = h
        return h


_HASHES = _Hashes()


def forget() -> None:
    _HASHES.clear()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = WORD.findall(text)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = min(N, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = _mixed(out * _A + h[j : j + len(out)])
    return np.unique(out)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(23)
    return rng.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def band_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS hashes for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = np.empty((BANDS * ROWS, len(sets)), np.uint64)
    for k, (a, b) in enumerate(zip(*_seeds())):
        low[k] = np.minimum.reduceat((flat ^ b) * a, starts)
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(sets), band, np.uint64)
        for r in range(ROWS):
            h = _mixed(h * _A + low[band * ROWS + r])
        out[:, band] = h
    return out


@tidy(forget)
def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, text) -> (id, key, node, bands); texts without words are left out."""
    names = ["id", "key", "node", "bands"]
    for b in batches:
        at, sets, held = [], [], 0

        def out(b=b) -> pa.RecordBatch:
            node = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            bands = pa.array(list(band_hashes(sets).view(np.int64)), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(node, pa.binary()), bands], names)

        for i, t in enumerate(b.column(2).to_pylist()):
            s = shingles(t or "")
            if len(s):
                at.append(i)
                sets.append(s)
                held += len(s)
            if held > _RUN:
                yield out()
                at, sets, held = [], [], 0
        if at:
            yield out()


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = times[col] > 1
    row, col = row[many], (np.cumsum(times > 1) - 1)[col[many]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n), np.float32)
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        x, y = np.searchsorted(col, [a, a + 4096])
        block = np.zeros((n, min(4096, int(col[-1]) + 1 - a)), np.float32)
        block[row[x:y], col[x:y] - a] = 1
        out += block @ block.T  # whole numbers below 2**24: exact
    out = out.astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _block(similarity: float):
    """The nodes of one (anchor, i, j) -> (node, links, low): links to documents, and the least node of its part."""

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        anchor, i, j = (k.as_py() for k in key)
        first: dict[bytes, int] = {}
        for p, node in enumerate(rows.column("node").to_pylist()):
            first.setdefault(node, p)
        rows = rows.take(pa.array(list(first.values())))
        nodes, n = list(first), len(first)
        empty = pa.table({"node": pa.array([], pa.binary()), "links": pa.array([], pa.int64()), "low": pa.array([], pa.binary())})
        if n < 2:
            return empty
        sets = [shingles(t) for t in rows.column("text").to_pylist()]
        size = np.array([len(s) for s in sets])
        both = common_counts(sets)
        linked = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(linked, False)
        part = np.array(rows.column("block").to_pylist())
        if i != j:
            linked &= part[:, None] != part[None, :]
        if not linked.any():
            return empty
        smaller: dict[bytes, int] = {}
        at = [(p, smaller.setdefault(a, len(smaller))) for p, own in enumerate(rows.column("anchors").to_pylist()) for a in own if a < anchor]
        mine = linked
        if at:
            member = np.zeros((n, len(smaller)), np.float32)
            member[tuple(np.array(at).T)] = 1
            mine = linked & (member @ member.T == 0)  # other pairs count at a smaller anchor
        links = mine @ np.array(rows.column("copies").to_pylist(), np.int64)
        order = np.empty(n, np.int64)
        order[sorted(range(n), key=lambda p: (rows.column("id")[p].as_py(), nodes[p]))] = np.arange(n)
        by_order = np.argsort(order)
        low = order
        while True:
            near = np.minimum(low, np.where(linked, low[None, :], n).min(1))
            if (near == low).all():
                break
            low = near
        told = np.flatnonzero(linked.any(1))
        return pa.table({"node": pa.array([nodes[p] for p in told], pa.binary()), "links": pa.array(links[told]), "low": pa.array([nodes[by_order[low[p]]] for p in told], pa.binary())})

    return work


def join_parts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (node, low), nodes (node, id) -> (node, low): the least node, by id, of every node's component. A round's table goes when the next one is written."""
    both = materialise(edges.union(edges.select("low", "node")).where(F.col("node") != F.col("low")).distinct())
    rank = F.struct("id", "node")
    step = materialise(nodes.join(both.select("node").distinct(), "node", "left_semi").select("node", rank.alias("new"), rank.alias("low")))
    while True:
        labels = step.select("node", F.col("new").alias("low"))
        near = both.join(labels.select(F.col("node").alias("low"), F.col("low").alias("best")), "low").groupBy("node").agg(F.min("best").alias("best"))
        told = labels.join(near, "node").select("node", F.least("low", "best").alias("new"), "low")
        jump = labels.select(F.col("node").alias("at"), F.col("low").alias("further"))
        old, step = step, materialise(told.join(jump, F.col("new.node") == F.col("at")).select("node", F.least("new", "further").alias("new"), "low"))
        release(old)
        if not step.where(F.col("new.node") != F.col("low.node")).limit(1).count():
            release(both)
            return step.select("node", F.col("new.node").alias("low"))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key, class_id (the least id of its class), n_links (other documents at least so similar), keeps.

    keeps marks the document that stays of its class; equal rows (id and text) are marked alike. Bands, anchors and nodes that hold many rows are told by
    broadcast (hot_join), so the join on them is even; an anchor's blocks are dealt one by one.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).cast("string").alias("text"))
    signed = materialise(rows.mapInArrow(signatures, "id long, key long, node binary, bands array<long>"))
    nodes = materialise(signed.groupBy("node").agg(F.min(F.struct("id", "key")).alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands")).select("node", "least.*", "copies", "bands"))

    banded = nodes.select("node", "id", F.explode("bands").alias("band"))
    met = materialise(banded.groupBy("band").agg(F.min(F.struct("id", "node"))["node"].alias("anchor"), F.count("*").alias("n")).where(F.col("n") > 1))
    stars = hot_join(banded, met, "band", "n").select("node", "anchor").distinct()
    stars = materialise(stars.groupBy("node").agg(F.collect_set("anchor").alias("anchors")))  # at most BANDS each
    release(met)
    asked = stars.join(nodes.drop("bands"), "node")
    asked = asked.join(rows, ["id", "key"]).select("node", "id", "copies", "text", "anchors", F.explode("anchors").alias("anchor"))
    # only anchors of several blocks are told to their nodes; groups of (anchor, i, j) are dealt by all three
    large = stars.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = materialise(large.select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("n_blocks")))
    side = F.broadcast(large) if large.limit(BROADCAST_ANCHORS + 1).count() <= BROADCAST_ANCHORS else large
    asked = asked.join(side, "anchor", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    asked = asked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    asked = asked.select("node", "id", "copies", "text", "anchors", "anchor", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    told = materialise(asked.groupBy("anchor", "i", "j").applyInArrow(_block(similarity), "node binary, links long, low binary"))

    labels = join_parts(told.select("node", "low"), nodes.select("node", "id"))
    links = told.groupBy("node").agg(F.sum("links").alias("links"))
    least = nodes.select(F.col("node").alias("low"), F.col("id").alias("class"), F.col("key").alias("class_key"))
    info = nodes.select("node", "id", "key", "copies").join(labels, "node", "left").join(links, "node", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    info = materialise(info.select("node", F.coalesce("low", "node").alias("low"), n_links, "copies").join(least, "low").select("node", "class", "class_key", "n_links", "copies"))
    with_words = hot_join(signed.select("id", "key", "node"), info, "node", "copies").select("id", "key", "class", "class_key", "n_links")
    without = rows.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select("id", "key", F.col("id").alias("class"), F.col("key").alias("class_key"), F.lit(0).cast("long").alias("n_links"))
    real = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    keeps = (F.col("id") == F.col("class")) & (F.col("key") == F.col("class_key"))
    return with_words.union(without).select(real("id").alias("doc_id"), F.col("key").alias("text_key"), real("class").alias("class_id"), "n_links", keeps.alias("keeps"))


def keep_one(docs: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with one row of each class: the least id's; of rows equal in id and text the one whose whole row has the least hash. Texts without words all stay, but equal rows once. An empty table stays empty."""
    kept = near_duplicates(docs, similarity, doc_id, text).where("keeps").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_text"))
    met = keyed.join(kept, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_key")))
    return met.groupBy("_doc", "_key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
