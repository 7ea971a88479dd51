"""Substring dedup by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of a document. Its minimiser is the least of its hashed word pairs; consecutive
windows that share a minimiser travel as one packed string to the minimiser's bucket, where sorting brings equal windows
together and the least id of each is found. Hashes only order: equality is always checked word by word.

Hot data: pairs that make up ``1 / HOT_SHARE`` of all pairs or more are counted first, over all documents, and rank last as
minimisers. So a window holds a hot one only if all its pairs are hot, and such windows, as those of copies, are
told apart from their like within a task's run of documents, which sends each window once, for its least id. What a bucket gets
so grows with the number of runs and not with the number of copies.

Words are judged on the input. Null text has no words. Null ids come after all others and remove nothing from each other, as rows with
equal ids don't. Repeated rows have equal results. An empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialise

WINDOW, PAIR = 13, 2
HOT_SHARE = 8000
#: Bytes of text in a run, and windows of words that a bucket gets.
RUN_BYTES = 8_000_000
BUCKET_WORDS = 400_000
#: Buckets a task gets, on average.
TASK_BUCKETS = 4
LAST_ID = (1 << 63) - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts in order, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    full = pc.not_equal(flat, "")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[np.cumsum(sizes)] if len(sizes) else np.zeros(0, np.int64)
    return flat.filter(full), np.diff(ends, prepend=0)


def _coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _hashed(dictionary: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, dictionary.to_pylist()), np.uint64, len(dictionary))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of word pairs, below 2**63."""
    return _mixed(h[:-1] * _A + h[1:]) >> np.uint64(1)


def _rolled(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of every run of WINDOW values."""
    n = len(h) - WINDOW + 1
    out = np.full(n, seed, np.uint64)
    for j in range(WINDOW):
        out = (out + h[j : j + n]) * _A
        out ^= out >> np.uint64(31)
    return out


def _equal(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the windows that start at a and at b have the same words."""
    same = np.ones(len(a), bool)
    for j in range(WINDOW):
        same &= codes[a + j] == codes[b + j]
    return same


def _classes(codes: np.ndarray, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """starts, sorted so that equal windows stand together in the order given, and the places where a class begins."""
    seed = 0
    while True:
        key = _rolled(h, seed)[starts]
        order = np.argsort(key, kind="stable")
        at, key = starts[order], key[order]
        near = key[1:] == key[:-1]
        if _equal(codes, at[1:][near], at[:-1][near]).all():
            return at, np.flatnonzero(np.concatenate([[True], ~near])) if len(at) else np.zeros(0, np.int64)
        seed += 1  # two windows with one hash: try another


def _runs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about RUN_BYTES of text (column 1); a longer text is a slice."""
    size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).cumsum() if b.num_rows else np.zeros(0)
    a = 0
    while a < b.num_rows:
        c = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + RUN_BYTES, "right")))
        yield b.slice(a, c - a)
        a = c


def hot_pairs(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The pairs with at least 1 / HOT_SHARE of all pairs (so at most HOT_SHARE of them), and the number of words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run in _runs(b):
                flat, sizes = _words(run.column(1))
                codes, dictionary = _coded(flat)
                h = _hashed(dictionary)[codes]
                doc = np.repeat(np.arange(len(sizes)), sizes)
                pairs = _pairs(h)[doc[1:] == doc[:-1]] if len(h) > 1 else np.zeros(0, np.uint64)
                key, n = np.unique(pairs, return_counts=True)
                many = n >= max(2, len(pairs) / HOT_SHARE)
                out = [*key[many].astype(np.int64).tolist(), -1], [*n[many].tolist(), len(h)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["pair", "n"])

    counts = materialise(docs.mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    total = counts.where(F.col("pair") == -1).first()
    words = total.n if total else 0
    hot = counts.where((F.col("pair") >= 0) & (F.col("n") >= max(2.0, words / HOT_SHARE))).select("pair").collect()
    return np.sort(np.array([r.pair for r in hot], np.uint64)), words


def super_kmers(hot: np.ndarray, n_buckets: int):
    """Documents (id, text, key) -> (bucket, packed super-k-mers), or (n_buckets + some number, spans decided already)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run in _runs(b):
                if rows := list(_split(run.take(pc.sort_indices(run.column(0))), hot, n_buckets)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "packed"])

    return work


def _split(run: pa.RecordBatch, hot: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    flat, sizes = _words(run.column(1))
    ids, keys = run.column(0).to_numpy(), run.column(2).to_numpy()
    doc = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    if len(flat) < WINDOW:
        return
    codes, dictionary = _coded(flat)
    h = _hashed(dictionary)[codes]
    n = len(h) - WINDOW + 1
    whole = doc[WINDOW - 1 :] == doc[:n]
    # windows that an earlier document of the run has are decided here
    at, first = _classes(codes, h, np.flatnonzero(whole))
    lead = np.repeat(at[first], np.diff(np.append(first, len(at))))
    gone = np.zeros(n, bool)
    gone[at] = ids[doc[at]] > ids[doc[lead]]
    yield from _decided(gone, ids, keys, doc, begin, n_buckets)

    rank = _pairs(h)
    rank |= np.isin(rank, hot).astype(np.uint64) << np.uint64(63)
    low, span = rank, 1
    while span * 2 <= WINDOW - PAIR + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[WINDOW - PAIR + 1 - span :][:n])  # least pair of each window
    sent = whole & ~gone
    starts = np.flatnonzero(sent & ~np.concatenate([[False], sent[:-1] & (low[1:] == low[:-1]) & (doc[1:n] == doc[: n - 1])]))
    if not len(starts):
        return
    stop = np.flatnonzero(sent & ~np.concatenate([sent[1:] & (low[1:] == low[:-1]) & (doc[1:n] == doc[: n - 1]), [False]]))
    length = stop - starts + WINDOW
    bucket = ((low[starts] & np.uint64((1 << 63) - 1)) % np.uint64(n_buckets)).astype(np.int64)
    text = pc.binary_join(pa.array([flat.to_pylist()], pa.list_(pa.string())), " ")[0].as_py().encode()
    offset = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
    order = np.argsort(bucket, kind="stable")
    starts, length, bucket = starts[order], length[order], bucket[order]
    lo, hi = offset[starts].tolist(), (offset[starts + length] - 1).tolist()
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    pack = zstandard.ZstdCompressor(level=3).compress
    for a, c in zip(edges[:-1].tolist(), edges[1:].tolist()):
        s = starts[a:c]
        head = np.array([ids[doc[s]], keys[doc[s]], s - begin[s], length[a:c]], "<i8")
        words = b" ".join([text[x:y] for x, y in zip(lo[a:c], hi[a:c])])
        yield int(bucket[a]), pack((c - a).to_bytes(8, "little") + head.tobytes() + words)


def _spans(flags: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of flags; a run ends where cuts is set at the next place."""
    joined = flags[1:] & flags[:-1] & ~cuts[1:]
    return np.flatnonzero(flags & ~np.concatenate([[False], joined])), np.flatnonzero(flags & ~np.concatenate([joined, [False]]))


def _decided(gone: np.ndarray, ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, begin: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    a, c = _spans(gone, np.diff(doc[: len(gone)], prepend=-1) != 0)
    to = keys[doc[a]] % n_buckets
    for t in np.unique(to).tolist():
        at = to == t
        x, y = a[at], c[at]
        yield n_buckets + t, zstandard.compress(np.array([ids[doc[x]], keys[doc[x]], x - begin[x], y - begin[x] + WINDOW], "<i8").tobytes())


def repeated_spans(n_buckets: int):
    """A bucket's packed super-k-mers -> spans of words (id, key, lo, hi) to remove."""

    def out(ids, keys, lo, hi) -> pa.Table:
        return pa.table({"id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        blobs = [zstandard.decompress(x) for x in rows.column("packed").to_pylist()]
        if key[0].as_py() >= n_buckets:
            return out(*np.hstack([np.frombuffer(x, "<i8").reshape(4, -1) for x in blobs]))
        heads, words = [], []
        for x in blobs:
            n = int.from_bytes(x[:8], "little")
            heads.append(np.frombuffer(x, "<i8", 4 * n, 8).reshape(4, -1))
            words.append(x[8 + 32 * n :].decode())
        del blobs
        ids, keys, starts, lengths = np.hstack(heads)
        codes, dictionary = _coded(pc.split_pattern(pa.array(words, pa.large_string()), " ").flatten())
        h = _mixed(np.arange(1, len(dictionary) + 1, dtype=np.uint64) * _A)[codes]
        doc = np.repeat(np.arange(len(ids)), lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        open_ = place <= lengths[doc] - WINDOW
        at, first = _classes(codes, h, np.flatnonzero(open_))
        least = np.repeat(np.minimum.reduceat(ids[doc[at]], first), np.diff(np.append(first, len(at)))) if len(at) else at
        gone = np.zeros(len(codes), bool)
        gone[at] = ids[doc[at]] > least
        a, c = _spans(gone, place == 0)
        d = doc[a]
        return out(ids[d], keys[d], starts[d] + place[a], starts[d] + place[c] + WINDOW)

    return work


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) -> id, n_words, n_removed, kept text."""
    for b in batches:
        rows = []
        for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            words = WORD.findall(t or "")
            if spans:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [s["lo"] for s in spans], 1)
                np.add.at(edge, [s["hi"] for s in spans], -1)
                keep = np.cumsum(edge[:-1]) == 0
                kept = [w for w, k in zip(words, keep.tolist()) if k]
            else:
                kept = words
            rows.append((len(words), len(words) - len(kept), " ".join(kept)))
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: one row per document, without words that a smaller id's document has in a window."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = rows.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "text", F.xxhash64("text").alias("key"))
    hot, words = hot_pairs(keyed)
    n_buckets = max(64, -(-words // BUCKET_WORDS))
    sent = keyed.mapInArrow(super_kmers(hot, n_buckets), "bucket int, packed binary")
    # partitions grow in number with the buckets, so a task gets some of them whatever the input
    sent = sent.repartition(-(-n_buckets // TASK_BUCKETS), "bucket")
    spans = sent.groupBy("bucket").applyInArrow(repeated_spans(n_buckets), "id long, key long, lo long, hi long")
    per_doc = spans.groupBy("id", "key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # at most a document's words
    both = rows.withColumn("id", F.coalesce("doc_id", F.lit(LAST_ID))).withColumn("key", F.xxhash64("text")).join(per_doc, ["id", "key"], "left")
    return both.select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")
