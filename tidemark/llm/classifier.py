"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Every hash bucket of words has a sparse ternary index vector. A word's vector is the sum of the index vectors of the words
within ``WINDOW`` places of it, over all documents of the corpus; sums are integers, so reruns agree. Shapes of words (case, digits,
punctuation, length, equal to the word before) have vectors of their own, made likewise. A document is the means of its words' and shapes' vectors, their
norms, and its log length. The network learns quality from at most ``most_labelled`` labelled documents, those whose id's hash is
lowest; a fifth of these sets the temperature that calibrates its probabilities. Labels, language, source and id are no inputs.

Documents whose crc32(id as text) is divisible by 5 are held out, so are null ids. Null text is an empty text and gets a score as any
text does. Repeated rows get the same score. Labels that are null don't count; of several labels of an id the mean counts, of several documents of an id one. Without
labels of both classes every score is the share of class 1, or 0.5 without any. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, tidy

WORDS, SHAPES, DIM, WINDOW, NONZERO = 1 << 14, 1 << 9, 32, 2, 2
ROWS = WORDS + SHAPES
#: Rows of the vector table in a piece that tasks send.
PIECE = 1 << 10
#: Tasks whose sums are added at a time.
FAN = 32
FEATURES = 2 * DIM + 4
_BATCH = 1_000_000


def index_vectors(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors' nonzero entries; made by rule from the seed."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (ROWS, NONZERO)), rng.choice(np.array([-1, 1]), (ROWS, NONZERO))


def _shape(word: str) -> str:
    if word.isalpha() and word.islower():
        return f"l{min(len(word), 24) // 4}"
    kind = ["U" if c.isupper() else "l" if c.islower() else "9" if c.isdigit() else c if ord(c) < 128 else "?" for c in word]
    short = [k for i, k in enumerate(kind) if i < 1 or k != kind[i - 1] or k not in "Ul9"]
    return "".join(short[:6]) + str(min(len(word), 24) // 4)


class _Codes(dict):
    """Word -> (word bucket) | (shape bucket) << 20; keeps a bounded number."""

    def __missing__(self, word: str) -> int:
        code = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS | (WORDS + zlib.crc32(_shape(word).encode()) % (SHAPES - 1)) << 20
        if len(self) < 200_000:
            self[word] = code
        return code


_CODES = _Codes()


def forget() -> None:
    _CODES.clear()


_SAME = ROWS - 1  # the shape of a word that equals the one before


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows, shape rows and document numbers of all words of the texts."""
    words = [WORD.findall(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.fromiter(map(_CODES.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    word, shape = codes & 0xFFFFF, codes >> 20
    if len(codes) > 1:
        same = np.flatnonzero((codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])) + 1
        shape[same] = _SAME
    return word, shape, doc


def _grouped(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about _BATCH characters, so that arrays stay small; a longer text is a run."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= _BATCH:
            yield run
            run, size = [], 0
    if run:
        yield run


def context_sums(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The vectors (ROWS x DIM, integers) summed over the whole corpus. Tasks send sums in pieces of bounded size and number."""
    places, signs = index_vectors()

    @tidy(forget)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, beside = np.zeros(WORDS * DIM), np.zeros(SHAPES * SHAPES, np.int64)
        for b in batches:
            for run in _grouped([t or "" for t in b.column(0).to_pylist()]):
                word, shape, doc = _coded(run)
                shape = shape - WORDS
                for step in range(1, WINDOW + 1):
                    near = np.flatnonzero(doc[step:] == doc[:-step])
                    for a, c in ((word[near], word[near + step]), (word[near + step], word[near])):
                        for k in range(NONZERO):
                            total += np.bincount(a * DIM + places[c, k], signs[c, k], WORDS * DIM)
                    beside += np.bincount(shape[near] * SHAPES + shape[near + step], minlength=SHAPES * SHAPES)
        # few shapes: their neighbours are counted first and turned into index vectors at the end
        index = np.zeros((SHAPES, DIM), np.int64)
        np.add.at(index, (np.arange(SHAPES)[:, None], places[WORDS:]), signs[WORDS:])
        beside = beside.reshape(SHAPES, SHAPES)
        total = np.concatenate([np.rint(total).astype(np.int64), ((beside + beside.T) @ index).ravel()])
        if total.any():
            parts = total.reshape(-1, PIECE * DIM) if ROWS % PIECE == 0 else np.pad(total, (0, -len(total) % (PIECE * DIM))).reshape(-1, PIECE * DIM)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["piece", "sums"])

    def add(pdf):
        import pandas as pd

        total = np.sum([np.frombuffer(x, np.int64) for x in pdf["sums"]], axis=0)
        return pd.DataFrame({"piece": pdf["piece"][:1], "part": pdf["part"][:1], "sums": [total.tobytes()]})

    # added as a tree of FAN tasks' sums at a time: a task adds FAN pieces, the last one the number of tasks / FAN**3
    some = docs.select(F.col(text).cast("string")).mapInArrow(work, "piece int, sums binary").withColumn("part", F.spark_partition_id())
    for _ in range(3):
        some = some.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("piece", "part").applyInPandas(add, "piece int, part int, sums binary")
    whole = np.zeros((-(-ROWS // PIECE), PIECE * DIM), np.int64)
    for r in some.groupBy("piece").applyInPandas(add, "piece int, part int, sums binary").collect():  # ROWS x DIM numbers, whatever the corpus
        whole[r.piece] = np.frombuffer(r.sums, np.int64)
    return whole.reshape(-1, DIM)[:ROWS]


def word_vectors(sums: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.where(norm > 0, norm, 1)).astype(np.float32)


def features(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    out = [np.zeros((0, FEATURES))]
    for run in _grouped(texts):
        word, shape, doc = _coded(run)
        n = np.bincount(doc, minlength=len(run))
        pooled = []
        for rows in (word, shape):
            mean = np.zeros((len(run), DIM))
            own, ends = vectors[rows], np.cumsum(n)
            for i, (size, end) in enumerate(zip(n.tolist(), ends.tolist())):
                if size:
                    mean[i] = own[end - size : end].mean(0, dtype=np.float64)
            pooled.append(mean)
        norms = [np.linalg.norm(m, axis=1, keepdims=True) for m in pooled]
        repeats = np.bincount(doc, shape == _SAME, len(run))[:, None] / np.maximum(n, 1)[:, None]
        out.append(np.hstack([*pooled, *norms, np.log1p(n)[:, None], repeats]))
    return np.vstack(out)


@dataclass
class Network:
    """score = sigmoid((tanh(x W1 + b1) W2 + b2) / temperature) of standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 40, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Network:
    """Two layers by Adam on four fifths of the rows; the rest choose the temperature by log loss."""
    k = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Network(np.zeros(k), np.ones(k), np.zeros((k, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-6
    p = [rng.normal(0, k**-0.5, (k, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z, t = np.clip((x - mean) / scale, -8, 8), 0
    for _ in range(epochs):
        rng.shuffle(used)
        for i in range(0, len(used), 128):
            at = used[i : i + 128]
            h = np.tanh(z[at] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - y[at]) / len(at)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [z[at].T @ back + decay * p[0], back.sum(0), h.T @ d + decay * p[2], np.array([d.sum()])]
            t += 1
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                p[j] = p[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(held):
        logit = net.logit(x[held])
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.mean(np.logaddexp(0, -np.where(y[held] == 1, logit, -logit) / g)) for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most_labelled: int = 20_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """The network, from at most most_labelled rows that are not held out."""
    rows = labels.select(F.col(doc_id).alias("_doc"), F.col(label).cast("double").alias("_y")).where(F.col("_doc").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_doc")))
    rows = rows.groupBy("_doc").agg((F.avg("_y") >= 0.5).cast("double").alias("_y")).orderBy(F.xxhash64("_doc"), "_doc").limit(most_labelled)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    @tidy(forget)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features([t or "" for t in b.column(2).to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["doc", "y", "x"])

    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    picked = texts.join(F.broadcast(rows), F.col("_id") == F.col("_doc")).select("_doc", "_y", "_text")  # most_labelled rows of 16 bytes
    # of documents with one id the one with the least features counts, so at most most_labelled rows come
    one = picked.mapInArrow(work, "doc long, y double, x binary").groupBy("doc", "y").agg(F.min("x").alias("x"))
    got = sorted((r.doc, r.y, bytes(r.x)) for r in one.collect())
    x = np.array([np.frombuffer(r[2]) for r in got]).reshape(-1, FEATURES)
    return fit(x, np.array([r[1] for r in got]))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_labelled: int = 20_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    vectors = word_vectors(context_sums(docs, text))
    net = train(docs, labels, vectors, most_labelled, doc_id, text, label)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    @tidy(forget)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for b in batches:
            score = net.score(features([t or "" for t in b.column(2).to_pylist()], vectors))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    cols = docs.select(F.col(doc_id).cast("long"), held_out(F.col(doc_id)), F.col(text).cast("string"))
    return cols.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_labelled: int = 20_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """docs, all columns, without the documents that score below the threshold. Null and empty texts are scored as others are, repeated rows alike; an empty table stays empty."""
    vectors = word_vectors(context_sums(docs, text))
    shared = docs.sparkSession.sparkContext.broadcast((vectors, train(docs, labels, vectors, most_labelled, doc_id, text, label)))
    at = docs.columns.index(text)

    @tidy(forget)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for b in batches:
            yield b.filter(pa.array(net.score(features([t or "" for t in b.column(at).to_pylist()], vectors)) >= threshold))

    return docs.mapInArrow(work, docs.schema)
