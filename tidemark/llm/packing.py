"""Order-preserving packing into token sequences by dynamic programming.

Documents keep their order within a task's share of the input and form one token stream. The stream
may be cut at document ends (free), at sentence ends (a small penalty) and, inside sentences longer than a
sequence, which must be cut somewhere, at every ``unit`` tokens (a truncation penalty). Over these places

    cost(j) = min over i with 0 < at[j] - at[i] <= width of cost(i) + width - (at[j] - at[i]) + penalty(j)

is minimal padding plus penalties; the best i is the front of a monotone queue of cost(i) + at[i], so a
stream costs time in proportion to its places; of equally cheap cuts those with longer last windows are taken. The stream is cut in rounds of about ``round_tokens``; what
the last window of a round holds moves to the next round. A task's last window is split into powers of two
where that spares padding, as sequences of such a length are not padded.

Null text is an empty text, which is one end-of-document id. Repeated rows are packed each for itself; a
null id stays null; an empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import tidy

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Local sequence numbers stand below, the task's number above.
SHARE_BITS = 40


class _Odd(Exception):
    """A piece that can't be encoded by itself."""


class _Pieces(dict):
    """Words between spaces -> the ids of a space and the word. Keeps the first ``room`` words, which hold the frequent ones."""

    def __init__(self, encode, room: int):
        self.encode, self.room = encode, room

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace() or "<|" in word:
            raise _Odd
        ids = np.array(self.encode(f" {word}"), "<u4").tobytes()
        if len(self) < self.room:
            self[word] = ids
        return ids


class Encoder:
    """Texts to little-endian 32-bit ids of a byte-level BPE tokenizer, and an end id.

    Such a tokenizer splits a text before every single space that stands between other characters,
    so the words between spaces are encoded once each (by ``ranks``, the same vocabulary in the faster
    library's format) and remembered. Texts with other white space beside a space, and those with what
    may be a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str, ranks: str, pattern: str, end_id: int = 1, room: int = 250_000):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], "<u4").tobytes()
        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ordinary = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={}).encode_ordinary
        self.pieces = _Pieces(self.ordinary, room)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(max(vocab.values()), end_id) + 1, bool)
        self.ends[[i for t, i in vocab.items() if re.search(r"[.!?\u010a]\Z", t)]] = True  # U+010A stands for a line feed

    def encode(self, text: str) -> bytes:
        if not text:
            return self.end
        first, *words = text.split(" ")
        try:
            if not first or first[-1].isspace() or "<|" in first:
                raise _Odd
            return np.array(self.ordinary(first), "<u4").tobytes() + b"".join(map(self.pieces.__getitem__, words)) + self.end
        except _Odd:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end


@functools.cache
def encoder(path: str | None, ranks: str | None, end_id: int) -> Encoder:
    """One for each Python worker; None: the public byte_bpe_50k files."""
    import public_tokenizers as public

    return Encoder(path or public.path("byte_bpe_50k.json"), ranks or public.path("byte_bpe_50k.tiktoken"), public.PATTERN, end_id)


def cut_places(ends: np.ndarray, doc_ends: np.ndarray, total: int, width: int, unit: int, sentence: float, truncation: float) -> tuple[np.ndarray, np.ndarray]:
    """The places where a stream of ``total`` tokens may be cut, from 0 to total, and their penalties."""
    kind = np.zeros(total + 1, np.int8)
    kind[ends] = 2
    kind[doc_ends] = 3
    kind[[0, total]] = 3
    whole = np.flatnonzero(kind)
    for i in np.flatnonzero(np.diff(whole) > width):
        kind[whole[i] + unit : whole[i + 1] : unit] = 1
    at = np.flatnonzero(kind)
    return at, np.array([0.0, truncation, sentence, 0.0])[kind[at]]


def best_cuts(at: list[int], penalty: list[float], width: int) -> list[int]:
    """Indexes into ``at`` of the cheapest cuts, first and last place included. Gaps in ``at`` are at most width."""
    n = len(at)
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int, int]] = deque([(float(at[0]), at[0], 0)])
    for j in range(1, n):
        here = at[j]
        low = here - width
        while queue[0][1] < low:
            queue.popleft()
        key, _, i = queue[0]
        cost[j] = c = key + width - here + penalty[j]
        back[j] = i
        key = c + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1]


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Packs the documents of one share as they come."""

    def __init__(self, share: int, ends: np.ndarray, width: int, unit: int, sentence: float, truncation: float, round_tokens: int):
        self.ends, self.width, self.unit, self.penalties, self.round = ends, width, unit, (sentence, truncation), round_tokens
        self.next = share << SHARE_BITS
        self.docs: list[list] = []  # doc_id, its ids, tokens packed already
        self.held = 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        self.docs.append([doc_id, ids, 0])
        self.held += len(ids) // 4
        if self.held >= self.round:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        sizes = np.array([len(d[1]) // 4 - d[2] for d in self.docs])
        doc_ends = np.cumsum(sizes)
        ids = np.frombuffer(b"".join([d[1][4 * d[2] :] for d in self.docs]), "<u4")
        at, cost = cut_places(np.flatnonzero(self.ends[ids]) + 1, doc_ends, len(ids), self.width, self.unit, *self.penalties)
        cuts = at[best_cuts(at.tolist(), cost.tolist(), self.width)].tolist()
        windows = list(zip(cuts[:-1], cuts[1:]))
        if last:
            a, b = windows.pop()
            parts = powers(b - a)
            if sum(parts[:1]) == b - a or self.width - (b - a) <= 0:
                parts = [b - a]
            for p in parts:
                windows.append((a, a + p))
                a += p
        elif len(windows) > 1:
            windows.pop()
        at_doc, begun = 0, 0
        for a, b in windows:
            offset = 0
            while a < b:
                while doc_ends[at_doc] <= a:
                    begun = int(doc_ends[at_doc])
                    at_doc += 1
                doc_id, raw, done = self.docs[at_doc]
                take = min(b, int(doc_ends[at_doc])) - a
                start = done + a - begun
                yield doc_id, start, take, zlib.crc32(raw[4 * start : 4 * (start + take)]), len(raw) // 4, self.next, offset
                offset += take
                a += take
            self.next += 1
        packed = windows[-1][1]
        gone = int(np.searchsorted(doc_ends, packed, "right"))
        before = int(doc_ends[gone - 1]) if gone else 0
        self.docs = self.docs[gone:]
        if self.docs:
            self.docs[0][2] += packed - before
        self.held -= packed


def pack(
    docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, width: int = 2048, end_id: int = 1, unit: int = 16, sentence: float = 2.0, truncation: float = 5.0,
    round_tokens: int = 400_000, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer, ranks: paths of one vocabulary as a tokenizers and as a tiktoken file, on every machine; default: the public byte_bpe_50k.
    No shuffle: each task packs the documents it reads, in their order.
    """

    @tidy()
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = encoder(tokenizer, ranks, end_id)
        packer = Packer(TaskContext.get().partitionId(), coder.ends, width, min(unit, width), sentence, truncation, round_tokens)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if rows := list(packer.add(key, coder.encode(t or ""))):
                    yield batch(rows)
        if rows := list(packer.flush(True)):
            yield batch(rows)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(work, SCHEMA)
