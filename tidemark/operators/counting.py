"""Counts of terms in Arrow batches: words are coded, so that a batch's counts are sorts of whole numbers and a term is spelled once.

Where all counts of a term meet (met_counts()), they are shuffled and written as blocks, a row per task and batch: words, and counts by the words' numbers. So no row of a term passes through the JVM.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from tidemark.functions import words as chunks
from tidemark.functions.words import coded_parts, slices

#: The white space of text.tokens(), without the space itself.
WHITE = r"[\x09-\x0d\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Bytes of text whose terms meet in one task.
TASK_BYTES = 8 << 20
#: Rows of counts in a block that is written.
BLOCK_ROWS = 1 << 16


def coded_tokens(texts: pa.Array, stopwords: frozenset[str] = frozenset()) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the number of every token in order, where each text's begin); as text.tokens(), without stop words."""
    words, codes, begins = coded_parts(pc.replace_substring_regex(texts, WHITE, " "))
    keep = ~pc.is_in(words, value_set=pa.array(["", *stopwords], pa.string())).to_numpy(zero_copy_only=False)[codes]
    return words, codes[keep].astype(np.int64), np.concatenate([[0], np.cumsum(keep)])[begins]


def _groups(columns: list[pa.Array], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(each row's group, from 0; a row of each group). Nulls are equal."""
    of = np.zeros(n, np.int64)
    for c in columns:
        codes = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy()
        of = np.unique(of * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
    _, rows, of = np.unique(of, return_index=True, return_inverse=True)
    return of, rows


def part_counts(df: DataFrame, text_col: str, by: tuple[str, ...], stopwords: list[str] | None = None, bigrams: bool = True) -> DataFrame:
    """by, term, tf: the counts of parts of the rows, which are to be added; no shuffle."""
    stop = frozenset(stopwords or ())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(len(by))):
                part = batch.slice(a, b - a)
                words, codes, begins = coded_tokens(part.column(len(by)), stop)
                if not len(codes):
                    continue
                group, rows = _groups([part.column(i) for i in range(len(by))], len(part))
                row = np.repeat(np.arange(len(part)), np.diff(begins))
                v, mine = len(words), group[row]
                key, n = np.unique(mine * v + codes, return_counts=True)
                found = [(key // v, words.take(pa.array(key % v)), n)]
                if bigrams:
                    at = np.flatnonzero(row[1:] == row[:-1])
                    first, second = mine[at] * v + codes[at], codes[at + 1]
                    if len(rows) * v * v < 1 << 62:
                        key, n = np.unique(first * v + second, return_counts=True)
                        first, second = key // v, key % v
                    else:
                        (first, second), n = np.unique(np.stack([first, second]), axis=1, return_counts=True)
                    found.append((first // v, pc.binary_join_element_wise(words.take(pa.array(first % v)), words.take(pa.array(second)), " "), n))
                for of, term, n in found:
                    at = pa.array(rows[of])
                    yield pa.RecordBatch.from_arrays([*[part.column(i).take(at) for i in range(len(by))], term, pa.array(n, pa.int64())], [*by, "term", "tf"])

    rows = df.select(*by, text_col)
    schema = StructType([*rows.schema.fields[: len(by)], StructField("term", StringType()), StructField("tf", LongType())])
    return rows.mapInArrow(work, schema)


def _summed(codes: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """(the distinct rows of codes, whole numbers from 0, in order; the sum of n of each, or how often it stands)."""
    sizes = [int(c.max(initial=0)) + 1 for c in codes]
    if math.prod(sizes) < 1 << 62:
        key = codes[0].astype(np.int64)
        for c, size in zip(codes[1:], sizes[1:], strict=True):
            key *= size
            key += c
        order = None if n is None else np.argsort(key)
        key = np.sort(key) if order is None else key[order]
        at = np.flatnonzero(np.diff(key, prepend=-1))
        key, made = key[at], []
        for size in sizes[:0:-1]:
            key, rest = np.divmod(key, size)
            made.append(rest)
        made = [key, *made[::-1]]
    else:
        order = np.lexsort(codes[::-1])
        made = [c[order] for c in codes]
        at = np.flatnonzero(np.any([np.diff(c, prepend=-1) != 0 for c in made], axis=0))
        made = [c[at] for c in made]
    if n is None:
        return made, np.diff(at, append=len(codes[0]))
    return made, np.add.reduceat(n[order], at) if len(at) else np.zeros(0, np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES of text."""
    held, size = [], 0
    for batch in batches:
        for a, b in slices(batch.column(column)):
            part = batch.slice(a, b - a)
            more = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + more > chunks.SLICE_BYTES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _own(values: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For stretches of numbers below size: (each stretch's distinct numbers, one after another; where each stretch's begin; every value's place among its stretch's)."""
    at, found, place, offsets = np.zeros(size, np.int32), [], np.zeros(len(values), np.int32), [0]
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        found.append(np.unique(values[a:b]))
        at[found[-1]] = np.arange(len(found[-1]))
        place[a:b] = at[values[a:b]]
        offsets.append(offsets[-1] + len(found[-1]))
    return np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64), np.array(offsets, np.int32), place


KINDS = (np.uint8, np.uint16, np.uint32, np.uint64)


def _narrow(c: np.ndarray) -> bytes:
    """Whole numbers from 0 in the narrowest kind that holds them, behind a byte that names it."""
    kind = next(i for i, k in enumerate(KINDS) if int(c.max(initial=0)) <= np.iinfo(k).max)
    return bytes([kind]) + c.astype(KINDS[kind]).tobytes()


class Blocks:
    """Counts as rows of a table: by (lists of the groups' values), words (joined by spaces) and numbers: how many rows there are (8 bytes), then one column after another, each as narrow as it can be."""

    def __init__(self, by: list[StructField]) -> None:
        self.fields = [StructField("words", StringType()), *[StructField(f.name, ArrayType(f.dataType)) for f in by], StructField("numbers", BinaryType())]

    @staticmethod
    def pack(spelled: pa.Array, groups: list[pa.Array], begins: np.ndarray, group: np.ndarray, first: np.ndarray, second: np.ndarray, *numbers: np.ndarray) -> list[pa.Array]:
        """Columns of blocks, each of the rows from one begin to the next, which are in order of first; second is -1 for a single word."""
        m = len(begins) - 1
        pairs = second >= 0
        both, spans = np.concatenate([first, second[pairs]]), []
        if m == 1:
            order, bounds = slice(None), np.array([0, len(both)])
        else:
            block = np.repeat(np.arange(m), np.diff(begins))
            spans = np.concatenate([block, block[pairs]])
            order = np.argsort(spans, kind="stable")
            bounds = np.searchsorted(spans[order], np.arange(m + 1))
        used, offsets, there = _own(both[order], bounds, len(spelled))
        place = np.empty(len(both), np.int32)
        place[order] = there
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), spelled.take(pa.array(used))), " ")
        mine, goffsets, group = _own(group, begins, len(groups[0]) if groups else 1)
        lists = [pa.ListArray.from_arrays(pa.array(goffsets), g.take(pa.array(mine))) for g in groups]
        other = np.full(len(first), -1, np.int32)
        other[pairs] = place[len(first) :]
        firsts, columns = place[: len(first)], (other + 1, *numbers)
        packed = [b"".join([int(b - a).to_bytes(8, "little"), _narrow(group[a:b]), _narrow(np.diff(firsts[a:b], prepend=0)), *[_narrow(c[a:b]) for c in columns]]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
        return [words, *lists, pa.array(packed, pa.binary())]

    @staticmethod
    def unpack(columns: list[pa.Array]) -> tuple[pa.Array, list[pa.Array], np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(distinct words, groups' values, group, first, second, numbers) of all rows of some blocks, in order."""
        words, codes, begins = coded_parts(columns[0])
        flat = [c.flatten() for c in columns[1:-1]]
        counts = pc.list_value_length(columns[1]).to_numpy() if flat else np.ones(len(columns[0]), np.int64)
        group_of, rows = _groups(flat, int(counts.sum()))
        gbegins = np.concatenate([[0], np.cumsum(counts)])
        parts: list[list[np.ndarray]] = []
        for i, packed in enumerate(columns[-1]):
            buffer = packed.as_buffer()
            m, at, made = int(np.frombuffer(buffer, np.int64, 1)[0]), 8, []
            while at < buffer.size:
                kind = KINDS[np.frombuffer(buffer, np.uint8, 1, at)[0]]
                made.append(np.frombuffer(buffer, kind, m, at + 1))
                at += 1 + m * np.dtype(kind).itemsize
            second = made[2].astype(np.int64) - 1
            made[:3] = group_of[made[0] + gbegins[i]], codes[np.cumsum(made[1], dtype=np.int64) + begins[i]], np.where(second < 0, -1, codes[second + begins[i]])
            parts.append(made)
        group, first, second, *numbers = [np.concatenate(p).astype(np.int64) for p in zip(*parts, strict=True)]
        return words, [c.take(pa.array(rows)) for c in flat], group, first, second, numbers

    @staticmethod
    def spelled(words: pa.Array, first: np.ndarray, second: np.ndarray) -> pa.Array:
        """The terms."""
        one = words.take(pa.array(first))
        two = pc.binary_join_element_wise(one, words.take(pa.array(np.maximum(second, 0))), " ")
        return pc.if_else(pa.array(second >= 0), two, one)


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """Whole numbers that repartition(n) by such a column deals to one partition each."""
    at = F.pmod(F.hash("id"), F.lit(n))
    return [r.key for r in spark.range(0, 24 * n, 1, 1).groupBy(at).agg(F.min("id").alias("key")).collect()]


def met_counts(df: DataFrame, text_col: str, by: tuple[str, ...], stopwords: list[str] | None = None, bigrams: bool = True) -> tuple[DataFrame, Blocks]:
    """Parts of counts, as blocks with one number, of which all with a term are in one partition: that of about TASK_BYTES of text. One shuffle; runs a job for the text's size, as the number of tasks follows it."""
    spark, stop = df.sparkSession, frozenset(stopwords or ())
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    rows = df.select(*by, text_col)
    blocks = Blocks(rows.schema.fields[: len(by)])
    n = max(spark.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))
    keys = np.array(even_keys(spark, n), np.int64)
    names = ["part", *[f.name for f in blocks.fields]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, len(by)):
            words, codes, begins = coded_tokens(batch.column(len(by)), stop)
            if not len(codes):
                continue
            group, of = _groups([batch.column(i) for i in range(len(by))], len(batch))
            row = np.repeat(np.arange(len(batch)), np.diff(begins))
            codes, mine, second = codes.astype(np.int32), group.astype(np.int32)[row], np.zeros(len(codes), np.int32)
            if bigrams:
                at = np.flatnonzero(row[1:] == row[:-1])
                mine, codes, second = np.concatenate([mine, mine[at]]), np.concatenate([codes, codes[at]]), np.concatenate([second, codes[at + 1] + 1])
            (first, second, mine), tf = _summed([codes, second, mine])
            hashes = np.fromiter((zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
            mixed = (hashes[first] * np.uint64(0x9E3779B97F4A7C15)) ^ np.concatenate([np.zeros(1, np.uint64), hashes + np.uint64(1)])[second] * np.uint64(0xC2B2AE3D27D4EB4F)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            part = ((mixed >> np.uint64(32)) % np.uint64(len(keys))).astype(np.uint16 if len(keys) < 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(len(keys) + 1))
            present = np.flatnonzero(np.diff(bounds))
            groups = [batch.column(i).take(pa.array(of)) for i in range(len(by))]
            columns = blocks.pack(words, groups, np.concatenate([bounds[present], [len(order)]]), mine[order], first[order], second[order] - 1, tf[order])
            yield pa.RecordBatch.from_arrays([pa.array(keys[present]), *columns], names)

    parts = rows.mapInArrow(work, StructType([StructField("part", LongType()), *blocks.fields]))
    return parts.repartition(n, "part").drop("part"), blocks


def _met(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Array, list[pa.Array], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(words, groups' values, group, first, second, tf, where each term's rows begin) of a task of met_counts(), by term."""
    held = [b for b in batches if len(b)]
    if not held:
        return None
    words, groups, group, first, second, (tf,) = Blocks.unpack([pa.concat_arrays([b.column(i) for b in held]) for i in range(held[0].num_columns)])
    (first, second, group), tf = _summed([first, second + 1, group], tf)
    begins = np.flatnonzero((np.diff(first, prepend=-1) != 0) | (np.diff(second, prepend=-1) != 0))
    return words, groups, group, first, second - 1, tf, begins


def pruned_counts(df: DataFrame, text_col: str, topic: str, stopwords: list[str] | None, bigrams: bool, min_df: int) -> DataFrame:
    """topic, term, tf, df, f of terms of at least min_df topics, and a row without term for each topic of a task's counts. Runs a job (met_counts())."""
    parts, _ = met_counts(df, text_col, (topic,), stopwords, bigrams)
    schema = StructType([df.schema[topic], StructField("term", StringType()), *[StructField(c, LongType()) for c in ("tf", "df", "f")]])
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _met(batches)
        if met is None:
            return
        words, (own,), group, first, second, tf, begins = met
        yield pa.RecordBatch.from_arrays([own, *[pa.nulls(len(own), t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64())]], names)
        each = np.diff(begins, append=len(tf))
        df_, f = np.repeat(each, each), np.repeat(np.add.reduceat(tf, begins), each)
        keep = np.flatnonzero(df_ >= min_df)
        for i in range(0, len(keep), BLOCK_ROWS):
            j = keep[i : i + BLOCK_ROWS]
            yield pa.RecordBatch.from_arrays([own.take(pa.array(group[j])), Blocks.spelled(words, first[j], second[j]), *[pa.array(c[j], pa.int64()) for c in (tf, df_, f)]], names)

    return parts.mapInArrow(work, schema)


def met_blocks(df: DataFrame, text_col: str, by: tuple[str, ...], stopwords: list[str] | None = None, bigrams: bool = True, min_df: int = 1) -> DataFrame:
    """Counts of the terms that at least min_df groups have, in blocks (read_blocks()) that hold a term's rows whole; and rows without numbers for totals: own (lists of a group's values), df and n, the sum of its terms found in df groups (df 0: none, the group has terms). Runs a job (met_counts())."""
    parts, blocks = met_counts(df, text_col, by, stopwords, bigrams)
    own = [StructField(f"own_{f.name}", f.dataType) for f in df.select(*by).schema.fields]
    schema = StructType([*blocks.fields, *own, StructField("df", LongType()), StructField("n", LongType())])
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _met(batches)
        if met is None:
            return
        words, groups, group, first, second, tf, begins = met
        each = np.diff(begins, append=len(tf))
        df_, f = np.repeat(each, each), np.repeat(np.add.reduceat(tf, begins), each)
        keep = df_ >= min_df
        (of, found), n = _summed([group[keep], df_[keep]], tf[keep])
        of, found, n = (np.concatenate([a, b]) for a, b in ((np.arange(len(groups[0])), of), (np.zeros(len(groups[0]), np.int64), found), (np.zeros(len(groups[0]), np.int64), n)))
        empty = [pa.nulls(len(of), t) for t in (pa.string(), *[pa.list_(g.type) for g in groups], pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, *[g.take(pa.array(of)) for g in groups], pa.array(found, pa.int64()), pa.array(n, pa.int64())], names)
        whole = each >= min_df
        ends = np.cumsum(each[whole])
        row = np.flatnonzero(keep)
        a = 0
        while a < len(row):
            b = int(ends[min(int(np.searchsorted(ends, a + BLOCK_ROWS)), len(ends) - 1)])
            j = row[a:b]
            columns = blocks.pack(words, groups, np.array([0, len(j)]), group[j], first[j], second[j], tf[j], df_[j], f[j])
            yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(1, g.type) for g in groups], pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names)
            a = b

    return parts.mapInArrow(work, schema)


def read_blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, list[pa.Array], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, groups' values, group, first, second, tf, df, f) of each block of met_blocks(); k: how many columns a group has."""
    for batch in batches:
        for i in range(len(batch)):
            words, groups, group, first, second, (tf, df_, f) = Blocks.unpack([batch.column(j).slice(i, 1) for j in range(k + 2)])
            yield words, groups, group, first, second, tf, df_, f


class Best:
    """Which values may be among the n largest of their cell, where values are compared after rounding to so many digits: at most a few more than that, told as the values come."""

    def __init__(self, cells: int, n: int, digits: int) -> None:
        self.top, self.slack = np.full((cells, n), -np.inf), 2 * 10.0**-digits
        self.least = np.full(cells, -np.inf)

    def may_be(self, cell: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The places of those values."""
        at = np.flatnonzero(value >= self.least[cell])
        if not len(at):
            return at
        at = at[np.argsort(cell[at], kind="stable")]
        begins = np.flatnonzero(np.diff(cell[at], prepend=-1))
        n = self.top.shape[1]
        for a, b in zip(begins, [*begins[1:], len(at)], strict=True):
            c = int(cell[at[a]])
            both = np.concatenate([self.top[c], value[at[a:b]]])
            self.top[c] = np.partition(both, len(both) - n)[len(both) - n :]
            low = self.top[c].min()
            self.least[c] = low - self.slack - abs(low) * 1e-15 if np.isfinite(low) else -np.inf
        return at[value[at] >= self.least[cell[at]]]
