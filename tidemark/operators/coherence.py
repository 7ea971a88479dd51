"""Topic coherence from sliding-window co-occurrence, in one pass over the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.words import slices
from tidemark.operators.counting import coded_tokens
from tidemark.tables import materialise

EPSILON = 1e-12
#: Top words of all topics up to which tasks hold them and their pair counts.
MOST_WORDS = 200_000
#: Top words of all topics up to which a task counts all pairs at once, of any topics.
MOST_DENSE = 2_000


def covered(word: np.ndarray, places: np.ndarray, window: int, n_windows: int, n_words: int) -> np.ndarray:
    """A row per word: which windows, numbered by their first place, hold one of its places."""
    row = word * (n_windows + 1)
    edge = np.bincount(row + np.maximum(places - window + 1, 0), minlength=n_words * (n_windows + 1)) - np.bincount(row + np.minimum(places, n_windows - 1) + 1, minlength=n_words * (n_windows + 1))
    return np.cumsum(edge.reshape(n_words, -1)[:, :-1], axis=1) > 0


def window_counts(df: DataFrame, words: DataFrame, key: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(topic, w1, w2, n of all ordered pairs of a topic's words: windows that hold both; w1 = w2 gives single counts), (n_windows). A text shorter than the window is one window.

    words (topic, term) is read by the driver: at most MOST_WORDS. Every row is a text of its own, whatever its key. A task adds its texts' counts and sends one row a pair and one for the windows.
    """
    rows = sorted((r.topic, r.term) for r in words.select("topic", "term").limit(MOST_WORDS + 1).collect())
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} topic words")
    terms = sorted({t for _, t in rows})
    code = {t: i for i, t in enumerate(terms)}
    own: dict[int, list[int]] = {}
    for topic, term in rows:
        own.setdefault(topic, []).append(code[term])

    dense = len(terms) <= MOST_DENSE

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = 0, pa.array(terms, pa.string())
        every = np.zeros((len(terms), len(terms)) if dense else (0, 0), np.int64)
        both = {} if dense else {topic: np.zeros((len(c), len(c)), np.int64) for topic, c in own.items()}
        for texts in (b.column(0).slice(i, j - i) for b in batches for i, j in slices(b.column(0))):
            spelled, codes, begins = coded_tokens(texts)
            size = np.diff(begins)
            lasts = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
            total += int(lasts.sum())
            mine = pc.fill_null(pc.index_in(spelled, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
            hit = np.flatnonzero(mine >= 0)
            doc, first = np.unique(np.searchsorted(begins, hit, "right") - 1, return_index=True)
            for d, at in zip(doc.tolist(), np.split(hit, first[1:])):
                present, word = np.unique(mine[at], return_inverse=True)
                held = covered(word, at - begins[d], window, int(lasts[d]), len(present))
                x = held.astype(np.float32 if lasts[d] < 1 << 24 else np.float64)
                if dense:
                    every[np.ix_(present, present)] += np.rint(x @ x.T).astype(np.int64)
                    continue
                for topic, wanted in own.items():
                    _, mine_, theirs = np.intersect1d(present, wanted, assume_unique=True, return_indices=True)
                    if len(mine_):
                        y = x[mine_]
                        both[topic][np.ix_(theirs, theirs)] += np.rint(y @ y.T).astype(np.int64)
        if dense:
            both = {topic: every[np.ix_(c, c)] for topic, c in own.items()}
        out = [(topic, terms[c[i]], terms[c[j]], int(m[i, j])) for topic, c in own.items() for m in [both[topic]] for i, j in zip(*np.nonzero(m))]
        out.append((None, None, None, total))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int64()))], ["topic", "w1", "w2", "n"])

    sent = materialise(df.select(text_col).mapInArrow(work, "topic long, w1 string, w2 string, n long"))
    sent = sent.withColumn("topic", F.col("topic").cast(words.schema["topic"].dataType))
    counts = sent.where(F.col("w1").isNotNull()).groupBy("topic", "w1", "w2").agg(F.sum("n").alias("n"))
    return counts, sent.where(F.col("w1").isNull()).agg(F.sum("n").alias("n_windows"))


def _npmi(df: DataFrame, words: DataFrame, key: str, text_col: str, window: int) -> DataFrame:
    """topic, w1, w2, npmi for all ordered pairs of a topic's words that occur, pairs of a word with itself included."""
    both, total = window_counts(df, words, key, text_col, window)
    single = both.where(F.col("w1") == F.col("w2"))
    pairs = single.select("topic", "w1", F.col("n").alias("na")).join(single.select("topic", "w2", F.col("n").alias("nb")), "topic")
    pairs = pairs.join(both, ["topic", "w1", "w2"], "left").join(F.broadcast(total))  # one row
    p = F.coalesce("n", F.lit(0)) / F.col("n_windows")
    npmi = F.log((p + EPSILON) / (F.col("na") / F.col("n_windows") * F.col("nb") / F.col("n_windows"))) / -F.log(p + EPSILON)
    return pairs.select("topic", "w1", "w2", npmi.alias("npmi"))


def c_npmi(df: DataFrame, words: DataFrame, key: str, text_col: str, window: int = 10) -> DataFrame:
    """topic, c_npmi: mean over the pairs of different top words. words: topic, term."""
    pairs = _npmi(df, words, key, text_col, window).where(F.col("w1") != F.col("w2"))
    return pairs.groupBy("topic").agg(F.avg("npmi").alias("c_npmi"))


def c_v(df: DataFrame, words: DataFrame, key: str, text_col: str, window: int = 110) -> DataFrame:
    """topic, c_v: mean cosine of each word's NPMI vector with the sum of all words' vectors."""
    cells = _npmi(df, words, key, text_col, window)
    whole = cells.groupBy("topic", "w2").agg(F.sum("npmi").alias("all"))
    met = cells.join(whole, ["topic", "w2"]).groupBy("topic", "w1").agg(
        F.sum(F.col("npmi") * F.col("all")).alias("dot"), F.sqrt(F.sum(F.col("npmi") * F.col("npmi"))).alias("a"), F.sqrt(F.sum(F.col("all") * F.col("all"))).alias("b")
    )
    return met.groupBy("topic").agg(F.avg(F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("dot") / F.col("a") / F.col("b")).otherwise(0.0)).alias("c_v"))


def mean_coherence(per_topic: DataFrame, measure: str) -> DataFrame:
    return per_topic.agg(F.avg(measure).alias(measure))
