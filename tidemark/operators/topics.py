"""Topic words by class-based TF-IDF, and what is done with topic assignments. A document here is a row of (key, topic, text).

Tables of a row per topic are broadcast: topics are at most some thousands, whatever the number of documents. Counts that several steps read
(ctfidf() after prune_vocabulary()) are best kept with tables.materialise().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from tidemark.functions import text
from tidemark.operators import counting
from tidemark.tables import materialise


def terms(df: DataFrame, text_col: str, keep: tuple[str, ...], stopwords: list[str] | None = None, bigrams: bool = True) -> DataFrame:
    """keep, term: one row per occurrence; stop words go before bigrams are made."""
    t = text.tokens(F.col(text_col))
    if stopwords:
        stop = F.array(*[F.lit(w) for w in stopwords])
        t = F.filter(t, lambda x: ~F.array_contains(stop, x))
    if not bigrams:
        return df.select(*keep, F.explode(t).alias("term"))
    t, df = F.col("_tokens"), df.select(*keep, t.alias("_tokens"))  # a column of its own, so that a text is split once
    pairs = F.when(F.size(t) > 1, F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t)), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return df.select(*keep, F.explode(F.concat(t, pairs)).alias("term"))


def term_counts(df: DataFrame, text_col: str, by: tuple[str, ...] = ("topic",), stopwords: list[str] | None = None, bigrams: bool = True) -> DataFrame:
    return counting.part_counts(df, text_col, by, stopwords, bigrams).groupBy(*by, "term").agg(F.sum("tf").alias("tf"))


def pruned_counts(df: DataFrame, text_col: str, min_df: int = 2, max_df: float = 0.95, topic: str = "topic", stopwords: list[str] | None = None, bigrams: bool = True) -> DataFrame:
    """prune_vocabulary() of term_counts(), with df as well, in one shuffle of the counts. Runs jobs: the terms of min_df topics are written once, as the number of topics is known after."""
    made = materialise(counting.pruned_counts(df, text_col, topic, stopwords, bigrams, min_df))
    total = made.where(F.col("term").isNull()).agg(F.countDistinct(topic).alias("n_topics"))
    return made.where(F.col("term").isNotNull()).join(F.broadcast(total)).where(F.col("df") <= max_df * F.col("n_topics")).drop("n_topics")  # one row


def prune_vocabulary(counts: DataFrame, min_df: int = 2, max_df: float = 0.95, topic: str = "topic") -> DataFrame:
    """Terms of at least min_df topics and at most a share of max_df of all topics, with f: the term's total, which needs no second shuffle later (a term keeps all its topics or none)."""
    per = W.partitionBy("term")
    total = counts.agg(F.countDistinct(topic).alias("n_topics"))
    made = counts.withColumn("df", F.count("*").over(per)).withColumn("f", F.sum("tf").over(per)).join(F.broadcast(total))  # one row
    return made.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n_topics"))).drop("df", "n_topics")


def _totals(counts: DataFrame, topic: str) -> DataFrame:
    """topic, n: its total; a: mean total of a topic, as a whole number. One row per topic."""
    sizes = counts.groupBy(topic).agg(F.sum("tf").alias("n"))
    return sizes.join(F.broadcast(sizes.agg(F.floor(F.avg("n")).alias("a"))))  # one row


def ctfidf(counts: DataFrame, topic: str = "topic") -> DataFrame:
    """topic, term, tf, weight = tf / topic's total * ln(1 + A / term's total); A: mean total of a topic, as a whole number.

    Shuffles counts once, by term, which has at most a row per topic; so a large topic is spread over all tasks. Not even once, if they have f, a term's total (prune_vocabulary()).
    """
    sizes = _totals(counts, topic).withColumnRenamed(topic, "_topic")
    totals = counts if "f" in counts.columns else counts.withColumn("f", F.sum("tf").over(W.partitionBy("term")))
    made = totals.join(F.broadcast(sizes), F.col(topic).eqNullSafe(F.col("_topic")))
    return made.select(topic, "term", "tf", (F.col("tf") / F.col("n") * F.log1p(F.col("a") / F.col("f"))).alias("weight"))


def top_words(weights: DataFrame, n: int = 10, by: tuple[str, ...] = ("topic",), digits: int = 12) -> DataFrame:
    """by, rank, term, weight; ties, to so many digits, by term. Noise is left out."""
    order = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.round("weight", digits)), "term"))
    rows = weights.where(F.col("topic") != -1) if "topic" in by else weights
    return rows.withColumn("rank", order).where(F.col("rank") <= n).select(*by, "rank", "term", "weight")


def pruned_top_words(df: DataFrame, text_col: str, n: int = 10, min_df: int = 2, max_df: float = 0.95, topic: str = "topic", stopwords: list[str] | None = None, bigrams: bool = True, digits: int = 12) -> DataFrame:
    """top_words() of ctfidf() of pruned_counts(), without a row per term: weights are computed block by block, and a task sends on what may be among a topic's n. Runs jobs: the blocks are written once, the totals, a row per topic, come to the driver."""
    made = materialise(counting.met_blocks(df, text_col, (topic,), stopwords, bigrams, min_df))
    own = f"own_{topic}"
    totals = made.where(F.col("numbers").isNull()).groupBy(own, "df").agg(F.sum("n").alias("n"))
    most = totals.agg(F.countDistinct(own)).first()[0] * max_df
    sizes = totals.where((F.col("df") > 0) & (F.col("df") <= most)).groupBy(own).agg(F.sum("n").alias("n")).collect()  # a row per topic
    of, size = [r[0] for r in sizes], np.array([r[1] for r in sizes], np.float64)
    mean = math.floor(sum(r[1] for r in sizes) / len(sizes)) if sizes else 0
    wanted = np.array([t is not None and t != -1 for t in of], bool)
    schema = StructType([df.schema[topic], StructField("term", StringType()), StructField("weight", DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = counting.Best(len(of), n, digits)
        for words, (values,), group, first, second, tf, df_, f in counting.read_blocks(batches, 1):
            known = pc.fill_null(pc.index_in(values, value_set=pa.array(of, values.type)), -1).to_numpy()
            cell = known[group]
            at = np.flatnonzero((df_ <= most) & (cell >= 0))
            at = at[wanted[cell[at]]]
            weight = tf[at] / size[cell[at]] * np.log1p(mean / f[at])
            kept = best.may_be(cell[at], weight)
            at = at[kept]
            yield pa.RecordBatch.from_arrays([values.take(pa.array(group[at])), counting.Blocks.spelled(words, first[at], second[at]), pa.array(weight[kept])], schema.names)

    return top_words(made.where(F.col("numbers").isNotNull()).select(*made.columns[:3]).mapInArrow(work, schema), n, (topic,), digits)


def topic_info(df: DataFrame, words: DataFrame, n: int = 4, topic: str = "topic") -> DataFrame:
    """topic, count, name: the id and the first words."""
    names = words.where(F.col("rank") <= n).groupBy(topic).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), "_").alias("w"))
    return df.groupBy(topic).agg(F.count("*").alias("count")).join(names, topic, "left").select(topic, "count", F.concat_ws("_", F.col(topic).cast("string"), "w").alias("name"))


def relabel_by_size(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Topics numbered 0, 1, ... by falling size (ties by old id); noise stays -1."""
    sizes = df.where(F.col(topic) != -1).groupBy(topic).agg(F.count("*").alias("n"))
    order = sizes.select(F.col(topic).alias("_old"), (F.row_number().over(W.orderBy(F.desc("n"), topic)) - 1).alias("_new"))
    return df.join(F.broadcast(order), F.col(topic) == F.col("_old"), "left").withColumn(topic, F.coalesce("_new", F.lit(-1))).drop("_old", "_new")


def merge_topics(df: DataFrame, groups: list[list[int]], topic: str = "topic") -> DataFrame:
    """Each group becomes its first topic; then all are numbered by size."""
    to = {t: g[0] for g in groups for t in g[1:]}
    if to:
        table = F.create_map(*[F.lit(x) for pair in to.items() for x in pair])
        df = df.withColumn(topic, F.coalesce(F.element_at(table, F.col(topic)), F.col(topic)))
    return relabel_by_size(df, topic)


def with_labels(df: DataFrame, labels: dict[int, str], topic: str = "topic", prefix: str = "Topic ") -> DataFrame:
    default = F.concat(F.lit(prefix), F.col(topic).cast("string"))
    if not labels:
        return df.withColumn("label", default)
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return df.withColumn("label", F.coalesce(F.element_at(table, F.col(topic)), default))


def representative_documents(df: DataFrame, weights: DataFrame, key: str, text_col: str, n: int = 3, bigrams: bool = False, digits: int = 9) -> DataFrame:
    """topic, rank, key, similarity: a topic's documents whose weighted terms are nearest to the topic's by cosine."""
    # one shuffle, by which the counts are added and joined: a row per document that holds a topic's term
    each = counting.part_counts(df, text_col, (key, "topic"), bigrams=bigrams).repartition("topic", "term").groupBy(key, "topic", "term").agg(F.sum("tf").alias("c"))
    idf = weights.select("topic", "term", "weight", (F.col("weight") / F.col("tf")).alias("unit"))
    met = each.join(idf, ["topic", "term"])
    size = weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("topic_norm"))
    own = F.col("c") * F.col("unit")
    cos = met.groupBy(key, "topic").agg(F.sum(own * F.col("weight")).alias("dot"), F.sqrt(F.sum(own * own)).alias("norm")).join(F.broadcast(size), "topic")
    cos = cos.where(F.col("norm") > 0).select("topic", key, F.round(F.col("dot") / F.col("norm") / F.col("topic_norm"), digits).alias("similarity"))
    return cos.withColumn("rank", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("similarity"), key))).where(F.col("rank") <= n)


def topics_over_time(df: DataFrame, text_col: str, month: str = "relative_month", n_words: int = 5, evolution: bool = True, overall: bool = True, stopwords: list[str] | None = None, bigrams: bool = False, digits: int = 12) -> DataFrame:
    """topic, month, freq, words (best first): class-based TF-IDF per month with the whole corpus's vocabulary and idf.

    Runs jobs: the counts, which all parts read, are written once, in blocks of whole terms; totals and months of the topics come to the driver. evolution averages a month's weights with the month before, if the topic had one; overall then
    averages them with the topic's own. Both run over a block's terms at once, month by month, and a task sends on what may be among a month's n_words.
    """
    rows = df.where(F.col("topic") != -1).withColumn("_month", F.col(month).cast("int"))
    made = materialise(counting.met_blocks(rows, text_col, ("topic", "_month"), stopwords, bigrams))
    totals = made.where(F.col("numbers").isNull()).groupBy("own_topic", "own__month").agg(F.sum("n")).collect()  # a row per topic and month
    present = rows.where(F.col("_month").isNotNull()).select("topic", "_month").distinct().collect()  # likewise
    of, months = list(dict.fromkeys(r[0] for r in totals)), sorted({r[1] for r in present})
    place, when = {t: i for i, t in enumerate(of)}, {m: j for j, m in enumerate(months)}
    sizes, cells, there = np.zeros(len(of)), np.zeros((len(of), len(months))), np.zeros((len(of), len(months)), bool)
    for t, m, n in totals:
        sizes[place[t]] += n
        if m is not None:
            cells[place[t], when[m]] = n
    for t, m in present:
        if t in place:
            there[place[t], when[m]] = True
    mean = math.floor(sizes.sum() / len(of)) if of else 0
    schema = StructType([df.schema["topic"], StructField("month", IntegerType()), StructField("term", StringType()), StructField("w", DoubleType())])

    def tuned(topic: np.ndarray, idf: np.ndarray, whole: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """The weights of terms of topics by month; minus infinity where the topic has no text."""
        out, last, state = np.full(tf.shape, -np.inf), np.full(len(topic), -1), np.zeros(len(topic))
        for j, m in enumerate(months):
            at = np.flatnonzero(there[topic, j])
            n = cells[topic[at], j]
            w = np.where(tf[at, j] > 0, tf[at, j] / np.where(n > 0, n, 1) * idf[at], 0.0)
            if evolution and j and months[j - 1] == m - 1:
                w = np.where(last[at] == j - 1, (w + state[at]) / 2, w)
            if overall:
                w = (whole[at] + w) / 2
            out[at, j], last[at], state[at] = w, j, w
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = counting.Best(len(of) * len(months), n_words, digits)
        for words, (topics, at_month), group, first, second, tf, _, f in counting.read_blocks(batches, 2):
            topic = pc.index_in(topics, value_set=pa.array(of, topics.type)).to_numpy()[group]
            j = pc.fill_null(pc.index_in(at_month, value_set=pa.array(months, pa.int32())), -1).to_numpy()[group]
            # a row for each term of a topic
            term = np.cumsum((np.diff(first, prepend=-1) != 0) | (np.diff(second, prepend=-1) != 0)) - 1
            key, row_of, pair = np.unique(term * len(of) + topic, return_index=True, return_inverse=True)
            whole_tf = np.bincount(pair, tf, len(key))
            idf, whose = np.log1p(mean / f[row_of]), topic[row_of]
            whole = whole_tf / sizes[whose] * idf
            order = np.argsort(pair, kind="stable")
            step = max(1, (1 << 21) // max(1, len(months)))
            for a in range(0, len(key), step):
                b = min(a + step, len(key))
                mine = order[np.searchsorted(pair[order], a) : np.searchsorted(pair[order], b)]
                mine = mine[j[mine] >= 0]
                by_month = np.zeros((b - a, len(months)))
                np.add.at(by_month, (pair[mine] - a, j[mine]), tf[mine])
                w = tuned(whose[a:b], idf[a:b], whole[a:b], by_month)
                r, m = np.nonzero(np.isfinite(w))
                kept = best.may_be(whose[a:b][r] * len(months) + m, w[r, m])
                r, m = r[kept], m[kept]
                at = row_of[a + r]
                yield pa.RecordBatch.from_arrays([pa.array(of, topics.type).take(pa.array(whose[a + r])), pa.array(np.array(months, np.int32)[m]), counting.Blocks.spelled(words, first[at], second[at]), pa.array(w[r, m])], schema.names)

    found = made.where(F.col("numbers").isNotNull()).select(*made.columns[:4]).mapInArrow(work, schema)
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("topic", "month").orderBy(F.desc(F.round("w", digits)), "term"))).where(F.col("rank") <= n_words)
    words = best.groupBy("topic", "month").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("words"))
    freq = df.where(F.col("topic") != -1).groupBy("topic", F.col(month).cast("int").alias("month")).agg(F.count("*").alias("freq"))
    return freq.join(words, ["topic", "month"], "left")


def dtm_table(over_time: DataFrame) -> DataFrame:
    """The published layout: Topic, Words, Frequency, Timestamp."""
    return over_time.select(F.col("topic").alias("Topic"), F.array_join("words", ", ").alias("Words"), F.col("freq").alias("Frequency"), F.col("month").alias("Timestamp"))
