"""Semantic and lexical drift between months: centroids, word sets and their cosines. Tables are long: one row per cell, absent cells have no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import DRIFT_LABELS
from tidemark.functions import decide, text


def rounded(c: Column, digits: int = 4) -> Column:
    """Half to even; what rounds to zero from below stays -0.0, which reports show."""
    return F.when(c < 0, -F.bround(-c, digits)).otherwise(F.bround(c, digits))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; 0 if one of them is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def centroids(df: DataFrame, topic: str = "topic", month: str = "relative_month", embedding: str = "embedding", dim: int | None = None) -> DataFrame:
    """topic, month, n, vec: means by element. dim, if not given, is read from the table first, so that all elements are plain averages in one aggregation.

    Null and empty vectors count as rows and add nothing to the mean. ValueError for vectors of several lengths, or not of dim: they have no mean.
    """
    lengths = df.select(F.size(embedding).alias("n")).where(F.col("n") > 0).agg(F.min("n"), F.max("n")).first()
    if lengths[0] != lengths[1] or dim not in (None, lengths[0]) and lengths[0] is not None:
        raise ValueError(f"vectors of {lengths[0]} to {lengths[1]} elements" + (f", not {dim}" if dim else ""))
    dim = dim or lengths[0] or 0
    means = [F.avg(F.get(embedding, F.lit(i)).cast("double")) for i in range(dim)]
    vec = F.array(*means) if means else F.array().cast("array<double>")
    return df.groupBy(F.col(topic).alias("topic"), F.col(month).alias("month")).agg(F.count("*").alias("n"), vec.alias("vec"))


def similarity_matrix(cells: DataFrame, n_months: int = 12) -> DataFrame:
    """topic, m1, m2, cos of all month pairs of each topic (n_months squared rows); null where a month is absent."""
    spine = cells.select("topic").distinct().select("topic", F.explode(F.sequence(F.lit(1), F.lit(n_months))).alias("m1")).select("topic", "m1", F.explode(F.sequence(F.lit(1), F.lit(n_months))).alias("m2"))
    side = lambda k: cells.select("topic", F.col("month").alias(f"m{k}"), F.col("vec").alias(f"v{k}"))
    return spine.join(side(1), ["topic", "m1"], "left").join(side(2), ["topic", "m2"], "left").select("topic", "m1", "m2", cosine(F.col("v1"), F.col("v2")).alias("cos"))


def consecutive(matrix: DataFrame) -> DataFrame:
    """topic, m1, m2 = m1 + 1, cos."""
    return matrix.where(F.col("m2") == F.col("m1") + 1)


def word_sets(dtm: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """Topic, Words, Timestamp -> topic, month, words: sets without noise; words outside a given vocabulary are ignored."""
    words = F.array_distinct(text.split_words(F.col("Words")))
    if vocabulary is not None:
        words = F.array_intersect(words, F.array(*[F.lit(w) for w in vocabulary]))
    rows = dtm.where(F.col("Topic") != -1).select(F.col("Topic").alias("topic"), F.col("Timestamp").alias("month"), words.alias("words"))
    return rows.groupBy("topic", "month").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"))


def vocabulary(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("words").alias("word")).distinct().orderBy("word")


def set_similarity_matrix(sets: DataFrame, n_months: int = 12) -> DataFrame:
    """topic, m1, m2, cos of binary word vectors; null where a month is absent or has no words."""
    spine = sets.select("topic").distinct().select("topic", F.explode(F.sequence(F.lit(1), F.lit(n_months))).alias("m1")).select("topic", "m1", F.explode(F.sequence(F.lit(1), F.lit(n_months))).alias("m2"))
    side = lambda k: sets.where(F.size("words") > 0).select("topic", F.col("month").alias(f"m{k}"), F.col("words").alias(f"w{k}"))
    both = spine.join(side(1), ["topic", "m1"], "left").join(side(2), ["topic", "m2"], "left")
    cos = F.size(F.array_intersect("w1", "w2")) / (F.sqrt(F.size("w1").cast("double")) * F.sqrt(F.size("w2").cast("double")))
    return both.select("topic", "m1", "m2", F.when(F.col("w1").isNotNull() & F.col("w2").isNotNull(), cos).alias("cos"))


def mean_similarity(matrix: DataFrame) -> DataFrame:
    """topic, mean_cos off the diagonal without nulls."""
    return matrix.groupBy("topic").agg(F.avg(F.when(F.col("m1") != F.col("m2"), F.col("cos"))).alias("mean_cos"))


def month_means(matrix: DataFrame) -> DataFrame:
    return matrix.where(F.col("m1") != F.col("m2")).groupBy("topic", F.col("m1").alias("month")).agg(F.avg("cos").alias("month_mean")).where(F.col("month_mean").isNotNull())


def outlier_months(matrix: DataFrame, drop: float = 0.05) -> DataFrame:
    """topic, outliers ARRAY<STRUCT<month, mean>>: months whose mean is more than drop below the topic's."""
    odd = month_means(matrix).join(mean_similarity(matrix), "topic").where(F.col("month_mean") < F.col("mean_cos") - drop)
    found = odd.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("month", rounded(F.col("month_mean")).alias("mean")))).alias("outliers"))
    return matrix.select("topic").distinct().join(found, "topic", "left").select("topic", F.coalesce("outliers", F.array()).alias("outliers"))


def drift_table(semantic: DataFrame, lexical: DataFrame, t1: float = 0.95, t2: float = 0.60, labels: tuple[str, str, str, str] = DRIFT_LABELS) -> DataFrame:
    """topic, d1_mean, d2_mean (4 digits), pattern by the rounded means."""
    d1 = mean_similarity(semantic).select("topic", rounded(F.col("mean_cos")).alias("d1_mean"))
    d2 = mean_similarity(lexical).select("topic", rounded(F.col("mean_cos")).alias("d2_mean"))
    return d1.join(d2, "topic").withColumn("pattern", decide.drift_pattern(F.col("d1_mean"), F.col("d2_mean"), t1, t2, labels))


def histogram(values: DataFrame, column: str, bins: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """bin, n: equal widths; the last bin holds the upper end."""
    at = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return values.where(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def colour_range(matrix: DataFrame) -> DataFrame:
    """Adds the least and greatest cosine of the whole table, for one colour scale."""
    every = W.partitionBy()
    return matrix.withColumn("min_cos", F.min("cos").over(every)).withColumn("max_cos", F.max("cos").over(every))
