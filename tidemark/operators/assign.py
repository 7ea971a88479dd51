"""Topic assignment. Embeddings, clusters and languages come from injected models; a Spark ML substitute is supplied.

The substitute stands for manifold reduction and density clustering, which Spark lacks: vectors are normalised, reduced by PCA, clustered by
k-means, and documents far from their centre or in small clusters become noise (-1). Its topics are its own.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import decide
from tidemark.operators import topics


def encoder_udf(encode: Callable[[list[str]], list]):
    """A pandas UDF around encode(texts) -> vectors; set spark.sql.execution.arrow.maxRecordsPerBatch for its batch size."""

    @F.pandas_udf("array<float>")
    def embedding(t: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in encode(t.fillna("").tolist())])

    return embedding


def detect_language(df: DataFrame, predict: Callable[[list[str]], list], text_col: str) -> DataFrame:
    """Adds lang_top, lang_top_conf, lang_tier. predict(texts) gives each text's (language, probability) pairs, best first."""

    @F.pandas_udf("array<struct<lang: string, prob: double>>")
    def three(t: pd.Series) -> pd.Series:
        return pd.Series([[{"lang": a.replace("__label__", ""), "prob": float(b)} for a, b in p[:3]] for p in predict([x.replace("\n", " ") for x in t.fillna("")])])

    made = df.withColumn("_t", decide.language_tier(F.col(text_col), three(F.col(text_col))))
    return made.select(*df.columns, "_t.*")


def language_report(df: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(tier counts, the n most frequent languages)."""
    return df.groupBy("lang_tier").count(), df.groupBy("lang_top").count().orderBy(F.desc("count"), "lang_top").limit(n)


def cluster_topics(df: DataFrame, n_topics: int, min_size: int = 15, components: int = 5, noise_share: float = 0.1, key: str = "doc_id", embedding: str = "embedding", seed: int = 42) -> DataFrame:
    """key, topic: 0 is the largest, -1 noise. Fits models, so it runs jobs."""
    rows = df.select(key, array_to_vector(F.col(embedding).cast("array<double>")).alias("raw"))
    unit = Normalizer(inputCol="raw", outputCol="unit").transform(rows)
    reduced = PCA(k=components, inputCol="unit", outputCol="features").fit(unit).transform(unit).select(key, "features")
    model = KMeans(k=n_topics, seed=seed).fit(reduced)
    centres = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, centre array<double>")
    placed = model.transform(reduced).join(F.broadcast(centres), "prediction")  # n_topics rows
    far = F.aggregate(F.zip_with(vector_to_array("features"), "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    placed = placed.select(key, F.col("prediction").alias("topic"), far.alias("far"))
    limits = placed.groupBy("topic").agg(F.percentile_approx("far", 1 - noise_share, 10_000).alias("limit"), F.count("*").alias("size"))
    made = placed.join(F.broadcast(limits), "topic")
    topic = F.when((F.col("far") > F.col("limit")) | (F.col("size") < min_size), -1).otherwise(F.col("topic"))
    return topics.relabel_by_size(made.select(key, topic.alias("topic")))


def grid_search(df: DataFrame, fit: Callable[..., DataFrame], score: Callable[[DataFrame], float], grid: list[dict], low: int = 15, high: int = 30) -> tuple[list[dict], dict | None]:
    """(a record per combination, the best by score among those with low..high topics, or None). Combinations that can't be fitted have an error."""
    records = []
    for params in grid:
        try:
            made = fit(df, **params)
            n = made.where("topic <> -1").select("topic").distinct().count()
            records.append(params | {"n_topics": n, "score": score(made), "error": None})
        except (ValueError, PySparkException) as e:
            records.append(params | {"n_topics": None, "score": None, "error": str(e)[:200]})
    fit_ = [r for r in records if r["n_topics"] is not None and low <= r["n_topics"] <= high]
    return records, max(fit_, key=lambda r: r["score"], default=None)


def attach_topics(df: DataFrame, assignments: DataFrame, key: str = "doc_id") -> DataFrame:
    """By key, never by place."""
    return df.join(assignments.select(key, "topic"), key)


def topic_share(df: DataFrame) -> DataFrame:
    return df.groupBy("topic").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))
