"""The corpus pipeline (part of the training-data subpackage): STAGES, run() and ORACLE_SQL.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents; the
last returns the pieces of the packed sequences. Columns beside those of documents pass through, whatever their names. The stages set
small Arrow batches in the session (common.lean), as texts are long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import classifier, mixing, near, packing, secrets
from tidemark.llm.common import lean, materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored like others, repeated rows alike, null ids train nothing; no labels: all stay. An empty table stays empty."""
    lean(spark)
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays (null ids last, ties by the whole row's hash). Null texts and those without words all stay, equal rows once. An empty table stays empty."""
    lean(spark)
    return near.keep_one(docs)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, n_chars follows. Null texts stay null, empty ones empty; every row is judged for itself. An empty table stays empty."""
    lean(spark)
    return secrets.redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them, shuffled within their shard. Texts that are null or without words are never taken; a null source is a source; repeated rows share their fate. An empty table stays empty."""
    lean(spark)
    return mixing.apply_mixture(docs, mixing.plan_mixture(docs), shard=None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens, in the order the mix left. Null text is an empty one, which is one end id; a null id stays null; repeated rows are packed each for itself. An empty table gives no pieces."""
    lean(spark)
    return packing.pack(docs)


STAGES = [("quality_classifier", quality), ("ngram_jaccard_join", dedup), ("secret_scan", redaction), ("mixing", mixture), ("packing", packed)]
#: A trained network and hashed draws have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result but the last is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
