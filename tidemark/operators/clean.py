"""Filters, de-duplication and the counts that go with them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import reltime, text, words
from tidemark.operators import counting
from tidemark.schemas import require


def filter_negative_ratings(df: DataFrame, rating: str = "rating", keep: tuple[int, ...] = (1, 2)) -> DataFrame:
    require(df, rating)
    return df.where(F.col(rating).isin(*keep))


def histogram(df: DataFrame, column: str, nulls: bool = False) -> DataFrame:
    """column, count; largest first, then by value."""
    rows = df if nulls else df.where(F.col(column).isNotNull())
    return rows.groupBy(column).count().orderBy(F.desc("count"), column)


def add_relative_time(df: DataFrame, launch: dt.date | str, date: str = "date_wib", window_months: int = 12, n_weeks: int = 52, before_launch: bool = False) -> DataFrame:
    """Adds relative_month and relative_week (clipped) and keeps the window's rows. Rows without a date go, as do those before launch unless asked for."""
    require(df, date)
    at = F.col(date)
    timed = df.where(at.isNotNull()).withColumns({"relative_month": reltime.relative_month(at, launch), "relative_week": reltime.relative_week(at, launch, n_weeks)})
    kept = timed.where(F.col("relative_month").between(1, window_months))
    return kept if before_launch else kept.where(F.to_date(at) >= reltime.launch_date(launch))


def drop_exact_duplicates(df: DataFrame, text: str = "review_text", order: tuple[str, ...] = ("date_wib", "review_id")) -> DataFrame:
    """The first row, by order, of each text; null texts are equal. One aggregation, which combines before the shuffle, so hot texts are not gathered."""
    require(df, text, *order)
    first = F.min_by(F.struct(*[F.col(c) for c in df.columns if c != text], F.lit(0)), F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order]))
    return df.groupBy(text).agg(first.alias("_row")).select(*[text if c == text else F.col("_row")[c].alias(c) for c in df.columns])  # the text travels once


def duplicate_texts(df: DataFrame, text: str = "review_text", n: int = 5) -> DataFrame:
    """text, count of the n most repeated texts."""
    return df.groupBy(text).count().where(F.col("count") > 1).orderBy(F.desc("count"), text).limit(n)


def apply_normalization(df: DataFrame, text_col: str = "review_text", output: str = "review_text_cleaned") -> DataFrame:
    require(df, text_col)
    return df.withColumn(output, words.normalize_text(F.col(text_col))).withColumn("word_count_after", text.token_count(F.col(output)))


def filter_short(df: DataFrame, text_col: str = "review_text_cleaned", min_words: int = 5) -> DataFrame:
    """Recounts the words and keeps rows with at least min_words."""
    require(df, text_col)
    return df.withColumn("word_count_after", text.token_count(F.col(text_col))).where(F.col("word_count_after") >= min_words)


def filter_language_tier(df: DataFrame, keep: tuple[int, ...] = (1, 2), tier: str = "lang_tier") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped)."""
    require(df, tier)
    fits = F.coalesce(F.col(tier).isin(*keep), F.lit(False))
    return df.where(fits), df.where(~fits)


def drop_noise(df: DataFrame, topic: str = "topic") -> DataFrame:
    return df.where(F.col(topic) != -1)


def slim(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The wanted columns that there are."""
    return df.select(*[c for c in columns if c in df.columns])


def reorder(df: DataFrame, *first: str) -> DataFrame:
    require(df, *first)
    return df.select(*first, *[c for c in df.columns if c not in first])


def contains(c: Column, pattern: str) -> Column:
    """Null doesn't contain anything."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def word_stats(df: DataFrame, column: str = "word_count_after") -> DataFrame:
    """One row: mean, exact median, maximum, empty."""
    c = F.col(column)
    return df.agg(F.avg(c).alias("mean_words"), F.expr(f"percentile(`{column}`, 0.5)").alias("median_words"), F.max(c).alias("max_words"), F.count_if(c == 0).alias("n_empty"))


def length_description(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, sample deviation, minimum, quartiles, maximum of the text's length."""
    rows = df.select(F.length(column).alias("v")).where(F.col("v").isNotNull())
    q = lambda p: F.expr(f"percentile(v, {p})")
    return rows.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max("v").alias("max"))


def null_counts(df: DataFrame, *columns: str) -> DataFrame:
    """One row per column: nulls and empty strings."""
    made = df.agg(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(F.col(c).cast("string") == "").alias("n_empty")).alias(f"_{i}") for i, c in enumerate(columns)])
    return made.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))])))


def token_frequencies(df: DataFrame, text_col: str, n: int = 100, by: tuple[str, ...] = ()) -> DataFrame:
    """The n most frequent tokens, of each group if by is given; ties by token."""
    counted = counting.part_counts(df, text_col, by, bigrams=False).groupBy(*by, F.col("term").alias("token")).agg(F.sum("tf").alias("count"))
    if not by:
        return counted.orderBy(F.desc("count"), "token").limit(n)
    return counted.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("count"), "token"))).where(F.col("rank") <= n)


def vocabulary_size(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.explode(text.tokens(F.col(text_col))).alias("token")).groupBy("token").count().agg(F.count("*").alias("unique_tokens"), F.sum("count").alias("total_tokens"))


def unexpected_values(df: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """Distinct values that are not expected."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*expected)).select(column).distinct()


def extremes(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: the keys of the least and the greatest value, the first key on ties."""
    return df.agg(F.min_by(key, F.struct(value, key)).alias("min_key"), F.min(value).alias("min_value"), F.min_by(key, F.struct(-F.col(value), F.col(key))).alias("max_key"), F.max(value).alias("max_value"))
