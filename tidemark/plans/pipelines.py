"""Whole analyses as compositions of operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import AppConfig
from tidemark.operators import clean, drift, lexicon, sampling, series, topics, trend, validation


def preprocess(raw: DataFrame, app: AppConfig, slang: DataFrame | None = None, min_words: int = 5) -> DataFrame:
    """Raw reviews -> the full table. One lazy plan, whose only shuffle is the removal of copies (the slang lexicon is read first)."""
    df = clean.filter_negative_ratings(raw)
    df = clean.add_relative_time(df, app.launch, window_months=app.window_months, n_weeks=app.n_weeks)
    df = clean.drop_exact_duplicates(df)
    df = clean.apply_normalization(df)
    if slang is not None:
        df = lexicon.normalize_slang(df, slang, "review_id")
    return clean.filter_short(df, min_words=min_words)


def draw_sheet(slim: DataFrame, n_per_stratum: int = 25, seed: int = 42) -> DataFrame:
    """The sheet that people label."""
    return sampling.labelling_sheet(sampling.stratified_sample(slim, "relative_month", "review_id", n_per_stratum, seed))


def check_labels(labeled: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Categories that aren't known."""
    return clean.unexpected_values(labeled, "category", list(categories))


def validate(labeled: DataFrame, population: DataFrame) -> validation.Summary:
    return validation.validation_summary(labeled, population)


class Analysis(NamedTuple):
    frequency: DataFrame
    summary: DataFrame
    semantic: DataFrame
    lexical: DataFrame
    drift: DataFrame
    trend_frequency: DataFrame
    trend_proportion: DataFrame
    comparison: DataFrame


def analyse(docs: DataFrame, app: AppConfig, text_col: str = "review_text_cleaned") -> Analysis:
    """Documents with topic, relative_month, relative_week, text and embedding -> prevalence, drift and trends, without noise."""
    rows = clean.drop_noise(docs)
    freq = series.topic_frequency(rows)
    semantic = drift.similarity_matrix(drift.centroids(rows), app.window_months)
    dtm = topics.dtm_table(topics.topics_over_time(rows, text_col))
    lexical = drift.set_similarity_matrix(drift.word_sets(dtm), app.window_months)
    weekly = series.weekly_series(rows, app.n_weeks)
    by_freq, by_prop = trend.fdr(trend.mann_kendall(weekly)), trend.fdr(trend.mann_kendall(weekly, value="prop"))
    return Analysis(
        freq, series.peak_summary(freq), semantic, lexical,
        drift.drift_table(semantic, lexical, app.semantic_threshold, app.lexical_threshold, app.drift_labels),
        by_freq, by_prop, trend.compare(by_freq, by_prop).orderBy(F.desc("prop_slope")),
    )


def refit_words(docs: DataFrame, text_col: str, stopwords: list[str], n: int = 10) -> DataFrame:
    """Topic words with a longer stop list; assignments don't change."""
    return topics.pruned_top_words(docs.where("topic <> -1"), text_col, n, stopwords=stopwords)
