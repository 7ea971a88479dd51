"""Plot-ready tables: what each figure needs, for any plotting tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import drift, series, topics, trend


def small_multiples(freq: DataFrame, labels: dict[int, str]) -> DataFrame:
    """Frequencies with labels and the topic's total."""
    totals = freq.groupBy("topic").agg(F.sum("freq").alias("total_n"))
    return topics.with_labels(freq.join(totals, "topic"), labels)


def proportions(freq: DataFrame, labels: dict[int, str], highlighted: tuple[int, ...] = (), period: str = "relative_month") -> DataFrame:
    return topics.with_labels(series.add_proportion(freq, period), labels).withColumn("is_highlight", F.col("topic").isin(*highlighted) if highlighted else F.lit(False))


def annotations(shares: DataFrame, notes: list[tuple[int, int, str]], period: str = "relative_month", value: str = "prop") -> DataFrame:
    """topic, period, note and the value at which an arrow ends and a vertical line crosses; null where the topic has no such period. notes: (topic, period, note)."""
    marks = shares.sparkSession.createDataFrame(notes, f"topic int, {period} int, note string")
    return marks.join(shares.select("topic", period, value), ["topic", period], "left").select("topic", period, "note", value)


def heatmaps(matrix: DataFrame, labels: dict[int, str]) -> DataFrame:
    return topics.with_labels(drift.colour_range(matrix), labels, prefix="T")


def consecutive_lines(matrix: DataFrame, labels: dict[int, str], highlighted: tuple[int, ...] = ()) -> DataFrame:
    made = topics.with_labels(drift.consecutive(matrix), labels, prefix="T")
    return made.withColumn("is_highlight", F.col("topic").isin(*highlighted) if highlighted else F.lit(False))


def forest(results: DataFrame, labels: dict[int, str]) -> DataFrame:
    """Trend results by falling slope, raw and corrected classes side by side."""
    return topics.with_labels(results, labels).orderBy("slope", "topic")


def trend_lines(weekly: DataFrame, results: DataFrame, labels: dict[int, str], value: str = "freq") -> DataFrame:
    return topics.with_labels(trend.significant_lines(weekly, results, value=value), labels)


def text_bars(shares: DataFrame, pct: str = "pct", per: float = 2.0) -> DataFrame:
    """One block for every ``per`` percent."""
    return shares.withColumn("bar", F.repeat(F.lit("█"), F.floor(F.col(pct) / per).cast("int")))


def threshold_histogram(means: DataFrame, column: str = "mean_cos", bins: int = 20) -> DataFrame:
    return drift.histogram(means.where(F.col(column).isNotNull()), column, bins)


def short_labels(df: DataFrame, n: int = 55) -> DataFrame:
    return df.withColumn("label", text.truncate(F.col("label"), n))
