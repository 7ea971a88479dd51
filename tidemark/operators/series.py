"""Monthly and weekly topic series. After the first group-by all tables are topics x periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import reltime
from tidemark.schemas import require


def topic_frequency(df: DataFrame, topic: str = "topic", period: str = "relative_month") -> DataFrame:
    """topic, period, freq of the cells that there are."""
    require(df, topic, period)
    return df.groupBy(topic, period).agg(F.count("*").alias("freq"))


def add_proportion(freq: DataFrame, period: str = "relative_month") -> DataFrame:
    """freq / total of the period; noise must be gone before."""
    total = F.sum("freq").over(W.partitionBy(period))
    return freq.withColumn("total", total).withColumn("prop", F.when(total == 0, 0.0).otherwise(F.col("freq") / total))


def dense(freq: DataFrame, periods: int, topic: str = "topic", period: str = "relative_month") -> DataFrame:
    """Every topic that there is in every period 1..periods, zeros filled, with total and prop."""
    spine = freq.select(topic).distinct().select(topic, F.explode(F.sequence(F.lit(1), F.lit(periods))).alias(period))
    full = spine.join(freq.select(topic, period, "freq"), [topic, period], "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    return add_proportion(full, period)


def weekly_series(df: DataFrame, n_weeks: int = 52, topic: str = "topic", week: str = "relative_week") -> DataFrame:
    """The dense series of a table that has weeks; others than 1..n_weeks are dropped."""
    require(df, topic, week)
    return dense(topic_frequency(df.where(F.col(week).between(1, n_weeks)), topic, week), n_weeks, topic, week)


def weekly_series_from_dates(df: DataFrame, launch: dt.date | str, n_weeks: int = 52, topic: str = "topic", date: str = "date") -> DataFrame:
    """The dense series by dates; days after the last week are dropped, not clipped."""
    require(df, topic, date)
    return weekly_series(df.withColumn("relative_week", reltime.relative_week_uncapped(F.col(date), launch)), n_weeks, topic)


def pivot(freq: DataFrame, value: str, columns: int, topic: str = "topic", period: str = "relative_month", prefix: str = "M") -> DataFrame:
    """One row per topic, one zero-filled column per period, Total and Mean over all columns."""
    cell = lambda i: F.coalesce(F.max(F.when(F.col(period) == i, F.col(value))), F.lit(0)).alias(f"{prefix}{i}")
    wide = freq.groupBy(topic).agg(*[cell(i) for i in range(1, columns + 1)])
    total = sum((F.col(f"{prefix}{i}") for i in range(2, columns + 1)), F.col(f"{prefix}1"))
    return wide.withColumn("Total", total).withColumn("Mean", total / columns)


def peak_summary(freq: DataFrame, topic: str = "topic", period: str = "relative_month") -> DataFrame:
    """topic, total_n, peaks by frequency and by proportion (first period on ties), mean proportion over the periods present."""
    p = add_proportion(freq, period)
    return p.groupBy(topic).agg(
        F.sum("freq").alias("total_n"), F.min_by(period, F.struct(-F.col("freq"), F.col(period))).alias("peak_freq_period"), F.max("freq").alias("peak_freq"),
        F.min_by(period, F.struct(-F.col("prop"), F.col(period))).alias("peak_prop_period"), F.max("prop").alias("peak_prop"), F.avg("prop").alias("mean_prop"),
    )


def peak_summary_short(freq: DataFrame, periods: int = 12, topic: str = "topic", period: str = "relative_month") -> DataFrame:
    """topic, total_n, peak_period, peak_freq, avg_per_period: the divisor is always ``periods``."""
    total = F.sum("freq")
    return freq.groupBy(topic).agg(total.alias("total_n"), F.min_by(period, F.struct(-F.col("freq"), F.col(period))).alias("peak_period"), F.max("freq").alias("peak_freq"), F.bround(total / periods, 2).alias("avg_per_period"))


def period_overview(freq: DataFrame, topic: str = "topic", period: str = "relative_month") -> DataFrame:
    """period, n_topics, total."""
    return freq.groupBy(period).agg(F.countDistinct(topic).alias("n_topics"), F.sum("freq").alias("total"))


def max_min_ratio(freq: DataFrame, period: str = "relative_month") -> DataFrame:
    totals = freq.groupBy(period).agg(F.sum("freq").alias("total"))
    return totals.agg((F.max("total") / F.min("total")).alias("ratio"))


def early_late(series: DataFrame, split: int = 26, topic: str = "topic", week: str = "relative_week") -> DataFrame:
    """Per topic: totals, means, maxima of both halves, zero and small weeks, the late share in percent."""
    early, f = F.col(week) <= split, F.col("freq")
    half = lambda cond, name: [F.sum(F.when(cond, f)).alias(f"{name}_total"), F.avg(F.when(cond, f)).alias(f"{name}_mean"), F.max(F.when(cond, f)).alias(f"{name}_max")]
    return series.groupBy(topic).agg(
        *half(early, "early"), *half(~early, "late"), F.count_if(f == 0).alias("zero_weeks"), F.count_if(f < 5).alias("weeks_below_5"),
        F.count_if(~early & (f < 3)).alias("late_weeks_below_3"), (F.sum(F.when(~early, f)) / F.sum(f) * 100).alias("late_pct"),
    )


def spike_weeks(series: DataFrame, times: float = 2.0, topic: str = "topic", week: str = "relative_week") -> DataFrame:
    """topic, week, freq, mean of the weeks above so many times the topic's mean."""
    mean = F.avg("freq").over(W.partitionBy(topic))
    return series.withColumn("mean", mean).where(F.col("freq") > times * F.col("mean")).select(topic, week, "freq", "mean")
