"""Arriving review files as a stream: the batch operators that keep no history, copies within a watermark, and weekly counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clean


def read_reviews(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def clean_reviews(stream: DataFrame, time: str = "date_utc", text: str = "review_text", delay: str = "7 days", min_words: int = 5) -> DataFrame:
    """Negative ratings, normalised, each text once within the delay, without short texts."""
    df = clean.filter_negative_ratings(stream).withColumn("_hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    df = df.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")
    return clean.filter_short(clean.apply_normalization(df, text), min_words=min_words)


def weekly_counts(stream: DataFrame, launch: dt.date, time: str = "date_utc", topic: str = "topic", delay: str = "7 days") -> DataFrame:
    """week, topic, freq in blocks of seven days from launch; a block is final once the watermark passed it."""
    days = (launch - dt.date(1970, 1, 1)).days % 7
    at = F.window(time, "7 days", startTime=f"{days} days")
    made = stream.withWatermark(time, delay).groupBy(at.alias("w"), topic).agg(F.count("*").alias("freq"))
    week = (F.datediff(F.to_date("w.start"), F.lit(str(launch)).cast("date")) / 7 + 1).cast("int")
    return made.select(week.alias("week"), topic, "freq")
