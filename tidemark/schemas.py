"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Raw reviews as CSV text: date_wib is read as a string, since its offset is dropped and not converted.
RAW_REVIEWS = (
    "review_id string, app_id string, app_name string, user_name_hash string, rating int, review_text string, thumbs_up_count int, "
    "review_created_version string, reply_content string, reply_date timestamp, date_utc timestamp, date_wib string, date_local date, "
    "word_count int, char_count int, scrape_timestamp timestamp"
)
#: What a store's API returns of one review.
FETCHED = "reviewId string, userName string, score int, content string, thumbsUpCount int, reviewCreatedVersion string, replyContent string, repliedAt timestamp, at timestamp"
SLIM_COLUMNS = ("review_id", "review_text_cleaned", "relative_month", "relative_week", "date_wib", "rating")
SLANG_BASE = 'slang string, formal string, `In-dictionary` double'
SLANG_EXT = "slang string, formal string"
PREDICTIONS = "array<struct<lang: string, prob: double>>"


def require(df: DataFrame, *columns: str) -> None:
    """Fail when the plan is built, not when it runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
