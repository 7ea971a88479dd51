"""Reading reviews: CSV with declared schemas, and paging through a store's API by an injected fetch function."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import reltime, text
from tidemark.schemas import FETCHED, RAW_REVIEWS, SLANG_BASE, SLANG_EXT
from tidemark.tables import materialise, new_path

#: Fetched rows that the driver holds before it writes them.
HELD_ROWS = 50_000
CSV = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8"}


def load_raw_reviews(spark: SparkSession, path: str, date: str = "date_wib", schema: str = RAW_REVIEWS) -> DataFrame:
    """Raw reviews; date becomes the local wall clock, null where it can't be parsed."""
    return spark.read.options(**CSV).schema(schema).csv(path).withColumn(date, reltime.wall_clock(F.col(date)))


def unparsed_dates(raw: DataFrame, date: str = "date_wib") -> DataFrame:
    return raw.agg(F.count_if(F.col(date).isNull()).alias("n_unparsed"), F.count("*").alias("n"))


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Any CSV by its schema; a byte-order mark before the first name is dropped by reading columns by place."""
    return spark.read.options(**CSV, enforceSchema=True).schema(schema).csv(path)


def _numbered(df: DataFrame) -> DataFrame:
    """pos: the row's place in its file, for "first wins" rules."""
    return df.withColumn("pos", F.monotonically_increasing_id())


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(load_csv(spark, path, SLANG_BASE))


def load_lexicon_extension(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(load_csv(spark, path, SLANG_EXT))


@dataclass
class Paging:
    """What fetch_pages() saw."""

    stop_reason: str = ""
    batches: int = 0
    total: int = 0
    oldest: dt.datetime | None = None
    newest: dt.datetime | None = None


def fetch_pages(
    fetch: Callable[[object, int], tuple[list[dict], object]], launch: dt.datetime, batch: int = 200, most_batches: int = 10_000, pause: float = 1.5, retry_after: float = 10.0,
    sleep: Callable[[float], None] = time.sleep, keep: Callable[[list[dict]], None] = lambda rows: None,
) -> Paging:
    """Pages newest first until a page is empty or passes launch, there is no token, a fetch fails twice, or most_batches is reached.

    fetch(token, count) returns (rows with an "at" of naive UTC, next token). One app's pages are a sequence, so the driver reads them; keep(rows) takes each page.
    """
    out, token = Paging(), None
    while True:
        if out.batches >= most_batches:
            out.stop_reason = "max_batches"
            return out
        try:
            rows, token = fetch(token, batch)
        except Exception:
            sleep(retry_after)
            try:
                rows, token = fetch(token, batch)
            except Exception as e:
                out.stop_reason = f"fetch_error: {type(e).__name__}"
                return out
        if not rows:
            out.stop_reason = "empty_batch"
            return out
        out.batches += 1
        out.total += len(rows)
        times = [r["at"] for r in rows]
        out.oldest = min(times) if out.oldest is None else min(out.oldest, *times)
        out.newest = max(times) if out.newest is None else max(out.newest, *times)
        keep(rows)
        if out.oldest < launch:
            out.stop_reason = "reached_launch"
            return out
        if token is None:
            out.stop_reason = "no_token"
            return out
        sleep(pause)


def shape_fetched(fetched: DataFrame, app_id: str, app_name: str, launch: dt.datetime, end: dt.datetime, scraped: dt.datetime, timezone: str = "Asia/Jakarta") -> DataFrame:
    """Rows of an API (schemas.FETCHED) -> the raw review table; the window includes both ends, in local time."""
    local = reltime.to_local(F.col("at"), timezone).cast("timestamp_ntz")
    body = F.coalesce("content", F.lit(""))
    made = fetched.withColumn("_local", local).where(F.col("_local").between(F.lit(launch.isoformat(" ")).cast("timestamp_ntz"), F.lit(end.isoformat(" ")).cast("timestamp_ntz")))
    return made.select(
        F.coalesce("reviewId", F.lit("")).alias("review_id"), F.lit(app_id).alias("app_id"), F.lit(app_name).alias("app_name"), text.hash_user(F.col("userName")).alias("user_name_hash"),
        F.col("score").cast("int").alias("rating"), body.alias("review_text"), F.coalesce("thumbsUpCount", F.lit(0)).alias("thumbs_up_count"), F.col("reviewCreatedVersion").alias("review_created_version"),
        F.col("replyContent").alias("reply_content"), F.col("repliedAt").alias("reply_date"), F.col("at").alias("date_utc"), F.col("_local").alias("date_wib"), F.to_date("_local").alias("date_local"),
        text.scrape_word_count(body).alias("word_count"), F.length(body).alias("char_count"), F.lit(scraped).cast("timestamp").alias("scrape_timestamp"),
    )


def _utc_launch(launch: dt.datetime, timezone: str) -> dt.datetime:
    return launch.replace(tzinfo=ZoneInfo(timezone)).astimezone(dt.UTC).replace(tzinfo=None)


def _shaped(rows: DataFrame, pages: Paging, app_id: str, app_name: str, launch: dt.datetime, end: dt.datetime, scraped: dt.datetime, timezone: str) -> tuple[DataFrame, DataFrame]:
    shaped = shape_fetched(rows, app_id, app_name, launch, end, scraped, timezone)
    seen = rows.agg(F.min(reltime.to_local(F.col("at"), timezone)).alias("oldest_review_seen_wib"), F.max(reltime.to_local(F.col("at"), timezone)).alias("newest_review_seen_wib"))
    kept = shaped.agg(F.count("*").cast("int").alias("total_in_window"))
    meta = seen.join(F.broadcast(kept)).select(  # one row each
        F.lit(app_name).alias("app_name"), F.lit(app_id).alias("app_id"), F.lit(pages.stop_reason).alias("stop_reason"), F.lit(pages.batches).alias("batches_fetched"), F.lit(pages.total).alias("total_raw_fetched"),
        "total_in_window", "oldest_review_seen_wib", "newest_review_seen_wib", F.lit(launch).alias("launch_date_wib"), F.lit(end).alias("window_end_wib"),
        F.coalesce(F.col("oldest_review_seen_wib") <= F.lit(launch), F.lit(False)).alias("reached_launch_date"),
    )
    return shaped, meta


def scrape_app(spark: SparkSession, fetch, app_id: str, app_name: str, launch: dt.datetime, end: dt.datetime, scraped: dt.datetime, timezone: str = "Asia/Jakarta", **paging) -> tuple[DataFrame, DataFrame]:
    """(raw reviews in the window, one row of metadata). Fetched rows go to the shared folder, HELD_ROWS at a time."""
    names, path, held = [c.split()[0] for c in FETCHED.split(", ")], new_path(spark), []

    def write() -> None:
        spark.createDataFrame([tuple(r.get(c) for c in names) for r in held], FETCHED).write.mode("append").parquet(path)
        held.clear()

    def keep(page: list[dict]) -> None:
        held.extend(page)
        if len(held) >= HELD_ROWS:
            write()

    pages = fetch_pages(fetch, _utc_launch(launch, timezone), keep=keep, **paging)
    write()
    return _shaped(spark.read.schema(FETCHED).parquet(path), pages, app_id, app_name, launch, end, scraped, timezone)


def fetch_table(store: DataFrame, launch: dt.datetime, batch: int, tie: str) -> tuple[Paging, DataFrame]:
    """What fetch_pages() sees of a store that is a table with "at", and the rows of its pages; no row passes through the driver.

    Pages are newest first, ties by falling tie; rows without a time come last. The pages up to launch hold every row from launch on, and the last is filled
    with the newest of the others: only these, at most batch, are put in order. There is no API to spare, so no limit of pages. Runs a job.
    """
    at = F.col("at").cast("timestamp_ntz")
    from_launch = at >= F.lit(launch.isoformat(" ")).cast("timestamp_ntz")
    seen = store.agg(F.count("*").alias("n"), F.count_if(from_launch).alias("newer"), F.count_if(~from_launch).alias("older"), F.min(at).alias("oldest"), F.max(at).alias("newest")).first()
    if not seen.older:
        return Paging("empty_batch", -(-seen.n // batch), seen.n, seen.oldest, seen.newest), store
    batches = seen.newer // batch + 1  # the first row past launch ends its page
    rest = min(batches * batch, seen.n) - seen.newer
    last = store.where(~F.coalesce(from_launch, F.lit(False))).orderBy(F.desc_nulls_last("at"), F.desc(tie)).limit(rest)
    rows = materialise(store.where(from_launch).unionByName(last))
    oldest = rows.agg(F.min(at)).first()[0]
    return Paging("reached_launch", batches, seen.newer + rest, oldest, seen.newest), rows


def scrape_table(store: DataFrame, app_id: str, app_name: str, launch: dt.datetime, end: dt.datetime, scraped: dt.datetime, timezone: str = "Asia/Jakarta", batch: int = 200, tie: str = "reviewId") -> tuple[DataFrame, DataFrame]:
    """scrape_app() of a store that is a table: columns of FETCHED (those it lacks are null) and tie. The same pages, stop and results; the work is shared by all tasks."""
    pages, rows = fetch_table(store, _utc_launch(launch, timezone), batch, tie)
    names = [c.split() for c in FETCHED.split(", ")]
    rows = rows.select(*[(F.col(c) if c in store.columns else F.lit(None)).cast(kind).alias(c) for c, kind in names])
    return _shaped(rows, pages, app_id, app_name, launch, end, scraped, timezone)


def acquire(results: Iterable[tuple[DataFrame, DataFrame]], path: str, metadata_path: str) -> DataFrame | None:
    """Writes every app's rows under path by app_id, and all metadata. Returns the metadata; None for no app."""
    meta = None
    for rows, one in results:
        if not rows.isEmpty():
            rows.write.mode("append").partitionBy("app_id").parquet(path)
        meta = one if meta is None else meta.unionByName(one)
    if meta is not None:
        meta.write.mode("overwrite").parquet(metadata_path)
    return meta


def scrape_summary(raw: DataFrame) -> DataFrame:
    """app_id, rating counts, dates, short reviews."""
    stars = [F.count_if(F.col("rating") == r).alias(f"rating_{r}") for r in range(1, 6)]
    return raw.groupBy("app_id").agg(*stars, F.min("date_wib").alias("first"), F.max("date_wib").alias("last"), F.count_if(F.col("word_count") < 5).alias("below_5_words"), F.count_if(F.col("word_count") < 10).alias("below_10_words"))
