import csv
import datetime as dt

import duckdb
from pyspark.sql import functions as F

from tidemark.config import APPS
from tidemark.operators import assign
from tidemark.plans import catalog, pipelines
from tidemark.sources import outputs, reviews
from tidemark.streaming import reviews as stream


def test_paging_stops():
    at = dt.datetime(2024, 7, 10)
    pages = [[{"at": at}], [{"at": at - dt.timedelta(days=1)}], []]
    fetch = lambda token, n: (pages[token or 0], (token or 0) + 1)
    launch = dt.datetime(2024, 7, 5)
    assert reviews.fetch_pages(fetch, launch, sleep=lambda s: None).stop_reason == "empty_batch"
    assert reviews.fetch_pages(fetch, at, sleep=lambda s: None).stop_reason == "reached_launch"
    assert reviews.fetch_pages(fetch, launch, most_batches=1, sleep=lambda s: None).stop_reason == "max_batches"
    assert reviews.fetch_pages(lambda t, n: (pages[0], None), launch, sleep=lambda s: None).stop_reason == "no_token"
    waits = []

    def broken(token, n):
        raise OSError

    assert reviews.fetch_pages(broken, launch, sleep=waits.append).stop_reason == "fetch_error: OSError" and waits == [10.0]


def test_scrape_window_and_round_trip(spark, tmp_path):
    launch, end = dt.datetime(2024, 7, 5), dt.datetime(2024, 7, 6)
    row = lambda i, at, **k: {"reviewId": i, "userName": "u", "score": 1, "content": 'a "b",\nc', "at": at} | k
    utc = dt.datetime(2024, 7, 4, 17)  # midnight in Jakarta
    rows = [row("end", dt.datetime(2024, 7, 5, 17)), row("in", utc, content=None, userName=None), row("before", utc - dt.timedelta(seconds=1))]
    raw, meta = reviews.scrape_app(spark, lambda t, n: (rows, None), "id", "App", launch, end, end, sleep=lambda s: None)
    got = {r.review_id: r for r in raw.collect()}
    assert set(got) == {"end", "in"} and got["in"].review_text == "" and got["in"].user_name_hash == "" and got["in"].date_wib == launch and got["end"].word_count == 3
    m = meta.first()
    assert (m.stop_reason, m.total_raw_fetched, m.total_in_window, m.reached_launch_date) == ("reached_launch", 3, 2, True)
    outputs.save_csv(raw, str(tmp_path / "raw"))
    back = {r.review_id: r for r in reviews.load_raw_reviews(spark, str(tmp_path / "raw")).collect()}
    assert back["end"].review_text == 'a "b",\nc' and back["in"].date_wib == launch
    assert reviews.acquire([(raw, meta)], str(tmp_path / "all"), str(tmp_path / "meta")).count() == 1
    assert spark.read.parquet(str(tmp_path / "all")).count() == 2


def test_preprocess_and_outputs(spark, tmp_path):
    rows = [("r1", 1, "tidak bisa login sama sekali hari ini", "2024-07-06 10:00:00"), ("r2", 1, "tidak bisa login sama sekali hari ini", "2024-07-07 10:00:00"), ("r3", 5, "bagus sekali aplikasi ini saya suka", "2024-07-06 10:00:00"), ("r4", 2, "gagal", "2024-07-06 10:00:00"), ("r5", 2, None, "2024-07-06 10:00:00")]
    raw = spark.createDataFrame(rows, "review_id string, rating int, review_text string, d string").withColumn("date_wib", F.col("d").cast("timestamp_ntz")).drop("d")
    full = pipelines.preprocess(raw, APPS["app1"])
    assert [r.review_id for r in full.collect()] == ["r1"]
    assert outputs.save_outputs(full.drop("rating"), str(tmp_path / "slim"), str(tmp_path / "full")) == ["rating"]
    assert outputs.save_spreadsheet(full.select("review_id"), str(tmp_path / "s.csv")) == 1
    assert (tmp_path / "s.csv").read_text(encoding="utf-8-sig") == "review_id\nr1\n"
    assert reviews.load_csv(spark, str(tmp_path / "s.csv"), "review_id string").first().review_id == "r1"
    assert outputs.backup(spark, str(tmp_path / "s.csv"), str(tmp_path / "old.csv")) and not outputs.backup(spark, str(tmp_path / "none"), str(tmp_path / "x"))


def test_embedding_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab"), (2, "c"), (3, None)], "id int, text string")
    seen = spark.sparkContext.accumulator(0)

    def encode(texts):
        seen.add(len(texts))
        return [[float(len(t))] for t in texts]

    udf = assign.encoder_udf(encode)
    for n in (3, 3):
        got = outputs.cached_embeddings(df, udf, str(tmp_path / "c"), "m")
        assert {r.id: r.embedding for r in got.collect()} == {1: [2.0], 2: [1.0], 3: [0.0]}
        assert seen.value == n


def test_clusters_and_grid(spark):
    rows = [(i, [1.0 + i % 5 / 100, 0.0, 0.0] if i % 3 else [0.0, 1.0, i % 7 / 100]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id int, embedding array<double>")
    made = assign.cluster_topics(df, 2, min_size=5, components=2)
    sizes = {r.topic: r["count"] for r in made.groupBy("topic").count().collect()}
    assert sum(sizes.values()) == 90 and sizes[0] >= sizes[1] > 20
    records, best = assign.grid_search(df, lambda d, k: assign.cluster_topics(d, k, 5, 2), lambda m: 1.0, [{"k": 2}, {"k": 0}], 1, 5)
    assert best["k"] == 2 and records[1]["error"]


def test_language_detection(spark):
    df = spark.createDataFrame([("halo\napa",), ("",)], "t string")
    got = assign.detect_language(df, lambda ts: [[("__label__id", 0.9), ("__label__en", 0.1)] for _ in ts], "t").collect()
    assert [(r.lang_top, r.lang_tier) for r in got] == [("id", 1), ("", 3)]


def test_streaming(spark, tmp_path):
    schema = "review_id string, rating int, review_text string, topic int, date_utc timestamp"
    t = dt.datetime(2024, 7, 6)
    rows = [("a", 1, "satu dua tiga empat lima", 0, t), ("b", 1, "satu dua tiga empat lima", 0, t), ("c", 1, "pendek", 0, t), ("d", 2, "enam tujuh delapan sembilan sepuluh", 1, t + dt.timedelta(days=8))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = stream.clean_reviews(stream.read_reviews(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    got = [r.review_id for r in spark.table("cleaned").collect()]
    assert len(got) == 2 and "d" in got
    q = stream.weekly_counts(stream.read_reviews(spark, str(tmp_path / "in"), schema), dt.date(2024, 7, 5)).writeStream.outputMode("complete").format("memory").queryName("weeks").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.week, r.topic): r.freq for r in spark.table("weeks").collect()} == {(1, 0): 3, (2, 1): 1}


def test_paging_stops_at_launch_in_any_time_zone(spark):
    launch = dt.datetime(2024, 3, 31, 0, 0)
    for zone, hours in (("America/New_York", -4), ("Asia/Jakarta", 7), ("UTC", 0)):
        utc = launch - dt.timedelta(hours=hours)
        pages = [[{"reviewId": str(i), "at": utc + dt.timedelta(minutes=30 - 20 * i)}] for i in range(6)]
        raw, meta = reviews.scrape_app(spark, lambda t, n: (pages[t or 0], (t or 0) + 1), "a", "A", launch, launch + dt.timedelta(days=1), launch, zone, sleep=lambda s: None)  # noqa: B023
        assert (meta.first().stop_reason, meta.first().batches_fetched) == ("reached_launch", 3) and {r.review_id for r in raw.collect()} == {"0", "1"}, zone


def test_spreadsheet_of_any_size(spark, tmp_path):
    path = str(tmp_path / "big.csv")
    assert outputs.save_spreadsheet(spark.range(100_002).withColumn("b", F.col("id") % 3), path) == 100_002
    assert reviews.load_csv(spark, path, "id long, b long").agg(F.count("*"), F.sum("id"), F.sum("b")).first() == (100_002, 100_002 * 100_001 // 2, 100_002)
    rows = [(i, None if i % 5 == 0 else 'a "b",\nc' if i % 2 else " é", i / 3 if i % 4 else 1e-7, i % 3 == 0, dt.datetime(2024, 1, 1, 0, 0, i % 60)) for i in range(2500)]
    assert outputs.save_spreadsheet(spark.createDataFrame(rows, "i int, t string, d double, b boolean, at timestamp_ntz").repartitionByRange(3, "i").sortWithinPartitions("i"), path) == 2500
    with open(path, encoding="utf-8-sig", newline="") as f:
        assert list(csv.reader(f)) == [["i", "t", "d", "b", "at"], *[["" if v is None else str(v) for v in r] for r in rows]]
    assert outputs.save_spreadsheet(spark.range(0), path) == 0 and (tmp_path / "big.csv").read_text(encoding="utf-8-sig") == "id\n"


def _order_rows(spark, path, days):
    at = dt.datetime(1999, 1, 5)
    rows = [(i, i % 4, at + dt.timedelta(days=d), f"{i % 5 + 1}-P", "O") for i, d in enumerate(days)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string, o_orderstatus string").write.parquet(f"{path}/orders.parquet")


def test_scrape_queries_page_without_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "PAGE", 3)
    for case, days in {"past": [5, 1, 1, 1, 0, -5, -5, -5, -6, 400, 30], "whole pages": [3, 2, 1, -5, -6, -7], "none past": [4, 3, 2, 1], "all past": [-5, -9]}.items():
        _order_rows(spark, tmp_path / case, days)
        for name in ("scraped_reviews", "scrape_metadata", "scrape_report"):
            if case == "all past" and name == "scrape_report":
                continue  # nothing is written, so nothing can be read
            got = [tuple(r) for r in getattr(catalog, name)(spark, str(tmp_path / case)).collect()]
            want = duckdb.connect().execute(catalog.ORACLE[name].replace("4000", "3").replace("FROM orders", f"FROM '{tmp_path}/{case}/orders.parquet/*.parquet'")).fetchall()
            assert sorted(got) == sorted(want), (case, name)
    _order_rows(spark, tmp_path / "many", range(300))
    spark.sparkContext.setJobGroup("many", "")
    assert catalog.scraped_reviews(spark, str(tmp_path / "many")).count() == 300
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("many")) < 20  # 100 pages
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_table_is_paged_as_an_api_is(spark):
    launch = dt.datetime(2024, 7, 5)
    for n, zone in ((0, "UTC"), (5, "Asia/Jakarta"), (23, "America/New_York"), (23, "UTC")):
        rows = [{"reviewId": f"{i:02}", "userName": "u", "score": i % 5, "content": "a b", "at": launch + dt.timedelta(hours=6 * (12 - i // 2))} for i in range(n)]
        order = sorted(rows, key=lambda r: (r["at"], r["reviewId"]), reverse=True)
        raw, meta = reviews.scrape_app(spark, lambda t, k: (order[t or 0 : (t or 0) + k], (t or 0) + k), "a", "A", launch, launch + dt.timedelta(days=2), launch, zone, batch=4, sleep=lambda s: None)  # noqa: B023
        store = spark.createDataFrame([tuple(r.values()) for r in rows], "reviewId string, userName string, score int, content string, at timestamp")
        raw2, meta2 = reviews.scrape_table(store, "a", "A", launch, launch + dt.timedelta(days=2), launch, zone, batch=4)
        assert sorted(map(str, raw2.collect())) == sorted(map(str, raw.collect())) and meta2.collect() == meta.collect() and meta2.schema == meta.schema
