"""Normalisation, lexicon, relative time: the traps of the parity ledger."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import APPS, stopwords
from tidemark.functions import decide, reltime, text, words
from tidemark.operators import clean, lexicon, topics

CASES = [
    ("Errorrrr!!! v1.3.1 gagal 504", "errorr gagal"),
    ("jam 8pagi error:padahal :v ok xD", "jam agi error adahal ok xd"),
    ("cek bri.co.id lalu login.identitas masuk", "cek lalu masuk"),
    ("Café naïve 😀😀 halooo", "caf na ve haloo"),
    ("gagal.ini bagus.idnya www.x.y", "gagal ini"),
    ("İstanbul ŞŞŞ aaa", "stanbul aa"),
    ("e😀rror", "rror"),
    ("A\n\nB\t cc", "cc"),
    ("", ""),
    (None, ""),
]


def test_normalize(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: (r.c, r.word_count_after) for r in clean.apply_normalization(df, "t", "c").collect()}
    assert [got[i][0] for i in range(len(CASES))] == [b for _, b in CASES]
    assert got[8][1] == got[9][1] == 0


def test_small_functions(spark):
    df = spark.createDataFrame([("Bank A/B", "x" * 90, " a, b ,,c", 3, "__label__id")], "n string, long string, w string, m int, l string")
    r = df.select(
        text.file_name(F.col("n")).alias("f"), text.truncate(F.col("long"), 80).alias("t"), text.split_words(F.col("w")).alias("w"), text.month_label(F.col("m")).alias("m"),
        text.short_label("T", F.col("m")).alias("s"), text.strip_language_label(F.col("l")).alias("l"), text.hash_user(F.lit("")).alias("h"), text.hash_user(F.lit("abc")).alias("h2"),
        text.scrape_word_count(F.lit("don't stop, 2x!")).alias("wc"),
    ).first()
    assert (r.f, len(r.t), r.t[-3:], r.w, r.m, r.s, r.l, r.h, r.h2, r.wc) == ("Bank_A-B", 80, "...", ["a", "b", "c"], "M03", "T3", "id", "", "ba7816bf8f01cfea", 4)


def test_lexicon(spark):
    base = spark.createDataFrame(
        [(0, "same", "same", 1.0), (1, "baru", "baru baru", 1.0), (2, "Nya", "dua-duanya", 1.0), (3, "tf", "transaksi", 0.0), (4, "tf", "kirim", 1.0), (5, "gk", "tidak", None), (6, "gk", None, 1.0), (7, "12", "angka", 1.0)],
        "pos int, slang string, formal string, `In-dictionary` double",
    )
    ext = spark.createDataFrame([(0, "tf", "transfer"), (1, "mbanking", "mobile-banking"), (2, "bca", "bca"), (3, "mbanking", "other")], "pos int, slang string, formal string")
    merged = lexicon.build_lexicon(base, ext)
    assert {r.slang: r.formal for r in merged.collect()} == {"tf": "transfer", "mbanking": "mobile banking", "bca": "bca", "gk": "tidak"}
    assert lexicon.override_count(lexicon.base_lexicon(base), lexicon.extension_lexicon(ext)).first().n_overrides == 1
    df = spark.createDataFrame([(1, "tf gk bisa"), (2, "bca ok"), (3, ""), (4, None)], "id int, t string")
    for most in (20_000, 1):  # a literal map, and a join
        lexicon.MOST_LITERAL, old = most, lexicon.MOST_LITERAL
        got = {r.id: (r.t, r.slang_changed, r.word_count_after) for r in lexicon.normalize_slang(df, merged, "id", "t").collect()}
        lexicon.MOST_LITERAL = old
        assert got == {1: ("transfer tidak bisa", True, 3), 2: ("bca ok", False, 2), 3: ("", False, 0), 4: ("", False, 0)}
    assert [(r.slang, r["count"]) for r in lexicon.slang_triggers(df, merged, "t").collect()] == [("gk", 1), ("tf", 1)]


def test_relative_time(spark):
    days = ["2024-07-05", "2024-08-04 23:59:00", "2024-08-05", "2025-07-04", "2025-07-05", "2024-07-04", None]
    df = spark.createDataFrame([(d,) for d in days], "d string").withColumn("t", F.col("d").cast("timestamp_ntz"))
    at = df.select("d", reltime.relative_month(F.col("t"), "2024-07-05").alias("m"), reltime.relative_week(F.col("t"), "2024-07-05").alias("w"), reltime.relative_week_uncapped(F.col("t"), "2024-07-05").alias("u")).collect()
    assert [(r.m, r.w) for r in at[:6]] == [(1, 1), (1, 5), (2, 5), (12, 52), (13, 52), (1, 0)]
    assert at[3].u == 53 and at[6].m is None
    kept = clean.add_relative_time(df, "2024-07-05", "t")
    assert {r.d for r in kept.collect()} == {days[0], days[1], days[2], days[3]}
    assert clean.add_relative_time(df, "2024-07-05", "t", before_launch=True).count() == 5
    end = spark.createDataFrame([("2025-02-28",), ("2025-02-27",)], "d string").select(reltime.relative_month(F.col("d"), "2025-01-30").alias("m")).collect()
    assert [r.m for r in end] == [2, 1]  # as calendar arithmetic clips to the month's end


def test_wall_clock(spark):
    r = spark.createDataFrame([("2024-07-05T01:02:03+07:00",), ("junk",), (None,)], "s string").select(reltime.wall_clock(F.col("s")).alias("t")).collect()
    assert [x.t for x in r] == [dt.datetime(2024, 7, 5, 1, 2, 3), None, None]


def test_dedup_keeps_earliest(spark):
    df = spark.createDataFrame([("b", "x", 2), ("a", "x", 2), ("c", "x", None), ("d", None, 5), ("e", None, 4)], "review_id string, review_text string, date_wib int")
    assert {r.review_id for r in clean.drop_exact_duplicates(df).collect()} == {"a", "e"}
    assert [(r.review_text, r["count"]) for r in clean.duplicate_texts(df).collect()] == [("x", 3), (None, 2)]


def test_language_tiers(spark):
    rows = [("a", [("id", 0.6)], 1), ("a", [("id", 0.4)], 2), ("a", [("ms", 0.5), ("id", 0.2)], 2), ("a", [("ms", 0.5), ("id", 0.19)], 3), (" ", [("id", 0.9)], 3), ("a", None, 3)]
    df = spark.createDataFrame(rows, "t string, p array<struct<lang: string, prob: double>>, want int")
    assert all(r.want == r.x.lang_tier for r in df.select("want", decide.language_tier(F.col("t"), F.col("p")).alias("x")).collect())
    kept, dropped = clean.filter_language_tier(spark.createDataFrame([(1,), (3,), (None,)], "lang_tier int"))
    assert (kept.count(), dropped.count()) == (1, 2)


def test_columns_are_checked():
    class NoColumns:
        columns = ["a"]

    with pytest.raises(KeyError, match="rating"):
        clean.filter_negative_ratings(NoColumns())
    with pytest.raises(KeyError):
        stopwords("unknown")
    assert stopwords("app1")[-1] == "ya" and len(set(stopwords("app2"))) == len(stopwords("app2"))
    assert APPS["app1"].launch == dt.date(2024, 7, 5)


def test_merge_and_relabel(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([7, 7, 7, 3, 5, 5, -1, 9, 9, 9, 9])], "k int, topic int")
    got = {r.k: r.topic for r in topics.merge_topics(df, [[3, 5]]).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 1, 4: 1, 5: 1, 6: -1, 7: 0, 8: 0, 9: 0, 10: 0}


@pytest.mark.parametrize("most", [20_000, 0])
def test_slang_is_the_same_for_all_sizes(spark, most, monkeypatch):
    """By a literal or by a join: repeated keys, null keys and texts, repeated rows."""
    monkeypatch.setattr(lexicon, "MOST_LITERAL", most)
    words = spark.createDataFrame([("gk", "tidak"), ("tf", "transfer uang"), *((f"k{chr(97 + i)}", f"kata {i}") for i in range(26))], "slang string, formal string")
    df = spark.createDataFrame([(1, "gk bisa"), (1, "gk bisa"), (1, "tf gk tf"), (None, "gk"), (2, None), (3, ""), (4, "ka kz zz")], "id int, t string")
    got = sorted(((r.id, r.t, r.slang_changed, r.word_count_after) for r in lexicon.normalize_slang(df, words, "id", "t").collect()), key=str)
    want = [(1, "tidak bisa", True, 2), (1, "tidak bisa", True, 2), (1, "transfer uang tidak transfer uang", True, 5), (None, "tidak", True, 1), (2, "", False, 0), (3, "", False, 0), (4, "kata 0 kata 25 zz", True, 5)]
    assert got == sorted(want, key=str)


def test_normalisation_in_batches_is_the_expression(spark):
    rng = random.Random(7)
    plain = [*"aabbcxdvpoilnetorg  \n\t\r..//::;=8-^<3()[]{}@|\\'*_!?,#012389éÉßÄÿÑ¿«–’…€", "www.", "http://x", ".com", ".co.id", "xD", "XD", "aaa", "111", "..."]
    odd = ["ſ", "ı", "İ", "K", "²", "ª", " ", "\x1c", "\x85", "̇", "😀", "Σ", " ", "\x0b"]
    rows = [(i, "".join(rng.choice(plain if i % 4 else plain + odd) for _ in range(rng.randrange(50)))) for i in range(3000)] + [(-1, None), (-2, ""), (-3, " \n"), (-4, "a" * 100_000)]
    df = spark.createDataFrame(rows, "i long, t string")
    made = df.select("t", text.normalize_text(F.col("t")).alias("a"), words.normalize_text(F.col("t")).alias("b"))
    assert made.where(~F.col("a").eqNullSafe(F.col("b"))).collect() == [] and made.count() == len(rows)
    empty = clean.apply_normalization(df.limit(0), "t", "c")
    assert empty.count() == 0 and "ArrowEvalPython" in clean.apply_normalization(df, "t", "c")._jdf.queryExecution().executedPlan().toString()


def test_copies_send_their_text_once(spark):
    df = spark.createDataFrame([(2, "a", "x"), (1, "a", "y"), (None, "a", "z"), (5, None, "u"), (4, None, None), (6, "", "v")], "k int, t string, o string")
    made = clean.drop_exact_duplicates(df, "t", ("k",))
    assert made.columns == df.columns and {tuple(r) for r in made.collect()} == {(1, "a", "y"), (4, None, None), (6, "", "v")}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "k, k#" in plan and ", t, t#" not in plan
    assert clean.drop_exact_duplicates(df.select("t"), "t", ("t",)).count() == 3
    top = clean.token_frequencies(df.withColumn("t", F.concat_ws(" ", "t", "t", "o")), "t", 1, ("o",))
    assert "Generate" not in top._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.o, r.token, r["count"]) for r in top.collect()} == {("x", "a", 2), ("y", "a", 2), ("z", "a", 2), ("u", "u", 1), ("v", "v", 1)}
