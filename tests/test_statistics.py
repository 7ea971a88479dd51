"""Series, validation, trends and drift against plain restatements."""

import math
import random
from statistics import NormalDist, median

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR
from tidemark.config import TECHNICAL
from tidemark.functions import decide, words
from tidemark.operators import coherence, counting, drift, sampling, series, topics, trend, validation
from tidemark.plans import catalog, pipelines


def plain_hamed_rao(x, alpha=0.05):
    n = len(x)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    s = sum((x[j] > x[i]) - (x[j] < x[i]) for i, j in pairs)
    slope = median((x[j] - x[i]) / (j - i) for i, j in pairs)
    ties = sum(t * (t - 1) * (2 * t + 5) for t in (x.count(v) for v in set(x)))
    var0 = (n * (n - 1) * (2 * n + 5) - ties) / 18
    y = [v - slope * i for i, v in enumerate(x)]
    rank = [sum(b < a for b in y) + (sum(b == a for b in y) + 1) / 2 for a in y]
    d = [r - sum(rank) / n for r in rank]
    c0 = sum(v * v for v in d)
    bound, corr = NormalDist().inv_cdf(1 - alpha / 2) / math.sqrt(n), 0.0
    for k in range(1, n):
        rho = sum(d[i] * d[i + k] for i in range(n - k)) / c0
        if abs(rho) > bound:
            corr += (n - k) * (n - k - 1) * (n - k - 2) * rho
    var = var0 * (1 + 2 / (n * (n - 1) * (n - 2)) * corr)
    z = 0.0 if s == 0 else (s - math.copysign(1, s)) / math.sqrt(var) if var > 0 else None
    return s, slope, var0, var, z


def test_mann_kendall(spark):
    rng = random.Random(5)
    kinds = {1: [4.0] * 52, 2: [float(i % 2) for i in range(52)], 3: [float(i) for i in range(52)], 4: [float(rng.random() < 0.2) * rng.randrange(3) for _ in range(52)], 5: [rng.gauss(i / 20, 1) for i in range(52)], 6: [float(rng.randrange(6)) for _ in range(52)]}
    df = spark.createDataFrame([(t, w + 1, v) for t, x in kinds.items() for w, v in enumerate(x)], "topic int, relative_week int, freq double")
    got = {r.topic: r for r in trend.mann_kendall(df).collect()}
    for t in (1, 2):
        assert got[t].trend == "insufficient_variance" and got[t].classification == "stable" and got[t].p is None
    assert got[3].trend == "increasing" and got[3].tau == 1.0
    for t in (4, 5, 6):
        s, slope, _, var, z = plain_hamed_rao(kinds[t])
        assert got[t].s == s and got[t].slope == pytest.approx(slope) and got[t].var_s == pytest.approx(var)
        if z is not None:
            assert got[t].z == pytest.approx(z) and got[t].p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_fdr(spark):
    p = [0.04, 0.001, 0.2, 0.03, 0.5, 0.03, None]
    df = spark.createDataFrame([(i, v, 0.0 if i == 1 else 1.0) for i, v in enumerate(p)], "topic int, p double, slope double")
    got = {r.topic: r for r in trend.fdr(df).collect()}
    assert [got[i].p_adj for i in range(6)] == pytest.approx([0.06, 0.006, 0.24, 0.06, 0.5, 0.06])
    assert got[6].p_adj is None and got[6].classification_fdr == "stable"
    assert got[1].classification_fdr == "declining"  # a significant slope of 0
    assert df.where("topic = 1").select(decide.final_class(F.lit("declining"), F.col("slope"), F.lit(True)).alias("c")).first().c == "Stable (practically)"


def test_cochran_without_a_stratum(spark):
    population = spark.createDataFrame([(1,)] * 60 + [(2,)] * 30 + [(3,)] * 10, "relative_month int")
    labeled = spark.createDataFrame([(1, "Bug Report")] * 3 + [(1, "Rating (Praise/Dispraise)")] + [(2, "Bug Report")] * 2, "relative_month int, category string")
    s = validation.validation_summary(labeled, population)
    got = {r.category: r for r in s.per_category.collect()}
    assert got["Bug Report"].weighted_pct == pytest.approx(75 * 0.6 + 30) and got["Rating (Praise/Dispraise)"].weighted_pct == pytest.approx(15)
    assert sum(r.weighted_pct for r in got.values()) == pytest.approx(90)
    head = {r.metric: r.value for r in validation.headline(s).collect()}
    assert head["Raw Validity %"] == pytest.approx(83.33) and head["Strata"] == 2 and len(head) == 9
    assert set(TECHNICAL) & set(got) == {"Bug Report"}


def test_stratified_sample(spark):
    df = spark.range(400).select("id", (F.col("id") % 4).alias("m"))
    a = [r.id for r in sampling.stratified_sample(df, "m", "id", 25).collect()]
    b = [r.id for r in sampling.stratified_sample(df.repartition(7), "m", "id", 25).collect()]
    assert a == b and len(set(a)) == 100 and all(sum(i % 4 == m for i in a) == 25 for m in range(4)) and a != sorted(a)
    with pytest.raises(ValueError, match="fewer than 101"):
        sampling.stratified_sample(df, "m", "id", 101)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-2, 9)), min_size=1, max_size=40))
def test_dense_series(spark, rows):
    df = spark.createDataFrame(rows, "topic int, relative_week int")
    kept = [r for r in rows if 1 <= r[1] <= 6]
    got = series.weekly_series(df, 6).collect()
    assert len(got) == 6 * len({t for t, _ in kept})
    assert sum(r.freq for r in got) == len(kept)
    for w in range(1, 7):
        total = sum(r.prop for r in got if r.relative_week == w)
        assert total == pytest.approx(1) or total == 0


def test_peaks_and_means(spark):
    freq = spark.createDataFrame([(0, 1, 5), (0, 3, 5), (1, 1, 5), (1, 2, 1)], "topic int, relative_month int, freq int")
    a = {r.topic: r for r in series.peak_summary(freq).collect()}
    assert a[0].peak_freq_period == 1 and a[0].peak_prop_period == 3 and a[0].mean_prop == 0.75
    wide = {r.topic: r for r in series.pivot(series.add_proportion(freq), "prop", 12).collect()}
    assert wide[0].Mean == pytest.approx(1.5 / 12) and wide[0].M2 == 0
    assert {r.topic: r.avg_per_period for r in series.peak_summary_short(freq).collect()} == {0: 0.83, 1: 0.5}


def test_similarity(spark):
    cells = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [2.0, 0.0]), (0, 4, [0.0, 1.0]), (1, 1, [0.0, 0.0])], "topic int, month int, vec array<double>")
    m = {(r.topic, r.m1, r.m2): r.cos for r in drift.similarity_matrix(cells, 4).collect()}
    assert m[0, 1, 2] == 1 and m[0, 1, 4] == 0 and m[0, 1, 3] is None and m[1, 1, 1] == 0 and len(m) == 32
    assert drift.consecutive(drift.similarity_matrix(cells, 4)).count() == 6
    dtm = spark.createDataFrame([(0, "a, b", 3, 1), (0, "b, c", 2, 2), (-1, "z", 1, 1), (0, "", 1, 3)], "Topic int, Words string, Frequency int, Timestamp int")
    w = {(r.m1, r.m2): r.cos for r in drift.set_similarity_matrix(drift.word_sets(dtm), 3).collect()}
    assert w[1, 2] == pytest.approx(0.5) and w[1, 3] is None and w[2, 2] == pytest.approx(1)
    assert [r.word for r in drift.vocabulary(drift.word_sets(dtm, ["a", "c"])).collect()] == ["a", "c"]


def test_drift_thresholds_are_inclusive(spark):
    df = spark.createDataFrame([(0.95, 0.6), (0.95, 0.59), (0.94, 0.6), (0.9, 0.5)], "a double, b double")
    assert [r.p for r in df.select(decide.drift_pattern(F.col("a"), F.col("b")).alias("p")).collect()] == ["Stable", "Paraphrase", "Lexical-anchor drift", "Topic drift"]


def test_ctfidf_of_all_topics(spark):
    rows = [(0, "a", 5), (0, "b", 1), (1, "a", 2), (None, "b", 4), (None, "c", 3)]
    got = {(r.topic, r.term): r.weight for r in topics.ctfidf(spark.createDataFrame(rows, "topic int, term string, tf long")).collect()}
    n, f = {0: 6, 1: 2, None: 7}, {"a": 7, "b": 5, "c": 3}
    assert got == pytest.approx({(t, w): tf / n[t] * math.log1p(5 / f[w]) for t, w, tf in rows})  # mean total: 15 / 3
    assert topics.ctfidf(spark.createDataFrame([], "topic int, term string, tf long")).count() == 0


def test_topics_over_time_by_hand(spark):
    rows = [(0, 1, "a a b"), (0, 3, "b c"), (1, 1, "c"), (1, 2, "a c c"), (-1, 1, "noise"), (1, 2, None)]
    df = spark.createDataFrame(rows, "topic int, relative_month int, t string")
    tf = {}
    for t, m, x in rows:
        for w in (x or "").split() if t != -1 else ():
            tf[t, m, w] = tf.get((t, m, w), 0) + 1
    add = lambda keep: sum(v for k, v in tf.items() if keep(*k))
    mean = add(lambda *_: True) // 2
    idf = {w: math.log1p(mean / add(lambda t, m, v, w=w: v == w)) for w in "abc"}
    want = {}
    for t in (0, 1):
        for w in {w for k, _, w in tf if k == t}:
            whole = add(lambda k, m, v: (k, v) == (t, w)) / add(lambda k, m, v: k == t) * idf[w]
            before = None
            for m in sorted({m for k, m, _ in tf if k == t}):
                x = tf.get((t, m, w), 0) / add(lambda k, n, v: (k, n) == (t, m)) * idf[w]
                if before and before[0] == m - 1:
                    x = (x + before[1]) / 2
                x = (whole + x) / 2
                before = m, x
                want.setdefault((t, m), []).append((-round(x, 12), w))
    got = {(r.topic, r.month): (r.freq, r.words) for r in topics.topics_over_time(df, "t").collect()}
    assert {k: v[1] for k, v in got.items()} == {k: [w for _, w in sorted(v)] for k, v in want.items()}
    assert {k: v[0] for k, v in got.items()} == {(0, 1): 1, (0, 3): 1, (1, 1): 1, (1, 2): 2}


def test_ctfidf_prunes_by_topic(spark):
    df = spark.createDataFrame([(1, 0, "a b c"), (2, 1, "a b d"), (3, 2, "a e f")], "k int, topic int, t string")
    pruned = topics.prune_vocabulary(topics.term_counts(df, "t"))
    assert {(r.topic, r.term) for r in pruned.collect()} == {(0, "b"), (1, "b"), (0, "a b"), (1, "a b")}  # a stands in all topics
    top = topics.top_words(topics.ctfidf(pruned), 1)
    assert {r.term for r in top.collect()} == {"a b"}


def test_coherence_cv_scores_ten_words(spark):
    d = catalog.doc_topics(spark, SMOKE_DIR)
    words = topics.top_words(topics.ctfidf(topics.term_counts(d, "clean", bigrams=False)), 10)
    want = {r[0]: r[1] for r in coherence.c_v(d, words, "doc_id", "clean").collect()}
    assert {r[0]: r[1] for r in catalog.coherence_cv(spark, SMOKE_DIR).collect()} == pytest.approx(want)


def plain_windows(texts, words, window):
    """Windows that hold each two of a topic's words, and how many there are."""
    total, both = 0, {}
    for t in texts:
        w = (t or "").split()
        if not w:
            continue
        for i in range(max(len(w) - window + 1, 1)):
            total += 1
            here = set(w[i : i + window])
            for topic, a in words:
                for other, b in words:
                    if topic == other and a in here and b in here:
                        both[topic, a, b] = both.get((topic, a, b), 0) + 1
    return both, total


@pytest.mark.parametrize("window", [1, 4, 50])
def test_window_counts(spark, window):
    rng = random.Random(window)
    texts = [" ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randrange(0, 40))) for _ in range(40)] + [None, "", "a", "a a a a a a a a"]
    words = [(t, w) for t, ws in ((0, "abc"), (1, "cdx"), (7, "h")) for w in ws]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b c d")], "k int, t string").repartition(3)
    both, total = coherence.window_counts(df, spark.createDataFrame(words, "topic int, term string"), "k", "t", window)
    want, n = plain_windows([*texts, "a b c d"], words, window)
    assert {(r.topic, r.w1, r.w2): r.n for r in both.collect()} == want and total.first().n_windows == n


def test_centroids_need_one_length(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (1, 2, None), (1, 2, [])], "topic int, relative_month int, embedding array<double>")
    got = {r.month: (r.n, r.vec) for r in drift.centroids(df).collect()}
    assert got == {1: (2, [2.0, 3.0]), 2: (2, [None, None])}
    with pytest.raises(ValueError, match="2 to 3 elements"):
        drift.centroids(df.unionByName(spark.createDataFrame([(1, 1, [1.0, 2.0, 3.0])], df.schema)))
    assert drift.centroids(df.limit(0)).count() == 0


def test_trend_orders(spark):
    rows = [(0, 0.5, 0.3, "stable"), (1, -0.5, 0.01, "declining"), (2, 0.7, 0.02, "emerging"), (3, 0.1, None, "stable"), (4, 0.9, 0.02, "emerging")]
    df = spark.createDataFrame(rows, "topic int, slope double, p_adj double, classification_fdr string")
    order = {by: [r.topic for r in trend.ordered(df, by).collect()] for by in ("slope", "p", "class")}
    assert order == {"slope": [1, 3, 0, 2, 4], "p": [1, 2, 4, 0, 3], "class": [4, 2, 1, 0, 3]}


def test_findings_keep_the_sign_of_a_rounded_zero(spark, tmp_path):
    rows = [(0, 0, [1.0, 0.0, 0.0]), (1, 0, [1.0, 0.0, 0.0]), (2, 0, [-0.00003, 1.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [tuple(r) for r in catalog.findings_sections(spark, str(tmp_path)).collect()]
    want = duckdb.connect().execute(catalog.ORACLE["findings_sections"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    assert sorted(got) == sorted(want) == [(0, "## Topic 0"), (0, "- month 3: mean -0.0")]


def test_weights_shuffle_no_pruned_counts_again(spark):
    counts = spark.createDataFrame([(0, "a", 3), (1, "a", 2), (0, "b", 1), (2, "b", 4), (1, "c", 1), (2, "d", 2), (0, "d", 5)], "topic int, term string, tf long")
    pruned = topics.prune_vocabulary(counts, 2, 0.95)
    kept = spark.createDataFrame(pruned.collect(), pruned.schema)
    made = topics.ctfidf(kept)
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(made.collect()) == sorted(topics.ctfidf(kept.drop("f")).collect())


def term_rows(rng, n):
    gaps = [" ", "  ", "\n", "\t", " ", " ", "\u0085"]
    rows = [(i, rng.choice([0, 1, 2, None]), rng.choice(["x", "y", None]), "".join(rng.choice(["a", "b", "the", "é", "\x1c", "d"]) + rng.choice(gaps) for _ in range(rng.randrange(9)))) for i in range(n)]
    return [*rows, (n, 1, "x", None), (n + 1, 3, "x", ""), (n + 2, 2, "y", "the the"), (None, 2, "y", "only once")]


@pytest.mark.parametrize("slice_bytes", [1, 1 << 24])
def test_terms_are_counted_in_batches(spark, slice_bytes, monkeypatch):
    rows = term_rows(random.Random(3), 200)
    df = spark.createDataFrame(rows, "k int, topic int, s string, t string").repartition(3)
    for by, stop, bigrams in ((("topic",), None, True), (("topic", "s"), ["the", "é"], True), (("s",), ["a"], False), ((), None, True)):
        want = {tuple(r) for r in topics.terms(df, "t", by, stop, bigrams).groupBy(*by, "term").agg(F.count("*").alias("tf")).collect()}
        assert {tuple(r) for r in topics.term_counts(df, "t", by, stop, bigrams).collect()} == want
    batch = pa.record_batch({"t": pa.array([r[3] for r in rows])})
    monkeypatch.setattr(words, "SLICE_BYTES", slice_bytes)
    assert [r for a, b in words.slices(batch.column(0)) for r in range(a, b)] == list(range(len(rows)))


@pytest.mark.parametrize("stop", [None, ["the"]])
def test_pruned_counts_in_one_shuffle(spark, stop, monkeypatch):
    df = spark.createDataFrame(term_rows(random.Random(4), 200), "k int, topic int, s string, t string").repartition(3)
    monkeypatch.setattr(counting, "TASK_BYTES", 100)
    for least, share in ((2, 0.95), (1, 0.4), (3, 1.0)):
        want = topics.prune_vocabulary(topics.term_counts(df, "t", stopwords=stop), least, share)
        got = topics.pruned_counts(df, "t", least, share, stopwords=stop)
        assert {tuple(r) for r in got.select(*want.columns).collect()} == {tuple(r) for r in want.collect()}
        assert all(r.df == n for r, n in ((r, r.n) for r in got.withColumn("n", F.count("*").over(Window.partitionBy("term"))).collect()))
    plan = counting.pruned_counts(df, "t", "topic", stop, True, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Sort" not in plan
    assert topics.pruned_counts(df.limit(0), "t").count() == 0


@pytest.mark.parametrize("dense", [0, 2_000])
def test_window_counts_of_many_and_few_words(spark, dense, monkeypatch):
    monkeypatch.setattr(coherence, "MOST_DENSE", dense)
    rng = random.Random(dense)
    texts = [" ".join(rng.choice("a b c d e".split()) for _ in range(rng.randrange(30))) for _ in range(30)] + [None, "", "a b\n\tc"]
    chosen = [(0, "a"), (0, "b"), (3, "b"), (3, "c"), (3, "zz")]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(2)
    both, total = coherence.window_counts(df, spark.createDataFrame(chosen, "topic int, term string"), "k", "t", 5)
    want, n = plain_windows(texts, chosen, 5)
    assert {(r.topic, r.w1, r.w2): r.n for r in both.collect()} == want and total.first().n_windows == n


def test_representative_documents_by_hand(spark):
    rows = [(1, 0, "a a b"), (2, 0, "b c"), (2, 0, "c c"), (3, 0, None), (4, 0, "zz"), (5, 1, "a"), (6, 1, "c b"), (None, 0, "a b c"), (7, None, "a")]
    df = spark.createDataFrame(rows, "k int, topic int, t string").repartition(3)
    weights = [(0, "a", 2, 0.6), (0, "b", 2, 0.3), (0, "c", 3, 0.9), (1, "a", 1, 0.2), (1, "b", 1, 0.5)]
    made = topics.representative_documents(df, spark.createDataFrame(weights, "topic int, term string, tf long, weight double"), "k", "t", 9)
    docs, want = {}, {}
    for k, topic, t in rows:
        docs.setdefault((topic, k), []).extend((t or "").split())
    w = {(topic, term): (tf, x) for topic, term, tf, x in weights}
    for (topic, k), words_ in docs.items():
        own = {t: words_.count(t) * w[topic, t][1] / w[topic, t][0] for t in set(words_) if (topic, t) in w}
        if own:
            size = math.sqrt(sum(x * x for (a, _), (_, x) in w.items() if a == topic))
            want[topic, k] = sum(v * w[topic, t][1] for t, v in own.items()) / math.sqrt(sum(v * v for v in own.values())) / size
    assert {(r.topic, r.k): r.similarity for r in made.collect()} == pytest.approx(want)
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()


def few_bytes(monkeypatch):
    """Many tasks and blocks on little text."""
    monkeypatch.setattr(counting, "TASK_BYTES", 100)
    monkeypatch.setattr(counting, "BLOCK_ROWS", 5)


@pytest.mark.parametrize("stop", [None, ["the"]])
def test_top_words_of_pruned_counts_by_blocks(spark, stop, monkeypatch):
    few_bytes(monkeypatch)
    rows = [*term_rows(random.Random(8), 200), (0, -1, "x", "a a b the"), (0, 4, "y", "zz zz d"), (0, 5, "y", "zz b")]
    df = spark.createDataFrame(rows, "k int, topic int, s string, t string").repartition(3)
    for least, share, n in ((2, 0.95, 3), (1, 0.5, 4), (3, 1.0, 100), (9, 1.0, 2)):
        want = topics.top_words(topics.ctfidf(topics.prune_vocabulary(topics.term_counts(df, "t", stopwords=stop), least, share)), n)
        got = topics.pruned_top_words(df, "t", n, least, share, stopwords=stop)
        assert got.columns == want.columns
        assert {tuple(r)[:3]: r.weight for r in got.collect()} == pytest.approx({tuple(r)[:3]: r.weight for r in want.collect()})
    assert topics.pruned_top_words(df.limit(0), "t").count() == 0
    made = pipelines.refit_words(df, "t", stop or [], 5)
    assert "MapInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r.topic for r in made.collect()} <= {0, 1, 2, 3, 4, 5}


def test_counts_meet_in_blocks(spark, monkeypatch):
    """A row per batch and task, not per term; a term's counts in one partition; other than by one key's sort where numbers are too large for it."""
    df = spark.createDataFrame([(i % 3, " ".join(f"w{(i * 7 + j * j) % 400}" for j in range(60))) for i in range(300)], "topic int, t string").repartition(2)
    monkeypatch.setattr(counting, "TASK_BYTES", 20_000)
    parts, _ = counting.met_counts(df, "t", ("topic",))
    n = parts.rdd.getNumPartitions()
    assert parts.count() <= 2 * n < topics.term_counts(df, "t").count() / 50
    assert sorted(r.p for r in spark.createDataFrame([(k,) for k in counting.even_keys(spark, 50)], "k long").repartition(50, "k").select(F.spark_partition_id().alias("p")).collect()) == list(range(50))
    rng = np.random.default_rng(5)
    codes, tf = [rng.integers(0, 3, 500) for _ in range(3)], rng.integers(1, 9, 500)
    for n_ in (None, tf):
        made, total = counting._summed(codes, n_)
        far, same = counting._summed([c * (1 << 30) for c in codes], n_)
        assert total.tolist() == same.tolist() and [(c * (1 << 30)).tolist() for c in made] == [c.tolist() for c in far]
    assert dict(zip(zip(*(c.tolist() for c in made), strict=True), total.tolist(), strict=True)) == {k: int(sum(t for *x, t in zip(*codes, tf, strict=True) if tuple(x) == k)) for k in zip(*(c.tolist() for c in codes), strict=True)}


def test_batches_are_gathered(monkeypatch):
    monkeypatch.setattr(words, "SLICE_BYTES", 10)
    texts = ["aaaa", None, "bbbb", "cc", "", "d" * 30, "e", "f"]
    batches = [pa.record_batch({"t": pa.array(texts[a : a + 3], pa.string()), "i": pa.array(range(a, min(a + 3, 8)))}) for a in (0, 3, 6)]
    made = list(counting._gathered(iter(batches), 0))
    assert [b.column(0).to_pylist() for b in made] == [texts[:5], texts[5:6], texts[6:]] and [i for b in made for i in b.column(1).to_pylist()] == list(range(8))
    assert list(counting._gathered(iter([]), 0)) == []


def test_best_keeps_ties_of_rounded_values():
    best = counting.Best(2, 2, 3)
    assert best.may_be(np.array([0, 0, 0, 1]), np.array([0.5, 0.4, 0.1, 0.1])).tolist() in ([0, 1, 3], [1, 0, 3])
    assert best.may_be(np.array([0, 0, 0]), np.array([0.3996, 0.39, 0.4004])).tolist() == [0, 2]
    assert best.may_be(np.array([], int), np.array([])).tolist() == []


@pytest.mark.parametrize(("evolution", "overall"), [(True, True), (True, False), (False, True), (False, False)])
def test_topics_over_time_by_blocks(spark, evolution, overall, monkeypatch):
    few_bytes(monkeypatch)
    rng = random.Random(12)
    rows = [(rng.choice([0, 1, 2, 2, -1, None]), rng.choice([1, 2, 3, 5, 6, 9, None]), " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(7)))) for _ in range(60)]
    rows += [(4, 2, ""), (5, 7, "a h"), (5, 8, None), (5, 9, "h h h"), (6, None, "b"), (1, 30, "the")]
    df = spark.createDataFrame(rows, "topic int, relative_month int, t string").repartition(3)
    tf, texts = {}, {}
    for t, m, x in rows:
        if t is not None and t != -1:
            texts[t, m] = texts.get((t, m), 0) + 1
            for w in (x or "").split():
                if w != "the":
                    tf[t, m, w] = tf.get((t, m, w), 0) + 1
    size, cell, whole, f = {}, {}, {}, {}
    for (t, m, w), n in tf.items():
        for where, k in ((size, t), (cell, (t, m)), (whole, (t, w)), (f, w)):
            where[k] = where.get(k, 0) + n
    mean, want = sum(size.values()) // len(size), {}
    for (t, w), n in whole.items():
        idf, last = math.log1p(mean / f[w]), None
        for m in sorted(m for k, m in texts if k == t and m is not None):
            x = tf.get((t, m, w), 0) / cell.get((t, m), 1) * idf
            x = (x + last[1]) / 2 if evolution and last and last[0] == m - 1 else x
            x = (n / size[t] * idf + x) / 2 if overall else x
            last = m, x
            want.setdefault((t, m), []).append((-round(x, 12), w))
    made = topics.topics_over_time(df, "t", n_words=3, evolution=evolution, overall=overall, stopwords=["the"])
    assert {(r.topic, r.month): (r.freq, r.words) for r in made.collect()} == {k: (n, [w for _, w in sorted(want[k])[:3]] if k in want else None) for k, n in texts.items()}
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert topics.topics_over_time(df.limit(0), "t").count() == 0


def test_blocks_are_narrow():
    blocks = counting.Blocks([])
    spelled, first, second = pa.array(["a", "b", "c", "d"]), np.array([0, 1, 1, 3, 0, 3]), np.array([-1, 3, 2, -1, 3, 3])
    group, tf = np.array([0, 2, 0, 1, 1, 1]), np.array([1, 300, 1 << 33, 4, 5, 6])
    columns = blocks.pack(spelled, [pa.array([7, None, 9])], np.array([0, 4, 6]), group, first, second, tf)
    words_, (values,), g, a, b, (n,) = counting.Blocks.unpack(columns)
    assert columns[0].to_pylist() == ["a b c d", "a d"] and columns[1].to_pylist() == [[7, None, 9], [None]]
    assert [len(x.as_py()) for x in columns[2]] == [8 + 4 + 3 * 4 + 8 * 4, 8 + 4 + 4 * 2]
    assert values.take(pa.array(g)).to_pylist() == [7, 9, 7, None, None, None] and n.tolist() == tf.tolist()
    assert counting.Blocks.spelled(words_, a, b).to_pylist() == ["a", "b d", "b c", "d", "a d", "d d"]
