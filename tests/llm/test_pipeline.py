import random
import re
from collections import defaultdict

import corpus_pipeline
from tidemark.llm import secrets


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    good = [" ".join(word() for _ in range(80)) for _ in range(160)]
    for i in range(20):
        w = good[i].split()
        w[40] = "changed"
        good.append(" ".join(w) if i % 2 else good[i])
    good[30] += ' password = "Abc123def456ghi"'
    bad = [" ".join(f"{word().upper()}!!" for _ in range(60)) for _ in range(60)]
    texts = good + bad
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        seen.append(docs.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "secret_scan", "mixing", "packing"]
    kept, single, clean, mixed, pieces = seen
    assert all(set(r.asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} for s in seen[:4] for r in s)
    assert {r.doc_id for r in kept} == set(range(len(good)))
    assert {r.doc_id for r in single} == set(range(160))
    assert [r.doc_id for r in clean if "[SECRET]" in r.text] == [30] and not any(secrets.scan(r.text) for r in clean)
    assert all(r.n_chars == len(r.text) for r in clean)
    times = defaultdict(int)
    for r in mixed:
        times[r.doc_id] += 1
    assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in clean}
    size, taken = defaultdict(int), defaultdict(int)
    for r in clean:
        size[r.source] += len(re.findall(r"\S+", r.text))
    for r in mixed:
        taken[r.source] += len(re.findall(r"\S+", r.text))
    total = sum(size.values())
    assert abs(taken["s0"] - total / 3) <= 120 and abs(taken["s1"] - 2 * total / 3) <= 120
    whole = {r.doc_id: r.doc_tokens for r in pieces}
    assert set(whole) == set(times)
    for key, n in whole.items():
        assert sum(r.length for r in pieces if r.doc_id == key) == n * times[key]
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert ran.count() > 0 and ran.columns == list(pieces[0].asDict())


EDGES = [None, "", " \n\t ", "one", "a b c d", "a b c d", "Z" * 5000 + " end", "word " * 30000, "nbsp\u00a0inside", "\U0001f600 pictograph"]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, columns with clashing names; then an empty table."""
    extra = ["id", "key", "node", "band", "anchor", "row", "block", "size", "copies", "shard", "spans", "score", "_doc", "_key"]
    cols = ["doc_id", "text", "lang", "source", "n_chars", *extra]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t) if t else None, *["x"] * len(extra)) for i, t in enumerate(EDGES)]
    rows += [(None, "no id here at all", None, None, None, *[None] * len(extra)), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, None), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sizes = {}
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            out = str(tmp_path / f"{name}{empty}")
            stage(spark, now, str(tmp_path)).write.parquet(out)
            made = spark.read.parquet(out)
            sizes[name, empty] = made.count()
            if name != "packing":
                assert set(made.columns) == set(cols)
            now = made
    assert all(n == 0 for (_, empty), n in sizes.items() if empty)
    assert 0 < sizes["ngram_jaccard_join", False] <= sizes["quality_classifier", False]
    # without a classifier that rejects: of the copies one stays, so do texts without words and the row without id
    single = corpus_pipeline.dedup(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in single), key=str) == sorted([0, 1, 2, 3, 4, 6, 7, 8, 9, None], key=str)
    mixed = corpus_pipeline.mixture(spark, docs, str(tmp_path)).collect()
    assert not {r.doc_id for r in mixed} & {0, 1, 2}


def test_survivor_is_fixed(spark):
    """Of rows equal in id and text the same one stays, whatever the order."""
    from tidemark.llm import near

    df = spark.createDataFrame([(1, "a b c d e f", x) for x in "pqrst"], "doc_id long, text string, note string")
    assert len({near.keep_one(df.orderBy("note", ascending=up).repartition(n)).first().note for up in (True, False) for n in (1, 3)}) == 1
