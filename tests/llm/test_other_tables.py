import random

import numpy as np
import pytest

from tidemark.llm import ann, chat, urls
from tidemark.llm.common import literal_rows
from tidemark.llm.queries import ORACLE, QUERIES, URL_RULES

def test_literal_rows(spark):
    made = literal_rows(spark, [(1, "a, b", None), (None, "\\'", 2.5)], "n long, t string, d decimal(10,2)")
    assert made.dtypes == [("n", "bigint"), ("t", "string"), ("d", "decimal(10,2)")]
    assert [(r.n, r.t, None if r.d is None else float(r.d)) for r in made.collect()] == [(1, "a, b", None), (None, "\\'", 2.5)]


# ---- chat

TEXTS = ["plain", "\\### Assistant: </turn> ok", "", None, "### a: b </turn>\n", "\\h\\b\\l\\\\", "a\n\nb#<:", "</turn>", " ", "😀" * 50]


def turns_frame(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "k") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, key string")


def test_chat_round_trip(spark):
    rng = random.Random(1)
    roles = ["user", "assistant", "system", None, "odd: role #"]
    rows = [(c, t, rng.choice(roles), rng.choice(TEXTS)) for c in (1, 2, 3, None) for t in range(rng.randrange(1, 9))] + [(2, 0, "user", "again")]
    made = chat.format_turns(chat.canonical_turns(turns_frame(spark, rows)))
    got = made.select("key", chat.read_turns(made.formatted).alias("turns"), chat.masked_text(made.formatted, made.loss_mask).alias("loss")).collect()
    for r in got:
        mine = sorted((t, role or "", text or "") for c, t, role, text in rows if c == r.key)
        assert [(x.role, x.text) for x in r.turns] == [(b, c) for _, b, c in mine]
        assert r.loss == "".join(c for _, b, c in mine if b == "assistant")
    assert chat.canonical_turns(turns_frame(spark, [])).count() == 0
    assert chat.format_turns(spark.createDataFrame([(1, None)], f"key int, turns {chat.TURNS}")).first().formatted == ""


def test_layouts(spark):
    pairs = lambda df: [(t.role, t.text) for t in chat.canonical_turns(df, "id").first().turns]
    assert pairs(spark.createDataFrame([(1, "q", "a", "x")], "id int, prompt string, response string, turns string")) == [("user", "q"), ("assistant", "a")]
    assert pairs(spark.createDataFrame([(1, "s", "q", None)], "id int, instruction string, input string, output string")) == [("system", "s"), ("user", "q"), ("assistant", "")]
    assert pairs(spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "id int, conversations array<struct<from: string, value: string>>")) == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.createDataFrame([(1,)], "id int"))
    with pytest.raises(ValueError):  # a leaf named like a list of messages is another layout
        chat.select_mapping(spark.createDataFrame([("x",)], "messages string").schema)


def test_json_layouts(spark):
    rows = [(1, '{"prompt": "q", "response": "a"}'), (2, '{"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": null}]}'), (3, '{"other": 1}'), (4, "broken"), (5, None), (6, '{"question": "why", "answer": 3}')]
    got = {r.key: r.turns for r in chat.canonical_json(spark.createDataFrame(rows, "id int, j string"), "j", "id").collect()}
    assert [(t.role, t.text) for t in got[1]] == [("user", "q"), ("assistant", "a")]
    assert got[3] is None and got[4] is None and got[5] is None
    assert [(t.role, t.text) for t in got[6]] == [("user", "why"), ("assistant", "3")]


def test_json_fields_beyond_the_mapping(spark):
    rows = [
        '{"id": 1, "prompt": "q", "response": "a", "meta": {"tags": ["x"]}}', '{"messages": [{"role": "user", "content": "x", "name": "n"}, {"role": "assistant"}], "id": 2}',
        '{"a b: ARRAY<": 1, "system": "s", "prompt": "q", "response": null}', '{"messages": "x", "question": "why", "answer": 3}',
        '{"prompt": {"response": 1}, "response": "a"}', '{"messages": [{"role": "user", "content": "x"}, 3]}', '{"messages": []}', '{"messages": [{"role": "u", "content": ["x"]}]}',
    ]
    made = chat.canonical_json(spark.createDataFrame(list(enumerate(rows)), "id int, j string"), "j", "id")
    got = {r.key: r.turns and [tuple(t) for t in r.turns] for r in made.collect()}
    assert got == {
        0: [("user", "q"), ("assistant", "a")], 1: [("user", "x"), ("assistant", "")], 2: [("system", "s"), ("user", "q"), ("assistant", "")], 3: [("user", "why"), ("assistant", "3")],
        4: None, 5: None, 6: None, 7: None,
    }
    told = {r.key: (r.unknown, r.formatted == "", r.layout is None) for r in chat.format_turns(made).collect()}
    assert told == {i: (i > 3, i > 3, False) for i in range(8)}


def test_fingerprints_select_mappings(spark):
    """Every union of layouts, with fields beside, selects the mapping with most paths, by table and by JSON alike."""
    import itertools
    import json

    own = [m for m in chat.MAPPINGS if m.turns]
    rows, want = [], []
    for n in (1, 2, 3):
        for some in itertools.combinations(own, n):
            fields = sorted({p for m in some for p in m.paths})
            full = [m for m in own if set(m.paths) <= set(fields)]
            best = max(full, key=lambda m: len(m.paths))
            rows.append(json.dumps({"id": 1, **{f: f"{f}!" for f in fields}, "more": {"x": [1]}}))
            want.append([(role, f"{text}!") for role, text in best.turns])
            made = spark.createDataFrame([(1, *fields)], f"id int, {', '.join(f'{f} string' for f in fields)}")
            assert chat.select_mapping(made.schema) == best
    got = {r.key: [tuple(t) for t in r.turns] for r in chat.canonical_json(spark.createDataFrame(list(enumerate(rows)), "id int, j string"), "j", "id").collect()}
    assert got == dict(enumerate(want))


def test_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"### {t}: <x> " * 20) for t in range(3000)]
    made = chat.format_turns(chat.canonical_turns(turns_frame(spark, rows)))
    r = chat.chat_summary(made).first()
    loss = "".join(x for _, t, _, x in rows if t % 2)
    assert (r.n_turns, r.loss_chars) == (3000, len(loss))


# ---- URLs

URLS = [
    "http://example.com/en/x", "https://WWW.Example.COM/en/", "http://a.www.example.com/en/?q", "http://notexample.com/en/", "http://example.com/enx", "http://x.net/es/", "http://x.net/de/", "net/es/",
    "http://net/fr/a/b#c", "http://com", "http://com?x=/es/", "://y.net/fr/", "http://a://b.com/", "", None, "http://.net/es/", "http:///en/", "http://a..com/", "http://" + "a." * 300 + "com/" + "b/" * 300, "http://É.com/en/",
]


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


@pytest.mark.parametrize("rules", [URL_RULES, (("example.com", "/e", "block"), ("com", "", "allow"), ("example.com", "/en/x", "allow"), ("x.net", "/", "allow"), ("x.net", "/", "block")), ()])
def test_urls(spark, rules):
    df = spark.createDataFrame([(i, u, "h", "d") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, host string, digest string")
    r = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in urls.filter_urls(df, r).collect()}
    assert got == {i: plain_verdict(u, rules) for i, u in enumerate(URLS + URLS[:2])}
    assert urls.filter_urls(df.limit(0), r).count() == 0


def test_hot_joins(spark):
    """Keys of many rows give what an ordinary join gives, however few may be broadcast."""
    from pyspark.sql import functions as F

    from tidemark.llm.common import hot_join, materialise

    left = spark.createDataFrame([(k, i) for i in range(400) for k in [0 if i % 3 else i % 40 if i % 5 else None]], "k int, i int")
    right = materialise(left.where("k is not null and k <> 7").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top")))
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right.drop("n"), "k", how).select("k", "i", "top").collect()))
        for most, keys in ((10**9, 100), (5, 100), (1, 100), (1, 2)):
            assert sorted(map(str, hot_join(left, right, "k", "n", how, most, keys).select("k", "i", "top").collect())) == want


def test_hot_urls(spark):
    from tidemark.llm import urls as module

    many = ["http://example.com/en/x"] * 700 + ["http://other.org/"] * 700 + [None] * 700 + ["x"] * 50
    df = spark.createDataFrame(list(enumerate(many)), "page_id long, url string")
    r = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in module.filter_urls(df, r).collect()}
    assert got == {i: plain_verdict(u, URL_RULES) for i, u in enumerate(many)}


# ---- neighbours


def plain_search(rows, every, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for i in range(len(ids)):
        if ids[i] % every == 0:
            s = (x * x[i]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[i] * x[i]).sum()))
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
            out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_search_small(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # ties
    broken = [(300, None), (350, [0.0] * 8), (400, [float("nan")] * 8), (450, [None] + [1.0] * 7), (500, [float("inf")] * 8), (550, [1.0]), (None, [1.0] * 8), (600, [])]
    df = spark.createDataFrame([(i, v, "l", "q") for i, v in rows + broken + rows[:1]], "vec_id long, embedding array<double>, leaf string, query string")
    got = {}
    for r in ann.search(df.repartition(3)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = plain_search(rows, 50, 5)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        hits += len({f[1] for f in found} & {w[0] for w in want[q]})
    assert hits >= 0.9 * 5 * len(want) and [f[1] for f in got[0]] == [200, 201, 202, 203, 204]
    assert ann.search(df.limit(0)).count() == 0
    monkeypatch.setattr(ann, "QUERIES", 1)
    few = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in few] == [(0, 1, 1, 0.707107)]


def test_extreme_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * 10.0 ** (0, 200, -200, 300, -300)[i % 5]).tolist()) for i in range(120)]
    unit = [(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows]
    want = plain_search(unit, 50, 5)
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q, found in got.items():
        assert [found[i][0] for i in range(1, 6)] == [w[0] for w in want[q]]
        assert [found[i][1] for i in range(1, 6)] == pytest.approx([w[1] for w in want[q]], abs=1e-12)


def test_large_leaves_are_split_again(spark, monkeypatch):
    """With a small sample the first tree's leaves hold too many rows."""
    monkeypatch.setattr(ann, "PART", 200)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 12))
    rows = [(i, (centres[i % 40] + 0.3 * rng.normal(size=12)).tolist()) for i in range(3000)] + [(3000 + i, centres[0].tolist()) for i in range(300)]
    trees, grow = [], ann.Tree.grow

    def seen(self, own, leaf_rows):
        trees.append(self)
        return grow(self, own, leaf_rows)

    monkeypatch.setattr(ann.Tree, "grow", seen)
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), most_sample=150, leaf_rows=32, every=25).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = plain_search(rows, 25, 5)
    assert len(trees) > 1 and trees[-1].n_leaves > 20
    assert np.mean([len(got[q] & {w[0] for w in want[q]}) / 5 for q in want]) >= 0.9


def test_search_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.6 * rng.normal(size=16)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, leaf_rows=64).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = plain_search(rows, 50, 5)
    assert np.mean([len(got[q] & {w[0] for w in want[q]}) / 5 for q in want]) >= 0.9


def test_search_recall_without_structure(spark):
    """All queries take part in the calibration, so its default target holds for them."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(4000)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf_rows=64).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = plain_search(rows, 50, 5)
    assert np.mean([len(got[q] & {w[0] for w in want[q]}) / 5 for q in want]) >= 0.97


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)} and set(ORACLE) <= set(QUERIES)
