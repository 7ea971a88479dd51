"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, chat, classifier, mixing, near, packing, quality, secrets, substring, urls
from tidemark.llm.common import literal_rows, spread, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query()
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_summary(secrets.find_secrets(spread(table(spark, sf_dir, "documents"))))


#: The conversation that the contract adds, as (turn, role, text).
EXTRA_CONVERSATION = -7, ((0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok"))


@query(r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, 15 + length(role) + length(text)
    + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS chars FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(chars) AS chars FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
""")
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, turns = EXTRA_CONVERSATION
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = literal_rows(spark, [(key, *t) for t in turns], rows.schema)
    return chat.chat_summary(chat.format_turns(chat.canonical_turns(rows.unionByName(more))))


#: The contract's rules: host, path, verdict.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


@query(r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
""")
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = literal_rows(spark, list(URL_RULES), "host string, path string, verdict string")
    return urls.filter_urls(table(spark, sf_dir, "pages"), rules)


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query()
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_summary(mixing.plan_mixture(table(spark, sf_dir, "documents")))


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_quality(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


@query()
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(spread(table(spark, sf_dir, "documents")))


@query()
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


@query(r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), t AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w
), k AS (
  SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS s,
    count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n FROM t
), f AS (
  SELECT s, min(doc_id) AS least FROM k WHERE n = 13 GROUP BY s
), g AS (
  SELECT k.doc_id, pos, word, coalesce(k.n = 13 AND k.doc_id > f.least, false) AS hit FROM k LEFT JOIN f USING (s)
), r AS (
  SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM g
), a AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN a USING (doc_id)
""")
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substring.remove_repeats(spread(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS grams FROM w WHERE len(ws) > 0
), k AS (
  SELECT doc_id, grams, min(doc_id) OVER (PARTITION BY sha256(array_to_string(list_sort(grams), chr(10)))) AS node FROM s
), n AS (
  SELECT node, count(*) AS copies FROM k GROUP BY node
), g AS (
  SELECT node, len(grams) AS size, unnest(grams) AS gram FROM k WHERE doc_id = node
), p AS (
  SELECT a.node AS x, b.node AS y FROM g a JOIN g b ON a.gram = b.gram AND a.node <> b.node
  GROUP BY a.node, b.node, a.size, b.size HAVING 10 * count(*) >= 8 * (a.size + b.size - count(*))
), r(node, other) AS (
  SELECT node, node FROM n UNION SELECT r.node, p.y FROM r JOIN p ON r.other = p.x
), c AS (
  SELECT node, min(other) AS class_id FROM r GROUP BY node
), l AS (
  SELECT n.node, n.copies - 1 + coalesce(sum(m.copies), 0) AS n_links FROM n LEFT JOIN p ON n.node = p.x LEFT JOIN n m ON p.y = m.node GROUP BY n.node, n.copies
)
SELECT w.doc_id, coalesce(c.class_id, w.doc_id) AS class_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN c ON k.node = c.node LEFT JOIN l ON k.node = l.node
""")
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(spread(table(spark, sf_dir, "documents"))).select("doc_id", "class_id", "n_links")
