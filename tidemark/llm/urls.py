"""URL filters by expanded expressions. DataFrame functions only.

A URL expands into its host's suffixes times its path's prefixes that end in ``/``. Each expression's
SHA-256 is joined on its first four bytes with that of the rules, the full digest confirms, then
the rule's whole path must start the URL's path. The longest host plus path wins; of two that long
the longer host, then block. Expressions longer than any rule cannot match and are not made.

Null URLs and those without ``://`` have an empty host and path and fit no rule; they take no part in any join. Other URLs are judged once
each and joined back; one that many rows have is told to them by broadcast. An empty table gives no rows. Rules with a null host are
void; a null path is an empty one. Only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hot_join, materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"://([^/?#]*)([^?#]*)"
#: Bytes of the short hash that the join uses.
SHORT = 4


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _suffixes(host: Column, most: Column) -> Column:
    """The host and its parents of at most so many labels."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), most)), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))


def _prefixes(path: Column, most: Column) -> Column:
    """The empty path and each beginning that ends in a slash, of at most so many slashes."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, most)), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", path, F.lit("/"), k), F.lit("/"))))


def _hashed(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """host, path, verdict -> with the digest of host plus the path up to its last slash."""
    host = F.translate(F.col("host"), _UPPER, _LOWER)
    path = F.coalesce(F.col("path"), F.lit(""))
    stem = F.regexp_extract(path, "^(?s)(.*/)?", 0)
    kept = rules.where(F.col("host").isNotNull()).select(host.alias("r_host"), path.alias("r_path"), stem.alias("r_stem"), F.col("verdict").alias("r_verdict"))
    digest = _hashed(F.col("r_host"), F.col("r_stem"))
    return kept.select("*", digest.alias("r_digest"), F.substring(digest, 1, 2 * SHORT).alias("short"))


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict: one row per page."""
    rules = prepare_rules(rules)
    labels, slashes = rules.agg(F.max(F.size(F.split("r_host", r"\.", -1))), F.max(F.size(F.split("r_stem", "/", -1)) - 1)).first()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    some = rows.where(F.col("host") != "")
    once = some.groupBy("url").agg(F.count("*").alias("n")).select("url", "n", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    made = once.select("url", "n", "path", F.explode(_suffixes(F.col("host"), F.lit(labels or 1))).alias("h"))
    made = made.select("url", "n", "path", "h", F.explode(_prefixes(F.col("path"), F.lit(slashes or 0))).alias("p"))
    made = made.select("url", "n", "path", _hashed(F.col("h"), F.col("p")).alias("digest"))
    hit = made.join(rules, F.substring("digest", 1, 2 * SHORT) == F.col("short"), "left")
    sure = (F.col("digest") == F.col("r_digest")) & F.col("path").startswith(F.col("r_path"))
    rank = F.when(sure, F.struct((F.length("r_host") + F.length("r_path")).alias("a"), F.length("r_host").alias("b"), (F.col("r_verdict") == "block").alias("c")))
    best = F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank)
    judged = materialise(hit.groupBy("url").agg(F.first("n").alias("n"), best.alias("best")))
    told = hot_join(some, judged, "url", "n", "left").select("page_id", "host", "path", "best")
    none = rows.where(F.col("host") == "").select("page_id", "host", "path", F.lit(None).cast(judged.schema["best"].dataType).alias("best"))
    return told.unionByName(none).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
