"""Building slang lexicons and applying large ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import PROTECTED_WORDS
from tidemark.functions import text

#: Entries up to which a lexicon is used as a literal, of some 40 bytes an entry.
MOST_LITERAL = 20_000


def _prepared(df: DataFrame) -> DataFrame:
    """Rows with both sides normalised and not empty; pos is the row's place in its file."""
    kept = df.where(F.col("slang").isNotNull() & F.col("formal").isNotNull())
    made = kept.withColumns({"slang": text.normalize_text(F.col("slang")), "formal": text.normalize_text(text.hyphens_to_spaces(F.col("formal")))})
    return made.where((F.col("slang") != "") & (F.col("formal") != ""))


def _first(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy("slang").orderBy(*order))).where(F.col("_n") == 1).select("slang", "formal")


def base_lexicon(df: DataFrame, blocked: tuple[str, ...] = PROTECTED_WORDS) -> DataFrame:
    """pos, slang, formal, In-dictionary -> slang, formal. Self-maps, degrading maps and blocked keys go; of a key's rows the dictionary's first."""
    rows = _prepared(df).where((F.col("slang") != F.col("formal")) & ~text.is_degrading(F.col("slang"), F.col("formal")))
    if blocked:
        rows = rows.where(~F.col("slang").isin(*blocked))
    return _first(rows, F.desc_nulls_last("In-dictionary"), "pos")


def extension_lexicon(df: DataFrame) -> DataFrame:
    """pos, slang, formal -> slang, formal. Self-maps stay, as they protect words."""
    return _first(_prepared(df), "pos")


def merge_lexicons(base: DataFrame, extension: DataFrame) -> DataFrame:
    """The extension wins."""
    return extension.unionByName(base.join(extension.select("slang"), "slang", "left_anti"))


def override_count(base: DataFrame, extension: DataFrame) -> DataFrame:
    return base.join(extension.select("slang"), "slang", "left_semi").agg(F.count("*").alias("n_overrides"))


def build_lexicon(base: DataFrame, extension: DataFrame | None = None, blocked: tuple[str, ...] = PROTECTED_WORDS) -> DataFrame:
    made = base_lexicon(base, blocked)
    return made if extension is None else merge_lexicons(made, extension_lexicon(extension))


def short_keys(lexicon: DataFrame, most: int = 4) -> DataFrame:
    return lexicon.where((F.length("slang") <= most) & (F.col("slang") != F.col("formal")))


def _joined(df: DataFrame, lexicon: DataFrame, text_col: str) -> DataFrame:
    """df with _new by a join of tokens with the lexicon. Each distinct text is worked on once, so neither keys nor repeated rows matter."""
    whole = F.coalesce(F.col(text_col), F.lit(""))
    once = df.select(whole.alias("_text")).distinct().select(F.sha2("_text", 256).alias("_hash"), F.posexplode(text.tokens(F.col("_text"))).alias("_pos", "slang"))
    each = once.join(lexicon, "slang", "left").groupBy("_hash").agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("formal", "slang").alias("t")))).alias("_all"))
    each = each.select("_hash", F.array_join(F.transform("_all", lambda x: x["t"]), " ").alias("_new"))
    made = df.withColumn("_key", F.sha2(whole, 256)).join(each, F.col("_key") == F.col("_hash"), "left").drop("_key", "_hash")
    return made.withColumn("_new", F.coalesce("_new", F.lit("")))  # texts without tokens


def normalize_slang(df: DataFrame, lexicon: DataFrame, key: str, text_col: str = "review_text_cleaned") -> DataFrame:
    """Replaces tokens and recounts words; adds slang_changed. Reads the lexicon to choose a literal table or, beyond MOST_LITERAL entries, a join; both give the same. Null text is an empty one; rows and keys may repeat or be null."""
    old = F.array_join(text.tokens(F.col(text_col)), " ")
    rows = lexicon.limit(MOST_LITERAL + 1).collect()
    if len(rows) <= MOST_LITERAL:
        made = df.withColumn("_new", text.replace_slang(F.col(text_col), {r.slang: r.formal for r in rows}))
    else:
        made = _joined(df, lexicon, text_col)
    made = made.withColumn("slang_changed", F.col("_new") != old).withColumn(text_col, F.col("_new")).drop("_new")
    return made.withColumn("word_count_after", text.token_count(F.col(text_col)))


def slang_triggers(df: DataFrame, lexicon: DataFrame, text_col: str, n: int = 30) -> DataFrame:
    """slang, formal, count of the n most used replacements."""
    used = df.select(F.explode(text.tokens(F.col(text_col))).alias("slang")).groupBy("slang").count()
    return used.join(lexicon.where(F.col("slang") != F.col("formal")), "slang").select("slang", "formal", "count").orderBy(F.desc("count"), "slang").limit(n)
