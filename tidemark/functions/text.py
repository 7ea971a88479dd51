"""Text normalisation as Column expressions; all of it runs in the JVM."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns that define the normalisation. (?U) gives \w, \d, \s their Unicode meaning.
URL = r"(?iU)https?://\S+|www\.\S+|\b\w+\.(?:com|co\.id|id|net|org|io)\S*"
EMOTICON = r"(?:[:;=8][\-o\*']?[\)\]\(\[dDpPvV/\\:\}\{@\|]|<3|\^[_\-\.]?\^|xD|XD)"
NUMBER = r"(?U)\d+"
REPEAT = r"(?d)(.)\1{2,}"
OTHER = r"[^a-z\s]"
SINGLE = r"\b[a-z]\b"
SPACE = r"\s+"


def lowercase(c: Column) -> Column:
    """Null becomes empty."""
    return F.lower(F.coalesce(c, F.lit("")))


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, " ")


def remove_emoticons(c: Column) -> Column:
    """ASCII emoticons; pictographs fall to remove_punctuation()."""
    return F.regexp_replace(c, EMOTICON, " ")


def remove_numbers(c: Column) -> Column:
    return F.regexp_replace(c, NUMBER, " ")


def collapse_repeats(c: Column) -> Column:
    """Three or more equal characters become two."""
    return F.regexp_replace(c, REPEAT, "$1$1")


def remove_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, OTHER, " ")


def remove_single_letters(c: Column) -> Column:
    return F.regexp_replace(c, SINGLE, " ")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normalize_text(c: Column) -> Column:
    """Lower case, then URLs, emoticons, numbers, repeats, punctuation, single letters and white space, in this order."""
    for step in (lowercase, remove_urls, remove_emoticons, remove_numbers, collapse_repeats, remove_punctuation, remove_single_letters, squeeze):
        c = step(c)
    return c


def tokens(c: Column) -> Column:
    """White-space tokens; none for null or empty text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def scrape_word_count(c: Column) -> Column:
    """Tokens after everything that is neither word character nor space became a space."""
    return token_count(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[^\w\s]", " "))


def hash_user(c: Column) -> Column:
    """First 16 hex digits of SHA-256; empty for no name."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(F.substring(F.sha2(c, 256), 1, 16))


def truncate(c: Column, n: int, mark: str = "...") -> Column:
    """At most n characters, the mark included."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - len(mark)), F.lit(mark))).otherwise(c)


def split_words(c: Column) -> Column:
    """A comma-joined list as an array, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def hyphens_to_spaces(c: Column) -> Column:
    return F.translate(c, "-", " ")


def month_label(c: Column) -> Column:
    return F.format_string("M%02d", c)


def short_label(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def strip_language_label(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("__label__"), F.lit("")), F.lit("\n"), F.lit(" "))


def file_name(c: Column) -> Column:
    return F.translate(c, " /", "_-")


def is_degrading(slang: Column, formal: Column) -> Column:
    """The formal form is the slang word two or more times."""
    words = tokens(formal)
    return (F.size(words) > 1) & F.forall(words, lambda w: w == slang)


def replace_slang(c: Column, lexicon: dict[str, str]) -> Column:
    """Token by token, once; values may be several words. For lexicons that fit a literal (see operators.lexicon for larger ones).

    A map is searched key by key, so the literal is an array of small maps, found by the token's checksum.
    """
    if not lexicon:
        return F.array_join(tokens(c), " ")
    n = max(1, len(lexicon) // 2)
    buckets: list[dict[str, str]] = [{} for _ in range(n)]
    for slang, formal in lexicon.items():
        buckets[zlib.crc32(slang.encode()) % n][slang] = formal
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string, string>>")
    own = lambda t: F.try_element_at(F.element_at(table, (F.crc32(t.cast("binary")) % n + 1).cast("int")), t)
    return F.array_join(F.transform(tokens(c), lambda t: F.coalesce(own(t), t)), " ")
