"""The same normalisation as text.normalize_text(), each distinct chunk of a batch worked on once.

All steps work within a run of characters that are not white space, so a text may be cut at spaces, tabs and line ends. The steps are stated here again for the characters below, on which Java's classes, RE2's and Python's agree; a text
with any other character is left to the expression.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions import text

#: ASCII without odd controls, Latin-1 letters and the usual typographic marks; ª, º, µ and superscripts are not among them.
OTHER_CHARACTERS = "[^\\t\\n\\r -~¡§«°»¿-ÿ–—‘’“”„…€]"
#: Bytes of text worked on at once.
SLICE_BYTES = 16 << 20
#: Chunks that may hold a URL or a letter three times in a row are worked on one by one.
_rare = "[./].|" + "|".join(c * 3 for c in string.ascii_lowercase)
_url = re.compile(r"https?://\S+|www\.\S+|\b\w+\.(?:com|co\.id|id|net|org|io)\S*")
_repeat = re.compile(r"(.)\1{2,}")


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE_BYTES, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES)), at + 1)
        yield at, end
        at = end


def coded_parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct parts between spaces, every part's number in order, where each text's begin: one more than texts). Nulls have the parts of an empty text; empty parts are among them."""
    parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
    begins = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = pc.dictionary_encode(parts.flatten())
    return coded.dictionary, coded.indices.to_numpy(), begins


def normal_chunks(chunks: pa.Array) -> pa.Array:
    """Each chunk's words, joined by a space."""
    c = pc.utf8_lower(chunks)
    rare = pc.match_substring_regex(c, _rare)
    one_by_one = [_repeat.sub(r"\1\1", re.sub("[0-9]+", " ", re.sub(text.EMOTICON, " ", _url.sub(" ", x)))) for x in c.filter(rare).to_pylist()]
    c = pc.replace_substring_regex(c, text.EMOTICON, " ")
    c = pc.replace_with_mask(c, rare, pa.array(one_by_one, pa.string()))
    for pattern in ("[^a-z]+", r"\b[a-z]\b", " +"):
        c = pc.replace_substring_regex(c, pattern, " ")
    return pc.ascii_trim(c, " ")


def _normal(texts: pa.Array) -> pa.Array:
    """Null for null and for a text with other characters."""
    left = pc.fill_null(pc.match_substring_regex(texts, OTHER_CHARACTERS), True)
    chunks, codes, begins = coded_parts(pc.replace_substring_regex(pc.if_else(left, "", texts), "[\\t\\n\\r]", " "))
    done = normal_chunks(chunks)
    keep = pc.not_equal(done, "").to_numpy(zero_copy_only=False)[codes]
    begins = np.concatenate([[0], np.cumsum(keep)])[begins]
    rows = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), done.take(pa.array(codes[keep])))
    return pc.if_else(left, pa.scalar(None, pa.string()), pc.binary_join(rows, " "))


@F.arrow_udf(StringType())
def _normalize(texts: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array([], pa.string()), *[_normal(texts.slice(a, b - a)) for a, b in slices(texts)]])


def normalize_text(c: Column) -> Column:
    """Equal to text.normalize_text(), for long texts and large tables."""
    c = F.coalesce(c, F.lit(""))
    return F.coalesce(_normalize(c), text.normalize_text(c))
