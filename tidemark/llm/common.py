"""Shared pieces of the training-data operators."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.tables import lean, materialise, release, shared_dir, spread, table

__all__ = ["WORD", "hot_join", "lean", "literal_rows", "materialise", "release", "shared_dir", "spread", "table", "tidy", "word_count"]

#: A word is a run of characters other than ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_count(text: Column) -> Column:
    """Words of a text as LONG, null text: 0. Stays in the JVM.

    White space is mapped to plain spaces one to one, runs are squeezed by removing every space
    that follows a space; what is left separates the words.
    """
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    squeezed = F.regexp_replace(flat, " {2,}", " ")
    spaces = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit("")))
    return F.when(squeezed == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """A few rows as literals of the plan, without Python data behind them."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def tidy(*forget):
    """For a task's function on batches: at its end calls the module-level functions that empty its module's memories and gives free memory back, as workers stay for other stages."""

    def wrap(work):
        @functools.wraps(work)
        def run(batches):
            try:
                yield from work(batches)
            finally:
                for f in forget:
                    f()
                pa.default_memory_pool().release_unused()

        return run

    return wrap


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: str, how: str = "inner", most: int = 512, broadcast_keys: int = 50_000) -> DataFrame:
    """left joined ("inner" or "left") with right, which has one row a key and in ``rows`` (dropped) how many rows of left have that key. right is read up to four times and should be materialised.

    Keys of more than ``most`` rows are told to left by broadcast, so that none meets in one task: they are at most left's rows / most. If these are
    over ``broadcast_keys``, ``most`` is doubled until they aren't; a key then has a small share of left, which a shuffle deals well.
    """
    while (n_hot := right.where(F.col(rows) > most).limit(broadcast_keys + 1).count()) > broadcast_keys:
        most *= 2
    cold = right.where(F.col(rows) <= most).drop(rows)
    if not n_hot:
        return left.join(cold, key, how)
    hot = F.broadcast(right.where(F.col(rows) > most).drop(rows))
    return left.join(hot, key).unionByName(left.join(hot, key, "left_anti").join(cold, key, how))
