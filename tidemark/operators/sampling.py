"""Exact-size stratified samples and their labelling sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.schemas import require


def lot(key: str, seed: int) -> Column:
    """A row's place in the draw: the MD5 of seed and key, which any engine can compute."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratum_feasibility(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """stratum, population, feasible."""
    return df.groupBy(stratum).agg(F.count("*").alias("population")).withColumn("feasible", F.col("population") >= n)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int = 25, seed: int = 42, check: bool = True) -> DataFrame:
    """n rows of each stratum without replacement, in shuffled order; reruns agree. check runs a count first and raises ValueError for a small stratum."""
    require(df, stratum, key)
    if check:
        small = stratum_feasibility(df, stratum, n).where(~F.col("feasible")).limit(20).collect()
        if small:
            raise ValueError(f"strata with fewer than {n} rows: {sorted((r[0], r.population) for r in small)}")
    place = F.row_number().over(W.partitionBy(stratum).orderBy(lot(key, seed), key))
    return df.withColumn("_n", place).where(F.col("_n") <= n).drop("_n").orderBy(lot(key, seed + 1), key)


def sample_sizes(df: DataFrame, stratum: str, n: int = 25) -> DataFrame:
    """What stratified_sample() takes of each stratum."""
    return stratum_feasibility(df, stratum, n).select(stratum, "population", F.least("population", F.lit(n)).alias("sample"))


def simple_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(lot(key, seed), key).limit(n)


def labelling_sheet(df: DataFrame, key: str = "review_id", rating: str = "rating", text: str = "review_text_cleaned", stratum: str = "relative_month") -> DataFrame:
    """stratum, rating, text, empty category and notes, key, then the rest."""
    require(df, stratum, rating, text, key)
    first = [stratum, rating, text, "category", "notes", key]
    made = df.withColumn("category", F.lit("")).withColumn("notes", F.lit(""))
    return made.select(*first, *[c for c in df.columns if c not in first])
