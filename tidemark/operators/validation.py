"""Stratified estimates of category shares (Cochran)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import TECHNICAL
from tidemark.schemas import require


class Summary(NamedTuple):
    per_category: DataFrame
    per_stratum: DataFrame
    totals: DataFrame


def weighted_proportion(labeled: DataFrame, population: DataFrame, stratum: str = "relative_month", category: str = "category", technical: tuple[str, ...] = TECHNICAL) -> DataFrame:
    """category, raw_count, raw_pct, weighted_pct, is_technical.

    weighted_pct is the sum over strata of population share times share within the stratum's sample. Strata without a sample are
    left out and the rest isn't scaled up, so the sum may be below 100.
    """
    require(labeled, stratum, category)
    require(population, stratum)
    everything = W.partitionBy()
    weight = population.groupBy(stratum).agg(F.count("*").alias("N_m")).withColumn("weight", F.col("N_m") / F.sum("N_m").over(everything))
    cells = labeled.where(F.col(category).isNotNull()).groupBy(stratum, category).agg(F.count("*").alias("n_cm"))
    cells = cells.withColumn("p", F.col("n_cm") / F.sum("n_cm").over(W.partitionBy(stratum)))
    sizes = labeled.agg(F.count("*").alias("n_all"))
    made = cells.join(weight, stratum, "left").groupBy(category).agg(F.sum("n_cm").alias("raw_count"), (F.coalesce(F.sum(F.col("p") * F.col("weight")), F.lit(0.0)) * 100).alias("weighted_pct"))
    made = made.join(F.broadcast(sizes))  # one row
    return made.select(category, "raw_count", (F.col("raw_count") / F.col("n_all") * 100).alias("raw_pct"), "weighted_pct", F.col(category).isin(*technical).alias("is_technical")).orderBy(F.desc("is_technical"), F.desc("weighted_pct"), category)


def validity_per_stratum(labeled: DataFrame, population: DataFrame, stratum: str = "relative_month", category: str = "category", technical: tuple[str, ...] = TECHNICAL) -> DataFrame:
    """stratum, validity_pct, population_count, sample_count."""
    valid = labeled.groupBy(stratum).agg((F.avg(F.coalesce(F.col(category).isin(*technical), F.lit(False)).cast("int")) * 100).alias("validity_pct"), F.count("*").alias("sample_count"))
    return valid.join(population.groupBy(stratum).agg(F.count("*").alias("population_count")), stratum).select(stratum, "validity_pct", "population_count", "sample_count")


def validation_summary(labeled: DataFrame, population: DataFrame, stratum: str = "relative_month", category: str = "category", technical: tuple[str, ...] = TECHNICAL) -> Summary:
    per_category = weighted_proportion(labeled, population, stratum, category, technical)
    per_stratum = validity_per_stratum(labeled, population, stratum, category, technical)
    totals = per_category.where("is_technical").agg(F.coalesce(F.sum("weighted_pct"), F.lit(0.0)).alias("overall_validity_pct"), F.coalesce(F.sum("raw_pct"), F.lit(0.0)).alias("raw_validity_pct"))
    totals = totals.join(F.broadcast(population.agg(F.count("*").alias("population_total")))).join(F.broadcast(labeled.agg(F.count("*").alias("sample_total"))))
    return Summary(per_category, per_stratum, totals)


def headline(summary: Summary, stratum: str = "relative_month") -> DataFrame:
    """metric, value: nine rows."""
    v = F.col("validity_pct")
    spread = summary.per_stratum.agg(F.count("*").alias("strata"), F.min("sample_count").alias("per"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    row = summary.totals.join(F.broadcast(spread))
    pairs = (
        ("Total Population", F.col("population_total")), ("Sample Size", F.col("sample_total")), ("Strata", F.col("strata")), ("Sample per Stratum", F.col("per")),
        ("Raw Validity %", F.round("raw_validity_pct", 2)), ("Weighted Validity %", F.round("overall_validity_pct", 2)),
        ("Min Validity %", F.round("lo", 2)), ("Max Validity %", F.round("hi", 2)), ("Range Validity %", F.round(F.col("hi") - F.col("lo"), 2)),
    )
    return row.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), x.cast("double").alias("value")) for m, x in pairs])))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """column, count, pct rounded to 2 digits."""
    made = df.groupBy(column).count()
    return made.withColumn("pct", F.bround(F.col("count") / F.sum("count").over(W.partitionBy()) * 100, 2))
