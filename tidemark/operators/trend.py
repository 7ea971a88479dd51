"""Mann-Kendall trend tests with Hamed-Rao correction, Sen slopes and false-discovery control.

A topic's series is gathered into one array (as long as there are periods, so bounded) and tested by array expressions: one shuffle and no
self-joins. Only the normal tail of the p-value, which Spark lacks, is a vectorised UDF over one row per topic.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import decide

#: Distinct values below which a series has no test.
LEAST_DISTINCT = 3


def _gathered(series: DataFrame, topic: str, period: str, value: str) -> DataFrame:
    """topic, x: a topic's values in order of period. One shuffle; everything else is computed on these short arrays."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(period), F.col(value).cast("double").alias("v"))))
    return series.groupBy(F.col(topic).alias("topic")).agg(F.transform(pairs, lambda p: p["v"]).alias("x")).withColumn("n", F.size("x").cast("long"))


def _range(low: Column, high: Column) -> Column:
    """Whole numbers from low to high; none if low is above."""
    return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _median(values: Column) -> Column:
    v, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)


def _with_sen(gathered: DataFrame) -> DataFrame:
    """Adds s, tau, slope, intercept, n_distinct."""
    x, n = F.col("x"), F.col("n")
    over_pairs = lambda f: F.flatten(F.transform(_range(F.lit(0), n - 2), lambda i: F.transform(_range(i + 1, n - 1), lambda j: f(i, j))))
    made = gathered.withColumns({
        "s": _total(over_pairs(lambda i, j: F.signum(F.get(x, j) - F.get(x, i)))),
        "slope": _median(over_pairs(lambda i, j: (F.get(x, j) - F.get(x, i)) / (j - i))),
        "mid": _median(x), "n_distinct": F.size(F.array_distinct(x)).cast("long"),
    })
    tau = F.when(n > 1, F.col("s") / (n * (n - 1) / 2))
    return made.withColumn("tau", tau).withColumn("intercept", F.col("mid") - F.coalesce("slope", F.lit(0.0)) * (n - 1) / 2)


def _with_variance(gathered: DataFrame) -> DataFrame:
    """Adds var0: the variance of S with ties and without autocorrelation."""
    x, n = F.col("x"), F.col("n")
    t = F.transform(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda w: w == v)).cast("double"))
    return gathered.withColumn("var0", (n * (n - 1) * (2 * n + 5) - _total(F.transform(t, lambda k: k * (k - 1) * (2 * k + 5)))) / 18)


def s_tau_sen(series: DataFrame, topic: str = "topic", period: str = "relative_week", value: str = "freq") -> DataFrame:
    """topic, n, s, tau, slope, intercept, n_distinct."""
    return _with_sen(_gathered(series, topic, period, value)).select("topic", "n", "s", "tau", "slope", "intercept", "n_distinct")


def tie_variance(series: DataFrame, topic: str = "topic", period: str = "relative_week", value: str = "freq") -> DataFrame:
    """topic, var0."""
    return _with_variance(_gathered(series, topic, period, value)).select("topic", "var0")


def hamed_rao(series: DataFrame, topic: str = "topic", period: str = "relative_week", value: str = "freq", alpha: float = 0.05) -> DataFrame:
    """topic, n, s, tau, slope, intercept, n_distinct, var0, corr, var_s, z."""
    df = _with_variance(_with_sen(_gathered(series, topic, period, value)))
    n, y, r, d, rho = F.col("n"), F.col("y"), F.col("r"), F.col("d"), F.col("rho")
    df = df.withColumn("y", F.transform("x", lambda v, i: v - F.col("slope") * i))
    df = df.withColumn("r", F.transform(y, lambda v: F.size(F.filter(y, lambda w: w < v)) + (F.size(F.filter(y, lambda w: w == v)) + 1) / 2))
    df = df.withColumn("d", F.transform(r, lambda v: v - _total(r) / n))
    lagged = lambda k: _total(F.transform(_range(F.lit(0), n - k - 1), lambda i: F.get(d, i) * F.get(d, i + k)))
    df = df.withColumn("rho", F.transform(_range(F.lit(1), n - 1), lambda k: F.struct(k.cast("double").alias("k"), F.when(lagged(F.lit(0)) > 0, lagged(k) / lagged(F.lit(0))).alias("v"))))
    bound = NormalDist().inv_cdf(1 - alpha / 2) / F.sqrt(n)
    kept = F.transform(rho, lambda e: F.when(F.abs(e["v"]) > bound, (n - e["k"]) * (n - e["k"] - 1) * (n - e["k"] - 2) * e["v"]).otherwise(0.0))
    corr = F.when(n > 2, 1 + 2 / (n * (n - 1) * (n - 2)) * _total(kept))
    df = df.withColumn("corr", corr).withColumn("var_s", F.col("var0") * F.coalesce("corr", F.lit(1.0)))
    z = F.when(F.col("s") == 0, 0.0).when(F.col("var_s") > 0, (F.col("s") - F.signum("s")) / F.sqrt("var_s"))
    return df.withColumn("z", z).select("topic", "n", "s", "tau", "slope", "intercept", "n_distinct", "var0", "corr", "var_s", "z")


def two_sided_p(z: Column) -> Column:
    @F.pandas_udf("double")
    def tail(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)))

    return tail(z)


def mann_kendall(series: DataFrame, topic: str = "topic", period: str = "relative_week", value: str = "freq", alpha: float = 0.05) -> DataFrame:
    """topic, trend, p, z, tau, s, var_s, slope, intercept, significant, classification. Series of fewer than three values: insufficient_variance, nulls, stable."""
    made = hamed_rao(series, topic, period, value, alpha).withColumn("p", two_sided_p(F.col("z")))
    few = F.col("n_distinct") < LEAST_DISTINCT
    only = lambda c: F.when(~few, F.col(c)).alias(c)
    sure = F.coalesce(F.col("p") < alpha, F.lit(False))
    trend = F.when(few, "insufficient_variance").when(sure & (F.col("z") > 0), "increasing").when(sure & (F.col("z") < 0), "decreasing").otherwise("no trend")
    cls = F.when(few, "stable").otherwise(decide.classify_trend(F.col("slope"), F.col("p"), alpha=alpha))
    return made.select("topic", trend.alias("trend"), *[only(c) for c in ("p", "z", "tau", "s", "var_s", "slope", "intercept")], (sure & ~few).alias("significant"), cls.alias("classification"))


def fdr(results: DataFrame, p: str = "p", slope: str = "slope", alpha: float = 0.05, key: str = "topic") -> DataFrame:
    """Adds p_adj (Benjamini-Hochberg), significant_fdr, classification_fdr. Null p stays out of the count. One row per topic, so one task orders them."""
    has = F.col(p).isNotNull()
    n = F.count(p).over(W.partitionBy())
    rank = F.row_number().over(W.partitionBy(has).orderBy(p, key))
    made = results.withColumn("_n", n).withColumn("_r", rank)
    after = W.partitionBy(has).orderBy("_r").rowsBetween(0, W.unboundedFollowing)
    made = made.withColumn("p_adj", F.when(has, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(after)))).drop("_n", "_r")
    sure = F.coalesce(F.col("p_adj") < alpha, F.lit(False))
    return made.withColumn("significant_fdr", sure).withColumn("classification_fdr", F.when(~sure, "stable").when(F.col(slope) > 0, "emerging").otherwise("declining"))


def compare(freq: DataFrame, prop: DataFrame, key: str = "topic") -> DataFrame:
    """Both results side by side with consistency, divergence and practical significance."""
    side = lambda df, name: df.select(key, F.col("classification_fdr").alias(f"{name}_class"), F.col("slope").alias(f"{name}_slope"), F.col("p_adj").alias(f"{name}_p_adj"))
    made = side(freq, "freq").join(side(prop, "prop"), key)
    points = decide.points_per_year(F.col("prop_slope"))
    return made.withColumns({
        "consistent": F.col("freq_class") == F.col("prop_class"), "divergence": decide.divergence(F.col("freq_class"), F.col("prop_class")),
        "pp_per_year": points, "practical": decide.practical_significance(points),
    })


def ordered(results: DataFrame, by: str, classes: tuple[str, ...] = ("emerging", "declining", "stable"), key: str = "topic") -> DataFrame:
    """results sorted by rising "slope", rising corrected "p" (nulls last), or "class" (in the given order, then falling slope); ties by key."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("classification_fdr"))
    order = {"slope": [F.col("slope")], "p": [F.asc_nulls_last("p_adj")], "class": [F.when(place == 0, len(classes) + 1).otherwise(place), F.desc("slope")]}
    return results.orderBy(*order[by], key)


def edge_cases(comparison: DataFrame) -> DataFrame:
    """Significant by test, yet negligible or small."""
    return comparison.where((F.col("prop_class") != "stable") & F.col("practical").isin("negligible", "small"))


def class_crosstab(comparison: DataFrame, rows: str = "prop_class", columns: str = "practical") -> DataFrame:
    """Counts with margins, named Total."""
    cube = comparison.cube(rows, columns).agg(F.count("*").alias("n"))
    return cube.select(F.coalesce(rows, F.lit("Total")).alias(rows), F.coalesce(columns, F.lit("Total")).alias(columns), "n")


def significant_lines(series: DataFrame, results: DataFrame, key: str = "topic", period: str = "relative_week", value: str = "freq") -> DataFrame:
    """topic, week, value, sen_line of the topics with a significant trend."""
    sure = results.where("significant_fdr").select(F.col("topic").alias(key), "slope", "intercept")
    return series.join(sure, key).select(key, period, value, (F.col("intercept") + F.col("slope") * (F.col(period) - 1)).alias("sen_line"))
