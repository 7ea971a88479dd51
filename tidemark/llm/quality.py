"""Quality rules: base limits and robust multivariate outliers.

Each text gives counts and a vector of transformed statistics. Per language and source, per language and over all, a minimum-covariance-determinant
estimate is made over all documents. There are two starts: medians and absolute deviations, and the mean and covariance of everything. Every
concentration step takes the mean and covariance of the ``share`` of documents that are nearest by Mahalanobis distance, until the
determinant falls no more; of the two ends the one with the smaller determinant counts. A step sends, per group, sums by classes of
distance (at most CLASSES rows), so no group is gathered and a hot group costs what any costs; the nearest classes that hold
the share are taken whole. At the end distances are scaled, up or down, so that their median is that of the chi-squared
distribution, and documents beyond its ``1 - tail`` quantile are rejected. A median under LEAST_MEDIAN counts as that: a group of all but
equal texts doesn't make small differences odd.

A document fails the base rule with fewer than 10 words or when more than 20 % of its words lie in 5-word windows that
the text has twice or more. Groups of fewer than ``least`` documents that pass the base rule take the estimate of their language, and where
that has fewer too, that of all documents, which any number makes. Null text has no words and fails; null language or source is a value like others; repeated rows count as often as they come; an empty table gives no rows.
Only the four named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialise

SYMBOLS = "#*$%&|<>"
WINDOW = 5
FEATURES = ("log_words", "word_length", "distinct", "upper", "marks", "spread")
P = len(FEATURES)
#: Least standard deviation of each statistic: no smaller difference is odd.
FLOOR = (0.35, 0.25, 0.06, 0.02, 0.02, 0.15)
#: Median of the chi-squared distribution with P degrees of freedom.
CHI2_MEDIAN = 5.348120627447121
#: Least median of a group's unscaled squared distances.
LEAST_MEDIAN = 1.0
#: Share of the chi-squared distribution beyond the cutoff. Statistics of short texts have far heavier tails than normal ones.
TAIL = 1e-18
CLASSES = 120
#: Least fall of the log determinant that calls for another step. It's bounded below by FLOOR's, so steps end.
FALL = 1e-3
#: Groups up to which their estimates are broadcast; one has some 300 bytes.
BROADCAST_GROUPS = 5_000
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<double>"
_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]")
_MARK = re.compile(r"[^\w\s]")


def chi2_quantile(tail: float) -> float:
    """The squared distance that a share ``tail`` of the chi-squared distribution with P (an even number of) degrees of freedom exceeds."""
    low, high = 0.0, 2000.0
    for _ in range(100):
        x = (low + high) / 2
        beyond = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(P // 2))
        low, high = (x, high) if beyond > tail else (low, x)
    return high


def repeat_words(words: list[str]) -> int:
    """Words that lie in windows found twice or more."""
    windows = list(zip(*[words[i:] for i in range(WINDOW)]))
    if len(set(windows)) == len(windows):
        return 0
    times, n, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            n += i + WINDOW - max(upto, i)
            upto = i + WINDOW
    return n


def text_stats(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the transformed vector."""
    words = WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    if not n:
        return 0, 0, 0, 0, 0, [0.0] * P
    lengths = np.fromiter(map(len, words), np.int64, n)
    # the share of distinct words falls with length, so the exponent of Heaps' law stands for it
    distinct = math.log(len(set(words)) + 1) / math.log(n + 1)
    upper = sum(1 for c in text if c.isupper()) if text != text.lower() else 0
    # short texts lean to usual values: as if 200 characters in 20 words more stood in each
    x = [math.log1p(n), min(40.0, (chars + 100) / (n + 20)), distinct, math.sqrt((upper + 4) / (chars + 200)), math.sqrt((len(_MARK.findall(text)) + 6) / (chars + 200)), math.log1p(math.sqrt((n * float(lengths.var()) + 180) / (n + 20)))]
    return n, chars, len(_SYMBOL.findall(text)), dup, repeat_words(words), x


def document_stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    kinds = [pa.int64()] * 5 + [pa.list_(pa.float64())]
    names = [c.split()[0] for c in STATS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_stats(t or "") for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]], names)

    return docs.select(F.col(doc_id).cast("long"), F.col(lang).cast("string"), F.col(source).cast("string"), F.col(text).cast("string")).mapInArrow(work, STATS)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _distance(x: Column, at: Column, metric: Column) -> Column:
    """(x - at)' M (x - at); metric holds M by rows."""
    y = [x[i] - at[i] for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        total = total + y[i] * y[i] * metric[i * P + i]
        for j in range(i):
            total = total + 2.0 * y[i] * y[j] * metric[i * P + j]
    return total


def _class(d2: Column) -> Column:
    """Distances by eighths of an octave."""
    return F.least(F.greatest(F.floor(F.log2(d2 + 1e-9) * 8) + 40, F.lit(0)), F.lit(CLASSES - 1)).cast("int")


def _by_class(pdf):
    pdf = pdf.sort_values("cls")
    return pdf, pdf["n"].to_numpy(np.float64).cumsum()


def _concentrate(share: float):
    """A group's rows by class of distance -> its next centre, metric and the log determinant; done, with what it had, where that doesn't fall."""
    floor = np.diag(np.square(FLOOR))

    def work(pdf):
        import pandas as pd

        pdf, upto = _by_class(pdf)
        k = min(int(np.searchsorted(upto, share * upto[-1])) + 1, len(upto))
        sums = np.array(pdf["sums"].iloc[:k].tolist()).sum(0) / upto[k - 1]
        mean = sums[:P]
        cov = np.zeros((P, P))
        cov[np.tril_indices(P)] = sums[P:]
        cov = cov + np.tril(cov, -1).T - np.outer(mean, mean) + floor
        det = float(np.linalg.slogdet(cov)[1])
        head = pdf.iloc[0]
        if det >= head["det"] - FALL:
            got = list(head["at"]), list(head["metric"]), float(head["det"]), True
        else:
            got = (np.array(head["at"]) + mean).tolist(), np.linalg.inv(cov).ravel().tolist(), det, False
        return pd.DataFrame([(head["grp"], head["start"], *got)], columns=["grp", "start", "at", "metric", "det", "done"])

    return work


def _scaled(pdf):
    """A group's rows by class of distance -> its metric, scaled so that the median distance is that of the chi-squared distribution."""
    import pandas as pd

    pdf, upto = _by_class(pdf)
    n = pdf["n"].to_numpy(np.float64)
    half = int(np.searchsorted(upto, upto[-1] / 2))
    inner = (upto[-1] / 2 - upto[half] + n[half]) / n[half]
    d2 = 2 ** ((pdf["cls"].iloc[half] - 40 + inner) / 8)
    metric = np.array(pdf["metric"].iloc[0]) * (CHI2_MEDIAN / max(d2, LEAST_MEDIAN))
    return pd.DataFrame({"grp": pdf["grp"][:1], "at": [list(pdf["at"].iloc[0])], "metric": [metric.tolist()]})


def _estimates(good: DataFrame, groups: DataFrame, share: float) -> DataFrame:
    """grp, x and the groups to estimate -> grp, at, metric. good is read once a step."""
    side = F.broadcast if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else lambda df: df
    good = good.join(side(groups.select("grp")), "grp")
    medians = F.array(*[F.percentile_approx(F.col("x")[i], 0.5, 1000) for i in range(P)])
    start = materialise(good.groupBy("grp").agg(medians.alias("at")))
    off = good.join(side(start), "grp")
    devs = F.array(*[F.percentile_approx(F.abs(F.col("x")[i] - F.col("at")[i]), 0.5, 1000) for i in range(P)])
    est = off.groupBy("grp").agg(F.first("at").alias("at"), devs.alias("dev"))
    cell = lambda i: F.lit(1.0) / (F.col("dev")[i] * F.col("dev")[i] * 2.2 + FLOOR[i] ** 2)
    zero = F.array(*[F.lit(0.0)] * (P * P))  # all documents are equally near: the next step takes everything
    starts = F.array(F.array(*[cell(i) if i == j else F.lit(0.0) for i in range(P) for j in range(P)]), zero)
    est = materialise(est.select("grp", "at", F.posexplode(starts).alias("start", "metric"), F.lit(float("inf")).alias("det"), F.lit(False).alias("done")))
    y = [F.col("x")[i] - F.col("at")[i] for i in range(P)]
    sums = F.array(*[F.sum(v) for v in y], *[F.sum(y[i] * y[j]) for i in range(P) for j in range(i + 1)]).alias("sums")

    def seen(est: DataFrame, by: tuple[str, ...], *more) -> DataFrame:
        near = good.join(side(est), "grp").withColumn("cls", _class(_distance(F.col("x"), F.col("at"), F.col("metric"))))
        return near.groupBy(*by, "cls").agg(F.count("*").alias("n"), F.first("at").alias("at"), F.first("metric").alias("metric"), *more).groupBy(*by)

    ends = est.where("done")
    while est.where(~F.col("done")).limit(1).count():
        step = seen(est.where(~F.col("done")), ("grp", "start"), F.first("det").alias("det"), sums)
        est = materialise(step.applyInPandas(_concentrate(share), "grp long, start int, at array<double>, metric array<double>, det double, done boolean"))
        ends = ends.unionByName(est.where("done"))
    best = ends.groupBy("grp").agg(F.min_by(F.struct("at", "metric"), F.struct("det", "start")).alias("e")).select("grp", "e.*")
    return side(materialise(seen(materialise(best), ("grp",)).applyInPandas(_scaled, "grp long, at array<double>, metric array<double>")))


def outlier_distances(stats: DataFrame, share: float = 0.75, least: int = 60) -> DataFrame:
    """stats -> with d2, the squared robust distance by the narrowest level that has an estimate; 0 where no document passes the base rule. stats is read once a step."""
    levels = (("lang", "source"), least), (("lang",), least), ((), 1)
    grp = [F.xxhash64(F.lit(len(keys)), F.to_json(F.struct(*keys)) if keys else F.lit("")) for keys, _ in levels]
    each = F.array(*[F.struct(g.alias("grp"), F.lit(n).alias("least")) for g, (_, n) in zip(grp, levels)])
    good = stats.where(~base_failed()).select("x", F.inline(each))
    groups = materialise(good.groupBy("grp", "least").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("least")))
    est = _estimates(good.select("grp", "x"), groups, share)
    far = stats.withColumn("d2", F.lit(None).cast("double"))
    for g in grp:
        d2 = F.coalesce("d2", _distance(F.col("x"), F.col("at"), F.col("metric")))
        far = far.withColumn("grp", g).join(est, "grp", "left").withColumn("d2", d2).drop("grp", "at", "metric")
    return far.withColumn("d2", F.coalesce("d2", F.lit(0.0)))


def quality_rules(docs: DataFrame, tail: float = TAIL, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2."""
    stats = materialise(document_stats(docs, doc_id, text, lang, source))
    far = outlier_distances(stats)
    failed, cutoff = base_failed(), chi2_quantile(tail)
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("d2") <= cutoff)).alias("kept"), "d2")
