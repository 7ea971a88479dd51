"""Decisions on statistics as CASE expressions. Thresholds are parameters and inclusive where named "at least"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import DRIFT_LABELS


def classify_trend(slope: Column, p: Column | None = None, trend: Column | None = None, alpha: float = 0.05) -> Column:
    """With p: stable unless p < alpha, then emerging for a positive slope, else declining (a slope of 0 too). Without: by the trend's name."""
    if p is not None:
        return F.when(p.isNull() | (p >= alpha), "stable").when(slope > 0, "emerging").otherwise("declining")
    return F.when(trend == "increasing", "emerging").when(trend == "decreasing", "declining").otherwise("stable")


def practically_stable(slope: Column, significant: Column, least: float = 1e-6) -> Column:
    return F.coalesce((F.abs(slope) < least) & significant, F.lit(False))


def final_class(cls: Column, slope: Column, significant: Column) -> Column:
    return F.when(practically_stable(slope, significant), "Stable (practically)").otherwise(cls)


def drift_pattern(semantic: Column, lexical: Column, t1: float = 0.95, t2: float = 0.60, labels: tuple[str, str, str, str] = DRIFT_LABELS) -> Column:
    high1, high2 = semantic >= t1, lexical >= t2
    return F.when(high1 & high2, labels[0]).when(high1, labels[1]).when(high2, labels[2]).otherwise(labels[3])


def divergence(freq_class: Column, prop_class: Column) -> Column:
    return (
        F.when(freq_class == prop_class, "consistent")
        .when((prop_class == "emerging") & freq_class.isin("stable", "declining"), "persistent_share")
        .when((prop_class == "declining") & freq_class.isin("stable", "emerging"), "fading_share")
        .when((prop_class == "stable") & (freq_class != "stable"), "volume_only")
        .otherwise("other")
    )


def divergence_rank(flag: Column) -> Column:
    order = ("persistent_share", "consistent", "fading_share", "volume_only", "other")
    return F.array_position(F.array(*[F.lit(x) for x in order]), flag)


def points_per_year(slope: Column, n_weeks: int = 52) -> Column:
    return F.bround(slope * n_weeks * 100, 2)


def practical_significance(points: Column) -> Column:
    return F.when(F.abs(points) < 0.5, "negligible").when(F.abs(points) < 2.0, "small").otherwise("meaningful")


def late_verdict(early: Column, late: Column) -> Column:
    return F.when(late > early * 1.5, "late-dominated").when(late > early, "modestly late-dominated").otherwise("not late-dominated")


def language_tier(text: Column, preds: Column, lang: str = "id", sure: float = 0.5, maybe: float = 0.2) -> Column:
    """STRUCT<lang_top, lang_top_conf, lang_tier> from the three best predictions (schemas.PREDICTIONS), best first."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    top = F.try_element_at(preds, F.lit(1))
    later = F.exists(F.slice(preds, 2, 2), lambda p: (p["lang"] == lang) & (p["prob"] >= maybe))
    tier = F.when(blank | top.isNull(), 3).when((top["lang"] == lang) & (top["prob"] >= sure), 1).when(top["lang"] == lang, 2).when(later, 2).otherwise(3)
    none = blank | top.isNull()
    return F.struct(F.when(none, "").otherwise(top["lang"]).alias("lang_top"), F.when(none, 0.0).otherwise(top["prob"]).alias("lang_top_conf"), tier.alias("lang_tier"))
