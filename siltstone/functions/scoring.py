"""Scores as columns: decay, recency, tiers, admission, linear rerank.  Time enters as columns, never as the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.schema import BETA, by_value

# fixed values: weights of the linear rerank
RERANK = {
    "fts": 0.14, "vec": 0.14, "kg": 0.08, "episode": 0.07, "recency": 0.07, "access": 0.05, "strength": 0.05, "importance": 0.05, "keyword_overlap": 0.05,
    "topic_match": 0.03, "brevity": 0.02, "channels": 0.04, "support": 0.02, "diversity": 0.02, "idle": 0.03, "related": 0.03, "concepts": 0.03, "tier": 0.03,
    "current": 0.03, "survival": 0.02,
}


def seconds(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later.cast("timestamp")) / 1e6 - F.unix_micros(earlier.cast("timestamp")) / 1e6


def days(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return seconds(later, earlier) / 86400


def whole_hours(later: Column, earlier: Column) -> Column:
    s = seconds(later, earlier)
    return F.when(s >= 0, F.floor(s / 3600)).otherwise(F.ceil(s / 3600))


def decay(decay_lambda: Column, access_count: Column, age_days: Column, layer: Column, importance: Column) -> Column:
    """exp(-lambda / (1 + 0.2 accesses) * days^beta); critical rows and new ones don't decay."""
    rate = decay_lambda / (1 + 0.2 * access_count)
    return F.when((importance == "critical") | (age_days <= 0), 1.0).otherwise(F.exp(-rate * F.pow(age_days, by_value(layer, BETA, 1.2))))


def recency_boost(hours: Column) -> Column:
    """1.5 in the first day, falling to 1 after a week."""
    return F.when(hours <= 24, 1.5).when(hours <= 168, 1.5 - 0.5 * (hours - 24) / 144).otherwise(1.0)


def weighted(score: Column, strength: Column, access_count: Column, boost: Column) -> Column:
    return score * strength * (1 + 0.2 * access_count) * boost


def access_rate(access_count: Column, age_days: Column) -> Column:
    return access_count / F.greatest(F.floor(age_days), F.lit(1))


def tier(rate: Column, cold: Column, hot: Column) -> Column:
    """Of an access rate between two quantiles; where these are equal, hot begins one above."""
    top = F.when(cold == hot, cold + 1).otherwise(hot)
    return F.when(rate >= top, "hot").when(rate <= cold, "cold").otherwise("warm")


def blended_strength(n: Column, ebbinghaus: Column, survival: Column) -> Column:
    """The survival curve takes over between 20 and 50 observations."""
    share = (n - 20) / 30
    return F.when((n < 20) | survival.isNull(), ebbinghaus).when(n >= 50, survival).otherwise((1 - share) * ebbinghaus + share * survival)


def promotion_threshold(median_days: Column) -> Column:
    clipped = F.least(F.lit(28.0), F.greatest(F.lit(1.0), median_days))
    return F.when(median_days.isNotNull(), F.least(F.lit(8), F.greatest(F.lit(2), F.ceil(clipped / 7) + 1))).cast("int")


def support_signal(n: Column) -> Column:
    return F.when(n > 1, (n - 1) / n).otherwise(0.0)


def confidence(sources: Column, support: Column, diversity: Column) -> Column:
    base = F.when(sources >= 3, 0.95).when(sources == 2, 0.85).when(sources == 1, 0.62).otherwise(0.0)
    return F.least(F.lit(0.99), base + 0.01 * F.least(F.greatest(support - 1, F.lit(0)), F.lit(4)) + 0.01 * F.least(F.greatest(diversity - 1, F.lit(0)), F.lit(3)))


def admission_threshold(recent_avg: Column) -> Column:
    return F.when(recent_avg < 0.4, F.least(F.lit(0.60), F.lit(0.2) * 1.1)).when(recent_avg > 0.7, F.greatest(F.lit(0.15), F.lit(0.2) * 0.9)).otherwise(0.2)


def admission(quality: Column, novelty: Column, prior: Column, contradiction: Column) -> Column:
    """Texts of no quality aren't admitted at all."""
    return F.when(quality < 0.05, 0.0).otherwise(0.45 * quality + 0.25 * novelty + 0.15 * prior + 0.15 * 0.7 - contradiction)


def rerank(f: dict[str, Column], weights: dict[str, float] = RERANK) -> Column:
    """The linear rerank of twenty features, clamped to [0, 2].  `f` has the raw values."""
    terms = {
        "fts": f["fts"], "vec": f["vec"], "kg": f["kg"], "episode": f["episode"],
        "recency": 1 / (1 + f["age_days"] / 7),
        "access": F.least(f["access_count"], F.lit(20)) / 20,
        "strength": f["strength"],
        "importance": by_value(f["importance"], {"critical": 1.0, "high": 0.8, "medium": 0.6, "low": 0.4}, 0.6),
        "keyword_overlap": f["keyword_overlap"],
        "topic_match": F.when(f["topic_match"], 1.0).otherwise(0.0),
        "brevity": 1 / (1 + f["bytes"] / 500),
        "channels": f["channels"] / 4,
        "support": f["support"] / (f["support"] + 1),
        "diversity": f["diversity"] / (f["diversity"] + 1),
        "idle": 1 / (1 + f["idle_days"] / 14),
        "related": F.least(f["related"], F.lit(10)) / 10,
        "concepts": F.least(f["concepts"], F.lit(5)) / 5,
        "tier": by_value(f["tier"], {"hot": 1.0, "warm": 0.5, "cold": 0.0}, 0.5),
        "current": F.when(f["is_current"], 1.0).otherwise(0.0),
        "survival": F.coalesce(f["survival"], F.lit(0.5)),
    }
    total = F.lit(0.0)
    for name, value in terms.items():
        total = total + F.lit(weights[name]) * value
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), total))
