"""Judges and learned settings under watch: agreement, drift, caps, rewards, dwell times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: agreement and pairs that a judge needs, and agreement below which its drift is reported
KAPPA_FLOOR, LEAST_PAIRS, DRIFT = 0.6, 30, 0.7


def agreement(pairs: DataFrame, by: list[str]) -> DataFrame:
    """n and Cohen's kappa of two raters (a, b: booleans) by group; with one class only, their agreement."""
    n = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("o"), F.avg(F.col("a").cast("int")).alias("pa"), F.avg(F.col("b").cast("int")).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return n.select(*by, "n", F.when(F.abs(1 - chance) < 1e-12, F.col("o")).otherwise((F.col("o") - chance) / (1 - chance)).alias("kappa"))


def drift_alerts(windows: DataFrame) -> DataFrame:
    """Windows (group, window, n, kappa) in which agreement falls below the line: enough pairs, and not below it before."""
    from pyspark.sql import Window as W

    before = F.lag("kappa").over(W.partitionBy("group").orderBy("window"))
    w = windows.withColumn("before", before)
    return w.filter((F.col("n") >= LEAST_PAIRS) & (F.col("kappa") < DRIFT) & (F.col("before").isNull() | (F.col("before") >= DRIFT))).select("group", "window", "n", "kappa")


def judge_gate(n: Column, kappa: Column) -> Column:
    """Whether a judge's verdicts may act: not before it has been compared often enough, nor below the floor."""
    valid = kappa.isNotNull() & ~F.isnan(kappa) & kappa.between(-1, 1)
    return F.when(n < LEAST_PAIRS, "insufficient").when(~valid, "invalid").when(kappa < KAPPA_FLOOR, "below_floor").otherwise("trusted")


def calls_left(calls: DataFrame, by: list[str], now, cap: int) -> DataFrame:
    """Calls (ts) of the day before `now` and how many are left under the cap, by group."""
    t = F.lit(now).cast("timestamp")
    used = F.sum(((F.col("ts") > t - F.expr("interval 1 day")) & (F.col("ts") <= t)).cast("int"))
    return calls.groupBy(*by).agg(used.alias("used")).select(*by, "used", F.greatest(F.lit(0), cap - F.col("used")).alias("left"))


def normalized_reward(ranked: DataFrame) -> DataFrame:
    """event, reward: the sum of label / rank, by the number of rows with a label; 0 without one."""
    labels = F.sum((F.col("label") != 0).cast("int"))
    return ranked.groupBy("event").agg(F.when(labels == 0, 0.0).otherwise(F.sum(F.col("label") / F.col("rank")) / labels).alias("reward"))


def dwell_p50(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """The interpolated median of dwell times, rounded."""
    return samples.groupBy(*by).agg(F.floor(F.percentile(value, 0.5) + 0.5).cast("long").alias("p50"))


def refresh_stats(refreshes: DataFrame, least: int = 10) -> DataFrame:
    """n and percentiles of revisions and ages (revisions, age_secs) at refreshes; ages only from enough samples on, else 0."""
    p = lambda c, q: F.floor(F.percentile(c, q) + 0.5).cast("long")
    enough = F.count("*") >= least
    return refreshes.agg(F.count("*").alias("n"), F.when(enough, p("revisions", 0.5)).otherwise(0).alias("revision_p50"), F.when(enough, p("revisions", 0.9)).otherwise(0).alias("revision_p90"), F.when(enough, p("age_secs", 0.5)).otherwise(0).alias("age_p50"))


def counterfactual(events: DataFrame) -> DataFrame:
    """How often the learned threshold would have decided otherwise than the one in force (similarity, hard, shadow)."""
    hit = lambda c: F.col("similarity") > F.col(c)
    n = lambda c: F.sum(c.cast("int")).cast("long")
    return events.agg(F.count("*").alias("n"), n(hit("hard") & hit("shadow")).alias("both"), n(hit("hard") & ~hit("shadow")).alias("hard_only"), n(~hit("hard") & hit("shadow")).alias("shadow_only"))
