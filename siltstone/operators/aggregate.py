"""Aggregations over memories: statistics, health, quality, quantiles, modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stats(df: DataFrame) -> DataFrame:
    def count(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).cast("long")

    return df.agg(
        F.count("*").alias("total"), count(F.col("layer") == "ltm").alias("ltm"), count(F.col("layer") == "stm").alias("stm"),
        *[count(F.col("tier") == t).alias(t) for t in ("hot", "warm", "cold")],
        F.countDistinct("topic").alias("topics"), F.coalesce(F.avg("strength"), F.lit(0.0)).alias("avg_strength"),
    )


def topic_health(df: DataFrame, many: int = 10, weak: float = 0.3) -> DataFrame:
    return df.groupBy("topic").agg(
        F.count("*").alias("n"), F.avg("strength").alias("avg_strength"), F.sum(F.when(F.col("strength") < weak, 1).otherwise(0)).cast("long").alias("n_weak")
    ).withColumn("needs_consolidation", F.col("n") > many)


def topics(df: DataFrame) -> DataFrame:
    return df.groupBy("topic").agg(F.count("*").alias("n"))


def support(evidence: DataFrame) -> DataFrame:
    """Support and diversity of canonical rows from their evidence."""
    return evidence.groupBy("canonical_id").agg(F.count("*").alias("support"), F.countDistinct("source").alias("diversity"))


def ratio(top: Column, bottom: Column, empty: float = 1.0) -> Column:
    return F.when(F.coalesce(F.sum(bottom), F.lit(0)) == 0, empty).otherwise(F.sum(top) / F.sum(bottom))


def dominant(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the least."""
    n = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return n.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("n"), value))).filter("_r = 1").drop("_r")


def quantiles(df: DataFrame, group: list[str], value: str, qs: tuple[float, ...]) -> DataFrame:
    """Exact quantiles by linear interpolation."""
    return df.groupBy(*group).agg(F.count(value).alias("n"), *[F.percentile(value, F.lit(q)).alias(f"p{round(100 * q)}") for q in qs])


def floor_quantile(df: DataFrame, group: list[str], value: str, q: float, name: str) -> DataFrame:
    """The value at index min(floor(q n), n - 1), not interpolated.  By ranks, so no group meets in one array."""
    one = W.partitionBy(*group)
    ranked = df.withColumn("_i", F.row_number().over(one.orderBy(value)) - 1).withColumn("_n", F.count("*").over(one))
    at = F.least(F.floor(F.lit(q) * F.col("_n")), F.col("_n") - 1)
    return ranked.filter(F.col("_i") == at).select(*group, F.col(value).alias(name))


def canonical_lengths(df: DataFrame, value: str = "bytes") -> DataFrame:
    """Quantiles of content length by cluster, and over all (cluster null), in one pass over grouping sets."""
    return df.cube("cluster_id").agg(F.count("*").alias("n"), F.percentile(value, F.lit(0.25)).alias("p25"), F.percentile(value, F.lit(0.75)).alias("p75"))


def target_bytes(cluster_n: Column, cluster_p25: Column, n: Column, p25: Column, default: float = 4000.0) -> Column:
    value = F.when(cluster_n >= 5, cluster_p25).when(n >= 10, p25).otherwise(default)
    return F.least(F.lit(10000.0), F.greatest(F.lit(2000.0), value))


def concept_quality(llm: Column, seen: Column, parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """The model's own confidence until 50 judged rows, then a weighted mean."""
    total = sum(weights.values())
    value = F.lit(0.0)
    for k, w in weights.items():
        value = value + F.lit(w) * parts[k]
    return F.when(seen < 50, llm).otherwise(value / (total + 0.001))


def learned_weights(df: DataFrame, good: Column, bad: Column, features: list[str]) -> DataFrame:
    """good / (good + bad + 0.001) of the sums of each feature over good and bad rows."""

    def w(f: str) -> Column:
        g, b = F.sum(F.when(good, F.col(f)).otherwise(0.0)), F.sum(F.when(bad, F.col(f)).otherwise(0.0))
        return (g / (g + b + 0.001)).alias(f"w_{f}")

    return df.agg(F.sum(F.when(good, 1).otherwise(0)).cast("long").alias("good"), F.sum(F.when(bad, 1).otherwise(0)).cast("long").alias("bad"), *[w(f) for f in features])


def consecutive_failures(df: DataFrame, group: str, order: list[str], failed: str) -> DataFrame:
    """Failures since the last success, of each group."""
    last = W.partitionBy(group)
    at = df.withColumn("_i", F.row_number().over(last.orderBy(*order)))
    ok = at.withColumn("_ok", F.max(F.when(~F.col(failed), F.col("_i"))).over(last))
    return ok.groupBy(group).agg(F.sum(F.when(F.col(failed) & (F.col("_i") > F.coalesce("_ok", F.lit(0))), 1).otherwise(0)).cast("long").alias("consecutive"), F.avg(F.col(failed).cast("int")).alias("rate"))


def useful_rate(views: Column, dwelt: Column, clicks: Column, thumbs: Column, requeries: Column, w_view=0.3, w_click=0.4, w_thumb=0.3, w_requery=0.5) -> Column:
    """Dwell, clicks and thumbs per view, less new queries per view, in [0, 1]."""
    rate = (w_view * dwelt + w_click * clicks + w_thumb * thumbs - w_requery * requeries) / F.greatest(views, F.lit(1))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), rate))


def kappa(yy: Column, yn: Column, ny: Column, nn: Column) -> Column:
    n = (yy + yn + ny + nn).cast("double")
    po = (yy + nn) / n
    pe = ((yy + yn) * (yy + ny) + (ny + nn) * (yn + nn)) / (n * n)
    return F.when(n == 0, None).when(F.abs(1 - pe) < 1e-12, po).otherwise((po - pe) / (1 - pe))
