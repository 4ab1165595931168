"""Learning from feedback: rewards, fusion weights, decayed means, shrinkage, folds, co-recall."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def correlated(recalls: DataFrame, feedback: DataFrame, seconds: int = 600) -> DataFrame:
    """recall_id, feedback_id: by request where both have one, else within a span of time of the same user.

    The band join is an equi-join on time buckets: each recall stands in its own bucket and both neighbours.
    """
    exact = recalls.filter("request is not null").join(feedback.filter("request is not null").select("request", "feedback_id"), "request").select("recall_id", "feedback_id")
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000))
    r = recalls.select("recall_id", "user", F.col("ts").alias("t0"), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("bucket"))
    f = feedback.filter("request is null").select("feedback_id", "user", F.col("ts").alias("t1"), bucket.alias("bucket"))
    gap = F.abs(F.unix_micros(F.col("t0").cast("timestamp")) - F.unix_micros(F.col("t1").cast("timestamp")))
    near = r.join(f, ["user", "bucket"]).filter(gap < seconds * 1_000_000).select("recall_id", "feedback_id")
    return exact.unionByName(near).distinct()


def co_recalled(recalled: DataFrame) -> DataFrame:
    """a, b, n: how often two rows came back for one request (request, id)."""
    x = recalled.distinct()
    y = x.select("request", F.col("id").alias("b"))
    return x.select("request", F.col("id").alias("a")).join(y, "request").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def tie_averaged_rr(scored: DataFrame, by: list[str]) -> DataFrame:
    """rr: 1 / rank, averaged over rows of equal score."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return scored.withColumn("_rr", 1 / rank).withColumn("rr", F.avg("_rr").over(W.partitionBy(*by, "score"))).drop("_rr")


def _by_event(candidates: DataFrame) -> DataFrame:
    """event, c: the candidates of each event; a recall returns few, so an event fits into a row."""
    return candidates.groupBy("event").agg(F.collect_list(F.struct("id", "bm25", "vec", "rest", "label")).alias("c"))


def _reward(c: Column, alpha: Column) -> Column:
    """The sum of label / rank of an event's candidates under a mixture of the two channels."""
    score = lambda x: F.round(alpha * x["bm25"] + (1 - alpha) * x["vec"] + x["rest"], 12)
    ranked = F.array_sort(F.transform(c, lambda x: F.struct((-score(x)).alias("k"), x["id"].alias("id"), x["label"].alias("label"))))
    return F.aggregate(F.transform(ranked, lambda x, i: x["label"] / (i + 1)), F.lit(0.0), lambda a, x: a + x)


def alpha_rewards(candidates: DataFrame, alphas: list[float]) -> DataFrame:
    """event, alpha, reward: the sum of label / rank under each mixture of the two channels.

    candidates: event, id, bm25, vec, rest, label (1 used, -1 unhelpful, 0 else).
    """
    grid = F.array(*[F.lit(a) for a in alphas])
    at = _by_event(candidates).select("event", F.explode(F.transform(grid, lambda a: F.struct(a.alias("alpha"), _reward(F.col("c"), a).alias("reward")))).alias("x"))
    return at.select("event", "x.alpha", "x.reward")


def best_alpha(candidates: DataFrame, coarse: int = 20, fine: int = 10, reach: float = 0.05) -> DataFrame:
    """event, alpha, reward: the first best of a coarse grid, then of a fine one within `reach` of it, if that is better.
    Events without a label, and those whose coarse grid is flat, have no signal and go."""
    at = lambda a: F.struct(F.round(_reward(F.col("c"), a), 12).alias("reward"), (-a).alias("minus"))
    events = _by_event(candidates).filter(F.exists("c", lambda x: x["label"] != 0))
    events = events.withColumn("grid", F.transform(F.array(*[F.lit(i / coarse) for i in range(coarse + 1)]), at))
    events = events.select("event", "c", F.array_max("grid").alias("top"), F.array_min("grid")["reward"].alias("low")).filter("top.reward > low")
    middle = -F.col("top.minus")
    lo, hi = F.greatest(middle - reach, F.lit(0.0)), F.least(middle + reach, F.lit(1.0))
    events = events.withColumn("near", F.array_max(F.transform(F.sequence(F.lit(0), F.lit(fine)), lambda i: at(lo + (hi - lo) * i / fine))))
    best = F.when(F.col("near.reward") > F.col("top.reward"), F.col("near")).otherwise(F.col("top"))
    return events.select("event", (-best["minus"]).alias("alpha"), best["reward"].alias("reward"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def event_weight(age_days: Column, rate: float = 0.06) -> Column:
    return F.exp(-rate * age_days)


def effective_size(previous: Column, days: Column, n: Column, rate: float = 0.06) -> Column:
    return (F.round(previous * F.exp(-rate * days)) + n).cast("long")


def shrunk(n: Column, value: Column, prior: Column, strength: float = 5.0) -> Column:
    return (n * value + strength * prior) / (n + strength)


def buckets(events: DataFrame, prior: float = 0.5, strength: float = 5.0) -> DataFrame:
    """Means over all, by type, and by type and cluster, each drawn towards the level above (events: type, cluster, alpha, weight)."""
    by = events.groupBy("type", "cluster").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.sum(F.col("alpha") * F.col("weight")).alias("s"))
    level = lambda *g: by.groupBy(*g).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("w")).alias("raw"))
    top = level().select(F.lit(None).cast("string").alias("type"), F.lit(None).cast("int").alias("cluster"), "n", shrunk(F.col("n"), F.col("raw"), F.lit(prior), strength).alias("alpha"))
    one = top.select(F.col("alpha").alias("_p"))
    mid = level("type").crossJoin(F.broadcast(one)).select("type", F.lit(None).cast("int").alias("cluster"), "n", shrunk(F.col("n"), F.col("raw"), F.col("_p"), strength).alias("alpha"))
    low = level("type", "cluster").join(mid.select("type", F.col("alpha").alias("_p")), "type").select("type", "cluster", "n", shrunk(F.col("n"), F.col("raw"), F.col("_p"), strength).alias("alpha"))
    return top.unionByName(mid).unionByName(low)


def resolve(buckets: DataFrame, wanted: DataFrame, least: int = 10) -> DataFrame:
    """The alpha of the most special bucket with enough events for each (type, cluster) wanted."""
    ok = buckets.filter(F.col("n") >= least)
    out = wanted.join(ok.filter("cluster is not null").select("type", "cluster", F.col("alpha").alias("a1")), ["type", "cluster"], "left")
    out = out.join(ok.filter("cluster is null and type is not null").select("type", F.col("alpha").alias("a2")), "type", "left")
    top = ok.filter("type is null").agg(F.max("alpha").alias("a3"))
    return out.crossJoin(F.broadcast(top)).select("type", "cluster", F.coalesce("a1", "a2", "a3").alias("alpha"))


def family_mean(rows: DataFrame, family: str, value: str) -> DataFrame:
    """The mean of the families' means."""
    return rows.groupBy(family).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("value"), F.count("*").alias("families"))


def settled_prefix(events: DataFrame) -> DataFrame:
    """Events before the first one that isn't settled (id, settled)."""
    block = events.agg(F.min(F.when(~F.col("settled"), F.col("id"))).alias("_b"))
    return events.crossJoin(F.broadcast(block)).filter(F.col("_b").isNull() | (F.col("id") < F.col("_b"))).drop("_b")


def exploration(counts: dict[str, int], theta: float) -> float:
    """The dedup threshold after an exploration of raised and lowered ones, by their duplicate rates."""
    raised, lowered = counts["raised"], counts["lowered"]
    if raised + lowered < 10 or min(raised, lowered) < 5:
        return theta
    up, down = counts["raised_duplicates"] / raised, counts["lowered_duplicates"] / lowered
    step = -0.02 if down > up + 0.15 else 0.02 if up > down + 0.15 else 0.0
    return min(0.90, max(0.40, theta + step))


def rerank_step(weights: dict[str, float], events: list[tuple[dict[str, float], float]], rate: float = 0.005) -> dict[str, float]:
    """Rerank weights after a fold of (features, signal) in their order: gradient steps that keep the learnable weights'
    subtotal, none below 0."""
    w = dict(weights)
    learnable = [k for k in w if any(k in f for f, _ in events)]
    total = sum(w[k] for k in learnable)
    for f, signal in events:
        for k in learnable:
            w[k] = max(0.0, w[k] + rate * signal * f.get(k, 0.0))
        now = sum(w[k] for k in learnable)
        if now > 0:
            for k in learnable:
                w[k] *= total / now
    return w
