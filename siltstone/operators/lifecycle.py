"""Survival, tiers, decay, pruning, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import scoring


def tiering(rates: DataFrame) -> DataFrame:
    """rates (id, rate, ...) with tier, by the exact quartiles of the rates."""
    q = rates.agg(F.percentile("rate", F.lit(0.25)).alias("_c"), F.percentile("rate", F.lit(0.75)).alias("_h"))
    return rates.crossJoin(F.broadcast(q)).withColumn("tier", scoring.tier(F.col("rate"), F.col("_c"), F.col("_h"))).drop("_c", "_h")


def lag_intervals(accesses: DataFrame, as_of) -> DataFrame:
    """id, days, event: the time from each access to the next one; the last is censored at as_of."""
    after = F.lead("ts").over(W.partitionBy("id").orderBy("ts"))
    end = F.coalesce(after.cast("timestamp"), F.lit(as_of).cast("timestamp"))
    return accesses.select("id", scoring.days(end, F.col("ts")).alias("days"), after.isNotNull().alias("event"))


def summary_intervals(rows: DataFrame, most: int = 20) -> DataFrame:
    """id, days, event of rows (id, age_days, idle_days, access_count): no access is one censored interval; one is an event
    if later than 0.01 days; n of them are min(n, 20) events of equal length; and the idle time is censored."""
    n, span = F.col("access_count"), F.col("age_days") - F.col("idle_days")
    events = F.when(n == 0, F.array().cast("array<double>")).when(n == 1, F.when(span > 0.01, F.array(span)).otherwise(F.array().cast("array<double>"))).otherwise(F.array_repeat(span / n, F.least(n, F.lit(most))))
    censored = F.when(n == 0, F.col("age_days")).otherwise(F.col("idle_days"))
    each = F.concat(F.transform(events, lambda x: F.struct(x.alias("days"), F.lit(True).alias("event"))), F.array(F.struct(censored.alias("days"), F.lit(False).alias("event"))))
    return rows.select(*[c for c in rows.columns if c not in ("age_days", "idle_days", "access_count")], F.explode(each).alias("_x")).select("*", "_x.days", "_x.event").drop("_x")


def kaplan_meier(intervals: DataFrame, group: list[str]) -> DataFrame:
    """group, t, at_risk, events, survival: the curve's steps.  Intervals are counted by time first, so the windows run
    over distinct times only."""
    at = intervals.groupBy(*group, F.col("days").alias("t")).agg(F.count("*").alias("n"), F.sum(F.col("event").cast("int")).cast("long").alias("events"))
    one = W.partitionBy(*group).orderBy("t")
    at = at.withColumn("at_risk", F.sum("n").over(one.rowsBetween(0, W.unboundedFollowing)))
    at = at.filter("events > 0")
    dead = F.max((F.col("events") == F.col("at_risk")).cast("int")).over(one.rowsBetween(W.unboundedPreceding, 0)) == 1
    log = F.sum(F.when(F.col("events") < F.col("at_risk"), F.log1p(-F.col("events") / F.col("at_risk"))).otherwise(0.0)).over(one.rowsBetween(W.unboundedPreceding, 0))
    return at.select(*group, "t", "at_risk", "events", F.when(dead, 0.0).otherwise(F.exp(log)).alias("survival"))


def median_survival(curve: DataFrame, group: list[str]) -> DataFrame:
    return curve.groupBy(*group).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median"))


def curve_value(steps: Column, t: Column) -> Column:
    """S(t) of an array of structs (t, s): the last step at or before t; behind the last step the hazard goes on
    log-linearly from the last two steps, down to 0."""
    before = F.filter(steps, lambda x: x["t"] <= t)
    n = F.size(steps)
    last = F.element_at(steps, -1)
    prior = F.when(n > 1, F.element_at(steps, -2)["t"]).otherwise(0.0)
    prior_s = F.when(n > 1, F.element_at(steps, -2)["s"]).otherwise(1.0)
    rate = (F.log(F.greatest(last["s"], F.lit(1e-12))) - F.log(F.greatest(prior_s, F.lit(1e-12)))) / F.greatest(last["t"] - prior, F.lit(1e-9))
    beyond = F.greatest(F.lit(0.0), last["s"] * F.exp(rate * (t - last["t"])))
    return F.when(n == 0, 1.0).when(t > last["t"], beyond).when(F.size(before) == 0, 1.0).otherwise(F.element_at(before, -1)["s"])


def prunable(df: DataFrame, below: float = 0.05) -> DataFrame:
    return df.filter((F.col("layer") == "stm") & (F.col("strength") < below) & ~F.col("importance").isin("critical", "high"))


def decayed(df: DataFrame, as_of) -> DataFrame:
    """Strengths as of a time, by the days since each row's last access; critical rows stay at 1."""
    age = scoring.days(F.lit(as_of), F.col("last_accessed"))
    return df.withColumn("strength", scoring.decay(F.col("decay_lambda"), F.col("access_count"), age, F.col("layer"), F.col("importance")))


def garbage(df: DataFrame, as_of, below: float = 0.05, dry_run: bool = True) -> DataFrame:
    """The rows that pruning after decay removes (dry run), or those that it leaves."""
    now = decayed(df, as_of)
    gone = prunable(now, below)
    return gone if dry_run else now.join(gone.select("id"), "id", "left_anti")


def promoted(df: DataFrame, accesses: DataFrame, medians: DataFrame | None = None, after: int = 5) -> DataFrame:
    """Count accesses; short-term rows over their threshold move to long-term memory and decay more slowly."""
    hits = accesses.groupBy("id").agg(F.count("*").cast("int").alias("_hits"), F.max("ts").alias("_last"))
    out = df.join(hits, "id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("_hits", F.lit(0)))
    if medians is None:
        out = out.withColumn("median", F.lit(None).cast("double"))
    else:
        out = out.join(medians.select("cluster_id", "median"), "cluster_id", "left")
    threshold = F.coalesce(scoring.promotion_threshold(F.col("median")), F.lit(after))
    up = (F.col("layer") == "stm") & (F.col("access_count") > threshold)
    slower = F.coalesce(F.least(F.lit(0.75), F.greatest(F.lit(0.25), F.col("median") / 28)), F.lit(0.5))
    return out.withColumns({"decay_lambda": F.when(up, F.col("decay_lambda") * slower).otherwise(F.col("decay_lambda")), "layer": F.when(up, "ltm").otherwise(F.col("layer"))}).drop("_hits", "_last", "median")


def migrations(proposals: DataFrame) -> DataFrame:
    """id, at, tier: where the same new tier is proposed twice in a row, the row moves."""
    one = W.partitionBy("id").orderBy("at")
    two = proposals.withColumns({"_before": F.lag("proposed").over(one), "_before2": F.lag("proposed", 2).over(one)})
    moved = (F.col("proposed") == F.col("_before")) & ((F.col("_before2") != F.col("proposed")) | F.col("_before2").isNull())
    return two.filter(moved).select("id", "at", F.col("proposed").alias("tier"))


def counted_hits(hits: DataFrame, counts: DataFrame) -> DataFrame:
    """Upsert of hit counters."""
    new = hits.groupBy("id").agg(F.count("*").alias("n"))
    return counts.unionByName(new).groupBy("id").agg(F.sum("n").alias("n"))
