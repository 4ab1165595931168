"""Replay of learning over windows of events: fusion weights and alphas of buckets, committed window after window.

A bucket is everything, a type of query, or a type and a cluster.  In each window a bucket's events give a decayed mean, which
is drawn towards that of the level above.  Commits follow the windows in order: what a bucket knew before counts with its
effective size, which decays with the days between; alphas walk at most a maximal step in each window.  A bucket has a row
for each window that it has events in, so its fold is one pass over a sorted array.

Null weights or alphas don't count.  A window that is earlier than what a bucket knows makes it forget its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.weights import DEFAULT

RATE, PRIOR, MAX_STEP = 0.06, 5.0, 0.15
_TINY = 2.220446049250313e-16


def normal(w: Column) -> Column:
    """Non-negative weights that add up to 1, or the default ones."""
    clean = F.transform(w, lambda x: F.when((x > 0) & (x < float("inf")), x).otherwise(0.0))
    total = F.aggregate(clean, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > _TINY, F.transform(clean, lambda x: x / total)).otherwise(F.array(*[F.lit(x) for x in DEFAULT]))


def _drawn(n: Column, own: Column, parent: Column, prior: float) -> Column:
    return normal(F.zip_with(own, parent, lambda a, b: (n * a + prior * b) / (n + prior)))


def window_weights(events: DataFrame, prior: float = PRIOR, rate: float = RATE) -> DataFrame:
    """type, cluster, window, at, n, weights of each bucket and window (type and cluster null: everything; cluster null: the
    type) of (window, at, ts, type, cluster, weights, evidence); `at` is when the window is learned from."""
    size = len(DEFAULT)
    e = events.filter("weights is not null and type is not null").withColumn("_w", F.col("evidence") * F.exp(-rate * F.greatest(F.lit(0.0), (F.unix_timestamp("at") - F.unix_timestamp("ts")) / 86_400.0)))
    sums = [F.sum(F.col("_w") * F.col("weights")[i]).alias(f"s{i}") for i in range(size)]
    by = e.groupBy("window", "type", "cluster").agg(F.max("at").alias("at"), F.count("*").alias("n"), F.sum("_w").alias("w"), *sums)

    def level(*keys: str) -> DataFrame:
        out = by.groupBy("window", *keys).agg(F.max("at").alias("at"), F.sum("n").alias("n"), F.sum("w").alias("w"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(size)])
        return out.filter(F.col("w") > _TINY).select("window", *keys, "at", "n", normal(F.array(*[F.col(f"s{i}") / F.col("w") for i in range(size)])).alias("own"))

    up = lambda t, *keys: t.select("window", *keys, F.col("weights").alias("parent"))
    top = level().withColumn("weights", _drawn(F.col("n"), F.col("own"), normal(F.array(*[F.lit(x) for x in DEFAULT])), prior))
    mid = level("type").join(up(top), "window").withColumn("weights", _drawn(F.col("n"), F.col("own"), F.col("parent"), prior))
    low = level("type", "cluster").filter("cluster is not null").join(up(mid, "type"), ["window", "type"]).withColumn("weights", _drawn(F.col("n"), F.col("own"), F.col("parent"), prior))
    no_type, no_cluster = F.lit(None).cast("string"), F.lit(None).cast("int")
    shape = lambda t, kind, cluster: t.select(kind.alias("type"), cluster.cast("int").alias("cluster"), "window", "at", "n", "weights")
    return shape(top, no_type, no_cluster).unionByName(shape(mid, F.col("type"), no_cluster)).unionByName(shape(low, F.col("type"), F.col("cluster")))


def _folded(windows: DataFrame, columns: list[str], step, state: str) -> DataFrame:
    """type, cluster, trail: the states of each bucket after each of its windows, in order; step(last state or null, row)."""
    rows = windows.groupBy("type", "cluster").agg(F.array_sort(F.collect_list(F.struct("window", *columns))).alias("rows"))
    none = F.array().cast(f"array<struct<{state}>>")
    return rows.select("type", "cluster", F.aggregate("rows", none, lambda trail, r: F.concat(trail, F.array(step(F.try_element_at(trail, F.lit(-1)), r)))).alias("trail"))


def _size_before(last: Column, r: Column, rate: float) -> Column:
    days = (F.unix_timestamp(r["at"]) - F.unix_timestamp(last["at"])) / 86_400.0
    return F.when(last.isNotNull() & (days >= 0), last["n"] * F.exp(-rate * days)).otherwise(0.0)


def committed_weights(windows: DataFrame, rate: float = RATE) -> DataFrame:
    """type, cluster, window, at, n, weights: of every bucket after each window."""

    def step(last: Column, r: Column) -> Column:
        before = _size_before(last, r, rate)
        blend = normal(F.zip_with(last["weights"], r["weights"], lambda a, b: (before * a + r["n"] * b) / (before + r["n"])))
        return F.struct(r["window"].alias("window"), r["at"].alias("at"), (F.round(before) + r["n"]).cast("long").alias("n"), F.when(before > 0, blend).otherwise(normal(r["weights"])).alias("weights"))

    trail = _folded(windows, ["at", "n", "weights"], step, "window: bigint, at: timestamp, n: bigint, weights: array<double>")
    return trail.select("type", "cluster", F.explode("trail").alias("x")).select("type", "cluster", "x.*")


def committed_alphas(events: DataFrame, prior: float = PRIOR, max_step: float = MAX_STEP, rate: float = RATE, start: float = 0.5) -> DataFrame:
    """type, cluster, window, at, n, alpha of every bucket after each window of (window, at, ts, type, cluster, alpha, evidence).

    A bucket walks from what it has, or from its parent's value of that window at first, towards the window's mean by
    `max_step` at most, and is then drawn towards its parent's value by the sizes of both."""
    e = events.filter("alpha is not null and type is not null").withColumn("_w", F.col("evidence") * F.exp(-rate * F.greatest(F.lit(0.0), (F.unix_timestamp("at") - F.unix_timestamp("ts")) / 86_400.0)))
    by = e.groupBy("window", "type", "cluster").agg(F.max("at").alias("at"), F.count("*").alias("n"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("alpha")).alias("s"))

    def step(last: Column, r: Column) -> Column:
        at = F.coalesce(last["alpha"], r["parent"])
        walked = at + F.least(F.greatest(r["own"] - at, F.lit(-max_step)), F.lit(max_step))
        n = F.round(_size_before(last, r, rate)) + r["n"]
        return F.struct(r["window"].alias("window"), r["at"].alias("at"), n.cast("long").alias("n"), ((n * walked + prior * r["parent"]) / (n + prior)).alias("alpha"))

    out, parent = None, None
    for keys in ((), ("type",), ("type", "cluster")):
        rows = by.groupBy("window", *keys).agg(F.max("at").alias("at"), F.sum("n").alias("n"), (F.sum("s") / F.sum("w")).alias("own"))
        if len(keys) == 2:
            rows = rows.filter("cluster is not null")
        if parent is None:
            rows = rows.withColumn("parent", F.lit(start))
        else:
            on = ["window", *keys[:-1]]
            rows = rows.join(parent.select(*on, F.col("alpha").alias("parent")), on)
        for c, kind in (("type", "string"), ("cluster", "int")):
            rows = rows.withColumn(c, (F.col(c) if c in keys else F.lit(None)).cast(kind))
        trail = _folded(rows, ["at", "n", "own", "parent"], step, "window: bigint, at: timestamp, n: bigint, alpha: double")
        parent = trail.select("type", "cluster", F.explode("trail").alias("x")).select("type", "cluster", "x.*")
        out = parent if out is None else out.unionByName(parent)
    return out


def latest(committed: DataFrame) -> DataFrame:
    """Each bucket after its last window."""
    value = [c for c in committed.columns if c not in ("type", "cluster", "window")]
    return committed.groupBy("type", "cluster").agg(F.max_by(F.struct(*value), "window").alias("x")).select("type", "cluster", "x.*")
