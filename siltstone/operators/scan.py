"""Scans, look-ups and sinks of the memory model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.schema import LIVE


def live(df: DataFrame) -> DataFrame:
    """Rows in use; superseded ones stay, they collapse onto their successors later."""
    return df.filter(F.col("status").isin(*LIVE))


def canonical(df: DataFrame) -> DataFrame:
    return live(df).filter(F.col("superseded_by").isNull())


def get(df: DataFrame, key, state: DataFrame | None = None) -> DataFrame:
    """One row by id, with its canonical state if there is a table of it."""
    found = df.filter(F.col("id") == key)
    return found if state is None else found.join(state, "id", "left")


def get_batch(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def by_topic(df: DataFrame, topic: str) -> DataFrame:
    return live(df).filter(F.col("topic") == topic)


def by_topics(df: DataFrame, topics: list[str]) -> DataFrame:
    return live(df).filter(F.col("topic").isin(topics))


def by_topic_pattern(df: DataFrame, pattern: str) -> DataFrame:
    from siltstone.functions.text import glob_to_regex

    return live(df).filter(F.col("topic").rlike(glob_to_regex(pattern)))


def by_cluster(df: DataFrame, cluster: int, limit: int) -> DataFrame:
    return live(df).filter(F.col("cluster_id") == cluster).orderBy("id").limit(limit)


def recent(df: DataFrame, limit: int) -> DataFrame:
    return live(df).orderBy(F.desc("created_at"), "id").limit(limit)


def page_after(df: DataFrame, cursor, limit: int) -> DataFrame:
    """Keyset pagination."""
    return df.filter(F.col("id") > cursor).orderBy("id").limit(limit)


def filtered(df: DataFrame, topic: str | None = None, keyword: str | None = None, start=None, end=None, exploratory: bool = True) -> DataFrame:
    """Topic, keyword (in the keywords or the content, any case), inclusive time bounds; cold rows only for exploration."""
    if topic is not None:
        from siltstone.functions.text import topic_key

        df = df.filter(topic_key(F.col("topic")) == topic_key(F.lit(topic)))
    if keyword is not None:
        low = keyword.lower()
        hit: Column = F.contains(F.lower("content"), F.lit(low))
        if "keywords" in df.columns:
            hit = hit | F.exists("keywords", lambda k: F.contains(F.lower(k), F.lit(low)))
        df = df.filter(hit)
    if start is not None:
        df = df.filter(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col("created_at") <= F.lit(end).cast("timestamp"))
    return df if exploratory else df.filter(F.col("tier") != "cold")


def evidence_of(evidence: DataFrame, canonical_id, limit: int, newest: bool = True) -> DataFrame:
    at = F.desc("merged_at") if newest else F.asc("merged_at")
    return evidence.filter(F.col("canonical_id") == canonical_id).orderBy(at, "id").limit(limit)


def canonicals(df: DataFrame, limit: int) -> DataFrame:
    """Rows that stand for merged ones, most supported first."""
    return canonical(df).filter(F.col("support") > 1).orderBy(F.desc("support"), "id").limit(limit)


def decisions(ledger: DataFrame, limit: int, **equal) -> DataFrame:
    """The decision ledger, newest first, filtered by what is given."""
    for name, value in equal.items():
        if value is not None:
            ledger = ledger.filter(F.col(name) == value)
    return ledger.orderBy(F.desc("created_at"), "winner_id", "loser_id").limit(limit)


def events_after(events: DataFrame, last_id: int, types: list[str], limit: int) -> DataFrame:
    return events.filter((F.col("id") > last_id) & F.col("type").isin(types)).orderBy("id").limit(limit)


def appended(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert: rows whose id is new; of rows with one id, the first by its own fields."""
    fresh = rows.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(*[c for c, t in rows.dtypes if c != "id" and not t.startswith("map")]))).filter("_n = 1").drop("_n")
    return df.unionByName(fresh.join(df.select("id"), "id", "left_anti"), allowMissingColumns=True)


def updated(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Copy on write: rows replace those of their ids and are marked as updated."""
    rows = rows.withColumn("status", F.when(F.col("status") == "active", "updated").otherwise(F.col("status"))) if "status" in rows.columns else rows
    return df.join(rows.select("id"), "id", "left_anti").unionByName(rows.join(df.select("id"), "id", "left_semi"), allowMissingColumns=True)


def deleted(df: DataFrame, ids: DataFrame, references: tuple[str, ...] = ()) -> DataFrame:
    """Without the rows of these ids, and without the ids in array columns of the others."""
    out = df.join(ids.select("id"), "id", "left_anti")
    for c in references:
        exploded = out.select("id", F.posexplode_outer(c).alias("_at", "_ref")).join(ids.select(F.col("id").alias("_ref"), F.lit(True).alias("_gone")), "_ref", "left")
        kept = exploded.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("_gone").isNull() & F.col("_ref").isNotNull(), F.struct("_at", "_ref")))).alias("_k"))
        out = out.drop(c).join(kept.select("id", F.transform("_k", lambda x: x["_ref"]).alias(c)), "id", "left")
    return out


def without_vectors(df: DataFrame, vectors: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """Live rows that need a vector: have none, and weren't refused by the provider."""
    out = live(df).join(vectors.select("id"), "id", "left_anti")
    return out if refused is None else out.join(refused.select("id"), "id", "left_anti")


def vectors_of(vectors: DataFrame, model: str, dims: int) -> DataFrame:
    """Only vectors that the query's own model made: others can't be compared."""
    return vectors.filter((F.col("model") == model) & (F.size("embedding") == dims))


def cached(requests: DataFrame, cache: DataFrame, model: str, oldest) -> DataFrame:
    """Requests (text) with what the cache holds for their hash, the model, and not older than `oldest`."""
    fresh = cache.filter((F.col("model") == model) & (F.col("created_at") >= F.lit(oldest).cast("timestamp"))).select("key", "embedding")
    return requests.withColumn("key", F.sha2(F.concat_ws("|", F.lit(model), "text"), 256)).join(fresh, "key", "left")
