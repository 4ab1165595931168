"""Recall: lexical, vector, graph and episode channels over a table of queries, fused, filtered, re-ranked, collapsed, diversified.

One job for all queries.  No time budgets: results depend on the tables, the parameters and `as_of` only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import scoring, text
from siltstone.operators import extract, retrieval
from siltstone.sources.shared import written

#: Weight of the episode channel by query class; others have the least.
EPISODE_WEIGHT = {"episodic": 0.45, "temporal": 0.30}


@dataclass(frozen=True)
class Recall:
    limit: int = 10
    mode: str = "rrf"  # or "cc"
    rrf_k: int = 60
    mmr_lambda: float = 1.0  # 1 is off
    kg_weight: float = 0.3
    episode_weight: float = 0.18
    #: leave the other channels out where the lexical one is sure
    bypass: bool = False
    #: learned weights of six features (names and values), and how far they have been adopted
    weights: tuple[tuple[str, float], ...] = ()
    adoption: float = 0.0
    #: pieces of evidence shown with each row
    preview: int = 0


def routed(queries: DataFrame) -> DataFrame:
    """queries (query_id, query) with type, alpha, multiplier, days_back and terms."""
    q = queries.withColumn("_c", extract.classify(F.col("query")))
    return q.select("*", "_c.*", text.sanitize_query(F.lower("query")).alias("terms")).drop("_c")


def asking_episodes(queries: DataFrame) -> DataFrame:
    """The queries that the episode channel counts for (`channels`); no other need be asked of it."""
    return routed(queries).filter((F.col("type") == "episodic") | F.col("days_back").isNotNull()).select(*queries.columns)


def fused(lists: DataFrame, routed_queries: DataFrame, p: Recall) -> DataFrame:
    """(query_id, id, score, channels): reciprocal ranks under each query's own weights, or a convex combination."""
    q = routed_queries.select("query_id", "type", "alpha")
    lists = (retrieval.ranked(lists) if p.mode == "rrf" else retrieval.normalized(lists)).join(q, "query_id")
    a = F.col("alpha")
    if p.mode == "rrf":
        episode = F.lit(p.episode_weight)
        for kind, w in EPISODE_WEIGHT.items():
            episode = F.when(F.col("type") == kind, w).otherwise(episode)
        share = F.when(F.col("channel") == "fts", a).when(F.col("channel") == "vec", 1 - a).when(F.col("channel") == "kg", p.kg_weight).otherwise(episode)
        value = share / (p.rrf_k + F.col("rank"))
    else:
        share = F.when(F.col("channel") == "fts", a).when(F.col("channel") == "vec", 1 - a).when(F.col("channel") == "kg", (1 - a)).otherwise(1.3 * (1 - a))
        value = share * F.col("score")
    return lists.groupBy("query_id", "id").agg(F.sum(value).alias("score"), F.countDistinct("channel").alias("channels"))


def take(candidates: DataFrame, limit: int) -> DataFrame:
    """Candidates in order of score until there are 2 * limit of them and `limit` live ends of chains among them."""
    one = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    first = candidates.withColumn("_n", F.row_number().over(one)).withColumn("_new", F.row_number().over(W.partitionBy("query_id", "tip").orderBy(F.desc("score"), "id")) == 1)
    before = F.coalesce(F.sum((F.col("_new") & F.col("tip_live")).cast("int")).over(one.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("_live", before).filter((F.col("_n") <= 2 * limit) | (F.col("_live") < limit)).drop("_n", "_new", "_live")


def recall(queries: DataFrame, memories: DataFrame, lists: DataFrame, as_of: str, p: Recall = Recall()) -> DataFrame:
    """query_id, id, score, rank for each query: the channels' lists (query_id, channel, id, score) fused and finished.

    memories: id, topic, content, status, superseded_by, tier, importance, strength, access_count, created_at,
    last_accessed, support, diversity.  Cold rows come for exploratory queries only; a query's relative time bounds rows.
    """
    q = routed(queries)
    lists = written(lists, "lists")  # they are read three times or four
    if p.bypass:
        lists = retrieval.bypassed(lists, retrieval.strong_signal(lists.filter("channel = 'fts'").select("query_id", "id", "score")))
    found = fused(lists, q, p)
    if p.weights and p.adoption > 0:
        blended = retrieval.six_weights(found.select("query_id", "id", "score"), retrieval.channel_scores(lists), memories, dict(p.weights), p.adoption)
        found = found.drop("score").join(blended, ["query_id", "id"])
    found = found.join(memories.filter(F.col("status") != "deprecated"), "id").join(q.select("query_id", "query", "type", "terms", "multiplier", "days_back"), "query_id")
    age = scoring.days(F.lit(as_of), F.col("created_at"))
    found = found.filter((F.col("tier") != "cold") | (F.col("type") == "exploratory")).filter(F.col("days_back").isNull() | (age <= F.col("days_back")))
    tips = retrieval.tips(memories)
    alive = memories.filter(F.col("status").isin("active", "updated")).select(F.col("id").alias("tip"), F.lit(True).alias("_alive"))
    found = found.join(tips, "id").join(alive, "tip", "left").withColumn("tip_live", F.col("_alive").isNotNull()).drop("_alive")
    found = take(found, p.limit)
    by_channel = retrieval.channel_scores(lists).groupBy("query_id", "id").pivot("channel", ["fts", "vec", "kg", "episode"]).agg(F.max("score"))
    found = found.join(by_channel, ["query_id", "id"], "left")
    zero = F.lit(0.0)
    features = {
        **{c: F.coalesce(c, zero) for c in ("fts", "vec", "kg", "episode")},
        "age_days": F.floor(age * 24) / 24, "access_count": F.col("access_count"), "strength": F.col("strength"), "importance": F.col("importance"),
        "keyword_overlap": text.keyword_overlap(F.col("terms"), F.array().cast("array<string>"), F.col("content")),
        "topic_match": F.contains(F.lower("query"), F.lower("topic")), "bytes": F.octet_length("content"), "channels": F.col("channels"), "support": F.col("support"),
        "diversity": F.col("diversity"), "idle_days": F.floor(scoring.days(F.lit(as_of), F.col("last_accessed")) * 24) / 24, "related": F.lit(0), "concepts": F.lit(0), "tier": F.col("tier"),
        "is_current": F.col("superseded_by").isNull(), "survival": F.lit(None).cast("double"),
    }
    # a single candidate keeps its fused score
    alone = F.count("*").over(W.partitionBy("query_id")) == 1
    scored = found.withColumn("score", F.round(F.when(alone, F.col("score")).otherwise(scoring.rerank(features)), 9))
    final = scored.filter("tip_live").groupBy("query_id", F.col("tip").alias("id")).agg(F.max("score").alias("score"))
    if p.mmr_lambda < 1:
        with_tokens = final.join(memories.select("id", text.tokens(F.col("content")).alias("tokens")), "id")
        return retrieval.mmr(with_tokens.select(F.col("query_id").cast("long"), F.col("id").cast("long"), "score", "tokens"), p.limit, p.mmr_lambda, lambda a, b: len(a & b) / max(1, len(a | b)))
    out = retrieval.top_k(final, p.limit)
    if not p.preview:
        return out
    evidence = memories.filter("superseded_by is not null").select(F.col("superseded_by").alias("id"), F.col("id").alias("memory_id"), "topic", "summary", F.col("id").alias("position"))
    return out.join(retrieval.evidence_preview(memories, evidence, p.preview), "id")


def channels(queries: DataFrame, lexical: DataFrame, vector: DataFrame, concepts: DataFrame, links: DataFrame, episodes: DataFrame | None = None) -> DataFrame:
    """query_id, channel, id, score of all four channels.  lexical, vector: (query_id, id, score).  The graph channel follows
    concepts and links; episodes (query_id, id, score) count for queries that ask for them."""
    from siltstone.operators.concepts import kg_channel, with_episodes

    kg = kg_channel(queries, concepts, links)
    asked = routed(queries).select("query_id", (F.col("type") == "episodic").alias("episodic"), F.col("days_back").isNotNull().alias("bounded"))
    episodes = kg.limit(0) if episodes is None else episodes
    out = with_episodes(kg, episodes, asked)
    for name, df in (("fts", lexical), ("vec", vector)):
        out = out.unionByName(df.select("query_id", F.lit(name).alias("channel"), "id", "score"))
    return out


def expanded(queries: DataFrame, variants: DataFrame) -> DataFrame:
    """query_id, query, variant: the queries, and those of their variants (query_id, variants) that are unlike them and each
    other: at most one for temporal queries, two for episodic ones, and three for others."""
    q = routed(queries).select("query_id", "query", "type").join(variants, "query_id", "left")
    most = F.when(F.col("type") == "temporal", 1).when(F.col("type") == "episodic", 2).otherwise(3)
    kept = text.kept_variants(F.col("query"), F.coalesce("variants", F.array().cast("array<string>")), most)
    return q.select("query_id", F.posexplode(F.concat(F.array("query"), kept)).alias("variant", "query"))
