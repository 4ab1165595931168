"""Search over concepts, and what found concepts lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import graph, retrieval
from siltstone.sources.shared import written

FIELDS = ("name", "definition", "labels")


def search(concepts: DataFrame, queries: DataFrame, k: int = 5, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """query_id, id, score, rank: the k best concepts that have every word of a query (query_id, query) in some field."""
    asked = queries.select("query_id", F.array_sort(F.array_distinct(text.sanitize_query(F.lower("query")))).alias("terms")).filter(F.size("terms") > 0)
    # concepts of equal fields are scored once, under their least id, and queries of equal words are asked once
    texts = concepts.select("id", *[F.coalesce(f, F.lit("")).alias(f) for f in fields])
    kinds = written(texts.groupBy(*fields).agg(F.min("id").alias("id"), F.count("*").alias("copies")), "kinds")
    named = written(asked.select("terms").distinct().withColumn("query_id", F.monotonically_increasing_id()), "asked")
    index = retrieval.postings(kinds, fields).join(kinds.select("id", "copies"), "id").join(named.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
    found = retrieval.bm25(index, retrieval.field_stats(concepts, fields), named, all_terms=True).withColumn("score", F.round("score", 9))
    best = retrieval.top_k(found, k).join(named, "query_id").select("terms", F.col("id").alias("kind"), "score")
    # the k best rows are among the first k of each of the k best kinds
    alike = W.partitionBy(*fields).orderBy("id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = texts.select("id", F.min("id").over(alike).alias("kind"), F.row_number().over(W.partitionBy(*fields).orderBy("id")).alias("_n")).filter(F.col("_n") <= k)
    best = retrieval.top_k(best.join(rows, "kind").select("terms", "id", "score"), k, ("terms",))
    return asked.join(best, "terms").select("query_id", "id", "score", "rank")


def links_from(links: DataFrame, ids: DataFrame) -> DataFrame:
    return links.join(ids.select(F.col("id").alias("source")), "source", "left_semi")


def links_to(links: DataFrame, ids: DataFrame) -> DataFrame:
    return links.join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def reached(links: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """query_id, id, depth: what each query's seeds (query_id, id) reach along links, by the fewest of some hops."""
    edges = links.select(F.col("source").alias("id"), "target").distinct()
    front = seeds.select("query_id", "id").distinct().withColumn("depth", F.lit(0))
    seen = front
    for _ in range(hops):
        front = front.join(edges, "id").select("query_id", F.col("target").alias("id"), (F.col("depth") + 1).alias("depth")).distinct()
        seen = seen.unionByName(front)
    return seen.groupBy("query_id", "id").agg(F.min("depth").alias("depth"))


def kg_channel(queries: DataFrame, concepts: DataFrame, links: DataFrame, k: int = 5, hops: int = 2) -> DataFrame:
    """query_id, id, score: memories behind the k best concepts of a query, by rank, and behind what these reach, by
    1 / (1 + depth); the greater score counts.  concepts: id, source_memory_ids and the searched fields."""
    seeds = written(search(concepts, queries, k), "seeds")
    sources = concepts.select("id", "source_memory_ids")
    own = graph.concept_scores(seeds.select("query_id", "id", "rank"), sources)
    far = reached(links, seeds, hops).join(sources, "id").select("query_id", F.explode("source_memory_ids").alias("id"), (1 / (1 + F.col("depth"))).alias("score"))
    return own.unionByName(far).groupBy("query_id", "id").agg(F.max("score").alias("score"))


def with_episodes(kg: DataFrame, episodes: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, channel, id, score of both channels; episodes count for queries that ask for them (`episodic` or bounds)."""
    ask = asked.filter("episodic or bounded").select("query_id")
    return kg.select("query_id", F.lit("kg").alias("channel"), "id", "score").unionByName(episodes.join(ask, "query_id", "left_semi").select("query_id", F.lit("episode").alias("channel"), "id", "score"))


def overlap(rows: DataFrame, concepts: DataFrame, words: int = 5, k: int = 5) -> DataFrame:
    """id, score: how like the definitions of the concepts that its keywords find a row (id, content) is; 0 without any."""
    queries = rows.select(F.col("id").alias("query_id"), F.array_join(text.keywords(F.col("content"), words), " ").alias("query"))
    hits = search(concepts, queries, k).select(F.col("query_id").alias("id"), F.col("id").alias("concept"))
    hits = hits.join(concepts.select(F.col("id").alias("concept"), text.tokens(F.col("definition")).alias("d")), "concept")
    best = hits.join(rows.select("id", text.tokens(F.col("content")).alias("c")), "id").groupBy("id").agg(F.max(text.similarity(F.col("c"), F.col("d"))).alias("score"))
    return rows.select("id").join(best, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def activated(rows: DataFrame, near: DataFrame, at, above: float = 0.3) -> DataFrame:
    """rows after new ones came in: those found like them (id, sim over `above`) count an access."""
    hit = near.filter(F.col("sim") > above).select("id").distinct().withColumn("_hit", F.lit(True))
    out = rows.join(hit, "id", "left")
    return out.withColumns({"access_count": F.col("access_count") + F.coalesce("_hit", F.lit(False)).cast("int"), "last_accessed": F.when(F.col("_hit"), F.lit(at).cast("timestamp")).otherwise(F.col("last_accessed"))}).drop("_hit")
