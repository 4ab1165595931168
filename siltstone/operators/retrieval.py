"""Lexical and vector search over tables of queries, and the fusion of their lists.

The common shape is (query_id, channel, id, score).  Queries are batches, so a search is a join, not a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B = 1.2, 0.75  # fixed values: the usual constants of Okapi BM25
RRF_K = 60


def postings(docs: DataFrame, fields: tuple[str, ...] = ("content",)) -> DataFrame:
    """(term, id, field, tf, length): the inverted index."""
    from siltstone.functions.text import let

    out = None
    for f in fields:
        words = F.filter(F.split(F.lower(F.coalesce(F.col(f), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        part = docs.select("id", let(words, lambda w: F.struct(w.alias("w"), F.size(w).alias("n"))).alias("x")).select("id", F.col("x.n").alias("length"), F.explode("x.w").alias("term"))
        part = part.groupBy("term", "id", "length").agg(F.count("*").alias("tf")).withColumn("field", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out.select("term", "id", "field", "tf", "length")


def bm25(index: DataFrame, n_docs: DataFrame, queries: DataFrame, all_terms: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score) of every document with a term of the query (or all of them); fields add up.

    `queries` is (query_id, terms).  The queries' terms reach the index as a join, so only their postings are scored;
    `n_docs` is (field, n, avg_length), a row for each field.  A document counts `copies` times, if the index has such a column.
    With all_terms, queries meet the postings of a share of the documents in one task, and no hit is shuffled.
    """
    terms = queries.select("query_id", F.size(F.array_distinct("terms")).alias("n_terms"), F.explode(F.array_distinct("terms")).alias("term"))
    hit = index.join(terms.select("term").distinct(), "term", "left_semi")
    df = hit.groupBy("term", "field").agg((F.sum("copies") if "copies" in index.columns else F.count("*")).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if all_terms and dict(index.dtypes)["id"] == "bigint":
        from siltstone.operators import lexical
        from siltstone.sources.shared import written

        weights = df.join(n_docs, "field").select("term", "field", idf.alias("idf"), F.greatest("avg_length", F.lit(1e-300)).alias("mean"))
        posts = written(hit.join(weights, ["term", "field"]).select("term", "id", "tf", "length", "idf", "mean"), "posts")
        asked = queries.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).filter(F.size("terms") > 0)
        return lexical.best_with_all_terms(posts, asked, None, k1, b)
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    scored = hit.join(df, ["term", "field"]).join(n_docs, "field").withColumn("s", idf * norm).join(terms, "term")
    out = scored.groupBy("query_id", "id").agg(F.sum("s").alias("score"), F.countDistinct("term").alias("found"), F.first("n_terms").alias("n_terms"))
    return (out.filter("found = n_terms") if all_terms else out).select("query_id", "id", "score")


def field_stats(docs: DataFrame, fields: tuple[str, ...] = ("content",)) -> DataFrame:
    out = None
    for f in fields:
        n = F.size(F.filter(F.split(F.lower(F.coalesce(F.col(f), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
        part = docs.agg(F.lit(f).alias("field"), F.count("*").alias("n"), F.avg(n).alias("avg_length"))
        out = part if out is None else out.unionByName(part)
    return out


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), order: Column | None = None) -> DataFrame:
    """The k best of each query, with rank from 1; ties by id.  Spark prunes the window to k rows before the shuffle."""
    order = F.desc("score") if order is None else order
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(order, "id"))).filter(F.col("rank") <= k)


def like(docs: DataFrame, queries: DataFrame, fields: tuple[str, ...], most: int = 10_000) -> DataFrame:
    """Rows in which a query stands literally in one of the fields, in any case; score is the strength.  A null or empty
    query finds nothing.

    Up to `most` queries are looked for in one pass over the rows.  More of them go in several passes.
    """
    queries = queries.filter("query <> ''").select("query_id", F.lower("query").alias("_q"))
    blocks = max(1, -(-queries.count() // most))
    out = None
    for i in range(blocks):
        some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect() if blocks > 1 else queries.collect()
        if not some:
            continue
        stated = F.array(*[F.struct(F.lit(r["query_id"]).alias("query_id"), F.lit(r["_q"]).alias("q")) for r in some]) if len(some) <= 50 else None
        if stated is not None:
            hit = lambda x: F.exists(F.array(*[F.lower(f) for f in fields]), lambda t: F.contains(t, x["q"]))
            part = docs.select("id", "strength", F.explode(F.filter(stated, hit)).alias("x")).select("x.query_id", "id", F.col("strength").alias("score"))
        else:
            hit = F.lit(False)
            for f in fields:
                hit = hit | F.contains(F.lower(f), F.col("_q"))
            table = docs.sparkSession.createDataFrame([(r["query_id"], r["_q"]) for r in some], queries.schema)
            part = docs.join(F.broadcast(table), hit).select("query_id", "id", F.col("strength").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.select(F.lit(None).cast("int").alias("query_id"), "id", F.col("strength").alias("score")).limit(0)


def with_fallback(channels: list[DataFrame]) -> DataFrame:
    """For each query the rows of the first channel that has any."""
    out = channels[0]
    for c in channels[1:]:
        out = out.unionByName(c.join(out.select("query_id").distinct(), "query_id", "left_anti"))
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, zero: float = 0.0) -> Column:
    """Cosine similarity in double precision; `zero` if a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, zero).otherwise(dot(a, b) / n)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """Exact k nearest by cosine: (query_id, id, score, rank).  Null vectors are left out.

    The stated queries are broadcast, `block` at a time, each in one Arrow pass over the vectors; each batch keeps its k
    best of each query, so at most k rows for each query and batch are shuffled.
    """
    queries = queries.filter("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    blocks = max(1, -(-queries.count() // block))
    found = None
    for i in range(blocks):
        some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries
        part = _near(vectors, some.collect(), k)
        found = part if found is None else found.unionByName(part)
    return top_k(found.withColumn("score", F.round("score", 12)), k)


def _near(vectors: DataFrame, stated: list, k: int) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    if not stated:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, score double")
    ids = np.array([r["query_id"] for r in stated], np.int64)
    q = np.array([r["embedding"] for r in stated], float)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def best(batches):
        ids, q = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            v = np.asarray(b.column("embedding").flatten(), float).reshape(b.num_rows, -1)
            norm = np.linalg.norm(v, axis=1)
            s = np.where(norm > 0, (q @ v.T) / np.where(norm > 0, norm, 1), 0.0)
            n = min(k, s.shape[1])
            key = b.column("id").to_numpy()
            by_id = np.argsort(key, kind="stable")
            top = by_id[np.argsort(-np.round(s[:, by_id], 12), axis=1, kind="stable")[:, :n]]
            yield pa.record_batch([pa.array(np.repeat(ids, n)), pa.array(key[top].ravel()), pa.array(np.take_along_axis(s, top, 1).ravel())], ["query_id", "id", "score"])

    return vectors.filter("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(best, "query_id long, id long, score double")


def centroids(vectors: DataFrame, cluster: str) -> DataFrame:
    """Element-wise means of the vectors of each cluster."""
    each = vectors.select(cluster, F.posexplode("embedding").alias("pos", "x")).groupBy(cluster, "pos").agg(F.avg("x").alias("x"))
    return each.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def assign(vectors: DataFrame, centers: DataFrame, cluster: str, least: float = 0.45) -> DataFrame:
    """The centroid of greatest cosine, null if that is at most `least`.  Centroids are few: they are counted first."""
    if centers.limit(10_001).count() > 10_000:
        raise ValueError("too many centroids to broadcast")
    c = F.round(cosine(F.col("embedding"), F.col("centroid")), 12)
    near = vectors.crossJoin(F.broadcast(centers)).select("id", cluster, c.alias("sim"))
    best = near.groupBy("id").agg(F.max_by(F.col(cluster), F.struct("sim", -F.col(cluster))).alias(cluster), F.max("sim").alias("sim"))
    return best.withColumn(cluster, F.when(F.col("sim") > least, F.col(cluster)))


def ranked(lists: DataFrame) -> DataFrame:
    return lists.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "channel").orderBy(F.desc("score"), "id")))


def rrf(lists: DataFrame, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank) over channels."""
    from siltstone.schema import by_value

    w = by_value(F.col("channel"), weights, 0.0)
    return ranked(lists).groupBy("query_id", "id").agg(F.sum(w / (k + F.col("rank"))).alias("score"))


def normalized(lists: DataFrame) -> DataFrame:
    """Scores of a channel from 0 to 1 by its least and greatest; a single row is 1, several equal ones are 0."""
    one = W.partitionBy("query_id", "channel")
    low, high, n = F.min("score").over(one), F.max("score").over(one), F.count("*").over(one)
    return lists.withColumn("score", F.when(n == 1, 1.0).when(high == low, 0.0).otherwise((F.col("score") - low) / (high - low)))


def convex(lists: DataFrame, alpha: float) -> DataFrame:
    """alpha * lexical + (1 - alpha) * vector, and the graph's and episodes' shares of the latter."""
    from siltstone.schema import by_value

    share = by_value(F.col("channel"), {"fts": alpha, "vec": 1 - alpha, "kg": 0.5 * 2 * (1 - alpha), "episode": 0.65 * 2 * (1 - alpha)}, 0.0)
    return normalized(lists).groupBy("query_id", "id").agg(F.sum(share * F.col("score")).alias("score"))


def channel_scores(lists: DataFrame) -> DataFrame:
    """The reported score of each channel: ranks of the vector channel become 1 / (1 + rank from 0); a channel whose
    greatest score is over 1 is divided by it."""
    s = F.when((F.col("channel") == "vec") | (F.col("score") < 0), 1 / (1 + F.abs("score"))).otherwise(F.col("score"))
    lists = lists.withColumn("score", s)
    top = F.max("score").over(W.partitionBy("query_id", "channel"))
    return lists.withColumn("score", F.when(top > 1, F.col("score") / top).otherwise(F.col("score")))


def max_merge(lists: DataFrame) -> DataFrame:
    return lists.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def strong_signal(scored: DataFrame, ratio: float = 1.5, single: float = 3.0) -> DataFrame:
    """Per query: whether the best positive score is `ratio` times the second, or, alone, at least `single`."""
    pos = top_k(scored.filter("score > 0"), 2)
    two = pos.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("top2"))
    return two.withColumn("strong", F.when(F.col("top2").isNull(), F.col("top1") >= single).otherwise(F.col("top1") / F.col("top2") >= ratio))


def permuted(scored: DataFrame, order: DataFrame) -> DataFrame:
    """A judge's order over the scores that are there: the n-th of its order gets the n-th score.  Rows that it doesn't
    name keep their order behind those that it does."""
    one = W.partitionBy("query_id")
    by_score = scored.withColumn("rank", F.row_number().over(one.orderBy(F.desc("score"), "id")))
    judged = by_score.join(order, ["query_id", "id"], "left").withColumn("new_rank", F.row_number().over(one.orderBy(F.asc_nulls_last("position"), "rank")))
    slots = by_score.select("query_id", F.col("rank").alias("new_rank"), F.col("score").alias("new_score"))
    return judged.join(slots, ["query_id", "new_rank"]).select("query_id", "id", F.col("new_score").alias("score"), F.col("new_rank").alias("rank"))


def tips(df: DataFrame) -> DataFrame:
    """(id, tip): the end of each row's chain of successors, by pointer jumping: each round halves what is left of a chain.
    A chain that leaves the table ends at its last row; one that hasn't ended after log2(n) + 1 rounds runs in a cycle, and
    its tip is the cycle's least id."""
    from siltstone.sources.shared import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    here = df.select(F.col("id").alias("tip"), F.lit(True).alias("_there"))
    at = df.select("id", F.col("superseded_by").alias("tip")).join(here, "tip", "left").withColumn("done", F.col("_there").isNull())
    at = at.select("id", F.when(F.col("done"), F.col("id")).otherwise(F.col("tip")).alias("tip"), "done")
    at = at.withColumn("least", F.least("id", "tip")).checkpoint()
    for _ in range(at.count().bit_length() + 1):
        if at.filter("not done").isEmpty():
            break
        to = at.select(F.col("id").alias("tip"), F.col("tip").alias("_next"), F.col("done").alias("_done"), F.col("least").alias("_least"))
        at = at.join(to, "tip").select("id", F.col("_next").alias("tip"), F.col("_done").alias("done"), F.least("least", "_least").alias("least")).checkpoint()
    return at.select("id", F.when(F.col("done"), F.col("tip")).otherwise(F.col("least")).alias("tip"))


def collapse(scored: DataFrame, df: DataFrame) -> DataFrame:
    """Found rows on the ends of their chains: greatest score, confidence and sources; dead ends go."""
    t = tips(df)
    alive = df.filter(F.col("status").isin("active", "updated")).select(F.col("id").alias("tip"))
    more = [F.max(c).alias(c) for c in scored.columns if c not in ("query_id", "id", "score")]
    out = scored.join(t, "id").groupBy("query_id", "tip").agg(F.max("score").alias("score"), *more)
    return out.join(alive, "tip", "left_semi").withColumnRenamed("tip", "id")


def mmr(candidates: DataFrame, limit: int, lam: float, similarity) -> DataFrame:
    """Greedy diversity: lam * relevance - (1 - lam) * the greatest similarity to what is chosen; the last of equal ones wins.

    `candidates` is (query_id, id, score, tokens), at most 2 * limit rows of each query by construction; scores are
    shifted to be positive.  similarity(a, b) is of token lists.
    """
    import pandas as pd

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        shift = -min(0.0, float(pdf.score.min())) + (1e-6 if pdf.score.min() <= 0 else 0.0)
        rel = (pdf.score + shift) / max(1e-12, float((pdf.score + shift).max()))
        sets, left, chosen = [set(x) for x in pdf.tokens], list(range(len(pdf))), []
        while left and len(chosen) < limit:
            best, value = left[0], None
            for i in left:
                v = lam * rel[i] - (1 - lam) * max((similarity(sets[i], sets[j]) for j in chosen), default=0.0)
                if value is None or v >= value:
                    best, value = i, v
            chosen.append(best)
            left.remove(best)
        out = pdf.loc[chosen, ["query_id", "id", "score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    short = top_k(candidates, 2 * limit).drop("rank")
    return short.groupBy("query_id").applyInPandas(choose, "query_id long, id long, score double, rank int")


def evidence_bonus(scored: DataFrame, evidence: DataFrame, query_tokens: DataFrame) -> DataFrame:
    """+ 0.08 * best similarity to a row's evidence * (min(support, 4) - 1) / 3, unless already well corroborated."""
    from siltstone.functions.text import similarity

    best = scored.join(evidence, "id").join(query_tokens, "query_id").groupBy("query_id", "id").agg(F.max(similarity(F.col("evidence_tokens"), F.col("query_tokens"))).alias("best"))
    bonus = 0.08 * F.coalesce("best", F.lit(0.0)) * (F.least("support", F.lit(4)) - 1) / 3
    skip = (F.col("confidence") >= 0.85) & (F.col("sources") >= 2)
    return scored.join(best, ["query_id", "id"], "left").withColumn("score", F.when(skip, F.col("score")).otherwise(F.col("score") + bonus)).drop("best")


def corroborated(docs: DataFrame, external: DataFrame, above: float = 0.3) -> DataFrame:
    """id, sources: in how many external sources a row has a text of word Jaccard over `above`, and 1 for itself.

    `docs` is (id, tokens), `external` is (source, key, tokens).  In one pass if the external texts are few enough to be sent
    to every task, else by postings.
    """
    from siltstone.operators.dedup import against

    def sources(n, shared, sizes, others):
        import numpy as np

        hit = np.flatnonzero(shared / np.maximum(n + sizes - shared, 1) > above)
        return 1 + len({others[i]["source"] for i in hit.tolist()})

    if (out := against(docs, external.select(F.struct("source", "key").alias("other"), "tokens"), "id long, sources long", sources)) is not None:
        return out
    a = docs.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    b = external.select("source", "key", F.size("tokens").alias("m"), F.explode("tokens").alias("t"))
    both = a.join(b, "t").groupBy("id", "source", "key").agg(F.count("*").alias("both"), F.first("n").alias("n"), F.first("m").alias("m"))
    hit = both.filter(F.col("both") / (F.col("n") + F.col("m") - F.col("both")) > above).groupBy("id").agg(F.countDistinct("source").alias("hits"))
    return docs.select("id").join(hit, "id", "left").select("id", (1 + F.coalesce("hits", F.lit(0))).alias("sources"))


def bypassed(lists: DataFrame, strong: DataFrame) -> DataFrame:
    """The channels' rows after strong lexical signals: queries that have one (query_id, strong) keep their lexical rows
    only."""
    sure = strong.filter("strong").select("query_id").withColumn("_sure", F.lit(True))
    return lists.join(sure, "query_id", "left").filter(F.col("_sure").isNull() | (F.col("channel") == "fts")).drop("_sure")


def six_weights(fused: DataFrame, channels: DataFrame, rows: DataFrame, weights: dict[str, float], adoption: float) -> DataFrame:
    """Fused scores (query_id, id, score) blended with the weighted sum of six features, as far as these weights have been
    adopted: the reported scores of four channels (query_id, channel, id, score), and a row's support and diversity."""
    from siltstone.functions.scoring import support_signal

    share = min(1.0, max(0.0, adoption))
    total = sum(max(w, 0.0) for w in weights.values())
    w = {k: max(v, 0.0) / total for k, v in weights.items()}
    wide = channels.groupBy("query_id", "id").pivot("channel", ["fts", "vec", "kg", "episode"]).agg(F.max("score"))
    x = fused.join(wide, ["query_id", "id"], "left").join(rows.select("id", "support", "diversity"), "id", "left")
    feature = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = w["bm25"] * feature("fts") + w["vec"] * feature("vec") + w["kg"] * feature("kg") + w["episode"] * feature("episode")
    score = score + w["support"] * support_signal(F.col("support")) + w["diversity"] * support_signal(F.col("diversity").cast("double"))
    return x.select("query_id", "id", F.when(F.col("support").isNull(), F.col("score")).otherwise(share * score + (1 - share) * F.col("score")).alias("score"))


def evidence_preview(rows: DataFrame, evidence: DataFrame, most: int = 2) -> DataFrame:
    """id, evidence_count (support but for the row itself) and preview: `[topic] summary` of its first pieces of evidence
    (id, memory_id, topic, summary, position)."""
    others = evidence.filter("memory_id <> id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("["), "topic", F.lit("] "), "summary").alias("line")))).alias("e"))
    n = F.greatest(F.col("support") - 1, F.lit(0))
    preview = F.when(n > 0, F.slice(F.coalesce(F.transform("e", lambda x: x["line"]), F.array()), 1, most)).otherwise(F.array().cast("array<string>"))
    return rows.join(others, "id", "left").select("id", n.alias("evidence_count"), preview.alias("preview"))


def knn_pairs(vectors: DataFrame, k: int, least: float = -1.0, digits: int = 9) -> DataFrame:
    """a, b, sim: each row with its k nearest others by cosine to so many digits (ties by id), every pair once.  All rows meet
    all others in blocks, and k rows of each are all that is shuffled.  Null vectors are left out."""
    from siltstone.operators.tiles import near_lists

    rows = vectors.filter("id is not null and embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").alias("x"))
    near = near_lists(rows, rows.count(), k, lambda s: -s.round(digits)).select(F.col("id").alias("query_id"), F.col("other").alias("id"), (-F.col("value")).alias("score"))
    near = top_k(near, k).filter(F.col("score") >= least)
    return near.groupBy(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).agg(F.max("score").alias("sim"))


def vector_dedup(vectors: DataFrame, pending: DataFrame, k: int = 5, strong: float = 0.80, weak: float = 0.70) -> DataFrame:
    """new_id, old_id, sim, band of waiting rows (id) and their nearest others: strong ones merge, weak ones go to a judge."""
    asked = vectors.join(pending.select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), "embedding")
    near = nearest(vectors, asked, k + 1).filter("query_id <> id")
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter((F.col("rank") <= k) & (F.col("score") >= weak))
    return near.select(F.col("query_id").alias("new_id"), F.col("id").alias("old_id"), F.col("score").alias("sim"), F.when(F.col("score") >= strong, "strong").otherwise("weak").alias("band"))


def top_hit_cluster(hits: DataFrame, assigned: DataFrame) -> DataFrame:
    """event, cluster: where the best vector hit of each event (event, id, score) belongs now; null if nowhere."""
    best = hits.groupBy("event").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"))
    return best.join(assigned.select("id", "cluster"), "id", "left").select("event", "cluster")
