"""Registered queries: scans, filters, aggregates, windows, scores, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import scoring, text
from siltstone.operators import aggregate, lexical, retrieval, scan
from siltstone.operators.vector_index import VectorIndex
from siltstone.plans.model import AS_OF, WITH, memories, memories_at, table
from siltstone.plans.registry import register
from siltstone.sources.shared import stored

LIVE = "status in ('active', 'updated')"


@register("point_lookup", WITH + "select id, topic, strength, support, diversity from memories where id = 42")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d)
    return scan.get(m.select("id", "topic", "strength"), 42, m.select("id", "support", "diversity"))


@register("batch_lookup", WITH + "select id, topic from memories where id in (select item_id from benchmark)")
def batch_lookup(spark, d):
    return scan.get_batch(memories(spark, d).select("id", "topic"), table(spark, d, "benchmark").select(F.col("item_id").alias("id")))


@register("topic_scan", WITH + f"select id, status from memories where topic = 'src3' and {LIVE}")
def topic_scan(spark, d):
    return scan.by_topic(memories(spark, d), "src3").select("id", "status")


@register("topic_group_load", WITH + f"select id, topic from memories where topic in ('src1', 'src2') and {LIVE}")
def topic_group_load(spark, d):
    return scan.by_topics(memories(spark, d), ["src1", "src2"]).select("id", "topic")


@register("topic_glob", WITH + f"select id, topic from memories where lower(topic) like 'src1%' and {LIVE}")
def topic_glob(spark, d):
    return scan.by_topic_pattern(memories(spark, d), "SRC1*").select("id", "topic")


@register("cluster_scan", WITH + f"select id, cluster_id from memories where cluster_id = 4 and {LIVE} order by id limit 20")
def cluster_scan(spark, d):
    return scan.by_cluster(memories(spark, d), 4, 20).select("id", "cluster_id")


@register("recent_topk", WITH + f"select id, age_hours from memories where {LIVE} order by age_hours, id limit 25")
def recent_topk(spark, d):
    return scan.recent(memories_at(spark, d), 25).select("id", "age_hours")


@register("keyset_page", WITH + "select id, topic from memories where id > 100 order by id limit 50")
def keyset_page(spark, d):
    return scan.page_after(memories(spark, d), 100, 50).select("id", "topic")


@register("list_canonicals", WITH + f"select id, support from memories where {LIVE} and superseded_by is null and support > 1 order by support desc, id limit 30")
def list_canonicals(spark, d):
    return scan.canonicals(memories(spark, d), 30).select("id", "support")


@register("live_filter", WITH + f"select id, status, superseded_by from memories where {LIVE}")
def live_filter(spark, d):
    return scan.live(memories(spark, d)).select("id", "status", "superseded_by")


@register("live_canonical", WITH + f"select id from memories where {LIVE} and superseded_by is null")
def live_canonical(spark, d):
    return scan.canonical(memories(spark, d)).select("id")


@register("keyword_time_filter", WITH + "select id, age_hours from memories where contains(lower(content), 'the') and age_hours between 100 and 700 and tier <> 'cold'")
def keyword_time_filter(spark, d):
    at = "timestamp'2024-03-01 00:00:00'"
    m = memories_at(spark, d)
    start, end = (spark.sql(f"select cast({at} - interval {h} hours as string) t").first()["t"] for h in (700, 100))
    return scan.filtered(m, keyword="The", start=start, end=end, exploratory=False).select("id", "age_hours")


@register("like_fallback", WITH + "select 1 as query_id, id, strength as score from memories where contains(lower(summary), 'tion the') or contains(lower(topic), 'tion the')")
def like_fallback(spark, d):
    q = spark.sql("select 1 as query_id, 'TION the' as query")
    return retrieval.like(memories(spark, d), q, ("summary", "topic"))


@register("event_log_page", "select event_id as id, event_type as type from events where event_id > 200 and event_type in ('view', 'click') order by event_id limit 100")
def event_log_page(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"))
    return scan.events_after(e, 200, ["view", "click"], 100)


@register("delete_rows", WITH + "select id, topic from memories where id % 10 <> 3")
def delete_rows(spark, d):
    m = memories(spark, d).select("id", "topic")
    return scan.deleted(m, m.filter("id % 10 = 3"))


@register("upsert_rows", WITH + "select id, case when id % 4 = 1 and status = 'active' then 'updated' else status end as status from memories")
def upsert_rows(spark, d):
    m = memories(spark, d).select("id", "status")
    return scan.updated(m, m.filter("id % 4 = 1"))


@register("unembedded", WITH + f"select id from memories where {LIVE} and id not in (select vec_id from embeddings) and id % 50 <> 7")
def unembedded(spark, d):
    m = memories(spark, d)
    return scan.without_vectors(m, table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), m.filter("id % 50 = 7")).select("id")


@register("stats_global", WITH + """select count(*) as total, count(*) filter (layer = 'ltm') as ltm, count(*) filter (layer = 'stm') as stm, count(*) filter (tier = 'hot') as hot,
 count(*) filter (tier = 'warm') as warm, count(*) filter (tier = 'cold') as cold, count(distinct topic) as topics, round(coalesce(avg(strength), 0), 6) as avg_strength from memories""")
def stats_global(spark, d):
    return aggregate.stats(memories(spark, d)).withColumn("avg_strength", F.round("avg_strength", 6))


@register("topic_health", WITH + "select topic, count(*) as n, round(avg(strength), 6) as avg_strength, count(*) filter (strength < 0.3) as n_weak, count(*) > 10 as needs_consolidation from memories group by topic")
def topic_health(spark, d):
    return aggregate.topic_health(memories(spark, d)).withColumn("avg_strength", F.round("avg_strength", 6))


@register("list_topics", WITH + "select topic, count(*) as n from memories group by topic")
def list_topics(spark, d):
    return aggregate.topics(memories(spark, d))


@register("support_refresh", WITH + "select superseded_by as canonical_id, count(*) as support, count(distinct lang) as diversity from memories where superseded_by is not null group by superseded_by")
def support_refresh(spark, d):
    return aggregate.support(memories(spark, d).filter("superseded_by is not null").select(F.col("superseded_by").alias("canonical_id"), F.col("lang").alias("source")))


@register("recall_access_ratio", "select user_id as id, case when count(*) filter (event_type = 'view') = 0 then 1.0 else count(*) filter (event_type = 'click') * 1.0 / count(*) filter (event_type = 'view') end as ratio from events group by user_id")
def recall_access_ratio(spark, d):
    one = lambda t: F.when(F.col("event_type") == t, 1).otherwise(0)
    return table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(aggregate.ratio(one("click"), one("view")).alias("ratio"))


@register("dominant_cluster", WITH + "select topic, cluster_id, n from (select topic, cluster_id, count(*) as n, row_number() over (partition by topic order by count(*) desc, cluster_id) as r from memories group by topic, cluster_id) where r = 1")
def dominant_cluster(spark, d):
    return aggregate.dominant(memories(spark, d), ["topic"], "cluster_id")


@register("quantile_interpolated", "select l_returnflag, count(l_quantity) as n, quantile_cont(l_extendedprice, 0.25) as p25, quantile_cont(l_extendedprice, 0.75) as p75 from lineitem group by l_returnflag")
def quantile_interpolated(spark, d):
    return aggregate.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", (0.25, 0.75))


@register("quantile_floor_index", "select l_suppkey, v as p90 from (select l_suppkey, l_extendedprice as v, row_number() over (partition by l_suppkey order by l_extendedprice) - 1 as i, count(*) over (partition by l_suppkey) as n from lineitem) where i = least(floor(0.9 * n), n - 1)")
def quantile_floor_index(spark, d):
    return aggregate.floor_quantile(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", 0.9, "p90")


@register("canonical_lengths", WITH + "select cluster_id, count(*) as n, quantile_cont(strlen(content), 0.25) as p25, quantile_cont(strlen(content), 0.75) as p75 from memories group by cube (cluster_id)")
def canonical_lengths(spark, d):
    return aggregate.canonical_lengths(memories(spark, d).withColumn("bytes", F.octet_length("content")))


@register("quality_weights", "select count(*) filter (quality = 1) as good, count(*) filter (quality = 0) as bad, round(sum(case when quality = 1 then n_chars else 0 end) / (sum(n_chars) + 0.001), 6) as w_n_chars from documents join labels using (doc_id)")
def quality_weights(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return aggregate.learned_weights(x, F.col("quality") == 1, F.col("quality") == 0, ["n_chars"]).withColumn("w_n_chars", F.round("w_n_chars", 6))


@register("kappa_labels", """with c as (select count(*) filter (quality = 1 and toxic = 0) as yy, count(*) filter (quality = 1 and toxic = 1) as yn, count(*) filter (quality = 0 and toxic = 0) as ny, count(*) filter (quality = 0 and toxic = 1) as nn from labels),
 r as (select *, cast(yy + yn + ny + nn as double) as n from c) select yy, nn, round(((yy + nn) / n - ((yy + yn) * (yy + ny) + (ny + nn) * (yn + nn)) / (n * n)) / (1 - ((yy + yn) * (yy + ny) + (ny + nn) * (yn + nn)) / (n * n)), 6) as kappa from r""")
def kappa_labels(spark, d):
    one = lambda q, t: F.sum(F.when((F.col("quality") == q) & (F.col("toxic") == t), 1).otherwise(0)).cast("long")
    c = table(spark, d, "labels").agg(one(1, 0).alias("yy"), one(1, 1).alias("yn"), one(0, 0).alias("ny"), one(0, 1).alias("nn"))
    return c.select("yy", "nn", F.round(aggregate.kappa(*[F.col(x) for x in ("yy", "yn", "ny", "nn")]), 6).alias("kappa"))


@register("useful_rate", """select user_id as id, round(least(1.0, greatest(0.0, (0.3 * count(*) filter (event_type = 'purchase') + 0.4 * count(*) filter (event_type = 'click') + 0.3 * count(*) filter (event_type = 'signup') - 0.5 * count(*) filter (event_type = 'error')) / greatest(count(*) filter (event_type = 'view'), 1))), 6) as rate from events group by user_id""")
def useful_rate(spark, d):
    n = lambda t: F.sum(F.when(F.col("event_type") == t, 1).otherwise(0))
    return table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.round(aggregate.useful_rate(n("view"), n("purchase"), n("click"), n("signup"), n("error")), 6).alias("rate"))


@register("failure_streaks", """with e as (select user_id, event_type = 'error' as failed, row_number() over (partition by user_id order by ts, event_id) as i from events),
 o as (select *, max(case when not failed then i end) over (partition by user_id) as ok from e)
 select user_id, cast(count(*) filter (failed and i > coalesce(ok, 0)) as bigint) as consecutive, round(avg(case when failed then 1 else 0 end), 6) as rate from o group by user_id""")
def failure_streaks(spark, d):
    e = table(spark, d, "events").withColumn("failed", F.col("event_type") == "error")
    return aggregate.consecutive_failures(e, "user_id", ["ts", "event_id"], "failed").withColumn("rate", F.round("rate", 6))


# scores


@register("decay_strength", WITH + "select id, round(case when importance = 'critical' or age_hours < 3 then 1.0 else exp(-decay_lambda / (1 + 0.2 * access_count) * power(floor(age_hours / 3.0) / 24.0, case layer when 'ltm' then 0.8 else 1.2 end)) end, 6) as strength from memories")
def decay_strength(spark, d):
    age = scoring.days(F.lit(AS_OF), F.col("last_accessed"))
    c = scoring.decay(F.col("decay_lambda"), F.col("access_count"), age, F.col("layer"), F.col("importance"))
    return memories_at(spark, d).select("id", F.round(c, 6).alias("strength"))


@register("recency_boost", WITH + "select id, round(case when age_hours <= 24 then 1.5 when age_hours <= 168 then 1.5 - 0.5 * (age_hours - 24) / 144.0 else 1.0 end, 6) as boost from memories")
def recency_boost(spark, d):
    return memories_at(spark, d).select("id", F.round(scoring.recency_boost(scoring.whole_hours(F.lit(AS_OF), F.col("created_at"))), 6).alias("boost"))


@register("weighted_score", WITH + "select id, round(0.5 * strength * (1 + 0.2 * access_count) * case when age_hours <= 24 then 1.5 when age_hours <= 168 then 1.5 - 0.5 * (age_hours - 24) / 144.0 else 1.0 end, 8) as score from memories")
def weighted_score(spark, d):
    boost = scoring.recency_boost(F.col("age_hours"))
    return memories(spark, d).select("id", F.round(scoring.weighted(F.lit(0.5), F.col("strength"), F.col("access_count"), boost), 8).alias("score"))


@register("tier_assign", WITH + """, r as (select id, access_count / greatest(floor(age_hours / 24.0), 1) as rate from memories), q as (select quantile_cont(rate, 0.25) as c, quantile_cont(rate, 0.75) as h from r)
 select id, round(rate, 6) as rate, case when rate >= (case when c = h then c + 1 else h end) then 'hot' when rate <= c then 'cold' else 'warm' end as tier from r, q""")
def tier_assign(spark, d):
    from siltstone.operators.lifecycle import tiering

    out = tiering(memories(spark, d).select("id", scoring.access_rate(F.col("access_count"), F.col("age_hours") / 24).alias("rate")))
    return out.select("id", F.round("rate", 6).alias("rate"), "tier")


@register("promotion_threshold", "select p_partkey as id, cast(least(8, greatest(2, ceil(least(28.0, greatest(1.0, p_size * 0.7)) / 7) + 1)) as int) as threshold from part")
def promotion_threshold(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), scoring.promotion_threshold(F.col("p_size") * 0.7).alias("threshold"))


@register("confidence", WITH + "select id, round(least(0.99, case when cluster_id % 4 >= 3 then 0.95 when cluster_id % 4 = 2 then 0.85 when cluster_id % 4 = 1 then 0.62 else 0.0 end + 0.01 * least(greatest(support - 1, 0), 4) + 0.01 * least(greatest(diversity - 1, 0), 3)), 6) as confidence from memories")
def confidence(spark, d):
    return memories(spark, d).select("id", F.round(scoring.confidence(F.col("cluster_id") % 4, F.col("support"), F.col("diversity")), 6).alias("confidence"))


@register("rerank_linear", WITH + """select id, round(greatest(0.0, least(2.0, 0.14 * strength + 0.14 * (1 - strength) + 0.08 * 0.5 + 0.07 * 0.25 + 0.07 / (1 + age_hours / 24.0 / 7) + 0.05 * least(access_count, 20) / 20.0 + 0.05 * strength
 + 0.05 * case importance when 'critical' then 1.0 when 'high' then 0.8 when 'medium' then 0.6 else 0.4 end + 0.05 * 0.5 + 0.03 * case when topic = 'src1' then 1.0 else 0.0 end + 0.02 / (1 + strlen(content) / 500.0)
 + 0.04 * (cluster_id % 5) / 4.0 + 0.02 * support / (support + 1.0) + 0.02 * diversity / (diversity + 1.0) + 0.03 / (1 + floor(age_hours / 3.0) / 24.0 / 14) + 0.03 * least(support, 10) / 10.0 + 0.03 * least(diversity, 5) / 5.0
 + 0.03 * case tier when 'hot' then 1.0 when 'warm' then 0.5 else 0.0 end + 0.03 * case when superseded_by is null then 1.0 else 0.0 end + 0.02 * 0.5)), 6) as score from memories""")
def rerank_linear(spark, d):
    f = {
        "fts": F.col("strength"), "vec": 1 - F.col("strength"), "kg": F.lit(0.5), "episode": F.lit(0.25), "age_days": F.col("age_hours") / 24, "access_count": F.col("access_count"),
        "strength": F.col("strength"), "importance": F.col("importance"), "keyword_overlap": F.lit(0.5), "topic_match": F.col("topic") == "src1", "bytes": F.octet_length("content"),
        "channels": F.col("cluster_id") % 5, "support": F.col("support"), "diversity": F.col("diversity"), "idle_days": F.floor(F.col("age_hours") / 3) / 24, "related": F.col("support"),
        "concepts": F.col("diversity"), "tier": F.col("tier"), "is_current": F.col("superseded_by").isNull(), "survival": F.lit(None).cast("double"),
    }
    return memories(spark, d).select("id", F.round(scoring.rerank(f), 6).alias("score"))


# text


@register("token_sets", "with t as (select doc_id as id, list_distinct(list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g')), lambda w: w <> '')) as w from documents) select id, cast(len(w) as int) as n, array_to_string(list_sort(w), ' ') as tokens from t")
def token_sets(spark, d):
    from siltstone.functions.text import let

    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), let(text.tokens(F.coalesce("text", F.lit(""))), lambda w: F.struct(F.size(w).alias("n"), F.array_join(F.array_sort(w), " ").alias("tokens"))).alias("x"))
    return t.select("id", "x.n", "x.tokens")


@register("topic_key", "select p_partkey as id, trim(regexp_replace(lower(trim(p_name || ' / ' || p_brand)), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') as topic_key from part")
def topic_key(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.topic_key(F.concat("p_name", F.lit(" / "), "p_brand")).alias("topic_key"))


@register("deterministic_folds", "with h as (select c_custkey as id, sha256('family:' || c_name) as h from customer), b as (select id, list_transform(range(1, 64, 2), lambda i: (strpos('0123456789abcdef', h[i:i]) - 1) + (strpos('0123456789abcdef', h[i + 1:i + 1]) - 1)) as s from h) select id, cast(list_sum(s) % 5 as int) as fold from b")
def deterministic_folds(spark, d):
    # 16 = 1 (mod 5), so a number modulo 5 is the sum of its hexadecimal digits modulo 5: the SQL counts on that
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.fold_of(F.col("c_name"), "family:").alias("fold"))


def _secret_sql(c: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return " or ".join([f"contains(lower({c}), {quoted(p)})" for p in text.SECRET_PHRASES] + [f"regexp_matches({c}, {quoted(p)})" for p, _ in text.SECRETS])


@register("secret_lines", f"select doc_id as id, {_secret_sql('x')} as secret from (select doc_id, coalesce(text, '') as x from documents)")
def secret_lines(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.is_secret(F.coalesce("text", F.lit(""))).alias("secret"))


@register("json_payload", "select event_id as id, cast(json_extract_string(props, '$.k') as int) as k from events where cast(json_extract_string(props, '$.k') as int) >= 5")
def json_payload(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("int").alias("k")).filter("k >= 5")


# retrieval

WORDS_SQL = "regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')"
#: The stated queries: the first three words of every document whose id is divisible by 20.
QUERIES_SQL = f"select doc_id as query_id, array_to_string(list_filter({WORDS_SQL}, lambda x: x <> '')[1:3], ' ') as query from documents where doc_id % 20 = 0"
BM25_SQL = f"""
with q as ({QUERIES_SQL}), terms as (select distinct query_id, unnest(string_split(query, ' ')) as term from q),
w as (select doc_id as id, list_filter({WORDS_SQL}, lambda x: x <> '') as ws from documents), len as (select id, len(ws) as n from w), st as (select count(*) as n, avg(n) as a from len),
p as (select id, term, count(*) as tf from (select id, unnest(ws) as term from w) where term in (select term from terms) group by all), df as (select term, count(*) as df from p group by term),
s as (select query_id, p.id, sum(ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len.n / st.a))) as score, count(*) as found from p join terms using (term) join df using (term) join len using (id), st group by all)
"""


def asked(spark, d):
    """query_id, query of the stated queries."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return table(spark, d, "documents").filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(words, 1, 3), " ").alias("query"))


def asked_terms(spark, d):
    return asked(spark, d).select("query_id", text.sanitize_query(F.col("query")).alias("terms"))


def lexical_index(spark, d):
    """The stored index of the documents' texts: written when it is first asked for, and read by all queries after that."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return stored(spark, docs, "lexical", lambda root: lexical.LexicalIndex(spark, root).build(docs), lambda root: lexical.LexicalIndex(spark, root).reader())


def best_lexical(spark, d, k):
    """query_id, id, score, rank of the k best documents of each stated query."""
    return lexical_index(spark, d).search(asked_terms(spark, d), k)


def _lists(spark, d):
    """Two channels of 20 rows for each query: BM25, and cosine to the vector of the query's number, if there is one."""
    lexical = best_lexical(spark, d, 20).select(F.col("query_id").cast("int"), F.lit("fts").alias("channel"), F.col("id").cast("long"), F.round("score", 9).alias("score"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    near = retrieval.nearest(v, q, 20).select(F.col("query_id").cast("int"), F.lit("vec").alias("channel"), "id", F.round("score", 9).alias("score"))
    return lexical.unionByName(near)


COSINE_SQL = "select q.vec_id as query_id, v.vec_id as id, round(list_dot_product(cast(q.embedding as double[]), cast(v.embedding as double[])) / sqrt(list_dot_product(cast(q.embedding as double[]), cast(q.embedding as double[]))) / sqrt(list_dot_product(cast(v.embedding as double[]), cast(v.embedding as double[]))), 9) as score from embeddings q, embeddings v where q.vec_id % 20 = 0"
LISTS_SQL = BM25_SQL + f""", l as (select cast(query_id as int) as query_id, 'fts' as channel, id, score from (select *, row_number() over (partition by query_id order by score desc, id) as r from (select query_id, id, round(score, 9) as score from s)) where r <= 20
 union all select cast(query_id as int), 'vec', id, score from (select *, row_number() over (partition by query_id order by score desc, id) as r from ({COSINE_SQL})) where r <= 20)"""


@register("bm25_topk", BM25_SQL + "select query_id, id, score, rank from (select query_id, id, round(score, 6) as score, cast(row_number() over (partition by query_id order by round(score, 9) desc, id) as int) as rank from s) where rank <= 10")
def bm25_topk(spark, d):
    return best_lexical(spark, d, 10).withColumn("score", F.round("score", 6))


@register("bm25_all_terms", BM25_SQL + "select query_id, id, round(score, 6) as score from s where found = (select count(*) from terms t where t.query_id = s.query_id)")
def bm25_all_terms(spark, d):
    return lexical_index(spark, d).all(asked_terms(spark, d), all_terms=True).withColumn("score", F.round("score", 6))


@register("cosine_topk", f"select query_id, id, round(score, 6) as score, rank from (select *, cast(row_number() over (partition by query_id order by score desc, id) as int) as rank from ({COSINE_SQL})) where rank <= 10")
def cosine_topk(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return retrieval.nearest(v, q, 10).withColumn("score", F.round(F.round("score", 9), 6))


def vector_index(spark, d):
    """The stored neighbour index of the embeddings, written once like the lexical one."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return stored(spark, v, "vectors", lambda root: VectorIndex(spark, root).build(v), lambda root: VectorIndex(spark, root).reader())


def asked_vectors(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@register("ann_topk")
def ann_topk(spark, d):
    """The k nearest live rows, as the probed cells have them; tested by recall."""
    live = scan.live(memories(spark, d)).select("id")
    return vector_index(spark, d).search(asked_vectors(spark, d), 10, live=live).withColumn("score", F.round("score", 6))


@register("live_vector_topk", WITH + f"select query_id, id, round(score, 6) as score, rank from (select query_id, id, score, cast(row_number() over (partition by query_id order by score desc, id) as int) as rank from ({COSINE_SQL}) join (select id from memories where {LIVE}) using (id)) where rank <= 10")
def live_vector_topk(spark, d):
    """All cells are probed, so it is exact; rows that aren't live go before the k are taken."""
    index = vector_index(spark, d)
    live = scan.live(memories(spark, d)).select("id")
    return index.search(asked_vectors(spark, d), 10, probes=len(index.manifest["cells"]), live=live).withColumn("score", F.round(F.round("score", 9), 6))


@register("rrf_fusion", LISTS_SQL + "select query_id, id, round(sum(case channel when 'fts' then 0.3 else 0.7 end / (60 + r)), 9) as score from (select *, row_number() over (partition by query_id, channel order by score desc, id) as r from l) group by all")
def rrf_fusion(spark, d):
    return retrieval.rrf(_lists(spark, d), {"fts": 0.3, "vec": 0.7}).withColumn("score", F.round("score", 9))


@register("convex_fusion", LISTS_SQL + """, b as (select *, min(score) over w as lo, max(score) over w as hi, count(*) over w as n from l window w as (partition by query_id, channel))
 select query_id, id, round(sum(case channel when 'fts' then 0.4 else 0.6 end * case when n = 1 then 1.0 when hi = lo then 0.0 else (score - lo) / (hi - lo) end), 6) as score from b group by all""")
def convex_fusion(spark, d):
    return retrieval.convex(_lists(spark, d), 0.4).withColumn("score", F.round("score", 6))


@register("max_merge", LISTS_SQL + "select query_id, id, round(max(score), 6) as score from l group by all")
def max_merge(spark, d):
    return retrieval.max_merge(_lists(spark, d)).withColumn("score", F.round("score", 6))


@register("channel_scores", LISTS_SQL + """, s2 as (select query_id, channel, id, case when channel = 'vec' or score < 0 then 1 / (1 + abs(score)) else score end as v from l)
 select query_id, channel, id, round(case when m > 1 then v / m else v end, 6) as score from (select *, max(v) over (partition by query_id, channel) as m from s2)""")
def channel_scores(spark, d):
    return retrieval.channel_scores(_lists(spark, d)).select("query_id", "channel", "id", F.round("score", 6).alias("score"))


@register("strong_signal", LISTS_SQL + """, t as (select query_id, score, row_number() over (partition by query_id order by score desc, id) as r from l where channel = 'fts' and score > 0), b as (select query_id, max(case when r = 1 then score end) as a, max(case when r = 2 then score end) as b from t where r <= 2 group by query_id)
 select query_id, round(a, 6) as top1, round(b, 6) as top2, case when b is null then a >= 3.0 else a / b >= 1.5 end as strong from b""")
def strong_signal(spark, d):
    out = retrieval.strong_signal(_lists(spark, d).filter("channel = 'fts'").select("query_id", "id", "score"))
    return out.select("query_id", F.round("top1", 6).alias("top1"), F.round("top2", 6).alias("top2"), "strong")


@register("score_permutation", LISTS_SQL + """, f as (select query_id, id, score from l where channel = 'fts'), r as (select *, row_number() over (partition by query_id order by score desc, id) as k from f), j as (select *, row_number() over (partition by query_id order by case when id % 3 = 0 then id end nulls last, k) as nk from r)
 select j.query_id, j.id, round(s.score, 6) as score, cast(j.nk as int) as rank from j join r s on j.query_id = s.query_id and j.nk = s.k""")
def score_permutation(spark, d):
    f = _lists(spark, d).filter("channel = 'fts'").select("query_id", "id", "score")
    order = f.filter("id % 3 = 0").select("query_id", "id", F.col("id").alias("position"))
    return retrieval.permuted(f, order).withColumn("score", F.round("score", 6))


@register("canonical_collapse", WITH.replace("with ", "with recursive ", 1) + """, c(id, tip, n) as (select id, id, 0 from memories union all select c.id, m.superseded_by, n + 1 from c join memories m on c.tip = m.id where m.superseded_by is not null and m.superseded_by in (select id from memories) and n < 60000),
 t as (select id, arg_max(tip, n) as tip from c group by id) select 1 as query_id, t.tip as id, max(m.strength) as score from memories m join t using (id) join memories a on a.id = t.tip where a.status in ('active', 'updated') group by t.tip""")
def canonical_collapse(spark, d):
    m = memories(spark, d)
    return retrieval.collapse(m.select(F.lit(1).alias("query_id"), "id", F.col("strength").alias("score")), m)


@register("centroids", "select label, cast(pos - 1 as int) as pos, round(avg(x), 5) as x from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings) group by all")
def centroids(spark, d):
    c = retrieval.centroids(table(spark, d, "embeddings"), "label")
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 5))


@register("mmr_diversity")
def mmr_diversity(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("id"), text.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    c = best_lexical(spark, d, 20).drop("rank").withColumn("score", F.round("score", 9)).join(docs, "id").select(F.col("query_id").cast("long"), "id", "score", "tokens")
    return retrieval.mmr(c, 8, 0.7, lambda a, b: len(a & b) / max(1, len(a | b)))


@register("cross_validate", """with a as (select doc_id as id, list_distinct(list_filter(string_split(lower(coalesce(text, '')), ' '), lambda w: w <> '')) as t from documents where doc_id in (select doc_id from labels)),
 b as (select item_id as k, list_distinct(list_filter(string_split(lower(text), ' '), lambda w: w <> '')) as t from benchmark),
 h as (select distinct a.id from a, b where len(list_intersect(a.t, b.t)) * 1.0 / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) > 0.1) select a.id, cast(1 + case when h.id is null then 0 else 1 end as bigint) as sources from a left join h using (id)""")
def cross_validate(spark, d):
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), " "), lambda w: w != ""))
    a = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), words("text").alias("tokens"))
    b = table(spark, d, "benchmark").select(F.lit("bench").alias("source"), F.col("item_id").alias("key"), words("text").alias("tokens"))
    return retrieval.corroborated(a, b, 0.1)
