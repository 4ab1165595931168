"""Registered queries: concepts, writing with duplicates in mind, calibration, and the later steps of a recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import calibrate, concepts, retrieval, store
from siltstone.plans.core import BM25_SQL, COSINE_SQL, LISTS_SQL, _lists
from siltstone.plans.model import AS_OF, WITH, memories, memories_at, table
from siltstone.plans.registry import register
from siltstone.sources.shared import written

# concepts: parts, with their neighbours as sources, each linked with the third after it; queries: names of every twentieth part

CONCEPTS_SQL = """with recursive c as (select p_partkey as id, p_name as name, p_type as definition, p_brand as labels from part), q as (select p_partkey as query_id, lower(p_name) as query from part where p_partkey % 20 = 0),
t as (select distinct query_id, unnest(list_filter(regexp_split_to_array(trim(regexp_replace(query, '[-*:()"^‘’“”«»]', ' ', 'g')), '\\s+'), lambda w: w <> '')) as term from q),
f as (select id, 'name' as field, name as x from c union all select id, 'definition', definition from c union all select id, 'labels', labels from c), w as (select id, field, list_filter(regexp_split_to_array(lower(coalesce(x, '')), '[^\\p{L}\\p{N}]+'), lambda v: v <> '') as ws from f),
st as (select field, count(*) as n, avg(len(ws)) as a from w group by field), p as (select id, field, term, n, count(*) as tf from (select id, field, unnest(ws) as term, len(ws) as n from w) where term in (select term from t) group by all), df as (select term, field, count(*) as df from p group by all),
s as (select query_id, p.id, sum(ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * p.n / st.a))) as score, count(distinct p.term) as found from p join t using (term) join df using (term, field) join st using (field) group by all),
hit as (select query_id, id, score, cast(row_number() over (partition by query_id order by score desc, id) as int) as rank from (select query_id, id, round(score, 9) as score from s where found = (select count(*) from t where t.query_id = s.query_id)) qualify row_number() over (partition by query_id order by score desc, id) <= 5)
"""


def _concepts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("definition"), F.col("p_brand").alias("labels"), F.array("p_partkey", F.col("p_partkey") + 1).alias("source_memory_ids"))


def _asked(spark, d):
    return table(spark, d, "part").filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.lower("p_name").alias("query"))


def _links(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("source"), (F.col("p_partkey") + 3).alias("target"))


@register("concept_search", CONCEPTS_SQL + "select query_id, id, round(score, 6) as score, rank from hit")
def concept_search(spark, d):
    return concepts.search(_concepts(spark, d), _asked(spark, d)).withColumn("score", F.round("score", 6))


@register("kg_channel", CONCEPTS_SQL + """, l as (select p_partkey as s, p_partkey + 3 as t from part), r(query_id, id, depth) as (select query_id, id, 0 from hit union select query_id, t, depth + 1 from r join l on s = id where depth < 2),
 m as (select query_id, id, 1.0 / rank as score from hit union all select query_id, id, 1.0 / (1 + min(depth)) from r group by query_id, id), e as (select query_id, unnest([id, id + 1]) as id, score from m where id in (select p_partkey from part)) select query_id, id, round(max(score), 6) as score from e group by query_id, id""")
def kg_channel(spark, d):
    return concepts.kg_channel(_asked(spark, d), _concepts(spark, d), _links(spark, d)).withColumn("score", F.round("score", 6))


@register("links_around", "select p_partkey as source, p_partkey + 3 as target, case when p_partkey % 20 = 0 then 'from' else 'to' end as side from part where p_partkey % 20 = 0 or (p_partkey + 3) % 20 = 0")
def links_around(spark, d):
    ids = _asked(spark, d).select(F.col("query_id").alias("id"))
    more = ids.select((F.floor(F.col("id") / 20) * 20).alias("id")).unionByName(table(spark, d, "part").select((F.col("p_partkey") + 3).alias("id")).filter("id % 20 = 0")).distinct()
    a, b = concepts.links_from(_links(spark, d), ids), concepts.links_to(_links(spark, d), more)
    return a.withColumn("side", F.lit("from")).unionByName(b.withColumn("side", F.lit("to")))


@register("spreading_activation", WITH + ", s as (select superseded_by as id, max(strength) as sim from memories where superseded_by is not null group by 1) select m.id, cast(access_count + case when sim > 0.3 then 1 else 0 end as int) as access_count from memories m left join s using (id)")
def spreading_activation(spark, d):
    m = memories_at(spark, d)
    near = m.filter("superseded_by is not null").select(F.col("superseded_by").alias("id"), F.col("strength").alias("sim"))
    return concepts.activated(m, near, AS_OF).select("id", "access_count")


# writing


@register("store_with_dedup", WITH + """, o as (select * from memories where id % 7 <> 0), n as (select * from memories where id % 7 = 0), x as (select n.id as new_id, n.id - 1 as old_id, case when n.id % 5 = 0 or n.id = 0 then 'create_new' when n.id % 5 = 1 then 'merge_into' when n.id % 5 = 2 then 'supersede' when n.id % 5 = 3 then 'gray_zone' else 'merge_into_many' end as action from n),
 r as (select o.id, case when s.action = 'supersede' then 'deprecated' when t.new_id is not null then 'updated' else o.status end as status, coalesce(case when s.action = 'supersede' then s.new_id end, case when t.new_id is not null then t.old_id end, o.superseded_by) as superseded_by,
  o.access_count + case when s.action in ('merge_into', 'merge_into_many') then f.access_count + 1 else 0 end + case when s.action = 'merge_into_many' and g.id is not null then g.access_count + 1 else 0 end as access_count
  from o left join x s on s.old_id = o.id left join n f on f.id = s.new_id left join o g on g.id = o.id - 1 and s.action = 'merge_into_many' left join x t on t.action = 'merge_into_many' and t.old_id - 1 = o.id)
 select id, status, superseded_by, cast(access_count as int) as access_count from r union all select n.id, status, superseded_by, access_count from n join x on x.new_id = n.id where action in ('create_new', 'supersede', 'gray_zone')""")
def store_with_dedup(spark, d):
    m = memories_at(spark, d).withColumn("keywords", F.array("topic"))
    new = m.filter("id % 7 = 0")
    old, older = (F.col("id") - 1).cast("long"), (F.col("id") - 2).cast("long")
    action = F.when((F.col("id") % 5 == 0) | (F.col("id") == 0), "create_new").when(F.col("id") % 5 == 1, "merge_into").when(F.col("id") % 5 == 2, "supersede").when(F.col("id") % 5 == 3, "gray_zone").otherwise("merge_into_many")
    targets = F.when(action == "create_new", F.array().cast("array<bigint>")).when(action == "merge_into_many", F.array(old, older)).otherwise(F.array(old))
    rows, _, _ = store.store(m.filter("id % 7 <> 0"), new, new.select(F.col("id").alias("new_id"), action.alias("action"), targets.alias("targets")), AS_OF)
    return rows.select("id", "status", "superseded_by", "access_count")


@register("chain_versions", WITH + "select id, cast(case when superseded_by is null then 0 else 2 end as bigint) as version from memories")
def chain_versions(spark, d):
    return store.chain_versions(memories(spark, d).select("id", F.col("superseded_by").alias("version")))


@register("loo_evidence", WITH + "select cluster_id as canonical, count(*) as support, count(distinct topic) as diversity from memories where id % 20 <> 0 group by cluster_id")
def loo_evidence(spark, d):
    m = memories(spark, d).select(F.col("cluster_id").alias("canonical"), F.col("id").alias("memory_id"), F.col("topic").alias("source"))
    return store.without_family(m, m.filter("memory_id % 20 = 0"))


@register("json_references", "select doc_id as id from documents where doc_id in (select cast(json_extract_string(props, '$.k') as int) from events union select cast(json_extract_string(props, '$.k') as int) + 1 from events)")
def json_references(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    holders = table(spark, d, "events").filter(k.isNotNull()).select(F.to_json(F.array(k, k + 1)).alias("ids"))
    return store.referenced(table(spark, d, "documents").select(F.col("doc_id").alias("id")), holders, "ids")


@register("keyed_counters", "with k as (select 'recall_hit:' || user_id as key, count(*) as value from events group by 1) select c_custkey as id, value from customer left join k on key = 'recall_hit:' || c_custkey")
def keyed_counters(spark, d):
    k = table(spark, d, "events").groupBy(F.concat(F.lit("recall_hit:"), F.col("user_id").cast("string")).alias("key")).agg(F.count("*").alias("value"))
    return store.by_key(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), k, "recall_hit:")


@register("visible_summaries", WITH + "select id, case when tier = 'cold' and access_count = cast(id * 7 % 23 as int) and id % 2 = 0 then 'archived ' || id else summary end as summary from memories")
def visible_summaries(spark, d):
    archived = F.when(F.col("id") % 2 == 0, F.concat(F.lit("archived "), F.col("id").cast("string")))
    return memories(spark, d).select("id", store.visible_summary(F.col("summary"), archived, F.lit(True), F.col("tier"), F.col("access_count"), (F.col("id") * 7 % 23).cast("int")).alias("summary"))


@register("triple_cache", "select doc_id as id, case when doc_id % 3 = 0 then 1 end as n from documents")
def triple_cache(spark, d):
    rows = memories(spark, d).select("id", "content")
    cache = rows.select("id", F.sha2(F.when(F.col("id") % 3 == 1, F.concat("content", F.lit(" old"))).otherwise(F.col("content")), 256).alias("content_hash"), F.when(F.col("id") % 3 == 2, 0).otherwise(1).alias("extractor"), F.array(F.lit("t")).alias("triples"))
    return store.cached_triples(rows, cache, 1).select("id", F.when(F.col("triples").isNotNull(), F.size("triples")).alias("n"))


# calibration

KAPPA_SQL = """with p as (select user_id % 5 as g, event_id // 500 as win, value > 50 as a, (value > 50) <> (event_id // 500 % 2 = 1 and event_id % 4 = 0) as b from events), s as (select g, win, count(*) as n, avg((a = b)::int) as o, avg(a::int) as pa, avg(b::int) as pb from p group by all),
 k as (select g, win, n, case when abs(1 - (pa * pb + (1 - pa) * (1 - pb))) < 1e-12 then o else (o - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) end as kappa from s)"""


def _agreement(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("group"), F.floor(F.col("event_id") / 500).alias("window"), (F.col("value") > 50).alias("a"), ((F.col("value") > 50) != ((F.floor(F.col("event_id") / 500) % 2 == 1) & (F.col("event_id") % 4 == 0))).alias("b"))
    return calibrate.agreement(e, ["group", "window"])


@register("drift_alerts", KAPPA_SQL + " select g as \"group\", win as \"window\", n, round(kappa, 6) as kappa from (select *, lag(kappa) over (partition by g order by win) as before from k) where n >= 30 and kappa < 0.7 and (before is null or before >= 0.7)")
def drift_alerts(spark, d):
    return calibrate.drift_alerts(_agreement(spark, d)).withColumn("kappa", F.round("kappa", 6))


@register("judge_gates", KAPPA_SQL + " select g as \"group\", win as \"window\", case when n < 30 then 'insufficient' when kappa is null or kappa not between -1 and 1 then 'invalid' when kappa < 0.6 then 'below_floor' else 'trusted' end as gate from k")
def judge_gates(spark, d):
    return _agreement(spark, d).select("group", "window", calibrate.judge_gate(F.col("n"), F.col("kappa")).alias("gate"))


@register("calls_left", "with l as (select max(ts) as t from events) select event_type, cast(sum(case when ts > t - interval 1 day and ts <= t then 1 else 0 end) as bigint) as used, cast(greatest(0, 40 - sum(case when ts > t - interval 1 day and ts <= t then 1 else 0 end)) as bigint) as \"left\" from events, l group by event_type")
def calls_left(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return calibrate.calls_left(e, ["event_type"], e.agg(F.max("ts")).first()[0], 40)


@register("normalized_rewards", "with c as (select l_orderkey as event, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey, l_suppkey) as r, case when l_returnflag = 'R' then 1 when l_returnflag = 'A' then -1 else 0 end as y from lineitem) select event, round(case when count(*) filter (y <> 0) = 0 then 0 else sum(y / r) / count(*) filter (y <> 0) end, 6) as reward from c group by event")
def normalized_rewards(spark, d):
    from pyspark.sql import Window as W

    r = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey"))
    y = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -1).otherwise(0)
    return calibrate.normalized_reward(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event"), r.alias("rank"), y.alias("label"))).withColumn("reward", F.round("reward", 6))


@register("dwell_p50", "select event_type, cast(floor(quantile_cont(cast(floor(value * 1000) as bigint), 0.5) + 0.5) as bigint) as p50 from events group by event_type")
def dwell_p50(spark, d):
    return calibrate.dwell_p50(table(spark, d, "events").select("event_type", F.floor(F.col("value") * 1000).alias("ms")), ["event_type"], "ms")


@register("refresh_stats", "select count(*) as n, cast(floor(quantile_cont(l_linenumber, 0.5) + 0.5) as bigint) as revision_p50, cast(floor(quantile_cont(l_linenumber, 0.9) + 0.5) as bigint) as revision_p90, cast(floor(quantile_cont(cast(l_quantity as bigint), 0.5) + 0.5) as bigint) as age_p50 from lineitem")
def refresh_stats(spark, d):
    return calibrate.refresh_stats(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("revisions"), F.col("l_quantity").cast("long").alias("age_secs")))


@register("counterfactual", "with e as (select value / 100 as s, 0.7 as h, 0.6 + event_id % 20 / 100.0 as w from events) select count(*) as n, count(*) filter (s > h and s > w) as both, count(*) filter (s > h and s <= w) as hard_only, count(*) filter (s <= h and s > w) as shadow_only from e")
def counterfactual(spark, d):
    return calibrate.counterfactual(table(spark, d, "events").select((F.col("value") / 100).alias("similarity"), F.lit(0.7).alias("hard"), (0.6 + F.col("event_id") % 20 / 100.0).alias("shadow")))


# recall


@register("strong_bypass", LISTS_SQL + """, t as (select query_id, score, row_number() over (partition by query_id order by score desc, id) as r from l where channel = 'fts' and score > 0), b as (select query_id, max(case when r = 1 then score end) as a, max(case when r = 2 then score end) as b from t where r <= 2 group by query_id),
 g as (select query_id from b where case when b is null then a >= 3.0 else a / b >= 1.5 end) select query_id, channel, id, round(score, 6) as score from l where channel = 'fts' or query_id not in (select query_id from g)""")
def strong_bypass(spark, d):
    lists = _lists(spark, d)
    strong = retrieval.strong_signal(lists.filter("channel = 'fts'").select("query_id", "id", "score"))
    return retrieval.bypassed(lists, strong).select("query_id", "channel", "id", F.round("score", 6).alias("score"))


@register("six_weights", WITH.replace("with ", "with m0 as (select 1), ", 1) + ", " + LISTS_SQL.strip().removeprefix("with ") + """, s2 as (select query_id, channel, id, case when channel = 'vec' or score < 0 then 1 / (1 + abs(score)) else score end as v from l), s3 as (select query_id, channel, id, v, max(v) over (partition by query_id, channel) as top from s2), s4 as (select query_id, channel, id, case when top > 1 then v / top else v end as v from s3),
 fu as (select query_id, id, max(score) as score from l group by all), x as (select fu.query_id, fu.id, fu.score, coalesce(max(v) filter (channel = 'fts'), 0) as a, coalesce(max(v) filter (channel = 'vec'), 0) as b from fu left join s4 on s4.query_id = fu.query_id and s4.id = fu.id group by all)
 select query_id, x.id, round(case when m.id is null then score else 0.25 * (0.45 * a + 0.45 * b + 0.02 * case when support > 1 then (support - 1.0) / support else 0 end + 0.01 * case when diversity > 1 then (diversity - 1.0) / diversity else 0 end) + 0.75 * score end, 6) as score from x left join memories m on m.id = x.id""")
def six_weights(spark, d):
    lists = _lists(spark, d)
    weights = dict(zip(("bm25", "vec", "kg", "episode", "support", "diversity"), (0.45, 0.45, 0.04, 0.03, 0.02, 0.01), strict=True))
    return retrieval.six_weights(retrieval.max_merge(lists), retrieval.channel_scores(lists), memories(spark, d), weights, 0.25).withColumn("score", F.round("score", 6))


@register("evidence_preview", WITH + """, e as (select superseded_by as id, '[' || topic || '] ' || summary as line, row_number() over (partition by superseded_by order by id) as r from memories where superseded_by is not null)
 select m.id, cast(greatest(support - 1, 0) as int) as evidence_count, case when support > 1 then coalesce(max(case when r = 1 then line end), '') || coalesce('|' || max(case when r = 2 then line end), '') else '' end as preview from memories m left join e on e.id = m.id group by m.id, support""")
def evidence_preview(spark, d):
    m = memories(spark, d)
    evidence = m.filter("superseded_by is not null").select(F.col("superseded_by").alias("id"), F.col("id").alias("memory_id"), "topic", "summary", F.col("id").alias("position"))
    return retrieval.evidence_preview(m, evidence).select("id", F.col("evidence_count").cast("int").alias("evidence_count"), F.array_join("preview", "|").alias("preview"))


@register("knn_pairs", f"with s as ({COSINE_SQL.replace('where q.vec_id % 20 = 0', 'where q.vec_id <> v.vec_id')}), r as (select *, row_number() over (partition by query_id order by score desc, id) as k from s) select least(query_id, id) as a, greatest(query_id, id) as b, round(max(score), 6) as sim from r where k <= 3 group by 1, 2")
def knn_pairs(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.knn_pairs(v, 3).withColumn("sim", F.round(F.round("sim", 9), 6))


@register("vector_dedup", f"with s as ({COSINE_SQL}), r as (select *, row_number() over (partition by query_id order by score desc, id) as k from s where query_id <> id) select query_id as new_id, id as old_id, round(score, 6) as sim, case when score >= 0.3 then 'strong' else 'weak' end as band from r where k <= 5 and score >= 0.2")
def vector_dedup(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.vector_dedup(v, v.filter("id % 20 = 0"), 5, 0.3, 0.2).withColumn("sim", F.round(F.round("sim", 9), 6))


def _contains(column: str, phrases) -> str:
    return "(" + " or ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


@register("detectors", f"""with x as (select conv_id, turn, coalesce(text, '') || case conv_id % 4 when 0 then ' I prefer tea' when 1 then ' we switched to it' when 2 then ' 我喜欢茶' else '' end as t from conversations)
 select conv_id, turn, {_contains('lower(t)', text.PREFERENCES)} or {_contains('t', text.PREFERENCES_CJK)} as preference, {_contains('lower(t)', text.UPDATES)} or {_contains('t', text.UPDATES_CJK)} as changed from x""")
def detectors(spark, d):
    more = F.when(F.col("conv_id") % 4 == 0, " I prefer tea").when(F.col("conv_id") % 4 == 1, " we switched to it").when(F.col("conv_id") % 4 == 2, " 我喜欢茶").otherwise("")
    t = F.concat(F.coalesce("text", F.lit("")), more)
    return table(spark, d, "conversations").select("conv_id", "turn", text.is_preference(t).alias("preference"), text.is_update(t).alias("changed"))


@register("time_bounds", "select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' as lo, strftime(o_orderdate, '%Y-%m-%d') || ' 23:59:59' as hi, cast(null as varchar) as bad from orders")
def time_bounds(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), show(text.bound(day, False)).alias("lo"), show(text.bound(day, True)).alias("hi"), show(text.bound(F.concat(day, F.lit("x")), True)).alias("bad"))


@register("top_hit_cluster", "with h as (select l_orderkey as event, l_partkey as id, l_discount as score from lineitem), b as (select event, arg_max(id, score * 1e9 - id) as id from h group by event) select event, cast(p_size % 5 as int) as cluster from b left join part on p_partkey = b.id")
def top_hit_cluster(spark, d):
    h = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_partkey").alias("id"), F.col("l_discount").alias("score"))
    return retrieval.top_hit_cluster(h, table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("cluster")))


@register("query_variants")
def query_variants(spark, d):
    """Variants of a turn: the next two turns of its conversation."""
    from pyspark.sql import Window as W

    one = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", "text", F.array_compact(F.array(F.lead("text").over(one), F.lead("text", 2).over(one))).alias("v"))
    return c.select("conv_id", "turn", F.size(text.kept_variants(F.coalesce("text", F.lit("")), F.col("v"), F.lit(2))).alias("n"))




# leave-one-out


def loo_parts(spark, d):
    """memories, evidence, groups: superseded rows are evidence of their ends, asked with their summaries; rows of one
    decade are an episode, rows of one remainder of 97 a concept."""
    m = memories_at(spark, d)
    evidence = m.filter("superseded_by is not null").select(F.col("id").alias("evidence_id"), F.col("id").alias("memory_id"), F.col("id").alias("original_id"), F.col("summary").alias("content"), F.col("lang").alias("source"))
    one = lambda kind, c: m.select(F.lit(kind).alias("kind"), c.cast("long").alias("group_id"), F.col("id").alias("memory_id"))
    return m, evidence, one("episode", F.floor(F.col("id") / 10)).unionByName(one("concept", F.col("id") % 97))


_TOKENS = "list_distinct(list_filter(list_transform(regexp_split_to_array(lower({c}), '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: w <> ''))"
_SIM = "greatest(len(list_intersect(v.t, m.t)) * 1.0 / (len(v.t) + len(m.t) - len(list_intersect(v.t, m.t))), len(list_intersect(v.t, m.t)) * 1.0 / least(len(v.t), len(m.t)))"
LOO_SQL = WITH.replace("with ", "with recursive ", 1) + f""", c(id, tip, n) as (select id, id, 0 from memories union all select c.id, m.superseded_by, n + 1 from c join memories m on c.tip = m.id where m.superseded_by is not null and m.superseded_by in (select id from memories) and n < 60000),
 t as (select id, arg_max(tip, n) as tip from c group by id), r as (select tip, arg_min(id, {{'a': -age_hours, 'i': id}}) as family from t join memories using (id) group by tip),
 h as (select tip, family, sha256('family:' || family) as h from r),
 f as (select t.id, family, live.id as live_tip, list_sum(list_transform(range(1, 65), lambda i: strpos('0123456789abcdef', h.h[i:i]) - 1)) % 5 = 0 as holdout from t join h using (tip) left join (select id from memories where status in ('active', 'updated')) live on live.id = t.tip),
 v as (select m.id as evidence_id, family, live_tip, holdout, summary as query, {_TOKENS.format(c="summary")} as t from memories m join f using (id) where superseded_by is not null),
 mt as (select m.id, content, {_TOKENS.format(c="content")} as t, family as mf, live_tip as mtip from memories m join f using (id)),
 held as (select evidence_id, f.id from v join f on f.family = v.family where v.live_tip is null or f.id <> v.live_tip or f.id = v.evidence_id),
 met as (select evidence_id, m.id, case when mf <> family then mtip end as tip, case when content = query then 1 else 2 end as why from v join mt m on content = query or (len(v.t) > 0 and len(m.t) > 0 and {_SIM} > 0.7) where (evidence_id, m.id) not in (select evidence_id, id from held)),
 o as (select evidence_id, id, min(why) as why from (select evidence_id, id, 0 as why from held union all select evidence_id, id, why from met union all select evidence_id, tip, why from met where tip is not null) group by all),
 g as (select 'episode' as kind, id // 10 as group_id, family, live_tip, holdout from f union select 'concept', id % 97, family, live_tip, holdout from f),
 a as (select distinct evidence_id from v join g x using (family) join g y on x.kind = y.kind and x.group_id = y.group_id and y.holdout = v.holdout and y.family <> v.family and y.live_tip is not null where (evidence_id, y.live_tip) not in (select evidence_id, id from o)),
 k as (select distinct evidence_id from v join g x using (family) join g y on x.kind = y.kind and x.group_id = y.group_id and y.holdout <> v.holdout)
"""


@register("loo_cases", LOO_SQL + """, w as (select v.evidence_id, v.family, v.holdout, v.live_tip, o.why, v.live_tip is not null and o.why is null as canonical, v.live_tip is not null and v.evidence_id in (select evidence_id from a) as auxiliary from v left join o on o.evidence_id = v.evidence_id and o.id = v.live_tip)
 select evidence_id, family, holdout, canonical, auxiliary, case when canonical or auxiliary then null when live_tip is null then 'no_live_tip' when why is not null then case why when 0 then 'held_out' when 1 then 'equal' else 'near' end when evidence_id in (select evidence_id from k) then 'cross_fold' else 'no_positive' end as reason from w""")
def loo_cases(spark, d):
    from siltstone.operators.leave_one_out import Cases

    return Cases(*loo_parts(spark, d)).verdicts()


@register("loo_excluded", LOO_SQL + " select evidence_id, id, case why when 0 then 'held_out' when 1 then 'equal' else 'near' end as reason from o")
def loo_excluded(spark, d):
    from siltstone.operators.leave_one_out import Cases

    return Cases(*loo_parts(spark, d)).out


@register("loo_replay")
def loo_replay(spark, d):
    """Paired outcomes of both folds: the lexical ranking, and the same with the support that is left of each row."""
    from siltstone.operators import leave_one_out, lexical
    from siltstone.plans.core import lexical_index

    cases = leave_one_out.Cases(*loo_parts(spark, d))
    found = written(lexical_index(spark, d).search(lexical.terms_of(cases.queries()), 10, without=cases.without()), "found")
    blended = found.join(cases.support(found), ["query_id", "id"]).withColumn("score", F.col("score") * (1 + 0.1 * F.log1p("support")))
    return leave_one_out.paired(cases.outcomes(found, retrieval.top_k(blended.drop("rank"), 10)))


# replay of learning: a window is a week; types are event types, clusters four groups of users


def _weeks(spark, d):
    week = F.floor(F.datediff("ts", F.lit("2020-01-01").cast("date")) / 7).cast("long")
    at = F.timestamp_add("DAY", ((week + 1) * 7).cast("int"), F.lit("2020-01-01 00:00:00").cast("timestamp"))
    features = F.array(F.col("value"), F.col("user_id") % 10 * 1.0, F.col("event_id") % 5 * 1.0, F.lit(1.0), F.lit(0.0), F.col("event_id") % 3 * 1.0)
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(week.alias("window"), at.alias("at"), "ts", F.col("event_type").alias("type"), (F.col("user_id") % 4).cast("int").alias("cluster"), features.alias("weights"), (1.0 + F.col("user_id") % 3).alias("evidence"), (F.col("value") / 100).alias("alpha"))


def _alpha_level(name: str, keys: list[str], parent: str | None) -> str:
    by = "".join(f", {k}" for k in keys)
    on = " and ".join(f"p.{k} = r.{k}" for k in ["wk", *keys[:-1]])
    same = " and ".join(f"n.{k} = c.{k}" for k in keys) or "true"
    size = "round(c.n * exp(-0.06 * (epoch(n.tm) - epoch(c.tm)) / 86400.0)) + n.n"
    walked = "c.alpha + least(greatest(n.own - c.alpha, -0.15), 0.15)"
    first = "parent + least(greatest(own - parent, -0.15), 0.15)"
    rows = f"select wk{by}, max(tm) as tm, sum(n) as n, sum(s) / sum(w) as own from b group by wk{by}"
    rows = f"select r.*, p.alpha as parent from ({rows}) r join {parent} p on {on}" if parent else f"select *, 0.5 as parent from ({rows})"
    return f"""{name}r as (select *, row_number() over ({'partition by ' + ', '.join(keys) + ' ' if keys else ''}order by wk) as k from ({rows})),
 {name}(wk{by}, tm, n, k, alpha) as (select wk{by}, tm, cast(n as double), k, (n * ({first}) + 5 * parent) / (n + 5) from {name}r where k = 1
  union all select n.wk{"".join(f", n.{k}" for k in keys)}, n.tm, cast({size} as double), n.k, (({size}) * ({walked}) + 5 * n.parent) / (({size}) + 5) from {name} c join {name}r n on {same} and n.k = c.k + 1)"""


ALPHA_REPLAY_SQL = f"""with recursive e as (select date_diff('day', timestamp '2020-01-01', ts) // 7 as wk, ts, event_type as type, cast(user_id % 4 as int) as cluster, 1.0 + user_id % 3 as evidence, value / 100 as alpha from events where value is not null),
 d as (select *, timestamp '2020-01-01' + to_days(cast((wk + 1) * 7 as int)) as tm from e), x as (select *, evidence * exp(-0.06 * greatest(0.0, floor(epoch(tm)) - floor(epoch(ts))) / 86400.0) as wt from d),
 b as (select wk, type, cluster, max(tm) as tm, count(*) as n, sum(wt) as w, sum(wt * alpha) as s from x group by all),
 {_alpha_level("g", [], None)}, {_alpha_level("t", ["type"], "g")}, {_alpha_level("l", ["type", "cluster"], "t")}
 select null as type, null as cluster, wk as "window", cast(n as bigint) as n, round(alpha, 6) as alpha from g union all select type, null, wk, cast(n as bigint), round(alpha, 6) from t union all select type, cluster, wk, cast(n as bigint), round(alpha, 6) from l"""


@register("alpha_replay", ALPHA_REPLAY_SQL)
def alpha_replay(spark, d):
    from siltstone.operators import replay

    return replay.committed_alphas(_weeks(spark, d)).select("type", "cluster", "window", "n", F.round("alpha", 6).alias("alpha"))


@register("weight_replay")
def weight_replay(spark, d):
    from siltstone.operators import replay

    out = replay.latest(replay.committed_weights(replay.window_weights(_weeks(spark, d))))
    return out.select("type", "cluster", "n", F.array_join(F.transform("weights", lambda w: F.round(w, 6).cast("string")), " ").alias("weights"))


# gates


@register("recall_gate", BM25_SQL + """, r as (select query_id, id, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s), c as (select query_id, bool_or(id = query_id and rank <= 3) as passed from r group by query_id), g as (select q.query_id, coalesce(passed, false) as passed from q left join c using (query_id))
 select 'recall' as gate, count(*) filter (passed) as passed, count(*) as total, round(count(*) filter (passed) / count(*), 6) as score from g""")
def recall_gate(spark, d):
    """Each stated query should find the document that its words come from."""
    from siltstone.operators import gates
    from siltstone.plans.core import asked, best_lexical

    cases = asked(spark, d).select(F.col("query_id").alias("case_id"), F.array("query_id").alias("expected"))
    card = gates.scorecard({"recall": gates.recall_gate(cases, best_lexical(spark, d, 10).withColumnRenamed("query_id", "case_id"))})
    return card.withColumn("score", F.round("score", 6))


@register("stem_hits")
def stem_hits(spark, d):
    """Whether a turn of a conversation answers with the words of the document that has the conversation's number."""
    from siltstone.functions import stem

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("canonical"))
    cases = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("evidence")).join(docs, "conv_id")
    return stem.hits(cases).select("conv_id", "turn", "hit")
