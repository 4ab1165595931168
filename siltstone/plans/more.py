"""Registered queries: text detectors, duplicates, survival, graphs, episodes, learning, clustering, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import scoring, text
from siltstone.operators import cluster, dedup, extract, graph, learn, lifecycle, maintain, retrieval, weights
from siltstone.plans.core import LISTS_SQL, QUERIES_SQL, _lists, asked
from siltstone.plans.model import AS_OF, MEMORIES, WITH, memories, memories_at, table
from siltstone.plans.registry import register
from siltstone.sources.shared import written

TOKENS_SQL = "list_distinct(list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g')), lambda w: w <> ''))"


def _tokens(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("topic"), F.col("lang"), text.tokens(F.coalesce("text", F.lit(""))).alias("tokens"), F.length(F.coalesce("text", F.lit(""))).alias("size"))


PAIRS_SQL = f"""with t as (select doc_id as id, source as topic, lang, {TOKENS_SQL} as w, length(coalesce(text, '')) as size from documents),
 e as (select id, topic, lang, len(w) as n, unnest(w) as tok from t),
 b as (select a.topic, a.lang, a.id as a, c.id as b, count(*) as k, any_value(a.n) as n, any_value(c.n) as m from e a join e c on a.topic = c.topic and a.lang = c.lang and a.tok = c.tok and a.id < c.id group by all),
 p as (select topic, lang, a, b, k / (n + m - k) as jaccard, k / least(n, m) as containment from b)
"""


@register("similar_pairs", PAIRS_SQL + "select a, b, round(jaccard, 6) as jaccard, round(containment, 6) as containment from p where greatest(jaccard, containment) > 0.6")
def similar_pairs(spark, d):
    p = dedup.pairs(_tokens(spark, d), ["topic", "lang"], 0.6)
    return p.select("a", "b", F.round("jaccard", 6).alias("jaccard"), F.round("containment", 6).alias("containment"))


@register("dedup_bands", PAIRS_SQL + "select a, b, case when jaccard > 0.85 or containment > 0.7 then 'merge' when jaccard > 0.6 or containment >= 0.35 then 'gray_zone' else 'create_new' end as band from p where greatest(jaccard, containment) > 0.3")
def dedup_bands(spark, d):
    p = dedup.pairs(_tokens(spark, d), ["topic", "lang"], 0.3)
    return p.select("a", "b", dedup.band(F.col("containment"), F.col("jaccard"), 0.7).alias("band"))


@register("batch_dedup")
def batch_dedup(spark, d):
    t = _tokens(spark, d)
    return dedup.greedy(dedup.pairs(t, ["topic", "lang"], 0.7), t.select("id", "size"), ["topic", "lang"])


@register("insert_decisions", PAIRS_SQL + """, c as (select b as new_id, a as old_id, greatest(jaccard, containment) as lex, jaccard as vec, (b - a) % 14 as age from p where greatest(jaccard, containment) > 0.3),
 w as (select *, max(vec) over x as best_v, count(*) filter (lex > 0.7) over x as hits, max(lex) over x as best_l from c window x as (partition by new_id)), r as (select *, row_number() over (partition by new_id order by case when best_v > 0.85 and hits < 2 then vec else lex end desc, old_id) as r from w),
 m as (select new_id, list(old_id order by r) filter (lex > 0.7) as many from r group by new_id), o as (select r.*, m.many from r join m using (new_id) where r = 1),
 dec as (select *, case when best_v > 0.85 and hits < 2 then case when age >= 7 then 'supersede' else 'merge_into' end when best_v > 0.60 and best_l < 0.7 then 'gray_zone' when hits >= 2 then case when age >= 7 then 'supersede' else 'merge_into_many' end when hits = 1 then case when age >= 7 then 'supersede' else 'merge_into' end
  when best_l >= case when best_l >= 0.35 and best_l < 0.5 then 0.35 else 0.5 end then case when best_v < 0.50 then 'create_new' else 'gray_zone' end else 'create_new' end as action from o)
 select new_id, action, case action when 'create_new' then '' when 'merge_into_many' then array_to_string(many[1:5], ',') else cast(old_id as varchar) end as targets from dec union all select doc_id, 'create_new', '' from documents where doc_id not in (select new_id from c)""")
def insert_decisions(spark, d):
    t = _tokens(spark, d)
    p = dedup.candidates(t, ["topic", "lang"], 0.3, smaller=True)
    c = p.select(F.col("id").alias("new_id"), F.col("other").alias("old_id"), F.col("sim").alias("lexical"), F.col("jaccard").alias("vector"), ((F.col("id") - F.col("other")) % 14).cast("double").alias("age_days"), F.lit(False).alias("contains"))
    none = t.select(F.col("id").alias("new_id")).join(c.select("new_id"), "new_id", "left_anti")
    out = dedup.decide(c.unionByName(none, allowMissingColumns=True), 0.7)
    return out.withColumn("targets", F.array_join(F.transform("targets", lambda x: x.cast("string")), ","))


STORE_SQL = PAIRS_SQL + f""", mem as ({MEMORIES}), c as (select case when b % 7 = 0 then b else a end as new_id, case when b % 7 = 0 then a else b end as old_id, greatest(jaccard, containment) as lex, jaccard as vec, (b - a) % 14 as age from p where greatest(jaccard, containment) > 0.3 and (a % 7 = 0) <> (b % 7 = 0)),
 w as (select *, max(vec) over x as best_v, count(*) filter (lex > 0.7) over x as hits, max(lex) over x as best_l from c window x as (partition by new_id)), r as (select *, row_number() over (partition by new_id order by case when best_v > 0.85 and hits < 2 then vec else lex end desc, old_id) as r from w),
 m as (select new_id, list(old_id order by r) filter (lex > 0.7) as many from r group by new_id), o as (select r.*, m.many from r join m using (new_id) where r = 1),
 dec as (select *, case when best_v > 0.85 and hits < 2 then case when age >= 7 then 'supersede' else 'merge_into' end when best_v > 0.60 and best_l < 0.7 then 'gray_zone' when hits >= 2 then case when age >= 7 then 'supersede' else 'merge_into_many' end when hits = 1 then case when age >= 7 then 'supersede' else 'merge_into' end
  when best_l >= case when best_l >= 0.35 and best_l < 0.5 then 0.35 else 0.5 end then case when best_v < 0.50 then 'create_new' else 'gray_zone' end else 'create_new' end as action from o),
 dn as (select new_id, action, case action when 'create_new' then [] when 'merge_into_many' then many[1:5] else [old_id] end as targets from dec union all select id, 'create_new', [] from mem where id % 7 = 0 and id not in (select new_id from c)),
 mg as (select new_id, targets[1] as w, targets[2:] as others from dn where action in ('merge_into', 'merge_into_many')), ls as (select w, new_id as loser, true as fresh from mg union select w, unnest(others), false from mg),
 fd as (select w, sum(access_count + 1) as more from ls join mem on mem.id = loser group by w), gone as (select loser as id, w as win, 'updated' as st from ls where not fresh union all select targets[1], new_id, 'deprecated' from dn where action = 'supersede'), g as (select id, min(win) as win, arg_min(st, win) as st from gone group by id)
 select 'row' as kind, mem.id, coalesce(g.win, superseded_by) as other, coalesce(g.st, status) as state, cast(access_count + coalesce(more, 0) as bigint) as n from mem left join fd on fd.w = mem.id left join g on g.id = mem.id where mem.id % 7 <> 0
 union all select 'row', id, superseded_by, status, access_count from mem where id % 7 = 0 and id not in (select new_id from mg) union all select 'ledger', new_id, targets[1], action, len(targets) from dn union all select 'outbox', new_id, targets[1], 'pending', null from dn where action = 'gray_zone'"""


@register("store_flow", STORE_SQL)
def store_flow(spark, d):
    """Rows whose id is divisible by 7 come in: their candidates among the stored rows, the decisions, and the store, its
    ledger and its outbox afterwards."""
    from siltstone.operators import store

    m = memories_at(spark, d).withColumn("keywords", F.array("topic"))
    fresh = F.col("id") % 7 == 0
    p = dedup.candidates(_tokens(spark, d), ["topic", "lang"], 0.3, fresh, ~fresh)
    c = p.select(F.col("id").alias("new_id"), F.col("other").alias("old_id"), F.col("sim").alias("lexical"), F.col("jaccard").alias("vector"), (F.abs(F.col("id") - F.col("other")) % 14).cast("double").alias("age_days"), F.lit(False).alias("contains"))
    none = m.filter("id % 7 = 0").select(F.col("id").alias("new_id")).join(c.select("new_id"), "new_id", "left_anti")
    decisions = written(dedup.decide(c.unionByName(none, allowMissingColumns=True), 0.7), "decisions")
    rows, ledger, outbox = store.store(m.filter("id % 7 <> 0"), m.filter("id % 7 = 0"), decisions, AS_OF)
    out = rows.select(F.lit("row").alias("kind"), "id", F.col("superseded_by").alias("other"), F.col("status").alias("state"), F.col("access_count").cast("long").alias("n"))
    out = out.unionByName(ledger.select(F.lit("ledger").alias("kind"), F.col("new_id").alias("id"), F.get("targets", 0).alias("other"), F.col("action").alias("state"), F.size("targets").cast("long").alias("n")))
    return out.unionByName(outbox.select(F.lit("outbox").alias("kind"), F.col("new_id").alias("id"), F.col("old_id").alias("other"), F.col("status").alias("state"), F.lit(None).cast("long").alias("n")))


@register("threshold_sweep", PAIRS_SQL + ", l as (select greatest(jaccard, containment) as sim, jaccard > 0.7 as dup from p where greatest(jaccard, containment) > 0.3), th as (select unnest(range(30, 100, 5)) / 100 as theta), c as (select theta, count(*) filter (sim > theta and dup) as tp, count(*) filter (sim > theta and not dup) as fp, count(*) filter (sim <= theta and not dup) as tn, count(*) filter (sim <= theta and dup) as fn from l, th group by theta) select theta, tp, fp, tn, fn, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision, round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as recall from c")
def threshold_sweep(spark, d):
    s = dedup.sweep(dedup.tallied(_tokens(spark, d), ["topic", "lang"], 0.3, 0.7, dedup.thetas()))
    return s.select("theta", "tp", "fp", "tn", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@register("duplicate_components", PAIRS_SQL.replace("with ", "with recursive ", 1) + ", l as (select a, b from p where greatest(jaccard, containment) > 0.7), u as (select a, b from l union select b, a from l), r(id, x) as (select a, a from u union select r.id, u.b from r join u on u.a = r.x) select id, min(x) as root from r group by id")
def duplicate_components(spark, d):
    return dedup.components(dedup.pairs(_tokens(spark, d), ["topic", "lang"], 0.7).select("a", "b"))


@register("novelty", f"""with t as (select doc_id as id, {TOKENS_SQL} as w from documents), b as (select item_id as o, list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: w <> '')) as w from benchmark),
 s as (select t.id, len(list_intersect(t.w, b.w)) as k, len(t.w) as n, len(b.w) as m from t, b) select id, round(1 - max(case when k = 0 then 0 else greatest(k / (n + m - k), k / least(n, m)) end), 6) as novelty from s group by id""")
def novelty(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), text.tokens(F.col("text")).alias("tokens"))
    return dedup.novelty(_tokens(spark, d), b).select("id", F.round("novelty", 6).alias("novelty"))


@register("novel_lines", """with p as (select a.doc_id as id, string_split(coalesce(a.text, ''), chr(10)) as s, list_transform(string_split(lower(coalesce(b.text, '')), chr(10)), lambda x: trim(x)) as t from documents a join documents b on b.doc_id = a.doc_id + 1)
 select id, array_to_string(list_filter(list_transform(s, lambda x: trim(x)), lambda x: x <> '' and not starts_with(lower(x), '[merged') and not list_contains(t, lower(x))), '|') as lines from p""")
def novel_lines(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("s"))
    b = a.select((F.col("id") - 1).alias("id"), F.col("s").alias("t"))
    return a.join(b, "id").select("id", F.array_join(text.novel_lines(F.col("s"), F.col("t")), "|").alias("lines"))


@register("admission_score", WITH + "select id, round(case when strength < 0.05 then 0.0 else 0.45 * strength + 0.25 * (1 - strength) + 0.15 * 0.7 + 0.15 * 0.7 - cluster_id * 0.01 end, 6) as score, case when 0.45 * strength + 0.25 * (1 - strength) + 0.21 - cluster_id * 0.01 >= 0.4 - 1e-9 and strength >= 0.05 then true else false end as admitted from memories")
def admission_score(spark, d):
    s = scoring.admission(F.col("strength"), 1 - F.col("strength"), F.lit(0.7), F.col("cluster_id") * 0.01)
    return memories(spark, d).select("id", F.round(s, 6).alias("score"), (s >= 0.4 - 1e-9).alias("admitted"))


# survival and lifecycle

KM_SQL = """with i as (select user_id, extract(epoch from (coalesce(lead(ts) over w, timestamp '2024-03-01') - ts)) / 86400.0 as t, lead(ts) over w is not null as e from events window w as (partition by user_id order by ts, event_id)),
 k as (select user_id % 5 as g, floor(t * 4) / 4 as t, e from i), c as (select g, t, count(*) as n, count(*) filter (e) as d from k group by all), r as (select *, cast(sum(n) over (partition by g order by t rows between current row and unbounded following) as bigint) as risk from c),
 s as (select g, t, risk, d, max(case when d = risk then 1 else 0 end) over w as dead, exp(sum(case when d < risk then ln(1 - d / risk) else 0 end) over w) as s from r where d > 0 window w as (partition by g order by t))"""


def _curve(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", "event_id")
    i = lifecycle.lag_intervals(e.withColumn("ts", F.col("ts").cast("timestamp")), AS_OF)
    i = i.select((F.col("id") % 5).alias("g"), (F.floor(F.col("days") * 4) / 4).alias("days"), "event")
    return lifecycle.kaplan_meier(i, ["g"])


@register("km_curve", KM_SQL + " select g, t, risk as at_risk, d as events, round(case when dead = 1 then 0.0 else s end, 6) as survival from s")
def km_curve(spark, d):
    return _curve(spark, d).withColumn("survival", F.round("survival", 6))


@register("km_median", KM_SQL + " select g, min(case when (case when dead = 1 then 0.0 else s end) <= 0.5 then t end) as median from s group by g")
def km_median(spark, d):
    return lifecycle.median_survival(_curve(spark, d), ["g"])


@register("summary_intervals", WITH + """, r as (select id, age_hours / 24.0 as age, floor(age_hours / 3.0) / 24.0 as idle, access_count as n from memories)
 select id, round((age - idle) / n, 6) as days, true as event, cast(least(n, 20) as bigint) as copies from r where n > 1 or (n = 1 and age - idle > 0.01) union all select id, round(case when n = 0 then age else idle end, 6), false, 1 from r""")
def summary_intervals(spark, d):
    r = memories(spark, d).select("id", (F.col("age_hours") / 24).alias("age_days"), (F.floor(F.col("age_hours") / 3) / 24).alias("idle_days"), "access_count")
    return lifecycle.summary_intervals(r).groupBy("id", F.round("days", 6).alias("days"), "event").agg(F.count("*").alias("copies"))


@register("prune_rows", WITH + "select id from memories where layer = 'stm' and strength < 0.3 and importance not in ('critical', 'high')")
def prune_rows(spark, d):
    return lifecycle.prunable(memories(spark, d), 0.3).select("id")


@register("gc_preview", WITH + "select id from memories where layer = 'stm' and importance not in ('critical', 'high') and age_hours >= 3 and exp(-decay_lambda / (1 + 0.2 * access_count) * power(floor(age_hours / 3.0) / 24.0, 1.2)) < 0.4")
def gc_preview(spark, d):
    return lifecycle.garbage(memories_at(spark, d), AS_OF, 0.4).select("id")


@register("promotion", WITH + ", h as (select user_id as id, count(*) as n from events group by user_id) select m.id, cast(access_count + coalesce(h.n, 0) as int) as access_count, case when layer = 'stm' and access_count + coalesce(h.n, 0) > 5 then 'ltm' else layer end as layer from memories m left join h using (id)")
def promotion(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), "ts")
    return lifecycle.promoted(memories(spark, d), e).select("id", "access_count", "layer")


@register("tier_migrations", """with p as (select user_id as id, event_id as k, case when value >= 60 then 'hot' when value < 20 then 'cold' else 'warm' end as t from events), l as (select *, lag(t) over w as a, lag(t, 2) over w as b from p window w as (partition by id order by k)) select id, k as at, t as tier from l where t = a and (b is null or b <> t)""")
def tier_migrations(spark, d):
    p = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.when(F.col("value") >= 60, "hot").when(F.col("value") < 20, "cold").otherwise("warm").alias("proposed"))
    return lifecycle.migrations(p)


# graphs

EDGES_SQL = """with recursive e as (select 'r' || r_regionkey as s, 'n' || n_nationkey as t from nation join region on n_regionkey = r_regionkey union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'n' || s_nationkey, 's' || s_suppkey from supplier union all select 'c' || o_custkey, 'o' || o_orderkey from orders)"""


def _edges(spark, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [table(spark, d, "nation").select(key("r", "n_regionkey").alias("source"), key("n", "n_nationkey").alias("target")), table(spark, d, "customer").select(key("n", "c_nationkey").alias("source"), key("c", "c_custkey").alias("target"))]
    parts += [table(spark, d, "supplier").select(key("n", "s_nationkey").alias("source"), key("s", "s_suppkey").alias("target")), table(spark, d, "orders").select(key("c", "o_custkey").alias("source"), key("o", "o_orderkey").alias("target"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("graph_bfs", EDGES_SQL + ", b(id, depth) as (select 'r2', 0 union select e.t, depth + 1 from b join e on e.s = b.id where depth < 3) select id, cast(min(depth) as int) as depth, round(1 / (1 + min(depth)), 6) as score from b group by id")
def graph_bfs(spark, d):
    return graph.bfs(_edges(spark, d), spark.sql("select 'r2' as id"), 3).withColumn("score", F.round("score", 6))


@register("neighborhood", EDGES_SQL + ", u as (select s, t from e union all select t, s from e), b(id, depth) as (select 'n3', 0 union select u.t, depth + 1 from b join u on u.s = b.id where depth < 2) select id, cast(min(depth) as int) as depth from b group by id")
def neighborhood(spark, d):
    return graph.neighborhood(_edges(spark, d), spark.sql("select 'n3' as id"), 2)[0].select("id", "depth")


@register("valid_links", "select o_orderkey as id from orders where o_orderdate <= timestamp '1996-01-01' and (o_orderstatus <> 'F' or o_orderdate + interval 400 day >= timestamp '1996-01-01')")
def valid_links(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    links = o.select("o_orderkey", F.col("o_orderdate").alias("valid_from"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("interval 400 days")).alias("valid_until"))
    return graph.valid_at(links, "1996-01-01").select(F.col("o_orderkey").alias("id"))


@register("asof_revision", "select o_custkey as id, revision, o_orderkey as value from (select *, row_number() over (partition by o_custkey order by revision desc) as r from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as revision from orders) where o_orderdate <= timestamp '1996-06-01') where r = 1")
def asof_revision(spark, d):
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderkey").alias("value"))
    rev = o.withColumn("revision", F.row_number().over(W.partitionBy("id").orderBy("created_at", "value")).cast("long"))
    return graph.as_of(rev, "1996-06-01").select("id", "revision", "value")


@register("concept_dedup", "with c as (select p_partkey as id, p_brand as memoir, trim(regexp_replace(lower(trim(p_type)), '[_\\s-]+', '-', 'g'), '-') as k, p_type as name from part) select memoir, min(id) as id, arg_min(name, id) as name, count(*) as n_sources from c group by memoir, k")
def concept_dedup(spark, d):
    c = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("memoir"), F.col("p_type").alias("name"), F.lit("").alias("definition"), F.array("p_partkey").alias("source_memory_ids"), F.lit(0).alias("created_at"))
    kept, _ = graph.dedup_concepts(c, spark.createDataFrame([], "source long, target long, relation string, weight double"))
    return kept.select("memoir", "id", "name", F.size("source_memory_ids").cast("long").alias("n_sources"))


@register("array_membership_join", LISTS_SQL + ", r as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as k from l where channel = 'fts'), c as (select doc_id as id, unnest([doc_id, doc_id + 1, doc_id + 2]) as m from documents) select query_id, m as id, round(max(1.0 / k), 6) as score from r join c using (id) group by all")
def array_membership_join(spark, d):
    hits = retrieval.ranked(_lists(spark, d).filter("channel = 'fts'")).select("query_id", "id", "rank")
    c = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array("doc_id", F.col("doc_id") + 1, F.col("doc_id") + 2).alias("source_memory_ids"))
    return graph.concept_scores(hits, c).withColumn("score", F.round("score", 6))


@register("episode_rank", """with e as (select conv_id as id, string_agg(text, ' ' order by turn) as title, string_agg(role, ' ' order by turn) as tags, count(*) as n from conversations group by conv_id), h as (select *, case when contains(lower(title), 'the that') then 3.0 else 0 end + case when contains(lower(title), 'the') then 0.9 else 0 end + case when contains(lower(title), 'that') then 0.9 else 0 end
 + case when contains(lower(tags), 'the that') then 1.2 else 0 end + case when contains(lower(tags), 'the') then 0.4 else 0 end + case when contains(lower(tags), 'that') then 0.4 else 0 end as h from e) select id, round(h + 0.3 / (1 + (id % 90) / 30.0) + 0.1 * least(n, 5), 6) as score from h where h > 0""")
def episode_rank(spark, d):
    c = table(spark, d, "conversations")
    join = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", x))), lambda s: s[x]), " ")
    e = c.groupBy(F.col("conv_id").alias("id")).agg(join("text").alias("title"), join("role").alias("tags"), F.count("*").alias("n_memories")).withColumn("n_concepts", F.lit(0))
    return graph.episode_scores(e, "The that", F.col("id") % 90, ("title", "tags")).select("id", F.round("score", 6).alias("score"))


@register("timeline_union", "select * from (select 'event' as kind, event_id as id, ts from events union all select 'order' as kind, o_orderkey, o_orderdate from orders) order by ts desc, kind, id limit 200")
def timeline_union(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "ts")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))
    return graph.timeline({"event": e, "order": o}, 200).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("graph_export", """select 'digraph {' || chr(10) || string_agg('  "' || n_regionkey || '" -> "' || n_nationkey || '" [label="holds"];', chr(10) order by '  "' || n_regionkey || '" -> "' || n_nationkey || '" [label="holds"];') || chr(10) || '}' as text from nation""")
def graph_export(spark, d):
    n = table(spark, d, "nation")
    return graph.exported(n.select("n_nationkey", "n_name"), n.select(F.col("n_regionkey").alias("source"), F.col("n_nationkey").alias("target"), F.lit("holds").alias("relation")), "dot")


# learning


@register("band_join", "select r.event_id as recall_id, f.event_id as feedback_id from events r join events f on r.user_id = f.user_id and r.event_type = 'view' and f.event_type = 'click' and abs(epoch_us(r.ts) - epoch_us(f.ts)) < 3600000000")
def band_join(spark, d):
    e = table(spark, d, "events").withColumn("request", F.lit(None).cast("string"))
    r = e.filter("event_type = 'view'").select(F.col("event_id").alias("recall_id"), F.col("user_id").alias("user"), "ts", "request")
    f = e.filter("event_type = 'click'").select(F.col("event_id").alias("feedback_id"), F.col("user_id").alias("user"), "ts", "request")
    return learn.correlated(r, f, 3600)


@register("co_recall_pairs", "with x as (select distinct l_orderkey as r, l_suppkey as id from lineitem) select a.id as a, b.id as b, count(*) as n from x a join x b on a.r = b.r and a.id < b.id group by all")
def co_recall_pairs(spark, d):
    return learn.co_recalled(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_suppkey").alias("id")))


@register("tie_averaged_rr", "select g, id, round(avg(1.0 / r) over (partition by g, s), 6) as rr from (select p_brand as g, p_partkey as id, p_size as s, row_number() over (partition by p_brand order by p_size desc, p_partkey) as r from part)")
def tie_averaged_rr(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("id"), F.col("p_size").alias("score"))
    return learn.tie_averaged_rr(p, ["g"]).select("g", "id", F.round("rr", 6).alias("rr"))


#: Every order is an event, and its lines are the candidates.
EVENTS_SQL = "with c as (select l_orderkey as event, (l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey as id, l_quantity / 50.0 as b, l_discount * 10 as v, case when l_returnflag = 'R' then 1 when l_returnflag = 'A' then -1 else 0 end as y from lineitem)"


def _events(spark, d):
    y = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -1).otherwise(0)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("id"), (F.col("l_quantity") / 50).alias("bm25"), (F.col("l_discount") * 10).alias("vec"), F.lit(0.0).alias("rest"), y.alias("label"))


@register("alpha_rewards", EVENTS_SQL + """, a as (select unnest(range(0, 21)) / 20 as alpha), s as (select *, row_number() over (partition by event, alpha order by round(alpha * b + (1 - alpha) * v, 12) desc, id) as r from c, a) select event, alpha, round(sum(y / r), 6) as reward from s group by all""")
def alpha_rewards(spark, d):
    return learn.alpha_rewards(_events(spark, d), [i / 20 for i in range(21)]).withColumn("reward", F.round("reward", 6))


@register("best_alpha", EVENTS_SQL + """, a as (select unnest(range(0, 21)) / 20 as alpha), s as (select *, row_number() over (partition by event, alpha order by round(alpha * b + (1 - alpha) * v, 12) desc, id) as r from c, a),
 g as (select event, alpha, round(sum(y / r), 12) as reward from s group by all), t as (select event, max(reward) as top, min(reward) as low from g group by event), m as (select event, top, min(alpha) as alpha from t join g using (event) where reward = top and top > low group by all),
 f as (select m.event, m.top, m.alpha as a0, greatest(m.alpha - 0.05, 0.0) + (least(m.alpha + 0.05, 1.0) - greatest(m.alpha - 0.05, 0.0)) * i / 10 as alpha from m, (select unnest(range(0, 11)) as i)), fs as (select f.*, id, y, row_number() over (partition by f.event, f.alpha order by round(f.alpha * b + (1 - f.alpha) * v, 12) desc, id) as r from f join c using (event)),
 fg as (select event, top, a0, alpha, round(sum(y / r), 12) as reward from fs group by all), ft as (select event, max(reward) as best from fg group by event) select event, round(case when best > top then min(alpha) filter (reward = best) else any_value(a0) end, 6) as alpha, round(greatest(best, top), 6) as reward from fg join ft using (event) group by event, best, top""")
def best_alpha(spark, d):
    return learn.best_alpha(_events(spark, d)).select("event", F.round("alpha", 6).alias("alpha"), F.round("reward", 6).alias("reward"))


@register("decayed_mean", "with e as (select event_type, value, exp(-0.06 * extract(epoch from (timestamp '2024-03-01' - ts)) / 86400.0) as w from events) select event_type as type, round(sum(value * w) / sum(w), 5) as mean from e group by event_type")
def decayed_mean(spark, d):
    w = learn.event_weight(scoring.days(F.lit(AS_OF), F.col("ts").cast("timestamp")))
    return table(spark, d, "events").groupBy(F.col("event_type").alias("type")).agg(F.round(learn.weighted_mean(F.col("value"), w), 5).alias("mean"))


BUCKETS_SQL = """with e as (select event_type as t, cast(user_id % 4 as int) as c, value / 100 as a, 1.0 + user_id % 3 as w from events), g as (select sum(a * w) / sum(w) as m, count(*) as n from e), g2 as (select n, (n * m + 5 * 0.5) / (n + 5) as a from g),
 t as (select t, count(*) as n, sum(a * w) / sum(w) as m from e group by t), t2 as (select t, t.n, (t.n * m + 5 * g2.a) / (t.n + 5) as a from t, g2), l as (select t, c, count(*) as n, sum(a * w) / sum(w) as m from e group by t, c), l2 as (select l.t, l.c, l.n, (l.n * l.m + 5 * t2.a) / (l.n + 5) as a from l join t2 using (t))"""


@register("alpha_buckets", BUCKETS_SQL + " select null as type, null as cluster, n, round(a, 6) as alpha from g2 union all select t, null, n, round(a, 6) from t2 union all select t, c, n, round(a, 6) from l2")
def alpha_buckets(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("type"), (F.col("user_id") % 4).cast("int").alias("cluster"), (F.col("value") / 100).alias("alpha"), (1.0 + F.col("user_id") % 3).alias("weight"))
    return learn.buckets(e).withColumn("alpha", F.round("alpha", 6))


@register("family_mean", "select round(avg(m), 6) as value, count(*) as families from (select c_nationkey, avg(c_acctbal) as m from customer group by c_nationkey)")
def family_mean(spark, d):
    return learn.family_mean(table(spark, d, "customer"), "c_nationkey", "c_acctbal").withColumn("value", F.round("value", 6))


@register("settled_prefix", "with b as (select min(event_id) as b from events where event_type = 'error' and value > 90) select event_id as id from events, b where b is null or event_id < b")
def settled_prefix(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), (~((F.col("event_type") == "error") & (F.col("value") > 90))).alias("settled"))
    return learn.settled_prefix(e).select("id")


@register("simplex_search")
def simplex_search(spark, d):
    y = F.when(F.col("l_returnflag") == "R", 1.0).when(F.col("l_returnflag") == "A", -1.0).otherwise(0.0)
    features = F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_extendedprice") / 100000, F.col("l_linenumber") / 7, F.col("l_suppkey") % 10 / 10)
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("id"), features.alias("features"), y.alias("label"))
    return weights.best_weights(c)


# clustering, extraction, streams


@register("hdbscan")
def hdbscan(spark, d):
    return cluster.clusters(table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "embedding"), 5, 5)


@register("hdbscan_blocks")
def hdbscan_blocks(spark, d):
    """The same in blocks, as more vectors than fit one task are clustered."""
    from siltstone.operators import density

    found = density.clusters(table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "embedding"), 5, 5)
    return found.select("id", F.when(F.col("label") >= 0, F.col("label")).alias("cluster_id"))


ASKED = "('What changed last week?'), ('which editor do i prefer'), ('what did we decide in spring'), ('foo_bar.rs'), ('how does the cache work with threads'), ('recent work'), ('what happened in the session'), ('tell me about the storage layer'), ('redis cache'), ('timeline of 2024-01-05'), ('open \"the file\" that we wrote'), ('我喜欢的编辑器'), ('总结 the whole storage layer design'), ('数据库'), ('why rust'), ('this month in the parser')"


def _phrases(column: str, phrases, words: bool = False) -> str:
    if words:
        return "(" + " or ".join(f"regexp_matches({column}, '(^|[^\\p{{L}}\\p{{N}}_]){p}($|[^\\p{{L}}\\p{{N}}_])')" if p.isascii() else f"contains({column}, '{p}')" for p in phrases) + ")"
    return "(" + " or ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


def _classes_sql() -> str:
    low, x = "low", extract
    episodic = f"({_phrases(low, x.EPISODIC)} or contains(low, 'what happened') and (contains(low, 'meeting') or contains(low, 'session')))"
    temporal = f"({_phrases(low, x.TEMPORAL, True)} or {_phrases(low, x.TEMPORAL_CJK)} or regexp_matches(low, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'))"
    asks = " or ".join(f"starts_with(low, '{p}')" for p in x.NOT_KEYWORDS)
    code = r"len(list_filter(ws, lambda w: contains(w, '_') or (strlen(w) > 2 and regexp_matches(w, '\p{Lu}') and regexp_matches(w, '\p{Ll}'))))"
    exact = f"case when regexp_matches(q, '[{text.CJK}]') then ceil(length(regexp_replace(q, '[^{text.CJK}]', '', 'g')) / 2.0) <= 3 and not {_phrases(low, x.QUESTIONS_CJK)} else (n <= 3 and strlen(q) < n * 15 and not ({asks})) or contains(q, '::') or contains(q, '.rs') or starts_with(low, 'fn ') or starts_with(low, 'struct ') or (n <= 4 and {code} > 0 and {code} >= n // 2) or contains(q, chr(34)) or contains(q, chr(96)) end"
    far = " or ".join(f"(contains(low, '{p}') and strlen(low) > {len(p.encode()) + 6})" for p in x.EXPLORATORY_CJK)
    days = " ".join(f"when {_phrases(low, p, True)} then {k}" for p, k in x.RELATIVE_DAYS)
    return f"""with t as (select *, lower(q) as low, list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '') as ws from asked), u as (select *, len(ws) as n from t),
 k as (select *, case when {episodic} then 'episodic' when {temporal} then 'temporal' when {_phrases(low, x.PREFERENCE)} then 'preference' when {exact} then 'exact' when {_phrases(low, x.EXPLORATORY)} or {far} then 'exploratory' else 'semantic' end as type from u)
 select q, count(*) as n, type, cast(case type when 'episodic' then 0.5 when 'temporal' then 0.7 when 'preference' then 0.4 when 'exact' then 0.85 when 'exploratory' then 0.5 else 0.3 end as double) as alpha,
  cast(case when type = 'temporal' and {_phrases(low, x.RELATIVE, True)} then case {days} else 30 end end as int) as days_back from k group by all"""


@register("query_classes", f"with asked as (select q from (values {ASKED}) t(q) union all select coalesce(text, '') from conversations) select * from ({_classes_sql()})")
def query_classes(spark, d):
    q = spark.sql(f"select * from values {ASKED} as t(q)").unionByName(table(spark, d, "conversations").select(F.coalesce("text", F.lit("")).alias("q")))
    return q.groupBy("q").agg(F.count("*").alias("n")).select("q", "n", extract.classify(F.col("q")).alias("c")).select("q", "n", "c.type", "c.alpha", "c.days_back")


def _episodes(spark, d):
    """A conversation is an episode of the document that has its number, and of the concept after it."""
    c = table(spark, d, "conversations")
    join = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", x))), lambda s: s[x]), " ")
    e = c.groupBy(F.col("conv_id").alias("id")).agg(join("text").alias("title"), join("role").alias("tags"), F.count("*").alias("n_memories")).withColumn("n_concepts", F.lit(1))
    return e.withColumn("age_days", F.col("id") % 90).withColumn("memory_ids", F.array("id")).withColumn("concept_ids", F.array(F.col("id") + 1))


def _concepts(spark, d):
    """Every document is a concept, named by its first words, of itself and the next one."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(F.slice(words, 1, 4), " ").alias("name"), F.lit("").alias("definition"), F.col("source").alias("labels"), F.array("doc_id", F.col("doc_id") + 1).alias("source_memory_ids"))


def _related(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array(F.col("doc_id") + 2).alias("related_ids"))


@register("episode_channel", f"""with q as (select query_id, 'what happened in the session ' || query as q from ({QUERIES_SQL})), e as (select conv_id as id, lower(string_agg(text, ' ' order by turn)) as title, lower(string_agg(role, ' ' order by turn)) as tags, count(*) as n from conversations group by conv_id),
 p as (select query_id, trim(q) as p, 3.0 as wt, 1.2 as wg from q union all select query_id, w, 0.9, 0.4 from (select distinct query_id, unnest(string_split(trim(q), ' ')) as w from q) where strlen(w) >= 2),
 h as (select query_id, id, n, sum(case when contains(title, p) then wt else 0 end + case when contains(tags, p) then wg else 0 end) as h from p, e group by all having h > 0),
 s as (select query_id, id, h + 0.3 / (1 + (id % 90) / 30.0) + 0.1 * least(n, 5) + 0.08 as score from h),
 o as (select query_id, id, score from s union all select query_id, s.id + 2, 0.65 * score from s join documents on doc_id = s.id union all select query_id, unnest([s.id + 1, s.id + 2]), 0.85 * score from s join documents on doc_id = s.id + 1)
 select query_id, id, round(max(score), 6) as score from o group by all""")
def episode_channel(spark, d):
    q = asked(spark, d).withColumn("query", F.concat(F.lit("what happened in the session "), "query"))
    e = _episodes(spark, d)
    out = graph.episode_lists(q, e, ("title", "tags"), _concepts(spark, d), _related(spark, d))
    return out.select("query_id", "id", F.round("score", 6).alias("score"))


def _channels(spark, d):
    """All four channels: documents are concepts, each linked with the tenth after it; conversations are episodes."""
    from siltstone.operators import recall as r

    lists = _lists(spark, d)
    one = lambda name: lists.filter(F.col("channel") == name).select("query_id", "id", "score")
    concepts, e = _concepts(spark, d), _episodes(spark, d)
    links = concepts.select(F.col("id").alias("source"), (F.col("id") + 10).alias("target"))
    q = asked(spark, d).withColumn("query_id", F.col("query_id").cast("int"))
    episodes = graph.episode_lists(r.asking_episodes(q), e, ("title", "tags"), concepts, _related(spark, d))
    return r.channels(q, one("fts"), one("vec"), concepts, links, episodes)


@register("recall")
def recall(spark, d):
    from siltstone.operators import recall as r

    return r.recall(asked(spark, d), memories_at(spark, d), _channels(spark, d), AS_OF, r.Recall(bypass=True))


@register("recall_diverse")
def recall_diverse(spark, d):
    from siltstone.operators import recall as r
    from siltstone.operators.weights import DEFAULT

    weights = tuple(zip(("bm25", "vec", "kg", "episode", "support", "diversity"), DEFAULT, strict=True))
    return r.recall(asked(spark, d), memories_at(spark, d), _channels(spark, d), AS_OF, r.Recall(limit=5, mode="cc", mmr_lambda=0.7, weights=weights, adoption=0.2))


@register("recall_preview")
def recall_preview(spark, d):
    from siltstone.operators import recall as r

    return r.recall(asked(spark, d), memories_at(spark, d), _channels(spark, d), AS_OF, r.Recall(preview=2)).withColumn("preview", F.array_join("preview", "|"))


@register("query_expansion")
def query_expansion(spark, d):
    from siltstone.operators import recall as r

    q = asked(spark, d)
    variants = q.select("query_id", F.array("query", F.concat("query", F.lit(" again")), F.concat(F.lit("what of "), "query"), F.lit("something else")).alias("variants"))
    return r.expanded(q, variants)


#: What turns of conversations say besides, by conversation: alike facts, others, and none.
SAID = {0: ". We decided to use the blue cache for it. We decided to use the blue cache for this. The fixed bug was a crash in the parser.", 1: ". The design uses a framework! Nothing else."}


def _facts_sql() -> str:
    said = " ".join(f"when {k} then '{v}'" for k, v in SAID.items())
    score = " + ".join("case when " + " or ".join(f"contains(lower(fact), '{w}')" for w in ws) + f" then {n} else 0 end" for ws, n in extract.SIGNALS)
    tokens = r"list_distinct(list_filter(list_transform(regexp_split_to_array(lower(fact), '\s+'), lambda w: regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')), lambda w: w <> ''))"
    both = "len(list_intersect(a.t, b.t)) * 1.0"
    return rf"""with x as (select conv_id * 1000 + turn as id, coalesce(text, '') || case conv_id % 3 {said} else '' end as t from conversations),
 s as (select id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '([.!?])(\s|$)', '\1' || chr(1) || '\2', 'g'), '\n([ \t\r]*\n)', chr(10) || chr(1) || '\1', 'g'), chr(1)), lambda v: regexp_replace(v, '^\s+|\s+$', '', 'g')), lambda v: v <> '') as v from x),
 f as (select id, unnest(v) as fact, cast(generate_subscripts(v, 1) - 1 as int) as position from s), c as (select *, cast({score} as int) as score, {tokens} as t from f), k as (select * from c where score >= 3 and strlen(fact) <= 10000)
 select id, position, fact, score from k b where not exists (select 1 from k a where a.id = b.id and a.position < b.position and len(a.t) > 0 and len(b.t) > 0 and greatest({both} / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), {both} / least(len(a.t), len(b.t))) > 0.6)"""


@register("sentence_facts", _facts_sql())
def sentence_facts(spark, d):
    said = F.lit("")
    for k, v in SAID.items():
        said = F.when(F.col("conv_id") % 3 == k, v).otherwise(said)
    return extract.facts(table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.coalesce("text", F.lit("")), said).alias("content")))


@register("chunks")
def chunks(spark, d):
    return extract.chunked(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@register("triples")
def triples(spark, d):
    return extract.triples(table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("text").alias("content")))


def _event_stream(spark, d):
    return spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*.parquet")


def _stream_root(spark):
    """A folder for a stream's state and output; it goes at exit."""
    from siltstone.sources.shared import scratch

    return scratch(spark, "stream")


@register("event_counters", "select user_id, count(*) filter (event_type = 'view') as views, count(*) filter (event_type = 'click') as clicks, max(event_id) as last_id from events group by user_id")
def event_counters(spark, d):
    from siltstone.streaming import events as st

    root, stream = _stream_root(spark), _event_stream(spark, d)
    fold = st.counter_fold(f"{root}/state", ["user_id"], {"views": "event_type = 'view'", "clicks": "event_type = 'click'"})
    st.consume(stream, fold, f"{root}/checkpoint").awaitTermination()
    return st.versioned(f"{root}/state")(spark)


@register("concept_buckets", """with e as (select cast(user_id % 16 as varchar) as owner, event_id, case event_type when 'purchase' then 'up' when 'error' then 'down' when 'signup' then 'requery' else event_type end as kind,
  (user_id % 7) || case when value < 50 then ':exact' else ':semantic' end as bucket, case when event_id % 3 = 0 then (user_id % 5) || ':temporal' end as route, cast(floor(value * 100) as bigint) as dwell from events),
 b as (select owner, bucket, false as shadow, event_id, kind, dwell from e union all select owner, route, true, event_id, kind, dwell from e where route is not null and route <> bucket),
 d as (select owner, bucket, dwell, row_number() over (partition by owner, bucket order by event_id desc) as r from b where kind = 'view'),
 p as (select owner, bucket, count(*) as dwells, avg(case when dwell > 3000 then 1.0 else 0.0 end) as far, cast(floor(quantile_cont(dwell, 0.5) + 0.5) as bigint) as dwell_p50 from d where r <= 500 group by all),
 c as (select owner, bucket, bool_and(shadow) as shadow, max(event_id) as last, count(*) filter (kind = 'view') as views, count(*) filter (kind = 'click') as clicks, count(*) filter (kind = 'up') as up, count(*) filter (kind = 'down') as down, count(*) filter (kind = 'requery') as requeries from b group by all)
 select owner, bucket, shadow, last, views, clicks, up, down, requeries, cast(coalesce(dwells, 0) as int) as dwells, dwell_p50,
  round(least(1.0, greatest(0.0, (coalesce(far, 0) + 0.5 * clicks / greatest(views, 1) + 2.0 * up / (up + down + 1) - 2.0 * requeries / greatest(views, 1)) / 5.5)), 6) as useful_rate from c left join p using (owner, bucket)""")
def concept_buckets(spark, d):
    from siltstone.streaming import keyed

    kind = F.when(F.col("event_type") == "purchase", "up").when(F.col("event_type") == "error", "down").when(F.col("event_type") == "signup", "requery").otherwise(F.col("event_type"))
    bucket = F.concat((F.col("user_id") % 7).cast("string"), F.when(F.col("value") < 50, ":exact").otherwise(":semantic"))
    route = F.when(F.col("event_id") % 3 == 0, F.concat((F.col("user_id") % 5).cast("string"), F.lit(":temporal")))
    events = _event_stream(spark, d).select((F.col("user_id") % 16).cast("string").alias("owner"), "event_id", kind.alias("kind"), bucket.alias("bucket"), route.alias("route"), F.floor(F.col("value") * 100).alias("dwell"), F.lit(None).cast("boolean").alias("hit"))
    root = _stream_root(spark)
    found = keyed.rates(keyed.current(keyed.drained(keyed.bucket_counters(events), f"{root}/out", f"{root}/checkpoint")))
    return found.select("owner", "bucket", "shadow", "last", "views", "clicks", "up", "down", "requeries", F.size("dwells").alias("dwells"), "dwell_p50", F.round("useful_rate", 6).alias("useful_rate"))


# maintenance


@register("topic_groups", "with t as (select p_brand || case when p_partkey % 3 = 0 then ' x' when p_partkey % 3 = 1 then '-x' else '_X' end as topic from part), n as (select trim(regexp_replace(lower(trim(topic)), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') as topic_key, topic, count(*) as n from t group by all) select topic_key, count(*) as variants, sum(n)::bigint as n from n group by topic_key")
def topic_groups(spark, d):
    x = F.when(F.col("p_partkey") % 3 == 0, " x").when(F.col("p_partkey") % 3 == 1, "-x").otherwise("_X")
    return maintain.topic_groups(table(spark, d, "part").select(F.concat("p_brand", x).alias("topic"))).select("topic_key", "variants", "n")


@register("index_consistency", WITH + ", a as (select count(*) as missing from memories where status in ('active', 'updated') and id not in (select vec_id from embeddings)), b as (select count(*) as orphaned from embeddings where vec_id not in (select id from memories)) select missing, orphaned, case when missing = 0 and orphaned = 0 then 'ok' else 'attention' end as status from a, b")
def index_consistency(spark, d):
    return maintain.index_consistency(memories(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("id")))


@register("consolidation", WITH + "select topic, count(*) as n, array_to_string(list_sort(list(id)), chr(44)) as ids from memories where status in ('active', 'updated') group by topic having count(*) >= 3")
def consolidation(spark, d):
    c = maintain.consolidated(memories_at(spark, d), AS_OF)
    return c.select("topic", "n", F.array_join(F.transform(F.array_sort("ids"), lambda x: x.cast("string")), ",").alias("ids"))


@register("context_windows", "with s as (select distinct l_orderkey as doc, greatest(l_linenumber - 2, 0) as a, l_linenumber + 2 as z from lineitem where l_returnflag = 'R'), m as (select *, max(z) over (partition by doc order by a, z rows between unbounded preceding and 1 preceding) as p from s), g as (select *, sum(case when p is null or a > p + 1 then 1 else 0 end) over (partition by doc order by a, z rows unbounded preceding) as g from m) select doc, min(a) as start, max(z) as end from g group by doc, g")
def context_windows(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "R").alias("signal"))
    return maintain.context_windows(x)


@register("concept_candidates")
def concept_candidates(spark, d):
    return maintain.auto_concepts(memories(spark, d))


@register("auto_links", PAIRS_SQL + ", l as (select a as source, b as target, greatest(jaccard, containment) as weight from p where greatest(jaccard, containment) > 0.2 union all select b, a, greatest(jaccard, containment) from p where greatest(jaccard, containment) > 0.2) select source, target, round(weight, 6) as weight from (select *, row_number() over (partition by source order by round(weight, 12) desc, target) as r from l) where r <= 5")
def auto_links(spark, d):
    return maintain.auto_links(_tokens(spark, d), ["topic", "lang"]).withColumn("weight", F.round("weight", 6))


@register("synthesis_prompts")
def synthesis_prompts(spark, d):
    ranked = retrieval.ranked(_lists(spark, d).filter("channel = 'fts'")).join(memories(spark, d).select("id", "summary"), "id")
    return maintain.synthesis_prompts(ranked)
