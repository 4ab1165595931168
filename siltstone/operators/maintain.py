"""Maintenance of memories: topic groups, consolidation, links, evolution, conflicts, refresh rules, reports, ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import stats, text
from siltstone.schema import LIVE


def topic_groups(df: DataFrame) -> DataFrame:
    """topic_key, topic (the variant that reads best, then the most frequent), variants, n."""
    n = df.groupBy(text.topic_key(F.col("topic")).alias("topic_key"), "topic").agg(F.count("*").alias("n"))
    best = F.max_by("topic", F.struct(text.topic_display_score(F.col("topic")), "n", "topic")).alias("topic")
    return n.groupBy("topic_key").agg(best, F.count("*").alias("variants"), F.sum("n").alias("n"))


def consolidated(df: DataFrame, as_of, least: int = 3, most_lines: int | None = None) -> DataFrame:
    """One row for each topic of at least `least` live rows: their distinct summaries and lines, joined; keywords together."""
    live = df.filter(F.col("status").isin(*LIVE))
    first = live.groupBy("topic").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("created_at", "id", "summary", "content"))).alias("_r")).filter(F.col("n") >= least)
    lines = F.array_distinct(F.filter(F.flatten(F.transform("_r", lambda r: F.transform(F.split(r["content"], "\n"), lambda x: F.trim(x)))), lambda x: (x != "") & ~F.lower(x).startswith("[merged")))
    body = F.concat_ws("\n", F.array_join(F.transform(F.array_distinct(F.transform("_r", lambda r: r["summary"])), lambda s: F.concat(F.lit("- "), s)), "\n"), F.array_join(lines if most_lines is None else F.slice(lines, 1, most_lines), "\n"))
    return first.select("topic", "n", F.transform("_r", lambda r: r["id"]).alias("ids"), body.alias("content"), F.lit(as_of).cast("timestamp").alias("created_at"))


def auto_links(df: DataFrame, block: list[str], above: float = 0.2, cap: int = 5) -> DataFrame:
    """source, target, weight in both directions: the most similar rows (id, tokens) of a block, at most `cap` for each."""
    from siltstone.operators.dedup import candidates

    both = candidates(df, block, above, top=cap).select(F.col("id").alias("source"), F.col("other").alias("target"), F.col("sim").alias("weight"))
    return both.withColumn("_r", F.row_number().over(W.partitionBy("source").orderBy(F.desc(F.round("weight", 12)), "target"))).filter(F.col("_r") <= cap).drop("_r")


def evolved(similar: DataFrame) -> DataFrame:
    """old_id, action: rows that a new one supersedes (over 0.8) or refines (over 0.5)."""
    act = F.when(F.col("sim") > 0.8, "supersede").when(F.col("sim") > 0.5, "refine")
    return similar.select("new_id", "old_id", act.alias("action")).filter("action is not null")


def conflict_scores(similar: DataFrame, cap: int = 5) -> DataFrame:
    """id, score: how much a row (id, concept_id, rank, sim) seems to contradict its nearest concepts."""
    near = similar.filter((F.col("rank") <= cap) & (F.col("sim") < 0.45))
    return near.groupBy("id").agg(F.max(F.least(F.lit(0.80), F.greatest(F.lit(0.0), 0.80 - F.col("sim")))).alias("score"))


def expired_links(links: DataFrame, definitions: DataFrame, at) -> DataFrame:
    """Open links whose concepts' new definition has little to do with the old one (id, sim, confidence) end now."""
    gone = definitions.filter((F.col("sim") < 0.3) & (F.col("confidence") > 0.5)).select(F.col("id").alias("source"), F.lit(True).alias("_gone"))
    end = F.when(F.col("_gone") & F.col("valid_until").isNull(), F.lit(at).cast("timestamp")).otherwise(F.col("valid_until"))
    return links.join(gone, "source", "left").withColumn("valid_until", end).drop("_gone")


def auto_concepts(df: DataFrame, least_chars: int = 80, cap: int = 3) -> DataFrame:
    """id, name: the topic and the longest keywords of rows with enough content."""
    c = df.filter(F.length("content") >= least_chars).select("id", F.array_distinct(F.concat(F.array(text.concept_key(F.col("topic"))), F.transform(text.keywords(F.col("content"), cap), text.concept_key))).alias("names"))
    return c.select("id", F.explode(F.slice("names", 1, cap)).alias("name"))


def resummarizable(df: DataFrame, claims: DataFrame, stale_before) -> DataFrame:
    """Flagged live rows that are their own canonical row and aren't claimed, or whose claim is stale."""
    held = claims.filter(F.col("claimed_at") >= F.lit(stale_before).cast("timestamp")).select("id")
    own = df.filter(F.col("flagged") & F.col("status").isin(*LIVE) & (F.col("canonical_id") == F.col("id")))
    return own.join(held, "id", "left_anti")


def refresh_due(revisions: Column, age_days: Column, min_revisions: float, min_age: float) -> Column:
    return (revisions >= min_revisions) & (age_days >= min_age)


def synthesis_prompts(ranked: DataFrame, budget: int = 4000) -> DataFrame:
    """query_id, prompt: ranked rows as text, as long as they fit into a budget of characters."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("summary"))
    one = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    fit = ranked.withColumn("_line", line).withColumn("_sum", F.sum(F.length("_line") + 1).over(one)).filter(F.col("_sum") <= budget)
    return fit.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_line"))), lambda x: x["_line"]), "\n").alias("prompt"))


def recall_events(events: DataFrame) -> DataFrame:
    """event_id, request, id, bm25, vec, label of recall events' candidates (JSON payload) joined to what was used of them."""
    shape = "request string, candidates array<struct<id bigint, bm25 double, vec double>>"
    r = events.filter("type = 'recall_complete'").select("event_id", F.from_json("payload", shape).alias("p")).select("event_id", "p.request", F.explode("p.candidates").alias("c")).select("event_id", "request", "c.*")
    used = events.filter("type = 'recall_access'").select(F.from_json("payload", "request string, id bigint, helpful boolean").alias("p")).select("p.*")
    used = used.groupBy("request", "id").agg(F.max(F.when(F.col("helpful") == F.lit(False), -1).otherwise(1)).alias("label"))
    return r.join(used, ["request", "id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def context_windows(lines: DataFrame, around: int = 2) -> DataFrame:
    """doc, start, end: stretches of lines (doc, line, signal) around signals, merged where they touch."""
    s = lines.filter("signal").select("doc", F.greatest(F.col("line") - around, F.lit(0)).alias("a"), (F.col("line") + around).alias("z")).distinct()
    one = W.partitionBy("doc").orderBy("a", "z")
    new = F.coalesce(F.col("a") > F.max("z").over(one.rowsBetween(W.unboundedPreceding, -1)) + 1, F.lit(True))
    return s.withColumn("_g", F.sum(new.cast("int")).over(one.rowsBetween(W.unboundedPreceding, 0))).groupBy("doc", "_g").agg(F.min("a").alias("start"), F.max("z").alias("end")).drop("_g")


def working_set(items: DataFrame, query: str, limit: int, least: float = 0.2) -> DataFrame:
    """Items (id, topic, summary, detail, stored, created_at) that a query asks for, newest first where equal."""
    q = text.tokens(F.lit(query))
    best = F.greatest(*[text.similarity(text.tokens(F.col(c)), q) for c in ("detail", "summary", "topic")])
    return items.withColumn("score", 0.7 * best + 0.3 * F.col("stored")).filter(F.col("score") >= least).orderBy(F.desc("score"), F.desc("created_at"), "id").limit(limit)


def ingested(sessions: DataFrame, least: int = 2) -> dict[str, DataFrame]:
    """Facts of sessions' turns and an episode for each session (session_id, turns, started_at)."""
    from siltstone.operators.extract import facts

    turns = sessions.select("session_id", F.posexplode("turns").alias("turn", "t")).select(F.struct("session_id", "turn").alias("id"), F.col("t.content").alias("content"))
    found = facts(turns, least).select("id.session_id", "id.turn", "position", "fact", "score")
    dates = sessions.select("session_id", text.date_keywords(F.array_join(F.transform("turns", lambda t: t["content"]), " ")).alias("temporal"), F.size("turns").alias("n_turns"), "started_at")
    n = found.groupBy("session_id").agg(F.count("*").alias("n_facts"))
    return {"facts": found, "episodes": dates.join(n, "session_id", "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))}


def index_consistency(df: DataFrame, vectors: DataFrame) -> DataFrame:
    """missing, orphaned, status of a vector table against live rows."""
    live = df.filter(F.col("status").isin(*LIVE)).select("id")
    a = live.join(vectors.select("id"), "id", "left_anti").agg(F.count("*").alias("missing"))
    b = vectors.select("id").join(df.select("id"), "id", "left_anti").agg(F.count("*").alias("orphaned"))
    return a.crossJoin(b).withColumn("status", F.when((F.col("missing") == 0) & (F.col("orphaned") == 0), "ok").otherwise("attention"))


def orphan_links(links: DataFrame, concepts: DataFrame) -> DataFrame:
    ids = concepts.select("id")
    return links.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").unionByName(links.join(ids.withColumnRenamed("id", "target"), "target", "left_anti")).distinct()


def priors(hints: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Means of valid hints (finite, not negative) by field, or defaults; and the threshold from the intervals' mean width."""

    def mean(c: str, ok: Column) -> Column:
        return F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(defaults[c])).alias(c)

    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf"))
    fields = [c for c in defaults if c not in ("ci_width", "threshold")]
    out = hints.agg(*[mean(c, finite(c)) for c in fields], F.avg(F.when(finite("ci_width") & (F.col("ci_width") <= 1), F.col("ci_width"))).alias("_w"))
    moved = F.least(F.lit(0.9), F.greatest(F.lit(0.1), defaults["threshold"] + (F.col("_w") - 0.5) * 0.2))
    return out.withColumn("threshold", F.coalesce(moved, F.lit(defaults["threshold"]))).drop("_w")


def compared(old: DataFrame, new: DataFrame) -> dict:
    """The verdict on two scorecards (fixture_id, passed) by their common fixtures."""
    both = old.select("fixture_id", F.col("passed").alias("a")).join(new.select("fixture_id", F.col("passed").alias("b")), "fixture_id")
    n = lambda a, b: F.sum(F.when((F.col("a") == a) & (F.col("b") == b), 1).otherwise(0))
    r = both.agg(n(True, True), n(True, False), n(False, True), n(False, False)).first()
    out = stats.mcnemar(*[int(x or 0) for x in r])
    return out | {"verdict": stats.verdict(out["low"], out["high"]) if out["n"] else "no_data"}


def false_positive_safe(sealed: DataFrame, limit: float = 0.02) -> bool:
    """Whether sealed negatives (sim over the threshold: predicted) bound the false positive rate below a limit."""
    r = sealed.agg(F.sum(F.col("predicted").cast("int")).alias("k"), F.count("*").alias("n")).first()
    return stats.clopper_pearson_upper(int(r["k"] or 0), int(r["n"])) <= limit


def judged(emits: DataFrame, most_weight: float = 1.0) -> DataFrame:
    """Checks of a judge's events (link, stamp, expected_stamp, weight, source_kind): id and the rules that fail."""
    rules = {"no link": F.col("link").isNull(), "stamp": ~F.col("stamp").eqNullSafe(F.col("expected_stamp")), "weight": ~F.col("weight").between(0, most_weight), "reinforces itself": F.col("source_kind") == "judge"}
    return emits.select("id", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])).alias("failed"))
