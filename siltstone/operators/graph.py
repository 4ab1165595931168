"""Concept graphs, episodes and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text


def valid_at(links: DataFrame, at) -> DataFrame:
    """Links valid at a time, both bounds inclusive, null bounds open."""
    t = F.lit(at).cast("timestamp")
    return links.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_until").isNull() | (F.col("valid_until") >= t)))


def bfs(links: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """id, depth, score = 1 / (1 + depth) of what outgoing links reach within some hops."""
    from siltstone.sources.shared import checkpoint_dir

    checkpoint_dir(links.sparkSession)
    edges = links.select("source", "target").distinct()
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for h in range(1, hops + 1):
        step = front.join(edges, front["id"] == edges["source"]).select(F.col("target").alias("id")).distinct()
        front = step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(h)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.withColumn("score", 1 / (1 + F.col("depth")))


def neighborhood(links: DataFrame, seeds: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and links around seeds, in both directions."""
    both = links.select("source", "target").unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target")))
    nodes = bfs(both, seeds, depth)
    ids = nodes.select("id")
    inside = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, inside


def as_of(revisions: DataFrame, at, key: str = "id") -> DataFrame:
    """The latest revision of each key at a time."""
    before = revisions.filter(F.col("created_at") <= F.lit(at).cast("timestamp"))
    return before.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("revision")))).filter("_r = 1").drop("_r")


def refined(concepts: DataFrame, changes: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """Concepts after new definitions (id, definition), and the revisions to append."""
    new = concepts.join(changes.select("id", F.col("definition").alias("_new")), "id", "left")
    changed = F.col("_new").isNotNull()
    out = new.withColumns({"definition": F.coalesce("_new", "definition"), "revision": F.col("revision") + changed.cast("int"), "confidence": F.when(changed, F.least(F.lit(1.0), F.col("confidence") + 0.1)).otherwise(F.col("confidence"))}).drop("_new")
    return out, out.join(changes.select("id"), "id", "left_semi").select("id", "revision", "definition", F.lit(at).cast("timestamp").alias("created_at"))


def dedup_concepts(concepts: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One concept for each memoir and normal name: the earliest row, with the definition of most sources, then the longest,
    and all sources; links follow, without self loops and repeats."""
    key = [F.col("memoir"), text.concept_key(F.col("name")).alias("_name")]
    first = F.min_by("id", F.struct("created_at", "id")).alias("id")
    best = F.max_by("definition", F.struct(F.size("source_memory_ids"), F.length("definition"), "id")).alias("definition")
    sources = F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_memory_ids")))).alias("source_memory_ids")
    kept = concepts.groupBy(*key).agg(first, F.min_by("name", F.struct("created_at", "id")).alias("name"), best, sources)
    at = concepts.select("memoir", key[1], F.col("id").alias("old")).join(kept.select("memoir", "_name", "id"), ["memoir", "_name"]).select("old", "id")
    moved = links.join(at.select(F.col("old").alias("source"), F.col("id").alias("s")), "source", "left").join(at.select(F.col("old").alias("target"), F.col("id").alias("t")), "target", "left")
    moved = moved.select(F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"), "relation", "weight").filter("source <> target")
    return kept.drop("_name"), moved.groupBy("source", "target", "relation").agg(F.max("weight").alias("weight"))


def concept_scores(hits: DataFrame, concepts: DataFrame) -> DataFrame:
    """Memories behind found concepts (query_id, id, rank from 1): the greatest 1 / (1 + rank from 0)."""
    each = hits.join(concepts, "id").select("query_id", (1 / F.col("rank")).alias("score"), F.explode("source_memory_ids").alias("memory_id"))
    return each.groupBy("query_id", F.col("memory_id").alias("id")).agg(F.max("score").alias("score"))


def episode_memories(episodes: DataFrame, concepts: DataFrame, memories: DataFrame) -> DataFrame:
    """Memories of found episodes (episode_id, score, memory_ids, concept_ids): their own by 1, those related to these by
    0.65, those of their concepts by 0.85; the greatest counts."""
    own = episodes.select("score", F.explode("memory_ids").alias("id"))
    related = own.join(memories.select("id", "related_ids"), "id").select((F.col("score") * 0.65).alias("score"), F.explode("related_ids").alias("id"))
    via = episodes.select("score", F.explode("concept_ids").alias("cid")).join(concepts.select(F.col("id").alias("cid"), "source_memory_ids"), "cid").select((F.col("score") * 0.85).alias("score"), F.explode("source_memory_ids").alias("id"))
    return own.unionByName(related).unionByName(via).groupBy("id").agg(F.max("score").alias("score"))


# fixed values: weights of an episode's fields for the whole query, and for each of its words
WHOLE = {"title": 3.0, "decisions": 2.6, "outcome": 2.2, "temporal": 2.0, "topics": 1.8, "paths": 1.6, "tags": 1.2}
EACH = {"title": 0.9, "decisions": 0.8, "topics": 0.7, "temporal": 0.7, "outcome": 0.6, "paths": 0.5, "tags": 0.4, "agents": 0.3}


#: Patterns that are looked for in one pass over the episodes.
PATTERNS = 200_000


def _matcher(ask, fields: tuple[str, ...]):
    """Names of the queries of patterns (query_id, pattern, is_whole), and a function of the fields' texts that gives places of
    queries that hit any, and the weights of their patterns that do."""
    import ahocorasick
    import numpy as np

    names = ask.column("query_id").combine_chunks().dictionary_encode()
    patterns = ask.column("pattern").combine_chunks().dictionary_encode()
    query, number, whole = names.indices.to_numpy(), patterns.indices.to_numpy(), np.asarray(ask.column("is_whole"))
    by = np.argsort(number, kind="stable")
    query, whole, start = query[by], whole[by], np.searchsorted(number[by], np.arange(len(patterns.dictionary) + 1))
    weight = {f: np.where(whole, WHOLE.get(f, 0.0), EACH.get(f, 0.0)) for f in fields}
    found = ahocorasick.Automaton()
    for i, p in enumerate(patterns.dictionary.to_pylist()):
        found.add_word(p, i)
    found.make_automaton()

    def hits(texts):
        at = [(f, start[p], start[p + 1]) for f, t in zip(fields, texts, strict=True) for p in {p for _, p in found.iter(t)}]
        if not at:
            return np.empty(0, np.int64), np.empty(0)
        h = np.bincount(np.concatenate([query[x:y] for _, x, y in at]), np.concatenate([weight[f][x:y] for f, x, y in at]), len(names.dictionary))
        hit = np.flatnonzero(h > 0)
        return hit, h[hit]

    return names.dictionary, hits


def _given(names, held, value: str):
    """query_id, id and the value of held (id, places of queries, values); a value that isn't a number is null."""
    import numpy as np
    import pyarrow as pa

    q = names.take(pa.array(np.concatenate([x[1] for x in held])))
    i = pa.array([x[0] for x in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), [len(x[1]) for x in held])))
    return pa.record_batch([q, i, pa.array(np.concatenate([x[2] for x in held]), from_pandas=True)], ["query_id", "id", value])


#: Rows that a task gives out at a time, about; episodes whose hits it remembers.
GIVEN, REMEMBERED = 1 << 18, 64


def _lower(episodes: DataFrame, fields: tuple[str, ...], *more) -> DataFrame:
    return episodes.select(F.col("id").cast("long").alias("id"), *[F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f) for f in fields], *more)


def _found(episodes: DataFrame, fields: tuple[str, ...], asked: DataFrame, kind: str) -> DataFrame:
    """query_id, id, h: the weights of each query's patterns (query_id, pattern, is_whole) that stand in an episode's fields,
    added up in the task that has the episode."""
    shared = episodes.sparkSession.sparkContext.broadcast(asked.toArrow())

    def run(batches):
        if not len(shared.value):
            return
        names, hits = _matcher(shared.value, fields)
        for b in batches:
            held, size = [], 0
            for i, *texts in zip(b.column("id").to_pylist(), *[b.column(f).to_pylist() for f in fields], strict=True):
                hit, h = hits(texts)
                if len(hit):
                    held.append((i, hit, h))
                    size += len(hit)
                if size >= GIVEN:
                    yield _given(names, held, "h")
                    held, size = [], 0
            if held:
                yield _given(names, held, "h")

    return _lower(episodes, fields).mapInArrow(run, f"query_id {kind}, id long, h double")


def _patterns(queries: DataFrame) -> list[DataFrame]:
    """query_id, pattern, is_whole of the queries (query_id, query), in passes of PATTERNS, about; a query is in one of them."""
    whole = F.trim(F.lower("query"))
    q = queries.select("query_id", whole.alias("whole"), F.array_distinct(F.filter(F.split(whole, r"\s+"), lambda w: F.octet_length(w) >= 2)).alias("words")).filter("whole <> ''")
    asked = q.select("query_id", F.col("whole").alias("pattern"), F.lit(True).alias("is_whole")).unionByName(q.select("query_id", F.explode("words").alias("pattern"), F.lit(False).alias("is_whole")))
    passes = max(1, -(-asked.count() // PATTERNS))
    return [asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i) if passes > 1 else asked for i in range(passes)]


def _extra():
    return 0.3 / (1 + F.col("age_days") / 30) + 0.1 * F.least(F.col("n_memories"), F.lit(5)) + 0.08 * F.least(F.col("n_concepts"), F.lit(5))


def episode_hits(queries: DataFrame, episodes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """query_id, id, score: `episode_scores` for a table of queries (query_id, query).  episodes: id, the fields, age_days,
    n_memories, n_concepts.  The patterns of all queries are looked for together, in passes of PATTERNS, about."""
    kind, hits = dict(queries.dtypes)["query_id"], None
    for asked in _patterns(queries):
        part = _found(episodes, fields, asked, kind)
        hits = part if hits is None else hits.unionByName(part)
    return hits.join(episodes.select("id", _extra().alias("extra")), "id").select("query_id", "id", (F.col("h") + F.col("extra")).alias("score"))


def _led(episodes: DataFrame, concepts: DataFrame, memories: DataFrame) -> DataFrame:
    """id, memory, weights: what an episode's score counts for a memory."""
    own = episodes.select(F.col("id").alias("episode"), F.explode("memory_ids").alias("memory"))
    related = own.join(memories.select(F.col("id").alias("memory"), "related_ids"), "memory").select("episode", F.explode("related_ids").alias("memory"), F.lit(0.65).alias("weight"))
    via = episodes.select(F.col("id").alias("episode"), F.explode("concept_ids").alias("cid")).join(concepts.select(F.col("id").alias("cid"), "source_memory_ids"), "cid").select("episode", F.explode("source_memory_ids").alias("memory"), F.lit(0.85).alias("weight"))
    led = own.withColumn("weight", F.lit(1.0)).unionByName(related).unionByName(via)
    return led.groupBy(F.col("episode").cast("long").alias("id"), F.col("memory").cast("long").alias("memory")).agg(F.array_sort(F.collect_set("weight")).alias("weights"))


def episode_lists(queries: DataFrame, episodes: DataFrame, fields: tuple[str, ...], concepts: DataFrame, memories: DataFrame) -> DataFrame:
    """query_id, id, score: `episode_channel` of `episode_hits`, but memories are sent the texts of the episodes that lead to
    them, and a memory's task asks all queries: nearly every query hits nearly every episode, and none of that is shuffled."""
    import numpy as np

    kind, out = dict(queries.dtypes)["query_id"], None
    texts = _led(episodes, concepts, memories).join(_lower(episodes, fields, _extra().cast("double").alias("extra")), "id")
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # near memories are often led to by the same episodes, whose hits a task then finds once
    texts = texts.repartitionByRange(parts, "memory").sortWithinPartitions("memory", "id")
    for asked in _patterns(queries):
        shared = queries.sparkSession.sparkContext.broadcast(asked.toArrow())

        def run(batches, shared=shared):
            if not len(shared.value):
                return
            names, hits = _matcher(shared.value, fields)
            known, held, size = {}, [], 0
            best, hit_any, now, begun = np.full(len(names), np.nan), np.zeros(len(names), bool), None, False

            def done():
                at = np.flatnonzero(hit_any)
                if len(at):
                    held.append((now, at, best[at]))
                best[:], hit_any[:] = np.nan, False
                return len(at)

            for b in batches:
                columns = [b.column(c).to_pylist() for c in ("memory", "id", "extra", "weights", *fields)]
                for memory, i, extra, weights, *low in zip(*columns, strict=True):
                    if begun and memory != now:
                        size += done()
                        if size >= GIVEN:
                            yield _given(names, held, "score")
                            held, size = [], 0
                    now, begun = memory, True
                    if i not in known:
                        if len(known) >= REMEMBERED:
                            del known[next(iter(known))]
                        known[i] = hits(low)
                    hit, h = known[i]
                    hit_any[hit] = True
                    score = h + (np.nan if extra is None else extra)
                    for w in weights:
                        best[hit] = np.fmax(best[hit], score * w)
            done()
            if held:
                yield _given(names, held, "score")

        part = texts.mapInArrow(run, f"query_id {kind}, id long, score double")
        out = part if out is None else out.unionByName(part)
    return out


def episode_channel(hits: DataFrame, episodes: DataFrame, concepts: DataFrame, memories: DataFrame) -> DataFrame:
    """query_id, id, score: `episode_memories` for a table of queries' episodes (query_id, id, score)."""
    at = hits.join(episodes.select("id", "memory_ids", "concept_ids"), "id")
    own = at.select("query_id", "score", F.explode("memory_ids").alias("id"))
    related = own.join(memories.select("id", "related_ids"), "id").select("query_id", (F.col("score") * 0.65).alias("score"), F.explode("related_ids").alias("id"))
    via = at.select("query_id", "score", F.explode("concept_ids").alias("cid")).join(concepts.select(F.col("id").alias("cid"), "source_memory_ids"), "cid").select("query_id", (F.col("score") * 0.85).alias("score"), F.explode("source_memory_ids").alias("id"))
    return own.unionByName(related).unionByName(via).groupBy("query_id", "id").agg(F.max("score").alias("score"))


def episode_scores(episodes: DataFrame, query: str, age_days, fields: tuple[str, ...]) -> DataFrame:
    """Episodes that a query hits, with score: weighted substring hits, recency, and how much hangs on them."""
    q = query.lower().strip()
    words = [w for w in dict.fromkeys(q.split()) if len(w.encode()) >= 2]
    hits = F.lit(0.0)
    for f in fields:
        low = F.lower(F.coalesce(F.col(f), F.lit("")))
        if f in WHOLE:
            hits = hits + F.when(F.contains(low, F.lit(q)), WHOLE[f]).otherwise(0.0)
        for w in words:
            hits = hits + F.when(F.contains(low, F.lit(w)), EACH[f]).otherwise(0.0)
    extra = 0.3 / (1 + age_days / 30) + 0.1 * F.least(F.col("n_memories"), F.lit(5)) + 0.08 * F.least(F.col("n_concepts"), F.lit(5))
    return episodes.withColumn("_h", hits).filter("_h > 0").withColumn("score", F.col("_h") + extra).drop("_h")


def timeline(parts: dict[str, DataFrame], limit: int) -> DataFrame:
    """kind, id, ts of several tables, newest first."""
    out = None
    for kind, df in parts.items():
        x = df.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
        out = x if out is None else out.unionByName(x)
    return out.orderBy(F.desc("ts"), "kind", "id").limit(limit)


def exported(concepts: DataFrame, links: DataFrame, fmt: str) -> DataFrame:
    """A memoir's graph as one text: json, dot or ascii."""
    if fmt == "json":
        c = concepts.agg(F.array_sort(F.collect_list(F.struct("id", "name", "definition"))).alias("concepts"))
        e = links.agg(F.array_sort(F.collect_list(F.struct("source", "target", "relation"))).alias("links"))
        return c.crossJoin(e).select(F.to_json(F.struct("concepts", "links")).alias("text"))
    line = {"dot": '  "%s" -> "%s" [label="%s"];', "ascii": "%s --> %s (%s)"}.get(fmt)
    if line is None:
        raise ValueError(f"unknown format {fmt}")
    body = links.agg(F.array_join(F.array_sort(F.collect_list(F.format_string(line, F.col("source").cast("string"), F.col("target").cast("string"), "relation"))), "\n").alias("text"))
    return body.select(F.concat(F.lit("digraph {\n"), "text", F.lit("\n}")).alias("text")) if fmt == "dot" else body


def prune_concepts(concepts: DataFrame, links: DataFrame, least: float = 0.2) -> DataFrame:
    """Concepts that stay: good enough, or with sources, or referred to."""
    used = links.select(F.col("source").alias("id")).unionByName(links.select(F.col("target").alias("id"))).distinct().withColumn("_used", F.lit(True))
    out = concepts.join(used, "id", "left")
    return out.filter(F.col("_used").isNotNull() | (F.col("quality") >= least) | (F.size("source_memory_ids") > 0)).drop("_used")
