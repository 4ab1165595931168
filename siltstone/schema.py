"""Record types (as DDL), enumerations and defaults of the memory model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMORY = (
    "id string, topic string, summary string, content string, keywords array<string>, importance string, layer string, "
    "source string, status string, tier string, strength double, decay_lambda double, access_count int, created_at timestamp, "
    "updated_at timestamp, last_accessed timestamp, related_ids array<string>, concept_ids array<string>, superseded_by string, "
    "canonical_id string, support_count int, merge_count int, source_diversity int, contradiction_score double, cluster_id int"
)
CONCEPT = "id string, memoir string, name string, definition string, labels array<string>, confidence double, revision int, source_memory_ids array<string>, created_at timestamp"
LINK = "source string, target string, relation string, weight double, valid_from timestamp, valid_until timestamp"
EPISODE = "id string, title string, outcome string, topics array<string>, decisions array<string>, paths array<string>, tags array<string>, agents array<string>, temporal array<string>, memory_ids array<string>, concept_ids array<string>, created_at timestamp"
EVENT = "id long, ts timestamp, type string, payload string"
SESSION = "session_id string, project string, started_at timestamp, turns array<struct<role string, content string>>"
DECISION = "winner_id string, loser_id string, relation string, lexical double, vector double, action string, reversible boolean, payload string, created_at timestamp"

# fixed values: enumerations and defaults of the model
IMPORTANCE = ("low", "medium", "high", "critical")
DECAY_FACTOR = {"low": 1.0, "medium": 0.7, "high": 0.4, "critical": 0.1}
BETA = {"ltm": 0.8, "stm": 1.2}
STATUS = ("active", "updated", "deprecated", "archived")
LIVE = ("active", "updated")
TIERS = ("hot", "warm", "cold")
BASE_LAMBDA = 0.06
RRF_K = 60
DEDUP_SIMILARITY = 0.70
PRUNE_BELOW = 0.05
PROMOTE_AFTER = 5


def by_value(c: Column, values: dict, default=None) -> Column:
    """A column's value looked up in a small fixed table."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def importance_rank(c: Column) -> Column:
    return by_value(c, {k: i for i, k in enumerate(IMPORTANCE)})


def layer_of(importance: Column) -> Column:
    """Important rows begin in long-term memory."""
    return F.when(importance.isin("high", "critical"), "ltm").otherwise("stm")


def build_rows(df: DataFrame, as_of: str) -> DataFrame:
    """Defaults for new rows: layer, decay rate, summary, strength and timestamps."""
    importance = F.coalesce("importance", F.lit("medium"))
    return df.withColumns({
        "importance": importance,
        "layer": layer_of(importance),
        "decay_lambda": F.lit(BASE_LAMBDA) * by_value(importance, DECAY_FACTOR, 0.7),
        "summary": F.coalesce("summary", F.substring("content", 1, 200)),
        "strength": F.lit(1.0),
        "access_count": F.lit(0),
        "status": F.lit("active"),
        "tier": F.lit("warm"),
        "created_at": F.lit(as_of).cast("timestamp"),
    })


def violations(memories: DataFrame) -> DataFrame:
    """id, rule: each constraint that a row breaks.  Spark has no CHECK, UNIQUE or foreign keys, so writers call this."""
    rules = {
        "id is null": F.col("id").isNull(),
        "importance": ~F.col("importance").isin(*IMPORTANCE),
        "layer": ~F.col("layer").isin("stm", "ltm"),
        "status": ~F.col("status").isin(*STATUS),
        "tier": ~F.col("tier").isin(*TIERS),
        "strength outside [0, 1]": ~F.col("strength").between(0, 1),
        "supersedes itself": F.col("superseded_by") == F.col("id"),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    single = memories.select("id", F.explode(broken).alias("rule"))
    twice = memories.groupBy("id").count().filter("count > 1").select("id", F.lit("id is not unique").alias("rule"))
    return single.unionByName(twice)


def link_violations(links: DataFrame) -> DataFrame:
    """Self loops, and edges of the same source, target and relation."""
    loops = links.filter("source = target").select("source", "target", "relation", F.lit("self loop").alias("rule"))
    twice = links.groupBy("source", "target", "relation").count().filter("count > 1").select("source", "target", "relation", F.lit("duplicate").alias("rule"))
    return loops.unionByName(twice)
