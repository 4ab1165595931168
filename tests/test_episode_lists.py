"""Episodes' lists for all queries: those of `episode_channel`, without a shuffle of hits."""

import random

import pytest

from siltstone.operators import graph, recall


@pytest.mark.parametrize(("patterns", "given", "remembered"), [(200_000, 1 << 18, 64), (7, 5, 1)])
def test_episode_lists(spark, monkeypatch, patterns, given, remembered):
    monkeypatch.setattr(graph, "PATTERNS", patterns)
    monkeypatch.setattr(graph, "GIVEN", given)
    monkeypatch.setattr(graph, "REMEMBERED", remembered)
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(n)))
    ids = lambda n: [rng.randrange(60) for _ in range(rng.randrange(n))]
    # one episode's age is null, one leads to its own memory by two ways, one's score is negative
    e = [(i, text(40), None if i % 9 == 0 else text(5), float(i), len(str(i)), 1, [i, *ids(3)], ids(3)) for i in range(50)]
    e += [(50, "w1 w2", "", None, 1, 1, [90, 3], [1]), (51, "w1", "", 1.0, 1, 1, [91, 91], [70]), (52, "w1", "", -30.3, 1, 1, [92], [])]
    e = spark.createDataFrame(e, "id long, title string, tags string, age_days double, n_memories int, n_concepts int, memory_ids array<long>, concept_ids array<long>").repartition(3)
    concepts = spark.createDataFrame([(i, ids(4)) for i in range(60)] + [(70, [91, 93])], "id long, source_memory_ids array<long>")
    related = spark.createDataFrame([(i, ids(3)) for i in range(60)] + [(90, [94]), (92, [95])], "id long, related_ids array<long>")
    q = spark.createDataFrame([(i, text(6)) for i in range(20)] + [(20, ""), (21, None), (22, "W1"), (23, "nothing at all")], "query_id int, query string")
    one = lambda t: {(r["query_id"], r["id"]): r["score"] for r in t.collect()}
    want = one(graph.episode_channel(graph.episode_hits(q, e, ("title", "tags")), e, concepts, related))
    out = graph.episode_lists(q, e, ("title", "tags"), concepts, related)
    got = one(out)
    assert out.count() == len(got) and set(got) == set(want) and len(got) > 300
    assert {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None} != set()
    assert any(v is not None and v < 0 for v in got.values())
    numbers = lambda x: {k: v for k, v in x.items() if v is not None}
    assert numbers(got) == pytest.approx(numbers(want), abs=1e-9)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_only_queries_that_ask_for_episodes(spark):
    q = spark.createDataFrame([(1, "what happened in the session"), (2, "plain words"), (3, "what did we do yesterday")], "query_id int, query string")
    kept = {r["query_id"] for r in recall.asking_episodes(q).collect()}
    routed = {r["query_id"] for r in recall.routed(q).filter("type = 'episodic' or days_back is not null").collect()}
    assert kept == routed and 1 in kept and 2 not in kept
