"""The stored neighbour index: recall against exact search, extension, deletion, live rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import vector_index
from siltstone.operators.retrieval import nearest
from siltstone.plans import core
from siltstone.plans.model import table
from siltstone.sources.versions import Conflict

SCHEMA = "id long, embedding array<double>"


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)] + 0.5 * rng.normal(size=(3000, 16))
    x[500:1500] = x[2]  # a third of all rows are one vector
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_search(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 200)
    monkeypatch.setattr(vector_index, "BLOCK", 40)
    v = spark.createDataFrame([*rows, (None, rows[0][1]), (9001, None), (9002, [1.0])], SCHEMA)
    q = v.filter("id % 20 = 0 and id < 3000").select(F.col("id").alias("query_id"), "embedding")
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/x")
    index.build(v)
    reader = index.reader()
    n = len(reader.manifest["cells"])
    assert reader.manifest["probes"] < n / 2 and reader.manifest["measured"] >= 0.95
    want = lists(nearest(spark.createDataFrame(rows, SCHEMA), q, 10))
    assert lists(reader.search(q, 10, probes=n)) == want
    assert recall(lists(reader.search(q, 10)), want) >= 0.9
    live = v.filter("id % 3 = 0").select("id")
    assert lists(reader.search(q, 10, probes=n, live=live)) == lists(nearest(spark.createDataFrame(rows, SCHEMA).filter("id % 3 = 0"), q, 10))
    assert index.reader().search(q.limit(0), 5).count() == 0


def test_versions(spark, rows, tmp_path):
    """Rows are added, replaced and deleted; the old reader doesn't see it."""
    first, more = rows[:400], [(i, rows[i + 2000][1]) for i in range(350, 450)]
    q = spark.createDataFrame(rows[1600:1620], "query_id long, embedding array<double>")
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/x")
    assert index.extend(spark.createDataFrame(first, SCHEMA)) == 1
    old = index.reader()
    assert index.extend(spark.createDataFrame(more, SCHEMA), spark.createDataFrame([(5,), (7,)], "id long")) == 2
    assert index.extend(spark.createDataFrame(first[5:6], SCHEMA)) == 3
    left = {i: v for i, v in first if i != 7} | dict(more)
    now = index.reader()
    exact = lambda r, data: lists(r.search(q, 10, probes=99)) == lists(nearest(spark.createDataFrame(data, SCHEMA), q, 10))
    assert exact(now, list(left.items())) and exact(old, first)
    with pytest.raises(Conflict):
        index.versions.publish({"segments": []}, 1)
    index.versions.vacuum()
    assert exact(now, list(left.items()))


def test_empty(spark, tmp_path):
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/x")
    index.build(spark.createDataFrame([], SCHEMA))
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert index.reader().search(q, 5).count() == 0
    index.build(spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 2.0])], SCHEMA))
    assert lists(index.reader().search(q, 5)) == {1: [(1, 0.0), (2, 0.0)]}


def test_recall_of_the_query(spark):
    d = "/root/testdata/sf0.01"
    live = core.scan.live(core.memories(spark, d)).select("id")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(live, "id", "left_semi")
    assert recall(lists(core.ann_topk(spark, d)), lists(nearest(v, core.asked_vectors(spark, d), 10))) >= 0.9
