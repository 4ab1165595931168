"""The stored lexical index against plain BM25, in versions."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import lexical, retrieval
from siltstone.sources.versions import Conflict

SCHEMA = "id long, topic string, summary string, content string, keywords string"


def rows(seed, ids):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 90}"
    text = lambda n: " ".join(word() for _ in range(rng.randrange(n)))
    return [(i, rng.choice(["a b", "c"]), text(6), text(rng.choice([5, 60, 400])), None if i % 5 == 0 else text(4)) for i in ids]


def plain(spark, docs, queries, fields, k=None):
    stats = retrieval.field_stats(docs, fields)
    out = retrieval.bm25(retrieval.postings(docs, fields), stats, queries).withColumn("score", F.round("score", 9))
    return sorted(map(tuple, (retrieval.top_k(out, k) if k else out).collect()))


def close(a, b):
    """Equal rows, but for the rounding of scores."""
    return [(*x[:2], *x[3:]) for x in a] == [(*x[:2], *x[3:]) for x in b] and all(abs(x[2] - y[2]) < 2e-9 for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, ["w1"]), (2, ["w1", "w2", "w40"]), (3, ["w7", "w8", "w8"]), (4, ["nothing"]), (5, []), (6, ["w2", "w3", "w5", "w77"])], "query_id int, terms array<string>")


@pytest.mark.parametrize("fields", [("content",), lexical.FIELDS])
def test_search_equals_plain_scores(spark, queries, tmp_path, fields):
    docs = spark.createDataFrame(rows(1, range(400)), SCHEMA)
    index = lexical.LexicalIndex(spark, f"file://{tmp_path}/x", fields, rows=16, buckets=3)
    index.build(docs)
    reader = index.reader()
    assert close(sorted(map(tuple, reader.all(queries).collect())), plain(spark, docs, queries, fields))
    for k in (1, 7):
        assert close(sorted(map(tuple, reader.search(queries, k).collect())), plain(spark, docs, queries, fields, k))
    every, spared = reader.skipped(queries, 3)
    assert spared > (0.2 if len(fields) == 1 else 0.05) * every


def test_versions(spark, queries, tmp_path):
    """An index in three steps gives the rows of one that is built at once; old readers see what they saw."""
    first, second = rows(1, range(200)), rows(2, range(150, 260))
    index = lexical.LexicalIndex(spark, f"file://{tmp_path}/x", rows=16, buckets=3)
    assert index.extend(spark.createDataFrame(first, SCHEMA)) == 1
    old = index.reader()
    before = sorted(map(tuple, old.search(queries, 5).collect()))
    assert index.extend(spark.createDataFrame(second, SCHEMA), spark.createDataFrame([(3,), (999,)], "id long")) == 2
    assert index.extend(spark.createDataFrame(first[:10], SCHEMA), spark.createDataFrame([(160,), (4,)], "id long")) == 3
    left = {r[0]: r for r in first} | {r[0]: r for r in second}
    for i in (3, 160):
        del left[i]
    left |= {r[0]: r for r in first[:10]}
    now = index.reader()
    assert {(r["id"], r["topic"]) for r in now.rows().collect()} == {(i, r[1]) for i, r in left.items()}
    docs = spark.createDataFrame(list(left.values()), SCHEMA)
    anew = lexical.LexicalIndex(spark, f"file://{tmp_path}/y", rows=16, buckets=3)
    anew.build(docs)
    found = sorted(map(tuple, now.search(queries, 5).collect()))
    assert close(found, sorted(map(tuple, anew.reader().search(queries, 5).collect()))) and close(found, plain(spark, docs, queries, ("content",), 5))
    assert close(sorted(map(tuple, old.search(queries, 5).collect())), before) and close(before, sorted(map(tuple, index.reader(1).search(queries, 5).collect())))
    with pytest.raises(Conflict):
        index.versions.publish({"segments": []}, 2)
    assert index.versions.latest()[0] == 3
    index.versions.vacuum()
    assert close(sorted(map(tuple, index.reader().search(queries, 5).collect())), found)
    with pytest.raises(ValueError):
        index.extend(docs.unionByName(docs.limit(1)))


def test_topics_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([*rows(3, range(50)), (None, "c", "w1", "w1", "w1")], SCHEMA)
    index = lexical.LexicalIndex(spark, f"file://{tmp_path}/x", lexical.FIELDS, rows=8)
    index.build(docs)
    q = spark.createDataFrame([(1, ["w1", "w2"], "c"), (2, ["w1", "w2"], None), (3, ["w1"], "zz")], "query_id int, terms array<string>, topic string")
    got = index.reader().search(q, 100).collect()
    topic = {r["id"]: r["topic"] for r in docs.collect()}
    mine = lambda i: {r["id"]: round(r["score"], 8) for r in got if r["query_id"] == i}
    assert mine(1) == {i: s for i, s in mine(2).items() if topic[i] == "c"} and mine(1) and not mine(3)
    empty = lexical.LexicalIndex(spark, f"file://{tmp_path}/y")
    empty.build(docs.limit(0))
    assert empty.reader().search(q, 5).count() == 0
    empty.extend(docs)
    assert empty.reader().rows().count() == 50


def test_shares_and_passes_equal_plain_scores(spark, queries, tmp_path, monkeypatch):
    """Many shares of rows and passes over queries give the k best, with ties by id."""
    monkeypatch.setattr(lexical, "SHARE", 50)
    monkeypatch.setattr(lexical, "ASKED", 2)
    docs = spark.createDataFrame([*rows(3, range(300)), *((i, "c", "", "w1 w2", None) for i in range(300, 400))], SCHEMA)
    index = lexical.LexicalIndex(spark, f"file://{tmp_path}/x", ("summary", "content"), rows=16, buckets=3)
    index.build(docs)
    got = index.reader().search(queries, 6)
    assert close(sorted(map(tuple, got.collect())), plain(spark, docs, queries, ("summary", "content"), 6))


def test_rows_left_out_are_not_shuffled(spark, tmp_path):
    """Rows that are out for a query go to the share that has their postings; all scored rows are not exchanged."""
    from siltstone.operators import lexical

    docs = spark.createDataFrame([(i, " ".join(f"w{i % m}" for m in (2, 3, 5, 7))) for i in range(300)], "id long, content string")
    index = lexical.LexicalIndex(spark, f"file://{tmp_path}/out", rows=16)
    index.build(docs)
    queries = spark.createDataFrame([(q, [f"w{q % 2}", f"w{q % 3}"]) for q in range(20)], "query_id long, terms array<string>")
    every = index.reader().search(queries, 300).collect()
    without = [(r["query_id"], r["id"]) for r in every if (r["query_id"] * 7 + r["id"]) % 3 or r["query_id"] == 4]
    found = index.reader().search(queries, 5, without=spark.createDataFrame(without, "query_id long, id long"))
    want, out = {}, set(without)
    for r in sorted(every, key=lambda r: r["rank"]):
        if (r["query_id"], r["id"]) not in out and len(want.setdefault(r["query_id"], [])) < 5:
            want[r["query_id"]].append((r["id"], round(r["score"], 9)))
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
    assert got == {q: v for q, v in want.items() if v} and 4 not in got
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
