"""Rows with all terms of a query come out of their share's task, and aren't shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import lexical, retrieval


@pytest.mark.parametrize(("fields", "share", "given"), [(("content",), 40, 50), (("summary", "content"), 1000, 1 << 18)])
def test_all_terms(spark, tmp_path, monkeypatch, fields, share, given):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.7)) % 30}" for _ in range(rng.randrange(n)))
    docs = spark.createDataFrame([(i, text(5), None if i % 17 == 0 else text(60)) for i in range(300)], "id long, summary string, content string")
    queries = spark.createDataFrame([(1, ["w1"]), (2, ["w1", "w2"]), (3, ["w7", "w2", "w2"]), (4, ["w1", "nothing"]), (5, []), (6, ["w2", "w3", "w5", "w11"])], "query_id int, terms array<string>")
    monkeypatch.setattr(lexical, "SHARE", share)
    monkeypatch.setattr(lexical, "GIVEN", given)
    index = lexical.LexicalIndex(spark, f"file://{tmp_path}/x", fields, rows=16, buckets=3)
    index.build(docs)
    for all_terms in (True, False):
        got = index.reader().all(queries, all_terms=all_terms)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("MapInArrow")[0] and "MapInArrow" in plan
        want = retrieval.bm25(retrieval.postings(docs, fields), retrieval.field_stats(docs, fields), queries.withColumn("terms", F.array_distinct("terms")), all_terms=all_terms)
        one = lambda t: {(r["query_id"], r["id"]): r["score"] for r in t.collect()}
        assert one(got) == pytest.approx(one(want), abs=1e-9)
        assert {q for q, _ in one(got)} >= {1, 2, 3, 6} and not (all_terms and any(q == 4 for q, _ in one(got)))
