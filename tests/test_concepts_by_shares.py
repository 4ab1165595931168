"""Concepts are searched by shares of their postings; the best are those of plain BM25 over all of them."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import concepts, lexical, retrieval


@pytest.mark.parametrize("share", [7, 32_768])
def test_search_by_shares(spark, monkeypatch, share):
    monkeypatch.setattr(lexical, "SHARE", share)
    calls, real = [], lexical.best_with_all_terms
    monkeypatch.setattr(lexical, "best_with_all_terms", lambda *a: calls.append(1) or real(*a))
    rng = random.Random(6)
    text = lambda n: " ".join(f"word{rng.randrange(12)}" for _ in range(rng.randrange(n)))
    c = spark.createDataFrame([(i, text(6), text(3), f"label{i % 3}") for i in range(120)], "id long, name string, definition string, labels string")
    q = spark.createDataFrame([(i, text(4)) for i in range(15)] + [(20, "label1"), (21, "word1 nothing"), (22, ""), (23, "WORD1 label2")], "query_id int, query string")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in concepts.search(c, q, 4).collect()}
    asked = q.select("query_id", concepts.text.sanitize_query(F.lower("query")).alias("terms"))
    # ids that aren't numbers are scored by joins
    plain = retrieval.bm25(retrieval.postings(c.withColumn("id", F.col("id").cast("string")), concepts.FIELDS), retrieval.field_stats(c, concepts.FIELDS), asked, all_terms=True)
    want = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in retrieval.top_k(plain.select("query_id", F.col("id").cast("long").alias("id"), F.round("score", 9).alias("score")), 4).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(got) > 20
    assert [got[k][1] for k in want] == pytest.approx([v[1] for v in want.values()], abs=2e-9)
    assert calls == [1]
