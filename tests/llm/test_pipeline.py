"""The pipeline's stages, each against brute force on its own input."""

import re

import corpus_pipeline
from siltstone.llm import decontamination, quality

from tests.llm.test_operators import brute_components, brute_repeats

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else None
        docs = _written(spark, stage(spark, docs, DIR), name)
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == set(before)
            continue
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        frame = spark.createDataFrame(list(before.items()), "doc_id long, text string")
        if name == "quality_rules":
            want = {r["doc_id"] for r in quality.quality_rules(frame).filter("kept").collect()}
            assert set(after) == want
        elif name == "ngram_jaccard_join":
            assert set(after) == {i for i, (_, c) in brute_components(list(before.items())).items() if i == c}
        elif name == "suffix_array_dedup":
            repeats = brute_repeats(list(before.items()))
            assert all(re.search(r"\S", t) for t in after.values())
            assert all(after[i] == before[i] for i in after if repeats[i][1] == 0)
            assert all(len(after.get(i, "").encode()) <= n - gone for i, (n, gone, _, _) in repeats.items())
        else:
            found = decontamination.contaminated(frame, spark.read.parquet(f"{DIR}/benchmark.parquet"))
            assert set(before) - set(after) == {r["doc_id"] for r in found.collect()}


def _written(spark, df, name):
    from siltstone.llm import common

    path = f"{common.shared_dir(spark)}/test-{name}-{common.new_name()}"
    df.write.parquet(path)
    return spark.read.parquet(path)


NAMES = ["doc_id", "text", "row", "row_", "spans", "_row", "item", "class", "root", "sequence", "n_words", "n_chars", "score"]
KINDS = "doc_id long, text string, row int, row_ string, spans int, _row int, item string, class long, root long, sequence int, n_words int, n_chars int, score double"


def _hostile():
    import random

    rng = random.Random(5)
    good = lambda n: " ".join(rng.choice(["the", "of", "and", "to", "in"]) + f" w{rng.randrange(5000)}" for _ in range(n)) + "."
    a, b, long = good(60), good(60), good(8000)
    texts = [(1, a), (1, a), (2, a), (3, b), (None, b), (None, good(60)), (4, None), (5, ""), (6, long), (7, good(60)), (7, good(60)), (8, "x" * 3000)]
    return [(i, t, 1, "r", 2, 3, "i", 4, 5, 6, 7, len(t or ""), 0.5) for i, t in texts]


def test_stages_on_hostile_rows(spark):
    """Nulls, empties, a long text, repeated rows, one id with two texts, and columns with the operators' own names."""
    docs = spark.createDataFrame(_hostile(), KINDS).repartition(3)
    rows = {name: stage(spark, docs, DIR) for name, stage in corpus_pipeline.STAGES}
    for name in list(rows)[:-1]:
        assert rows[name].columns == NAMES and rows[name].schema == docs.schema
    count = lambda name: sorted(((r["doc_id"], len(r["text"] or "")) for r in rows[name].collect()), key=str)
    whole = sorted(((r[0], len(r[1] or "")) for r in _hostile()), key=str)
    assert count("quality_rules") == [x for x in whole if x[1] > 0 and x[0] != 8]
    # one of the three equal texts, one of the two, and all that are linked with nothing
    kept = count("ngram_jaccard_join")
    assert [x[0] for x in kept].count(1) == 1 and 2 not in [x[0] for x in kept] and len(kept) == len(whole) - 3
    kept = dict(count("suffix_array_dedup"))
    assert {1, 3, 6, 7} <= set(kept) and not {2, 4, 5} & set(kept)
    assert len(count("benchmark_decontamination")) == len(whole)
    pieces = rows["best_fit_packing"].collect()
    assert {r["doc_id"] for r in pieces} == {r[0] for r in _hostile()} and sum(r["doc_id"] == 1 for r in pieces) == 2


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], KINDS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        assert out.count() == 0
        assert name == "best_fit_packing" or out.columns == NAMES


def test_results_outlive_other_calls(spark):
    """A result can be read after other operators have cleaned up behind themselves."""
    from siltstone.llm import jaccard_join, suffix_dedup, token_counts

    import public_tokenizers

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    first = [jaccard_join.components(docs), suffix_dedup.dedup(docs), token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))]
    for _, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, docs, DIR).count()
    assert all(x.count() == docs.count() for x in first)
