"""Hand-computed cases and invariants of single operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions import stats, text
from siltstone.operators import cluster, dedup, extract, graph, learn, lifecycle, retrieval, scan


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rrf_of_one_list(spark):
    lists = spark.createDataFrame([(1, "fts", i, s) for i, s in ((7, 3.0), (8, 2.0), (9, 1.0))], "query_id int, channel string, id long, score double")
    got = {r["id"]: r["score"] for r in retrieval.rrf(lists, {"fts": 1.0}).collect()}
    assert got == pytest.approx({7: 1 / 61, 8: 1 / 62, 9: 1 / 63})


def test_convex_ties(spark):
    lists = spark.createDataFrame([(1, "fts", 1, 5.0), (1, "fts", 2, 5.0), (1, "vec", 3, 0.2)], "query_id int, channel string, id long, score double")
    assert {r["id"]: r["score"] for r in retrieval.convex(lists, 0.4).collect()} == pytest.approx({1: 0.0, 2: 0.0, 3: 0.6})


def test_permutation_keeps_scores(spark):
    s = spark.createDataFrame([(1, i, float(10 - i)) for i in range(5)], "query_id int, id long, score double")
    order = spark.createDataFrame([(1, 4, 0), (1, 2, 1)], "query_id int, id long, position int")
    got = sorted(retrieval.permuted(s, order).collect(), key=lambda r: r["rank"])
    assert [r["id"] for r in got] == [4, 2, 0, 1, 3] and [r["score"] for r in got] == [10.0, 9.0, 8.0, 7.0, 6.0]


def test_tips_follow_chains_and_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 99), (5, 6), (6, 5)], "id long, superseded_by long")
    assert {r["id"]: r["tip"] for r in retrieval.tips(df).collect()} == {1: 3, 2: 3, 3: 3, 4: 4, 5: 5, 6: 5}


def test_fallback_fills_only_empty_queries(spark):
    a, b = (spark.createDataFrame(x, "query_id int, id long, score double") for x in ([(1, 1, 1.0)], [(1, 2, 1.0), (2, 3, 1.0)]))
    assert {(r["query_id"], r["id"]) for r in retrieval.with_fallback([a, b]).collect()} == {(1, 1), (2, 3)}


def test_kaplan_meier_halves(spark):
    i = spark.createDataFrame([(1, float(d), True) for d in range(1, 11)], "g int, days double, event boolean")
    curve = {r["t"]: r["survival"] for r in lifecycle.kaplan_meier(i, ["g"]).collect()}
    assert curve[5.0] == pytest.approx(0.5) and curve[10.0] == 0.0
    assert lifecycle.median_survival(lifecycle.kaplan_meier(i, ["g"]), ["g"]).first()["median"] == 5.0


def test_curve_value(spark):
    steps = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).alias("s")) for t, s in ((1.0, 0.8), (2.0, 0.4))])
    assert one(spark, lifecycle.curve_value(steps, F.lit(0.5))) == 1.0
    assert one(spark, lifecycle.curve_value(steps, F.lit(1.5))) == 0.8
    assert one(spark, lifecycle.curve_value(steps, F.lit(3.0))) == pytest.approx(0.2)


def test_token_sets(spark):
    assert one(spark, text.tokens(F.lit("The cat, the CAT!  --  x9"))) == ["the", "cat", "x9"]
    assert set(one(spark, text.tokens(F.lit("数据库 ok")))) == {"数据库", "ok", "数据", "据库"}
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0


@pytest.mark.parametrize(("raw", "key"), [("  Rust / Async!! ", "rust-async"), ("A_b", "a-b"), ("--x--", "x")])
def test_topic_key(spark, raw, key):
    assert one(spark, text.topic_key(F.lit(raw))) == key


def test_clip_bytes(spark):
    assert one(spark, text.clip_bytes(F.lit("é" * 10), 7)) == "ééé"
    assert one(spark, text.clip_bytes(F.lit("abc"), 7)) == "abc"


def test_citations_and_redaction(spark):
    assert one(spark, text.citations(F.lit("as [2], [1] and [2] but [9]"), 3)) == [1, 2]
    assert one(spark, text.redact(F.lit("password: hunter2 ok"))) == "password: [REDACTED] ok"


def test_trigrams(spark):
    assert one(spark, text.trigrams_kept(F.lit("The cat"), F.lit("see the cat run"))) == 1.0
    assert one(spark, text.trigrams_kept(F.lit("xyzw"), F.lit("abc"))) == 0.0


def test_statistics():
    assert stats.mcnemar(10, 0, 0, 0)["p"] == 1.0
    assert stats.mcnemar(0, 1, 9, 0)["p"] == pytest.approx(2 * 11 / 1024)
    assert stats.clopper_pearson_upper(0, 149) == pytest.approx(1 - 0.05 ** (1 / 149)) and stats.clopper_pearson_upper(0, 149) <= 0.02
    assert stats.binomial_cdf(1, 10, stats.clopper_pearson_upper(1, 10)) == pytest.approx(0.05)
    assert stats.kappa(20, 5, 10, 15) == pytest.approx(0.4)
    assert stats.kappa(5, 0, 0, 0) == 1.0
    assert stats.expected_improvement(1.0, 0.0, 0.5) == 0.5
    assert stats.verdict(-0.01, 0.1) == "ship" and stats.verdict(-0.2, -0.03) == "bail" and stats.verdict(-0.1, 0.1) == "no_data"
    low, high = stats.bootstrap_interval([0.0, 1.0] * 50)
    assert low < 0.5 < high


def test_hdbscan_separates_directions():
    rng = np.random.default_rng(0)
    centers = np.eye(3, 8) * 5
    x = np.concatenate([c + rng.normal(0, 0.1, (30, 8)) for c in centers])
    labels = cluster.hdbscan(x, 5, 5)
    groups = [set(labels[i * 30 : (i + 1) * 30].tolist()) - {-1} for i in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert (cluster.hdbscan(x[:3], 5, 5) == -1).all()


def test_anchors():
    today = dt.date(2024, 3, 13)
    got = extract.anchors("On 2024-01-05 and in January 2023, yesterday, last week, 3 days ago, since 2020, bad 2024-13-40", today)
    assert [(k, a, b) for k, a, b, _ in got] == [
        ("day", dt.date(2024, 1, 5), dt.date(2024, 1, 6)), ("month", dt.date(2023, 1, 1), dt.date(2023, 2, 1)), ("day", dt.date(2024, 3, 12), dt.date(2024, 3, 13)),
        ("week", dt.date(2024, 3, 4), dt.date(2024, 3, 11)), ("ago", dt.date(2024, 3, 10), dt.date(2024, 3, 11)), ("year", dt.date(2020, 1, 1), None),
    ]


def test_chunks_fit_and_keep_the_text():
    content = "## One\n\n" + "Sentence here. " * 40 + "\n\n### Two\n\n" + "é" * 300
    out = extract.chunks(content, 50, 0)
    assert sum(c.startswith("#") for c in out) == 2
    assert all(len(c.encode()) <= 200 for c in out)
    assert "".join("".join(out).split()) == "".join(content.split())


def test_chunks_by_hand():
    """Sections, paragraphs, sentences and slices, and the overlap from a word's beginning."""
    assert extract.chunks("", 10, 0) == [] and extract.chunks("short", 10, 0) == ["short"]
    assert extract.chunks("## A\nx\n\n## B\ny\n# C\nz", 512, 0) == ["## A\nx", "## B\ny\n# C\nz"]
    assert extract.chunks("aaaa aaaa\n\nbbbb\n\ncccc cccc cccc", 4, 0) == ["aaaa aaaa\n\nbbbb", "cccc cccc cccc"]
    assert extract.chunks("One two. Three four. Five six.", 5, 0) == ["One two. Three four.", "Five six."]
    assert extract.chunks("é" * 9, 1, 0) == ["éé", "éé", "éé", "éé", "é"]
    assert extract.chunks("One two. Three four. Five six.", 5, 40) == ["One two. Three four.", "four. Five six."]


def test_statements_and_facts(spark):
    """Sentences end at marks before white space, at CJK marks and blank lines; facts like one before are left out."""
    docs = spark.createDataFrame([(1, "We decided on v1.2 today. It uses\na queue! Nothing here\n\nfixed the bug。」我们prefer它。ok"), (2, "We decided to use the new cache. We decided to use the new cache now. Lunch was good.")], "id long, content string")
    got = sorted((r["id"], r["position"], r["fact"], r["score"]) for r in extract.facts(docs).collect())
    assert got == [(1, 0, "We decided on v1.2 today.", 4), (1, 1, "It uses\na queue!", 3), (1, 3, "fixed the bug。」", 3), (1, 4, "我们prefer它。", 4), (2, 0, "We decided to use the new cache.", 4)]


CLASSES = [
    ("What changed last week?", "temporal", 7), ("history of the cache since 2025-01-01", "temporal", None), ("recent changes in the parser", "temporal", 30), ("recently touched files", "temporal", 14),
    ("最近的变化", "temporal", 14), ("which editor do i prefer", "preference", None), ("what did we decide in spring", "episodic", None), ("what happened in the meeting yesterday", "episodic", None),
    ("foo_bar.rs", "exact", None), ("redis cache", "exact", None), ("open recent_files.rs and look for the bug", "exact", None), ('find "exact words" in all of the notes', "exact", None), ("数据库", "exact", None),
    ("how does the cache work with threads", "semantic", None), ("tell me about the storage layer design", "exploratory", None), ("what do we know on the storage engine", "exploratory", None), ("why rust", "semantic", None), ("fn main of the server crate here", "exact", None),
]


def test_query_classes(spark):
    q = spark.createDataFrame([(i, x[0]) for i, x in enumerate(CLASSES)], "i int, q string")
    got = {r["i"]: (r["type"], r["days_back"]) for r in q.select("i", extract.classify(F.col("q")).alias("c")).select("i", "c.*").collect()}
    assert {CLASSES[i][0]: v for i, v in got.items()} == {x[0]: (x[1], x[2]) for x in CLASSES}


def test_secrets(spark):
    lines = [("password = hunter2", True), ("Authorization: Bearer abc.def", True), ("a basket of fruit", False), ("ghp_" + "a" * 36, True), ("AKIA" + "A" * 16, True), ("nothing secretive", False), ("api_key=1", True)]
    df = spark.createDataFrame([(x,) for x, _ in lines], "x string")
    assert [r[0] for r in df.select(text.is_secret(F.col("x"))).collect()] == [y for _, y in lines]
    pem = "a\n-----BEGIN RSA PRIVATE KEY-----\nMII\nxyz\n-----END RSA PRIVATE KEY-----\nb token: t0 \"secret\": \"s\""
    got = spark.createDataFrame([(pem,)], "x string").select(text.redact(F.col("x"))).first()[0]
    assert got == "a\n[REDACTED_PEM_BLOCK]\nb token: [REDACTED] \"secret\": \"[REDACTED]\""


def test_gray_zone_bounds(spark):
    df = spark.createDataFrame([(0.34, 0.1), (0.35, 0.1), (0.42, 0.1), (0.5, 0.1), (0.7, 0.1), (0.71, 0.1), (0.1, 0.61), (0.1, 0.86)], "l double, v double")
    got = [tuple(r) for r in df.select(dedup.band(F.col("l"), F.col("v")), dedup.band(F.col("l"), F.col("v"), judged=False)).collect()]
    assert got == [("create_new",) * 2, ("gray_zone", "create_new"), ("gray_zone", "create_new"), ("gray_zone",) * 2, ("gray_zone",) * 2, ("merge",) * 2, ("gray_zone",) * 2, ("merge",) * 2]


def test_triples(spark):
    docs = spark.createDataFrame([(1, "I prefer dark mode. The team uses Spark on Linux servers in Rome.")], "id long, content string")
    got = {(r["subject"], r["predicate"], r["object"]) for r in extract.triples(docs).collect()}
    assert ("user", "prefers", "dark mode") in got and ("team", "uses", "Spark on Linux servers") in got


def test_bfs_takes_least_depth(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "source string, target string")
    assert {r["id"]: r["depth"] for r in graph.bfs(links, spark.createDataFrame([("a",)], "id string"), 3).collect()} == {"a": 0, "b": 1, "c": 1}


def test_concept_dedup_moves_links(spark):
    c = spark.createDataFrame([(1, "m", "Big Data", "x", [5], 1), (2, "m", "big_data", "longer", [6, 7], 2), (3, "m", "other", "", [], 3)], "id long, memoir string, name string, definition string, source_memory_ids array<long>, created_at int")
    links = spark.createDataFrame([(1, 2, "r", 0.5), (2, 3, "r", 0.4), (1, 3, "r", 0.6)], "source long, target long, relation string, weight double")
    kept, moved = graph.dedup_concepts(c, links)
    got = {r["id"]: (r["definition"], r["source_memory_ids"]) for r in kept.collect()}
    assert got[1] == ("longer", [5, 6, 7]) and set(got) == {1, 3}
    assert [tuple(r) for r in moved.collect()] == [(1, 3, "r", 0.6)]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["root"] for r in dedup.components(links).collect()}
    assert set(got.values()) == {1, 100} and got[40] == 1


def test_decisions(spark):
    c = spark.createDataFrame(
        [(1, None, None, None, None, None), (2, 10, 0.3, 0.9, 1.0, False), (3, 10, 0.3, 0.7, 1.0, False), (4, 10, 0.8, 0.1, 9.0, False), (5, 10, 0.8, 0.1, 1.0, False), (5, 11, 0.9, 0.1, 1.0, False), (6, 10, 0.6, 0.2, 1.0, False)],
        "new_id long, old_id long, lexical double, vector double, age_days double, contains boolean",
    )
    got = {r["new_id"]: (r["action"], r["targets"]) for r in dedup.decide(c, 0.7).collect()}
    assert got == {1: ("create_new", []), 2: ("merge_into", [10]), 3: ("gray_zone", [10]), 4: ("supersede", [10]), 5: ("merge_into_many", [11, 10]), 6: ("create_new", [])}


def test_sweep_and_best_threshold(spark):
    x = spark.createDataFrame([(0.9, True), (0.8, True), (0.6, False), (0.2, False)], "sim double, is_duplicate boolean")
    s = dedup.sweep(x)
    assert s.count() == 14
    r = dedup.best_threshold(s).first()
    assert (r["best"], r["safe"]) == (0.75, 0.6)


def test_best_alpha(spark):
    c = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0, 1), (1, 2, 0.0, 1.0, 0.0, 0), (2, 1, 1.0, 1.0, 0.0, 1), (2, 2, 0.0, 0.0, 0.0, 0)], "event long, id long, bm25 double, vec double, rest double, label int")
    assert [(r["event"], r["alpha"]) for r in learn.best_alpha(c).collect()] == [(1, 0.5)]


def test_best_alpha_goes_on_with_a_fine_grid(spark):
    """The used row is first from 0.43 on; the coarse grid says 0.45, the fine one the first of equals around it."""
    c = spark.createDataFrame([(1, 1, 0.57, 0.0, 0.0, 1), (1, 2, 0.0, 0.43, 0.0, 0)], "event long, id long, bm25 double, vec double, rest double, label int")
    assert [(r["event"], r["alpha"], r["reward"]) for r in learn.best_alpha(c).collect()] == [(1, 0.45, 1.0)]
    c = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.5, 1), (1, 2, 0.0, 1.0, 0.48, 0), (1, 3, 0.505, 0.505, 0.49, 0)], "event long, id long, bm25 double, vec double, rest double, label int")
    got = learn.best_alpha(c).first()
    assert got["reward"] == 1.0 and got["alpha"] == pytest.approx(0.5)


def test_weights_by_brute_force():
    """Rewards with ties, and the search never falls below its own candidates."""
    from siltstone.operators import weights

    rng = np.random.default_rng(4)
    assert len(weights._fixed()[0]) == 52 and len(weights._fixed()[1]) == math.comb(15, 5) and np.allclose(weights._fixed()[1].sum(1), 1)
    for _ in range(30):
        x, label = rng.integers(0, 3, (5, 6)) / 2, rng.integers(-1, 2, 5).astype(float)
        w = rng.dirichlet(np.ones(6), 4)
        want = []
        for row in w @ x.T:
            order = sorted(range(5), key=lambda i: -row[i])
            rr = {i: [] for i in range(5)}
            for i in range(5):
                tied = [r for r, j in enumerate(order) if abs(row[i] - row[j]) < 1e-12]
                rr[i] = sum(1 / (r + 1) for r in tied) / len(tied)
            want.append(sum(label[i] * rr[i] for i in range(5)))
        assert np.allclose(weights.rewards(w @ x.T, label), want)
        if (found := weights.search(x, label)) is not None:
            start = weights.rewards(weights._fixed()[0] @ x.T, label)
            assert found[0].sum() == pytest.approx(1) and found[1] >= start.max() - 1e-12
    assert weights.search(np.ones((3, 6)), np.array([1.0, 0, 0])) is None
    assert weights.search(np.eye(6)[:3], np.zeros(3)) is None


def test_pairs_against_brute_force(spark):
    """Prefixes lose no pair at any bound, with words that all rows have, empty rows and subsets."""
    import random

    rng = random.Random(3)
    rows = [(i, i % 2, sorted({"the", "a", *(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 12)))})) for i in range(60)] + [(60, 0, []), (61, 0, ["the"]), (62, 1, ["only"])]
    df = spark.createDataFrame(rows, "id long, g int, tokens array<string>")
    for bound in (0.0, 0.3, 0.5, 0.7, 0.99):
        want = {}
        for i, g, x in rows:
            for j, h, y in rows:
                if i < j and g == h and x and y and (k := len(set(x) & set(y))):
                    c = k / min(len(x), len(y))
                    if c > bound:
                        want[i, j] = (round(k / (len(x) + len(y) - k), 9), round(c, 9))
        got = {(r["a"], r["b"]): (round(r["jaccard"], 9), round(r["containment"], 9)) for r in dedup.pairs(df, ["g"], bound).collect()}
        assert got == want, bound


def test_novelty_and_sources_both_ways(spark, monkeypatch):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"]), (3, [])], "id long, tokens array<string>")
    stored = spark.createDataFrame([(7, ["a", "b", "d"]), (8, ["c"])], "id long, tokens array<string>")
    outside = spark.createDataFrame([("s", 1, ["a", "b", "d"]), ("s", 2, ["a", "b", "c"]), ("t", 3, ["a", "c"])], "source string, key long, tokens array<string>")
    for most in (10, 0):
        monkeypatch.setattr(dedup, "STORED_ROWS", most)
        assert {r["id"]: r["novelty"] for r in dedup.novelty(rows, stored).collect()} == {1: 0.0, 2: 1.0, 3: 1.0}
        assert {r["id"]: r["sources"] for r in retrieval.corroborated(rows, outside, 0.4).collect()} == {1: 3, 2: 1, 3: 1}


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 8)).astype("float32")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(50, None)], "id long, embedding array<float>")
    q = df.filter("id < 9").withColumnRenamed("id", "query_id")
    one, many = ({(r["query_id"], r["rank"]): r["id"] for r in retrieval.nearest(df, q, 4, block).collect()} for block in (100, 2))
    assert one == many and len(one) == 36 and all(one[i, 1] == i for i in range(9))


def test_rerank_fold_keeps_the_subtotal():
    w = {"a": 0.5, "b": 0.3, "c": 0.2}
    out = learn.rerank_step(w, [({"a": 1.0, "b": 0.0}, 1.0), ({"a": 0.0, "b": 1.0}, -1.0)])
    assert out["a"] > w["a"] and out["a"] + out["b"] == pytest.approx(0.8) and out["c"] == 0.2


def test_deleted_scrubs_references(spark):
    df = spark.createDataFrame([(1, [2, 3]), (2, []), (3, [2])], "id long, related array<long>")
    got = {r["id"]: r["related"] for r in scan.deleted(df, spark.createDataFrame([(2,)], "id long"), ("related",)).collect()}
    assert got == {1: [3], 3: []}


def test_violations(spark):
    rows = [("a", "medium", "stm", "active", "hot", 0.5, None), ("a", "odd", "stm", "active", "hot", 1.5, "a")]
    df = spark.createDataFrame(rows, "id string, importance string, layer string, status string, tier string, strength double, superseded_by string")
    assert {(r["id"], r["rule"]) for r in schema.violations(df).collect()} == {("a", "importance"), ("a", "strength outside [0, 1]"), ("a", "supersedes itself"), ("a", "id is not unique")}


def test_fold_is_the_big_number_modulo(spark):
    import hashlib

    assert one(spark, text.fold_of(F.lit("k1"), "s:")) == int(hashlib.sha256(b"s:k1").hexdigest(), 16) % 5


def test_markdown_source(spark, tmp_path):
    from siltstone.sources import readers

    (tmp_path / "a.md").write_text("---\ntitle: Spark notes\n---\nshuffle and skew")
    (tmp_path / "b.md").write_text("# Garden\nroses")
    got = readers.markdown(spark, f"file://{tmp_path}/*.md", "spark skew").collect()
    assert [(r["title"], r["score"]) for r in got] == [("Spark notes", 2)]


def test_session_source(spark, tmp_path):
    from siltstone.sources import readers

    (tmp_path / "s.json").write_text('{"session_id":"1","turns":[{"role":"user","content":"hi"},{"role":"bot","content":"yo"}]}\n')
    r = readers.session_files(spark, str(tmp_path)).first()
    assert (r["n_turns"], r["transcript"]) == (2, "user: hi\nbot: yo")


def test_stream_counts_once(spark, tmp_path):
    from siltstone.streaming import events as st

    for i in range(3):
        spark.createDataFrame([(i * 10 + k, k % 2, "view") for k in range(10)], "event_id long, user_id int, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = st.read_events(spark, f"{tmp_path}/in", "event_id long, user_id int, event_type string")
    fold = st.counter_fold(f"{tmp_path}/state", ["user_id"], {"views": "event_type = 'view'"})

    def twice(batch, batch_id):
        fold(batch, batch_id)
        fold(batch, batch_id)

    st.consume(stream, twice, f"{tmp_path}/checkpoint").awaitTermination()
    assert {r["user_id"]: (r["views"], r["last_id"]) for r in st.versioned(f"{tmp_path}/state")(spark).collect()} == {0: (15, 28), 1: (15, 29)}


def test_log_sum_survival_is_monotone(spark):
    i = spark.createDataFrame([(1, float(d % 7), d % 3 > 0) for d in range(50)], "g int, days double, event boolean")
    s = [r["survival"] for r in lifecycle.kaplan_meier(i, ["g"]).orderBy("t").collect()]
    assert s == sorted(s, reverse=True) and all(0 <= x <= 1 and math.isfinite(x) for x in s)


def test_variants_are_unlike_each_other(spark):
    v = F.array(*[F.lit(x) for x in ("fast cache store", "cache store fast", "slow disk", "slow disk", "other words here")])
    got = one(spark, text.kept_variants(F.lit("Fast Cache  store"), v, F.lit(5)))
    assert got == ["slow disk", "other words here"]
    assert one(spark, text.kept_variants(F.lit("x"), v, F.lit(2))) == ["fast cache store", "slow disk"]


def test_store_applies_decisions(spark):
    """Merges fold new rows and further targets into the winner, superseded rows stay as history, gray pairs wait."""
    from siltstone.operators import store

    row = lambda i, content, n=1: (i, "t", f"s{i}", content, ["k"], "medium", n, 0.5, 0.1, "stm", "active", None)
    schema = "id long, topic string, summary string, content string, keywords array<string>, importance string, access_count int, strength double, decay_lambda double, layer string, status string, superseded_by long"
    rows = spark.createDataFrame([row(1, "a"), row(2, "b"), row(3, "c"), row(4, "d")], schema)
    new = spark.createDataFrame([row(11, "a\nnew line", 5), row(12, "x"), row(13, "y"), row(14, "z"), row(15, "more")], schema)
    decisions = spark.createDataFrame([(11, "merge_into_many", [1, 2]), (12, "create_new", []), (13, "supersede", [3]), (14, "gray_zone", [4]), (15, "merge_into", [1])], "new_id long, action string, targets array<long>")
    out, ledger, outbox = store.store(rows, new, decisions, "2024-03-01")
    got = {r["id"]: r for r in out.collect()}
    assert set(got) == {1, 2, 3, 4, 12, 13, 14}
    assert got[1]["content"] == "a\n[merged 2024-03-01]\nb\n[merged 2024-03-01]\nnew line\n[merged 2024-03-01]\nmore"
    assert got[1]["access_count"] == 1 + (1 + 1) + (5 + 1) + (1 + 1)
    assert (got[2]["status"], got[2]["superseded_by"]) == ("updated", 1) and (got[3]["status"], got[3]["superseded_by"]) == ("deprecated", 13)
    assert ledger.count() == 5 and [tuple(r) for r in outbox.collect()] == [(14, 4, "pending")]
    verdicts = spark.createDataFrame([(14, 4, "merge")], "new_id long, old_id long, verdict string")
    assert [tuple(r) for r in store.resolved(outbox, verdicts).collect()] == [(14, "merge_into", [4])]
    assert store.drained(outbox, verdicts).count() == 0


def test_replaced_rows_leave_evidence(spark):
    from siltstone.operators import store

    rows = spark.createDataFrame([(1, "t", "a"), (2, "t", "b"), (3, "u", "c")], "id long, topic string, summary string")
    out, evidence = store.replaced(rows, rows.filter("id < 3"), spark.createDataFrame([(9, "t", "ab")], "id long, topic string, summary string"))
    assert sorted(r["id"] for r in out.collect()) == [3, 9] and sorted(r["memory_id"] for r in evidence.collect()) == [1, 2]


def test_novel_lines_end_in_digits_and_spaces(spark):
    """The number of a line must not be taken for characters to trim; all Unicode spaces are trimmed, and no tabs."""
    lines = one(spark, text.novel_lines(F.lit("0 zero 0\n 1 one 1　\n2\n\ttwo 2"), F.lit("x\nTWO 2\n2  ")))
    assert lines == ["0 zero 0", "1 one 1", "\ttwo 2"]
    assert one(spark, text.sentences(F.lit("a 0. b 1. c 2"))) == ["a 0", "b 1", "c 2"]


def test_tiles_of_any_size(spark):
    """Pairs, asked pairs, candidates and counts are those of brute force, however a block is dealt into tiles."""
    import random

    rng = random.Random(5)
    rows = [(i, None if i == 9 else i % 2, sorted({f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randint(0, 9))})) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, g int, tokens array<string>")
    sims = {}
    for i, g, x in rows:
        for j, h, y in rows:
            if i != j and g == h and None not in (g, h) and (k := len(set(x) & set(y))) and k / min(len(x), len(y)) > 0.3:
                sims[i, j] = (k / min(len(x), len(y)), k / (len(x) + len(y) - k))
    asked = [i for i in range(70) if i % 3 == 0]
    for side in (10**6, 25):
        got = [(r["a"], r["b"], r["sim"], r["jaccard"]) for r in dedup.pairs(df, ["g"], 0.3, side=side).collect()]
        assert sorted(got) == sorted((i, j, *s) for (i, j), s in sims.items() if i < j)
        some = dedup.pairs(df, ["g"], 0.3, spark.createDataFrame([(i,) for i in asked], "id long"), side=side)
        assert sorted((r["a"], r["b"]) for r in some.collect()) == sorted((i, j) for i, j in sims if i < j and (i in asked or j in asked))
        n = {}
        for r in dedup.tallied(df, ["g"], 0.3, 0.7, [0.5, 0.9], side=side).collect():
            key = sum(r["sim"] > t for t in (0.5, 0.9)), r["is_duplicate"]
            n[key] = n.get(key, 0) + r["n"]
        want = {}
        for (i, j), (c, v) in sims.items():
            key = sum(c > t for t in (0.5, 0.9)), v > 0.7
            want[key] = want.get(key, 0) + (i < j)
        assert n == {k: v for k, v in want.items() if v}
        for smaller in (False, True):
            best = {}
            for r in dedup.candidates(df, ["g"], 0.3, F.col("id") % 2 < 5, None, 2, smaller, side).collect():
                best.setdefault(r["id"], []).append((-r["sim"], r["other"], -r["jaccard"]))
            for i in range(70):
                mine = sorted((-c, j, -v) for (k, j), (c, v) in sims.items() if k == i and (j < i or not smaller))
                found = sorted(best.get(i, []))
                assert found[:2] == mine[:2] and set(found) <= set(mine)
                assert min(((v, j) for _, j, v in mine), default=None) == min(((v, j) for _, j, v in found), default=None)


def test_concepts_of_equal_fields_are_scored_once(spark, monkeypatch):
    """Copies of concepts and of queries change neither scores nor ranks, and don't reach the scoring."""
    from siltstone.operators import concepts, retrieval

    names = ["red ring", "red bolt", "blue ring", "red red ring", None]
    rows = [(i, names[i % 5 if i < 40 else 0], ["x ring", "y", None][i % 3], "b") for i in range(60)]
    table = spark.createDataFrame(rows, "id long, name string, definition string, labels string")
    queries = spark.createDataFrame([(i, ["Red ring", "ring red", "blue", "absent ring", "  "][i % 5]) for i in range(20)], "query_id long, query string")
    asked = queries.select("query_id", concepts.text.sanitize_query(F.lower("query")).alias("terms"))
    each = retrieval.bm25(retrieval.postings(table, concepts.FIELDS), retrieval.field_stats(table, concepts.FIELDS), asked, all_terms=True)
    want = retrieval.top_k(each.withColumn("score", F.round("score", 9)), 7).select("query_id", "id", "score", "rank")
    sizes, plain = [], retrieval.bm25
    monkeypatch.setattr(retrieval, "bm25", lambda *x, **y: sizes.append(plain(*x, **y).count()) or plain(*x, **y))
    got = concepts.search(table, queries, 7)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == 3 * 4 * 7
    assert sizes[0] <= 2 * 15


def test_events_are_searched_together(spark):
    """Many events at once have the results of each by itself: without a signal, with equal and with missing features."""
    from siltstone.operators import weights

    rng = np.random.default_rng(5)
    rows, want = [], {}
    for event in range(120):
        n = 1 + event % 6
        x, label = np.round(rng.random((n, 6)), event % 3 + 1), rng.choice([-1.0, 0.0, 1.0], n)
        if event % 10 == 0:
            x[:, 1:] = 0
        if event % 10 == 1:
            x[0, 2] = np.nan
        if (found := weights.search(x, label)) is not None:
            want[event] = found
        rows += [(event, i, x[i].tolist(), float(label[i])) for i in range(n)]
    got = {r["event"]: r for r in weights.best_weights(spark.createDataFrame(rows, "event long, id long, features array<double>, label double")).collect()}
    assert got.keys() == want.keys() and len(want) > 40
    for event, (w, reward) in want.items():
        assert np.allclose(got[event]["weights"], w, atol=1e-9) and abs(got[event]["reward"] - reward) < 1e-9
    assert [r is None for r in weights.search_many(np.stack([np.eye(6)[:3], np.ones((3, 6))]), np.array([[1.0, 0, 0]] * 2))] == [False, True]


def test_hits_of_episodes_are_added_up_in_place(spark, monkeypatch):
    """Hits for a table of queries are those of each query by itself, in one pass and in several, and no pattern's hits are
    shuffled before they are added up."""
    from siltstone.operators import graph

    rows = [(i, ["The cache", "a session in the cache", "", None, "redis"][i % 5], ["user", "agent user"][i % 2], i, 3 + i % 4, 1) for i in range(40)]
    e = spark.createDataFrame(rows, "id long, title string, tags string, age_days long, n_memories long, n_concepts int")
    asked = ["the cache", "session user", "nothing", "  Redis  ", "", "in the session"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    want = {(k, r["id"]): r["score"] for k, x in enumerate(asked) if x.strip() for r in graph.episode_scores(e, x, F.col("age_days"), ("title", "tags")).collect()}
    for most in (200_000, 3):
        monkeypatch.setattr(graph, "PATTERNS", most)
        got = graph.episode_hits(q, e, ("title", "tags"))
        assert {(r["query_id"], r["id"]): pytest.approx(r["score"]) for r in got.collect()} == want
        assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
