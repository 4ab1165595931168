"""Words of texts without spaces, by hand and against all cuts."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import segment, text
from siltstone.operators import extract, lexical

WORDS = {"我": 50, "喜欢": 40, "使用": 30, "数据": 30, "数据库": 25, "库": 10, "编辑": 10, "编辑器": 20, "研究": 20, "研究生": 15, "生命": 20, "命": 5, "的": 100, "起源": 10, "系统": 20, "东京": 20, "京都": 20, "东京都": 15}


@pytest.fixture(scope="module")
def dictionary():
    return segment.Dictionary.of(WORDS)


@pytest.mark.parametrize(("run", "words"), [("研究生命的起源", "研究 生命 的 起源"), ("我喜欢数据库系统", "我 喜欢 数据库 系统"), ("东京都", "东京都"), ("我使用编辑器", "我 使用 编辑器"), ("龘龘数据", "龘 龘 数据"), ("库", "库")])
def test_cuts_by_hand(dictionary, run, words):
    assert dictionary.cut(run) == words.split()


def test_cuts_are_best_of_all():
    rng = random.Random(1)
    letters = "甲乙丙丁"
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 3))): rng.randint(1, 60) for _ in range(25)}
    d = segment.Dictionary.of(counts)
    worth = lambda ws: sum(d.shares.get(w, d.unknown if len(w) == 1 else -math.inf) for w in ws)
    for _ in range(60):
        run = "".join(rng.choice(letters) for _ in range(rng.randint(1, 8)))
        every = [[run[a:z] for a, z in itertools.pairwise((0, *c, len(run)))] for k in range(len(run)) for c in itertools.combinations(range(1, len(run)), k)]
        got = d.cut(run)
        assert "".join(got) == run and worth(got) == pytest.approx(max(map(worth, every)))


def test_columns(spark, dictionary):
    rows = [(1, "我喜欢数据库 and Rust"), (2, None), (3, ""), (4, "plain words"), (5, "use数据库now"), (6, "研究生命")]
    df = segment.spaced(spark.createDataFrame(rows, "id long, content string"), ["content"], dictionary)
    got = {r["id"]: r["content"] for r in df.collect()}
    assert got == {1: "我 喜欢 数据库 and Rust", 2: None, 3: "", 4: "plain words", 5: "use 数据库 now", 6: "研究 生命"}
    tokens = {r["id"]: set(r["t"]) for r in df.select("id", text.tokens(F.col("content")).alias("t")).collect()}
    assert {"我", "喜欢", "数据库", "and", "rust"} <= tokens[1]


def test_query_classes_and_triples(spark, dictionary):
    q = spark.createDataFrame([(1, "数据库系统编辑器"), (2, "研究生命的起源系统数据库")], "query_id int, query string").withColumn("spaced", F.col("query"))
    q = segment.spaced(q, ["spaced"], dictionary)
    kinds = {r["query_id"]: (r["plain"], r["cut"]) for r in q.select("query_id", extract.classify(F.col("query")).type.alias("plain"), extract.classify(F.col("query"), F.col("spaced")).type.alias("cut")).collect()}
    assert kinds == {1: ("semantic", "exact"), 2: ("semantic", "semantic")}  # three words, though eight characters
    docs = spark.createDataFrame([(1, "今天我喜欢编辑器的系统")], "id long, content string")
    assert [tuple(r) for r in extract.triples(docs, dictionary).collect()] == [(1, "user", "prefers", "编辑器")]


def test_lexical_search_finds_words(spark, dictionary, tmp_path):
    docs = spark.createDataFrame([(1, "我喜欢数据库系统"), (2, "研究生命的起源"), (3, "研究生的数据")], "id long, content string")
    index = lexical.LexicalIndex(spark, f"file://{tmp_path}/x", dictionary=dictionary)
    index.build(docs)
    q = lexical.terms_of(spark.createDataFrame([(1, "数据库"), (2, "研究生"), (3, "生命起源")], "query_id int, query string"), dictionary)
    got = {(r["query_id"], r["id"]) for r in index.reader().search(q, 5).collect()}
    assert got == {(1, 1), (2, 3), (3, 2)}


def test_words_of_a_corpus(spark):
    rng = random.Random(2)
    words = ["数据库", "系统", "研究", "生命", "东京"]
    docs = spark.createDataFrame([("".join(rng.choice([*words, *"的了在和是我你他"]) for _ in range(12)),) for _ in range(300)], "t string")
    found = {r["word"] for r in segment.corpus_words(docs, "t", least=10).collect()}
    assert set(words) - found == set() and not {"库系", "统研"} & found
    d = segment.Dictionary.read(segment.corpus_words(docs, "t", least=10))
    assert d.cut("我研究生命的数据库") == ["我", "研究", "生命", "的", "数据库"]
