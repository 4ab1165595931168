"""op6 with more pairs than workers hold: no position of a text is shuffled, and only grams of frequent parts are counted."""

import random
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import suffix_tree_lm as lm
from siltstone.llm.common import Scratch
from siltstone.llm.shingles import Words


def _rows():
    rng = random.Random(3)
    phrase = [" ".join(f"w{rng.randrange(40)}" for _ in range(6)) for _ in range(6)]
    return [(i, " ".join(rng.choice(phrase) if rng.random() < 0.7 else f"x{rng.randrange(400)}" for _ in range(25))) for i in range(60)] + [(100, ""), (101, None), (102, "w1")]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held", [1, 3, 10_000])
def test_parts_of_the_tree_score_without_a_shuffle(spark, monkeypatch, held):
    docs = spark.createDataFrame(_rows(), "doc_id long, text string").repartition(3)
    one = lambda settings: sorted((r["doc_id"], r["score"]) for r in lm.scores(docs, settings, 200).collect())
    want = one(lm.Settings(least=3, deviations=0.0))
    parts, made = [], lm.part_of

    def seen(*a):
        parts.append(made(*a))
        return parts[-1]

    monkeypatch.setattr(lm, "part_of", seen)
    monkeypatch.setattr(lm, "HELD", held)
    got = one(lm.Settings(least=3, deviations=0.0, most=20))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-9)
    assert len(parts) == parts[0].of and (len(parts) == 1) == (held == 10_000)
    keys = [k for p in parts for level in p.nodes for k in level[0].tolist()]
    assert keys and len(keys) == len(set(keys))
    rows = spark.createDataFrame(_rows(), "row long, text string")
    assert "Exchange" not in _plan(lm.gains(rows, parts[0]))


def test_only_grams_of_frequent_parts_are_counted(spark):
    docs = spark.createDataFrame(_rows(), "doc_id long, text string")
    words, least = Words(), 5
    flat, lengths = lm.symbols(words, [(t or "").encode() for _, t in _rows()])
    brute = [Counter(flat.tolist())] + [Counter(g.tolist()) for _, g, _, _ in lm.grams(flat, lengths, 3)]
    scratch = Scratch(spark)
    counts = scratch.stage(lm.word_counts(scratch, docs).filter(f"n >= {least}"), "frequent")
    bits = lm._bits(counts, "key")
    for k in (1, 2, 3):
        often = scratch.stage(lm._gram_counts(docs, k, bits, bits, least, 100), "grams")
        got = {r["gram"] % 2**64: r["n"] for r in often.collect()}
        assert got == {g: n for g, n in brute[k].items() if n >= least} and got
        bits = lm._bits(often, "gram")
        rare = np.array([g for g, n in brute[k].items() if n < least], np.uint64)
        assert bits.has(np.array(list(got), np.uint64)).all() and bits.has(rare).mean() < 0.1
