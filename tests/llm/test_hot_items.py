"""Decontamination against the alignment of every document with every item."""

import random

import pytest

from siltstone.llm import decontamination


def prose(rng, n, pool):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def test_partial_copies_of_a_hot_passage(spark):
    rng = random.Random(9)
    hot, cold, long = prose(rng, 60, 5000), prose(rng, 40, 5000), prose(rng, 30, 60)
    docs = [prose(rng, 80, 5000) + hot[:35] + prose(rng, 20, 5000) for _ in range(60)]  # many copy the first part
    docs += [prose(rng, 10, 5000) + hot + prose(rng, 10, 5000) for _ in range(3)]  # a few copy it all
    docs += [hot[:20] + prose(rng, 20, 5000) for _ in range(5)]  # too little of it
    docs += [cold[:10] + ["x"] + cold[11:30], prose(rng, 4000, 60) + long[:18] + prose(rng, 3000, 60) + long + prose(rng, 500, 60)]
    docs += [prose(rng, rng.randint(1, 300), 5000) for _ in range(60)]
    items = [hot, cold, long]
    words = decontamination.Words()
    want = {}
    for d, t in enumerate(docs):
        for i, item in enumerate(items):
            own, text = words.of(" ".join(item).encode()), words.of(" ".join(t).encode())
            score = decontamination.align(own, text)[0]
            if score >= 0.5 * len(own) and set(decontamination.seeds_of(own).tolist()) & set(decontamination.seeds_of(text).tolist()):
                want[d, i] = score
    assert sum(i == 0 for _, i in want) == 63
    rows = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    for most in (decontamination.MOST_WORDS, 20):  # all items in one pass, and a few in each
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contaminated(rows, bench, most_words=most).collect()}
        assert got == want


def slow_align(item, passage):
    """Smith-Waterman cell by cell."""
    best = 0.0
    s = [[0.0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            s[i][j] = max(0.0, s[i - 1][j - 1] + (1.0 if item[i - 1] == passage[j - 1] else -0.5), s[i - 1][j] - 0.5, s[i][j - 1] - 0.5)
            best = max(best, s[i][j])
    return best


def test_alignment_cell_by_cell():
    """Scores are those of the whole matrix; the place and the matches that come with one explain it."""
    import numpy as np

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 14))] for _ in range(2))
        score, matched, lo, hi = decontamination.align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == slow_align(a, b)
        if score:
            assert 0 <= lo < hi <= len(b) and slow_align(a, b[lo:hi]) == score and matched >= score
            assert decontamination.align(np.array(a, np.uint64), np.array(b[lo:hi], np.uint64))[0] == score


def test_every_document_with_every_item(spark):
    """Edited copies, nulls, empty and long texts, repeated rows and equal items against brute force."""
    import numpy as np

    rng = random.Random(12)
    items = [(i, prose(rng, rng.randint(3, 25), 300)) for i in range(12)] + [(3, prose(rng, 9, 300)), (12, ["one", "two"])]
    docs = [(d, prose(rng, rng.randint(0, 60), 300)) for d in range(40)]
    for d, (_, item) in enumerate(items * 2):
        w = [x for x in item if rng.random() > 0.15]
        docs.append((100 + d, prose(rng, 20, 300) + w + prose(rng, rng.choice([3, 2000]), 300)))
    docs += [docs[-1], (100, docs[45][1])]
    words = decontamination.Words()
    want = {}
    for d, t in docs:
        text = words.of(" ".join(t).encode())
        for i, item in items:
            own = words.of(" ".join(item).encode())
            if len(own) < decontamination.SEED or not np.isin(decontamination.seeds_of(own), decontamination.seeds_of(text)).any():
                continue
            score = decontamination.align(own, text)[0]
            if score >= 0.5 * len(own):
                want[d, i] = max(score, want.get((d, i), 0))
    rows = spark.createDataFrame([(d, " ".join(t), 1.0) for d, t in docs] + [(900, None, 2.0), (901, "", None)], "doc_id long, text string, score double").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items] + [(50, None), (51, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contaminated(rows, bench).collect()}
    assert got == want and len(got) > 20
    assert decontamination.contaminated(rows.limit(0), bench).count() == 0 and decontamination.contaminated(rows, bench.limit(0)).count() == 0


@pytest.mark.parametrize("end", [10, 1000, 1001, 3333])
def test_blocks_cover_every_span(end):
    span = 33
    found = list(decontamination.blocks([[-20, end + 50]], span, end))
    assert found[0][0] == 0 and found[-1][1] == end
    assert all(any(lo <= p and min(p + span, end) <= hi for lo, hi in found) for p in range(end))
