"""Operators on rows that share a doc_id, on null ids, and on columns that clash with the operators' own."""

import hashlib
import random

import pytest

from siltstone.llm import suffix_dedup

LENGTH = 100


def brute(rows):
    """Rows with ids, in order -> number of removed bytes."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        gone = bytearray(len(t))
        for p in range(len(t) - LENGTH + 1):
            w = t[p : p + LENGTH]
            if w in seen:
                gone[p : p + LENGTH] = b"\1" * LENGTH
            seen.add(w)
        out.append((i, len(t), sum(gone)))
    return sorted(out, key=str)


def text(rng, n):
    return " ".join(f"w{rng.randrange(10**4)}" for _ in range(n))


def hostile(seed=3):
    """Common 32-byte strings between other words, long passages, copies, a long text of short periods."""
    rng = random.Random(seed)
    common, passage = text(rng, 9), text(rng, 60)
    rows = [(i, f"{text(rng, 12)} {common} {text(rng, 12)}") for i in range(40)]
    rows += [(100 + i, f"{text(rng, 20)} {passage} {text(rng, 20)} {passage}") for i in range(12)]
    rows += [(200, "ab" * 3000), (201, rows[3][1]), (202, text(rng, 2000)), (203, ""), (204, "x")]
    return rows


@pytest.mark.parametrize("portion", [suffix_dedup.PORTION, 150, 1000])
def test_suffix_dedup_in_portions(spark, portion):
    rows = hostile()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.dedup(df, LENGTH, portion).collect()), key=str)
    assert got == brute([(i, t.encode()) for i, t in rows])


def test_suffix_dedup_keeps_the_first_of_repeated_rows(spark):
    rng = random.Random(8)
    a, b = text(rng, 60), text(rng, 60)
    rows = [(7, a), (7, a), (9, b), (9, b), (9, b), (None, a), (None, text(rng, 40)), (3, text(rng, 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.dedup(df).collect()), key=str)
    assert got == brute([(i, t.encode()) for i, t in rows])


def test_suffix_dedup_with_clashing_columns(spark):
    rng = random.Random(9)
    a = text(rng, 60)
    names = ["doc_id", "text", "spans", "_spans", "row", "row_", "lo", "n_chars", "removed"]
    df = spark.createDataFrame([(1, a, 5, "u", 1, 2, 3, 9, True), (2, a, 6, "v", 1, 2, 3, 9, None), (3, None, None, None, 1, 2, 3, None, None)], "doc_id long, text string, spans int, _spans string, row int, row_ int, lo int, n_chars int, removed boolean")
    out = suffix_dedup.without_repeats(df)
    assert out.columns == names and out.schema == df.schema
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, a, 5, "u", 1, 2, 3, len(a), True), (2, "", 6, "v", 1, 2, 3, 0, None), (3, None, None, None, 1, 2, 3, None, None)], key=str)


def test_kept_digest(spark):
    rng = random.Random(2)
    a, b = text(rng, 40), text(rng, 30)
    df = spark.createDataFrame([(1, a), (2, f"{b}{a}")], "doc_id long, text string")
    kept = {r["doc_id"]: hashlib.sha256(r["kept"]).hexdigest() for r in suffix_dedup.dedup(df).collect()}
    assert kept == {1: hashlib.sha256(a.encode()).hexdigest(), 2: hashlib.sha256(b.encode()).hexdigest()}
