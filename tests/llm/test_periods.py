"""Suffix dedup of periodic texts against brute force."""

import random

import pytest

from siltstone.llm import suffix_dedup

LENGTH = 100


def brute_removed(rows, n=LENGTH):
    """doc_id -> removed bytes: those that a window covers which began earlier."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            w = t[p : p + n]
            if w in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(w)
        out[i] = sum(gone)
    return out


def periodic(rng, period, size):
    unit = bytes(rng.choice(b"abcdefghij \n") for _ in range(period))
    return (unit * (size // period + 1))[:size]


def test_every_window_of_a_run_differs():
    rng = random.Random(5)
    for period in range(1, 141):
        text = periodic(rng, period, 500)
        _, _, lo, hi = suffix_dedup.runs_of(text, LENGTH)
        assert lo[0] == 0 and hi[-1] == len(text) - LENGTH and (lo[1:] == hi[:-1] + 1).all()
        assert (hi - lo < LENGTH - suffix_dedup.SEED + 1).all()
        for a, z in zip(lo.tolist(), hi.tolist(), strict=True):
            assert len({text[p : p + LENGTH] for p in range(a, z + 1)}) == z - a + 1, period


@pytest.mark.parametrize("copies", [1, 2])
def test_periods_against_brute_force(spark, copies):
    rng = random.Random(6)
    rows = []
    for period in range(1, 141):
        # 344 bytes of period 69 are a document of sf0.1; copies are cut at other places
        text = periodic(rng, period, 344 + 3 * period)
        for k in range(copies):
            rows.append((10 * period + k, text[17 * k :]))
    df = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.dedup(df, LENGTH).collect()}
    assert got == brute_removed(rows)
