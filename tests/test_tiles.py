"""All pairs of blocks against all pairs in one array."""

import numpy as np
import pytest

from siltstone.operators import retrieval, tiles


@pytest.mark.parametrize(("kind", "rows", "step"), [("float", 40, 70), ("double", 4096, 1000)])
def test_lists_are_those_of_all_pairs(spark, monkeypatch, kind, rows, step):
    """In several steps or one: copies, near copies, zeros, and ids in no order."""
    monkeypatch.setattr(tiles, "FILE", 50)
    monkeypatch.setattr(tiles, "STEP", step)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(230, 7)).astype(np.float32)
    x[20:40], x[41], x[50] = x[19], x[19] + np.float32(1e-4), 0
    ids = rng.permutation(1000)[: len(x)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], f"id long, x array<{kind}>")
    got = {(r["id"], r["place"]): (r["other"], r["value"]) for r in tiles.near_lists(df, len(x), 5, tiles.distance, rows).collect()}
    d = tiles.distance(tiles.unit(x) @ tiles.unit(x).T)
    for i, own in enumerate(ids):
        order = [j for j in np.lexsort((ids, d[i])) if j != i][:5]
        assert [got[own, k + 1] for k in range(5)] == [(ids[j], d[i, j]) for j in order]


def test_neighbour_pairs_rank_to_nine_digits(spark):
    """As their SQL does: of two cosines that are equal to nine digits the smaller id comes first, though it is less near."""
    t = 0.5
    at = lambda a: [float(np.cos(a)), float(np.sin(a))]
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, at(t + 2e-11)), (2, at(t)), (3, None), (4, at(3.0))], "id long, embedding array<double>")
    got = {(r["a"], r["b"]) for r in retrieval.knn_pairs(df, 1).collect()}
    assert (0, 1) in got and (0, 2) not in got


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    assert [(r["a"], r["b"]) for r in retrieval.knn_pairs(df, 3).collect()] == [(1, 2)]
    assert retrieval.knn_pairs(df.limit(0), 3).count() == 0
