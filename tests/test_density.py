"""HDBSCAN in blocks against the version in one task."""

import numpy as np
import pytest

from siltstone.operators import cluster, density

SCHEMA = "id long, embedding array<double>"


def sample(seed, n):
    """Clusters of several densities, noise, copies (distances of 0) and a zero vector."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(5, 6))[rng.integers(0, 5, n)] + rng.choice([0.05, 0.2], (n, 1)) * rng.normal(size=(n, 6)), rng.normal(size=(n // 5, 6))])
    x[3:9] = x[2]
    x[10] = 0
    ids = rng.permutation(10 * len(x))[: len(x)]
    return ids, x


@pytest.mark.parametrize(("seed", "n", "least", "samples", "batch"), [(1, 150, 5, 5, 40), (2, 90, 4, 2, 1000)])
def test_blocks_give_what_one_task_gives(spark, monkeypatch, seed, n, least, samples, batch):
    monkeypatch.setattr(density, "BLOCK", 70)
    ids, x = sample(seed, n)
    order = np.argsort(ids)
    want = dict(zip(ids[order].tolist(), cluster.hdbscan(x[order], least, samples).tolist(), strict=True))
    assert len(set(want.values())) > 2
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = {r["id"]: r["label"] for r in density.clusters(vectors, least, samples, batch=batch).collect()}
    assert got == want


def test_merges_in_sums_are_merges_of_points():
    """Thousands of points, batches of any size: same labels."""
    rng = np.random.default_rng(6)
    for n, least, batch in ((1500, 5, 100), (1500, 20, 7), (400, 2, 1), (60, 30, 10)):
        edges = sorted((round(float(rng.choice([0.0, rng.random(), 0.5])), 2), min(i, j), max(i, j)) for i in range(1, n) for j in [int(rng.integers(max(0, i - 40), i))])
        f = cluster.Forest(n, least)
        for w, u, v in edges:
            f.merge(u, v, 1 / w if w > 0 else np.inf)
        want = np.full(n, -1 if f.kids else 0)
        for c, members in enumerate(f.select()):
            at = np.array(members)
            want[at[want[at] < 0]] = c
        c, state = density.Condensed(least), {i: (i, 1, None, None) for i in range(n)}
        for i in range(0, len(edges), batch):
            part = [{"w": w, "ga": state[u][0], "sa": state[u][1], "ca": state[u][2], "gb": state[v][0], "sb": state[v][1], "cb": state[v][2]} for w, u, v in edges[i : i + batch]]
            met = {r[0]: r[1:] for r in c.follow(part)}
            state = {p: (*met[s[0]][:3], s[3] if s[3] is not None else met[s[0]][3]) if s[0] in met else s for p, s in state.items()}
        labels = c.labels()
        got = [labels.get(state[p][3], -1) if c.kids else 0 for p in range(n)]
        assert got == want.tolist()


def test_few_rows(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0]), (3, None)], SCHEMA)
    assert sorted(map(tuple, density.clusters(vectors, 5, 5).collect())) == [(1, -1), (2, -1)]
    assert density.clusters(vectors.limit(0), 5, 5).count() == 0


def test_tables_of_rounds_go(spark):
    """Only the groups that the result reads are left in the shared folder."""
    from pathlib import Path

    from siltstone.sources.shared import checkpoint_dir

    there = lambda: {p.name for p in Path(checkpoint_dir(spark).removeprefix("file://")).glob("siltstone-*")}
    before = there()
    ids, x = sample(3, 60)
    density.clusters(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA), 4, 3).count()
    assert [n.split("-")[1] for n in there() - before] == ["groups"]
