"""Learning over windows against a replay step by step."""

import datetime as dt
import math
import random

import pytest

from siltstone.operators import replay
from siltstone.operators.weights import DEFAULT

START = dt.datetime(2024, 1, 1)


def events():
    rng, out = random.Random(4), []
    for window in range(6):
        at = START + dt.timedelta(days=[3, 4, 9, 8, 30, 31][window])
        for _ in range(rng.randrange(3, 25)):
            w = [rng.random() if rng.random() < 0.7 else 0.0 for _ in DEFAULT]
            out.append((window, at, at - dt.timedelta(hours=rng.randrange(-5, 90)), rng.choice(["exact", "semantic"]), rng.choice([None, 1, 2]), w if rng.random() < 0.95 else None, rng.choice([1.0, 0.5]), rng.random() if rng.random() < 0.95 else None))
    return out


def norm(w):
    return [x / sum(w) for x in w] if sum(w) > 2.3e-16 else list(DEFAULT)


def scopes(rows):
    kinds = sorted({r[3] for r in rows})
    yield (None, None), rows, None
    for k in kinds:
        mine = [r for r in rows if r[3] == k]
        yield (k, None), mine, (None, None)
        for c in sorted({r[4] for r in mine if r[4] is not None}):
            yield (k, c), [r for r in mine if r[4] == c], (k, None)


def weight(r):
    return r[6] * math.exp(-0.06 * max(0.0, (r[1] - r[2]).total_seconds() / 86_400))


def size(state, at):
    if state is None or at < state[0]:
        return 0.0
    return state[1] * math.exp(-0.06 * (at - state[0]).total_seconds() / 86_400)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(events(), "window long, at timestamp, ts timestamp, type string, cluster int, weights array<double>, evidence double, alpha double")


def test_weights(table):
    held, want = {}, {}
    for window in range(6):
        now, rows = {}, [r for r in events() if r[0] == window and r[5] is not None]
        for key, mine, above in scopes(rows):
            total = sum(map(weight, mine))
            own = norm([sum(weight(r) * r[5][i] for r in mine) / total for i in range(6)])
            parent = norm(DEFAULT) if above is None else now[above][1]
            now[key] = len(mine), norm([(len(mine) * a + 5 * b) / (len(mine) + 5) for a, b in zip(own, parent, strict=True)])
        for key, (n, w) in now.items():
            before = size(held.get(key), rows[0][1])
            if before > 0:
                w = norm([(before * a + n * b) / (before + n) for a, b in zip(held[key][2], w, strict=True)])
            held[key] = rows[0][1], math.floor(before + 0.5) + n, w
            want[*key, window] = held[key][1], w
    got = {(r["type"], r["cluster"], r["window"]): (r["n"], r["weights"]) for r in replay.committed_weights(replay.window_weights(table)).collect()}
    assert got.keys() == want.keys()
    for k, (n, w) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(w, abs=1e-9) and sum(got[k][1]) == pytest.approx(1)
    last = {(r["type"], r["cluster"]): r["n"] for r in replay.latest(replay.committed_weights(replay.window_weights(table))).collect()}
    assert last == {k: v[1] for k, v in held.items()}


@pytest.mark.parametrize("step", [0.15, 0.01])
def test_alphas(table, step):
    held, want = {}, {}
    for window in range(6):
        rows = [r for r in events() if r[0] == window and r[7] is not None]
        at = rows[0][1]
        for key, mine, above in scopes(rows):
            own = sum(weight(r) * r[7] for r in mine) / sum(map(weight, mine))
            parent = 0.5 if above is None else held[above][2]
            now = held[key][2] if key in held else parent
            walked = now + max(-step, min(step, own - now))
            n = math.floor(size(held.get(key), at) + 0.5) + len(mine)
            value = (n * walked + 5 * parent) / (n + 5)
            assert abs(value - now) <= step + abs(parent - now) + 1e-12
            held[key] = at, n, value
            want[*key, window] = n, value
    got = {(r["type"], r["cluster"], r["window"]): (r["n"], r["alpha"]) for r in replay.committed_alphas(table, max_step=step).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == n and got[k][1] == pytest.approx(a, abs=1e-9) for k, (n, a) in want.items())


def test_empty(table):
    assert replay.committed_weights(replay.window_weights(table.limit(0))).count() == 0
    assert replay.committed_alphas(table.limit(0)).count() == 0
