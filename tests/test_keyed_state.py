"""Keyed state in streams: restarts, late and repeated events, evictions and ages, against plain folds."""

import datetime as dt
import random

import pandas as pd
import pytest

from siltstone.streaming import keyed

EVENTS = "owner string, event_id long, kind string, bucket string, route string, dwell long, hit boolean"


def events(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["view", "view", "click", "up", "down", "requery", "judge", "odd"])
        out.append((f"o{rng.randrange(3)}", i, kind, f"b{int(rng.paretovariate(0.6)) % 12}", rng.choice([None, f"b{rng.randrange(14)}"]), rng.randrange(9000) if kind == "view" else None, rng.random() < 0.5 if kind == "judge" else None))
    return out


def plain(rows, most, shadows, dwells):
    """The rules, event by event, with a list in order of last use."""
    state = {}
    for owner, i, kind, bucket, route, dwell, hit in sorted(rows, key=lambda r: r[1]):
        mine = state.setdefault(owner, {})
        if kind not in ("view", "click", "up", "down", "requery", "judge"):
            continue
        for name, shadow in [(bucket, False)] + ([(route, True)] if kind != "judge" and route and route != bucket else []):
            old = mine.get(name)
            if old is None or (old["shadow"] and not shadow):
                same = sorted((b["last"], k) for k, b in mine.items() if b["shadow"] == shadow and k != name)
                if len(same) >= (shadows if shadow else most):
                    del mine[same[0][1]]
            b = mine.setdefault(name, {"shadow": shadow, "last": 0, "dwells": [], **dict.fromkeys(keyed.COUNTS, 0)})
            b["shadow"], b["last"] = b["shadow"] and shadow, i
            if kind == "judge":
                b["judged"] += 1
                b["hits"] += hit
            else:
                b[keyed.KINDS[kind]] += 1
            if kind == "view":
                b["dwells"] = (b["dwells"] + [dwell])[-dwells:]
    return {(o, k): b for o, mine in state.items() for k, b in mine.items()}


def written(spark, path, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")


@pytest.mark.parametrize("bounds", [(4096, 4096, 500), (4, 3, 5)])
def test_counters_over_restarts(spark, tmp_path, bounds):
    """Three runs over growing input: parts come again, late events have older ids."""
    rows, source = events(3, 400), f"file://{tmp_path}/in"
    run = lambda: keyed.drained(keyed.bucket_counters(spark.readStream.schema(EVENTS).parquet(f"{source}/*"), *bounds), f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    written(spark, source, rows[:150], EVENTS, "a")
    run()
    written(spark, source, rows[100:260] + rows[:30] + [(None, 10**6, "view", "b1", None, 1, None), ("o1", None, "view", "b1", None, 1, None)], EVENTS, "b")
    run()
    written(spark, source, rows[260:], EVENTS, "c")
    got = {(r["owner"], r["bucket"]): r.asDict() for r in keyed.current(run()).collect()}
    want = plain(rows, *bounds)
    assert got.keys() == want.keys()
    for k, b in want.items():
        assert {c: got[k][c] for c in b} == b
    for owner in ("o0", "o1", "o2"):
        mine = [b for (o, _), b in got.items() if o == owner]
        assert sum(b["shadow"] for b in mine) <= bounds[1] and sum(not b["shadow"] for b in mine) <= bounds[0]


def test_rates(spark):
    rows = [("a", 4, 1, 1, 0, 1, 0, 0, [1000, 4000, 5000, 6001]), ("b", 0, 0, 0, 0, 0, 0, 0, []), ("c", 2, 3, 1, 1, 0, 4, 3, [4000]), ("d", 1, 0, 0, 3, 1, 0, 0, [10])]
    df = spark.createDataFrame(rows, "bucket string, " + ", ".join(f"{c} long" for c in keyed.COUNTS) + ", dwells array<long>")
    got = {r["bucket"]: (r["dwell_p50"], round(r["useful_rate"], 9)) for r in keyed.rates(df).collect()}
    assert got["a"] == (4500, round((0.75 + 0.5 / 4 + 2 / 2 - 2 / 4) / 5.5, 9))
    assert got["b"] == (None, 0.0) and got["d"] == (10, 0.0)
    assert got["c"] == (4000, round((1 + 0.5 + 2 * 0.5 + 2 * 0.75) / (3.5 + 2 + 2), 9))


def pairs(rows, most, seconds):
    waiting, out = {}, []
    for owner, i, at, item, judge, verdict in sorted(rows, key=lambda r: r[1]):
        mine = waiting.setdefault(owner, {})
        half = mine.pop(item, None)
        if half and half[1] >= at - seconds and half[0] != judge:
            out.append((owner, item, verdict if judge else half[2], half[2] if judge else verdict, i))
            continue
        mine[item] = (judge, at, verdict, i)
        if len(mine) > most:
            del mine[min(mine, key=lambda k: mine[k][3])]
    return sorted(out)


@pytest.mark.parametrize("most", [10_000, 6])
def test_half_pairs(spark, tmp_path, most):
    """Pairs over restarts; halves over seven days old, and those beyond the room, make none."""
    rng, start = random.Random(9), dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows, at = [], 0
    for i in range(500):
        at += rng.choice([60, 3600, 40_000])
        rows.append((f"o{i % 2}", i, at, f"i{rng.randrange(40)}", rng.random() < 0.5, rng.random() < 0.5))
    schema = "owner string, event_id long, ts timestamp, item string, judge boolean, verdict boolean"
    timed = [(o, i, start + dt.timedelta(seconds=a), *r) for o, i, a, *r in rows]
    run = lambda: keyed.drained(keyed.half_pairs(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in/*"), most), f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    for name, part in (("a", timed[:200]), ("b", timed[150:350]), ("c", timed[350:])):
        written(spark, f"file://{tmp_path}/in", part, schema, name)
        got = run()
    found = sorted(map(tuple, got.collect()))
    seconds = 7 * 86_400
    base = int(start.timestamp())
    want = pairs([(o, i, base + a, *r) for o, i, a, *r in rows], most, seconds)
    assert found == want and want
    loose = pairs([(o, i, base + a, *r) for o, i, a, *r in rows], 10**6, 10**9)
    assert len(want) < len(loose)
    # the last halves in the store are no older than the watermark allows
    state = spark.read.format("statestore").option("stateVarName", "halves").load(f"file://{tmp_path}/check").selectExpr("user_map_value.at as at").toPandas()
    assert isinstance(state, pd.DataFrame) and len(state) <= 2 * most
    assert (state["at"] >= base + rows[-1][2] - seconds - 86_400 - 600_000).all()
