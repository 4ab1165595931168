"""Keyed state with bounds on Structured Streaming: counters by bucket, and halves of pairs that wait for each other.

State is kept for each owner (a store, a tenant) in the engine's state store and only changes are written, so a micro-batch
costs what it touches.  Every owner's state is bounded: buckets by a number of each class, halves by a number and an age.
Events have ids that grow; an owner remembers the last one, so events that come again, or late with an older id, count
nothing.  Events of a micro-batch are folded in the order of their ids, so results don't depend on how events are cut into
batches.

Streams write rows of what has changed; `current` makes the table of the last state out of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Bounds and weights of concept summaries.
BUCKETS, SHADOWS, DWELLS = 4096, 4096, 500
HALVES, HALF_DAYS = 10_000, 7
DWELL_MS = 3_000
W_VIEW, W_CLICK, W_THUMB, W_REQUERY = 1.0, 0.5, 2.0, 2.0

COUNTS = ("views", "clicks", "up", "down", "requeries", "judged", "hits")
KINDS = {"view": "views", "click": "clicks", "up": "up", "down": "down", "requery": "requeries"}
_STATE = "shadow boolean, last bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", dwells array<bigint>"
UPDATE = f"owner string, bucket string, {_STATE}, version bigint, gone boolean"
PAIR = "owner string, item string, judge boolean, human boolean, event_id bigint"


def use_store(spark: SparkSession) -> None:
    """State with several variables needs the RocksDB store; a session that has stated a store keeps it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass
class Bucket:
    shadow: bool
    last: int = 0
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTS, 0))
    dwells: list[int] = field(default_factory=list)


class Buckets:
    """One owner's buckets.  An event counts in its bucket, and in that of the route it was asked on, as a shadow.  A bucket
    that has met an event of its own is no shadow any more.  Each class has room for so many buckets; a new one, or a shadow
    that stops being one, pushes out the one of its class that was met longest ago."""

    def __init__(self, held: dict[str, Bucket], most: int, shadows: int, dwells: int):
        self.held, self.room, self.dwells = held, {False: most, True: shadows}, dwells
        self.touched: set[str] = set()
        self.gone: set[str] = set()

    def _enter(self, name: str, shadow: bool, at: int) -> Bucket:
        b = self.held.get(name)
        if b is None or (b.shadow and not shadow):
            peers = [(x.last, k) for k, x in self.held.items() if x.shadow == shadow and k != name]
            if len(peers) >= self.room[shadow]:
                victim = min(peers)[1]
                del self.held[victim]
                self.touched.discard(victim)
                self.gone.add(victim)
        if b is None:
            b = self.held[name] = Bucket(shadow)
        b.shadow &= shadow
        b.last = max(b.last, at)
        self.touched.add(name)
        self.gone.discard(name)
        return b

    def fold(self, event_id: int, kind: str, bucket: str, route: str | None, dwell: int | None, hit: bool | None) -> None:
        if kind == "judge":
            b = self._enter(bucket, False, event_id)
            b.counts["judged"] += 1
            b.counts["hits"] += bool(hit)
        elif kind in KINDS:
            for name, shadow in ((bucket, False), *([(route, True)] if route is not None and route != bucket else [])):
                b = self._enter(name, shadow, event_id)
                b.counts[KINDS[kind]] += 1
                if kind == "view" and dwell is not None:
                    b.dwells = [*b.dwells, dwell][-self.dwells :]


def _ordered(rows: Iterator[pd.DataFrame], seen: int) -> pd.DataFrame:
    """New events in order; of rows with one id, the first by their values."""
    every = pd.concat(list(rows), ignore_index=True)
    every = every[every.event_id > seen]
    return every.sort_values(list(every.columns), key=lambda c: c if c.name == "event_id" else c.astype(str)).drop_duplicates("event_id").sort_values("event_id")


def _none(v):
    return None if v is None or v is pd.NA or v != v else v


class CountBuckets(StatefulProcessor):
    def __init__(self, most: int, shadows: int, dwells: int):
        self.bounds = most, shadows, dwells

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "last bigint")
        self.state = handle.getMapState("buckets", "bucket string", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = self.seen.get()[0] if self.seen.exists() else -1
        events = _ordered(rows, seen)
        if not len(events):
            return
        held = {k[0]: Bucket(v[0], v[1], dict(zip(COUNTS, v[2:-1], strict=True)), list(v[-1])) for k, v in self.state.iterator()}
        b = Buckets(held, *self.bounds)
        for e in events.itertuples(index=False):
            dwell, hit = _none(e.dwell), _none(e.hit)
            b.fold(int(e.event_id), e.kind, e.bucket, _none(e.route), None if dwell is None else int(dwell), hit)
        version = int(events.event_id.max())
        self.seen.update((version,))
        out = []
        for name in sorted(b.gone):
            if self.state.containsKey((name,)):
                self.state.removeKey((name,))
            out.append((key[0], name, False, version, *[0] * len(COUNTS), [], version, True))
        for name in sorted(b.touched):
            x = b.held[name]
            value = (x.shadow, x.last, *[x.counts[c] for c in COUNTS], x.dwells)
            self.state.updateValue((name,), value)
            out.append((key[0], name, *value, version, False))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in UPDATE.split(", ")])

    def close(self) -> None:
        pass


def bucket_counters(events: DataFrame, most: int = BUCKETS, shadows: int = SHADOWS, dwells: int = DWELLS) -> DataFrame:
    """Changes of the buckets of a stream (owner, event_id, kind, bucket, route, dwell, hit).

    kind is one of KINDS or `judge`, which has a verdict (hit); others, and events without an owner or bucket, count nothing
    but are seen.  Of dwell times the last `dwells` are kept.
    """
    use_store(events.sparkSession)
    events = events.filter("owner is not null and bucket is not null and event_id is not null").select(F.col("owner").cast("string").alias("owner"), F.col("event_id").cast("long").alias("event_id"), "kind", "bucket", "route", F.col("dwell").cast("long").alias("dwell"), "hit")
    return events.groupBy("owner").transformWithStateInPandas(CountBuckets(most, shadows, dwells), UPDATE, "Append", "None")


def current(updates: DataFrame) -> DataFrame:
    """The buckets as they are after all changes."""
    last = updates.withColumn("_n", F.row_number().over(W.partitionBy("owner", "bucket").orderBy(F.desc("version"), "gone")))
    return last.filter("_n = 1 and not gone").drop("_n", "version", "gone")


def rates(buckets: DataFrame, judge_weight: float = 1.0) -> DataFrame:
    """With dwell_p50 and useful_rate: without verdicts over all weights, with verdicts over those of the signals there are."""
    n, long = F.size("dwells"), F.size(F.filter("dwells", lambda d: d > DWELL_MS))
    ordered = F.array_sort("dwells")
    at = (n - 1) / 2
    lo, hi = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.least(F.floor(at) + 1, n - 1).cast("int"))
    p50 = F.when(n > 0, F.floor(lo + (at - F.floor(at)) * (hi - lo) + 0.5).cast("long"))
    dwelt = F.when(n > 0, long / n).otherwise(0.0)
    views = F.greatest("views", F.lit(1))
    plain = (W_VIEW * dwelt + W_CLICK * F.col("clicks") / views + W_THUMB * F.col("up") / (F.col("up") + F.col("down") + 1) - W_REQUERY * F.col("requeries") / views) / (W_VIEW + W_CLICK + W_THUMB + W_REQUERY)
    seen, thumbs, judged = F.col("views") > 0, F.col("up") + F.col("down"), F.col("judged")
    w = W_THUMB * judge_weight
    cut = lambda c: F.least(F.col(c) / views, F.lit(1.0))
    above = F.when(seen, W_VIEW * dwelt + W_CLICK * cut("clicks") - W_REQUERY * cut("requeries")).otherwise(0.0) + F.when(thumbs > 0, W_THUMB * F.col("up") / thumbs).otherwise(0.0) + w * F.col("hits") / judged
    below = F.when(seen, W_VIEW + W_CLICK + W_REQUERY).otherwise(0.0) + F.when(thumbs > 0, W_THUMB).otherwise(0.0) + w
    rate = F.when((judged > 0) & (below > 0), above / below).otherwise(plain)
    return buckets.withColumns({"dwell_p50": p50, "useful_rate": F.least(F.lit(1.0), F.greatest(F.lit(0.0), rate))})


class Halves:
    """One owner's halves of pairs, oldest first.  A half waits for one of the other kind on its item; one of its own kind
    takes its place.  Halves older than `seconds` at an event don't count for it, and over `most` the oldest go."""

    def __init__(self, held: dict[str, tuple[bool, bool, int, int]], most: int, seconds: int):
        self.held, self.most, self.seconds = held, most, seconds

    def fold(self, event_id: int, item: str, judge: bool, verdict: bool, at: int) -> tuple[bool, bool] | None:
        """(judge's, human's) if the event makes a pair."""
        half = self.held.get(item)
        if half is not None and half[2] < at - self.seconds:
            half = None
        self.held.pop(item, None)
        if half is not None and half[0] != judge:
            return (verdict, half[1]) if judge else (half[1], verdict)
        self.held[item] = (judge, verdict, at, event_id)
        if len(self.held) > self.most:
            del self.held[min(self.held, key=lambda k: self.held[k][3])]
        return None

    def expire(self, at: int) -> None:
        for item in [k for k, v in self.held.items() if v[2] < at - self.seconds]:
            del self.held[item]


class MatchHalves(StatefulProcessor):
    def __init__(self, most: int, seconds: int):
        self.bounds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last bigint")
        self.state = handle.getMapState("halves", "item string", "judge boolean, verdict boolean, at bigint, event_id bigint")

    def _held(self) -> dict[str, tuple[bool, bool, int, int]]:
        return {k[0]: tuple(v) for k, v in self.state.iterator()}

    def _save(self, before: dict, after: dict) -> None:
        for item in before.keys() - after.keys():
            self.state.removeKey((item,))
        for item, v in after.items():
            if before.get(item) != v:
                self.state.updateValue((item,), v)

    def _remind(self, held: dict) -> None:
        """A timer for when the oldest half is too old."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held:
            self.handle.registerTimer((min(v[2] for v in held.values()) + self.bounds[1] + 1) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = _ordered(rows, self.seen.get()[0] if self.seen.exists() else -1)
        if not len(events):
            return
        before = self._held()
        h, out = Halves(dict(before), *self.bounds), []
        for e in events.itertuples(index=False):
            if (pair := h.fold(int(e.event_id), e.item, bool(e.judge), bool(e.verdict), int(e.at))) is not None:
                out.append((key[0], e.item, *pair, int(e.event_id)))
        self.seen.update((int(events.event_id.max()),))
        self._save(before, h.held)
        self._remind(h.held)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PAIR.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._held()
        h = Halves(dict(before), *self.bounds)
        h.expire(timerValues.getCurrentWatermarkInMs() // 1000)
        self._save(before, h.held)
        self._remind(h.held)
        yield pd.DataFrame(columns=[c.split()[0] for c in PAIR.split(", ")])

    def close(self) -> None:
        pass


def half_pairs(events: DataFrame, most: int = HALVES, days: int = HALF_DAYS, late: str = "1 day") -> DataFrame:
    """Pairs of a judge's and a human's verdict on an item, in a stream (owner, event_id, ts, item, judge, verdict).

    Timers drop halves that are too old once the watermark (`late` behind the newest event) has passed them."""
    use_store(events.sparkSession)
    whole = " and ".join(f"{c} is not null" for c in ("owner", "event_id", "ts", "item", "judge", "verdict"))
    events = events.filter(whole).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    events = events.select(F.col("owner").cast("string").alias("owner"), F.col("event_id").cast("long").alias("event_id"), F.col("item").cast("string").alias("item"), "judge", "verdict", F.unix_timestamp("ts").alias("at"), "ts")
    return events.groupBy("owner").transformWithStateInPandas(MatchHalves(most, days * 86_400), PAIR, "Append", "EventTime")


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all there is and returns what it has written under path so far."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
