"""Vectors in blocks, and all pairs of blocks, without a shuffle of pairs.

A block is a row with the ids and the components of some thousand vectors.  Blocks meet in a product of two stored tables, so a
vector is written once or twice, however many others it meets.  Inner products are taken in single precision first; whatever
could pass within the error of that is taken again in double precision, so results are exact.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.shared import dropped, written

#: Vectors of a block, of a file and of what a step's tasks meet, at most.
ROWS, FILE, STEP = 4_096, 16_384, 131_072
#: Rows of a block that are multiplied at once, and pairs that are looked at again at once.
STRIPE, AGAIN = 128, 1 << 15
_KINDS = {"bigint": np.int64, "double": np.float64, "array<float>": np.float32, "array<double>": np.float64}


@contextmanager
def _small_batches(spark: SparkSession, parts: int):
    """Reads a file of blocks in a task of its own, and hands few pairs of blocks at once to Python."""
    stated = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4", "spark.sql.files.minPartitionNum": str(max(1, parts))}
    before = {k: spark.conf.get(k, None) for k in stated}
    try:
        for k, v in stated.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _files(spark: SparkSession, n: int) -> int:
    return max(1, -(-n // FILE), min(-(-n // 512), 3 * spark.sparkContext.defaultParallelism))


def packed(rows: DataFrame, n: int, name: str, by: str | None = None, most: int = ROWS) -> DataFrame:
    """file, block, and the columns of (id, x, ...) as bytes; the n rows of a file are in the order of `by`."""
    kinds = {c: _KINDS[t] for c, t in rows.dtypes}
    dealt = rows.repartition(_files(rows.sparkSession, n), "id")
    dealt = dealt.sortWithinPartitions(by, "id") if by else dealt

    def pack(batches):
        if not (found := [b for b in batches if b.num_rows]):
            return
        t = pa.Table.from_batches(found).combine_chunks()
        if len(set(t["x"].combine_chunks().value_lengths().to_pylist())) > 1:
            raise ValueError("vectors differ in their numbers of components")
        values = {c: (t[c].combine_chunks().flatten() if c == "x" else t[c].combine_chunks()).to_numpy(zero_copy_only=False).astype(k).reshape(t.num_rows, -1) for c, k in kinds.items()}
        for at in np.array_split(np.arange(t.num_rows), -(-t.num_rows // most)):
            yield pa.record_batch([pa.array([values[c][at].tobytes()], pa.binary()) for c in kinds], list(kinds))

    made = dealt.mapInArrow(pack, ", ".join(f"{c} binary" for c in kinds))
    return written(made.select(F.spark_partition_id().alias("file"), F.monotonically_increasing_id().alias("block"), *kinds), name)


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision; zeros stay."""
    x = x.astype(float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _values(b: pa.RecordBatch, column: str, i: int, kind) -> np.ndarray:
    return np.frombuffer(b.column(column)[i].as_buffer(), kind)


def margin(x: np.ndarray) -> float:
    """More than an inner product of unit vectors can be wrong by in single precision."""
    return (x.shape[1] + 16) * 2.0**-23


def _again(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the pairs in double precision."""
    parts = [np.einsum("ij,ij->i", a[r[i : i + AGAIN]], b[c[i : i + AGAIN]]) for i in range(0, len(r), AGAIN)]
    return np.concatenate(parts) if parts else np.empty(0)


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what holds, which is little: eight at a time."""
    if mask.shape[1] % 8:
        return np.nonzero(mask)
    eights = np.flatnonzero(mask.view(np.uint64))
    j, k = np.nonzero(mask.reshape(-1, 8)[eights])
    return np.divmod(eights[j] * 8 + k, mask.shape[1])


class _Lists:
    """The k nearest of each vector of a block among all that it has met."""

    def __init__(self, ids, x, k, value, s=None, other=None):
        self.ids, self.k, self.value = ids, k, value
        self.x = unit(x)
        self.single, self.error = self.x.astype(np.float32), margin(x)
        self.s = np.full((len(ids), k), -np.inf) if s is None else s.copy()
        self.other = np.full((len(ids), k), np.iinfo(np.int64).max) if other is None else other.copy()
        self.held, self.n_held = [], 0
        self._bound()

    def _bound(self):
        self.least = self.s.min(1) - self.error

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        x = unit(x)
        single = np.ascontiguousarray(x.astype(np.float32).T)
        for at in range(0, len(self.ids), STRIPE):
            m = self.single[at : at + STRIPE] @ single
            least = self.least[at : at + STRIPE]
            if np.isinf(least).any() and m.shape[1] > self.k + 1:  # its own vector may be among them
                least = np.maximum(least, np.partition(m, -(self.k + 1), axis=1)[:, -(self.k + 1)] - 2 * self.error)
            r, c = _where(m >= least.astype(np.float32)[:, None])
            r = r + at
            there = self.ids[r] != ids[c]
            r, c = r[there], c[there]
            self.held.append((r, ids[c], _again(self.x, x, r, c)))
            self.n_held += len(r)
        if self.n_held > len(self.ids) * self.k // 2:
            self.merge()

    def merge(self) -> None:
        if not self.n_held:
            return
        there = np.isfinite(self.s)
        r, other, s = (np.concatenate(v) for v in zip((np.nonzero(there)[0], self.other[there], self.s[there]), *self.held, strict=True))
        order = np.lexsort((other, self.value(s), r))
        r, other, s = r[order], other[order], s[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        top = place < self.k
        self.s.fill(-np.inf)
        self.s[r[top], place[top]], self.other[r[top], place[top]] = s[top], other[top]
        self.held, self.n_held = [], 0
        self._bound()


def distance(s: np.ndarray) -> np.ndarray:
    """Cosine distance, rounded so that blocks of any shape give equal values."""
    return np.round(1 - np.clip(s, -1, 1), 12)


def near_lists(rows: DataFrame, n: int, k: int, value: Callable[[np.ndarray], np.ndarray], most: int = ROWS) -> DataFrame:
    """id, place (from 1), other, value: the k nearest others of each of n rows (id, x), by (value of the cosine, other).

    value(cosines) falls as they grow, and may round.  Steps go over the table in parts; each carries the lists that were found
    so far, so that later parts are mostly passed over by the least cosine of a list.
    """
    spark = rows.sparkSession
    kind = _KINDS[dict(rows.dtypes)["x"]]
    blocks = packed(rows, n, "blocks", most=most)
    files = sorted(r["file"] for r in blocks.select("file").distinct().collect())
    steps = max(1, -(-n // STEP))
    lists = blocks.select("file", "block", "id", "x", F.lit(None).cast("binary").alias("s"), F.lit(None).cast("binary").alias("other"))
    schema, made = lists.schema, None

    def meet(batches):
        now = state = kept = None

        def out():
            state.merge()
            cells = [state.s.tobytes(), state.other.tobytes()]
            return pa.record_batch([*kept, *[pa.array([c], pa.binary()) for c in cells]], schema.names)

        for b in batches:
            for i in range(b.num_rows):
                if now != (at := b.column("block")[i].as_py()):
                    if state is not None:
                        yield out()
                    now, ids = at, _values(b, "id", i, np.int64).copy()
                    kept = [pa.array([b.column(c)[i].as_py()], t) for c, t in (("file", pa.int32()), ("block", pa.int64()), ("id", pa.binary()), ("x", pa.binary()))]
                    old = [] if b.column("s")[i].as_py() is None else [_values(b, c, i, t).reshape(len(ids), k) for c, t in (("s", np.float64), ("other", np.int64))]
                    state = _Lists(ids, _values(b, "x", i, kind).reshape(len(ids), -1), k, value, *old)
                ids = _values(b, "id2", i, np.int64)
                state.meet(ids, _values(b, "x2", i, kind).reshape(len(ids), -1))
        if state is not None:
            yield out()

    with _small_batches(spark, len(files)):
        for step in range(steps):
            if not (some := files[step::steps]):
                continue
            others = blocks.filter(F.col("file").isin(some)).select(F.col("id").alias("id2"), F.col("x").alias("x2")).coalesce(1)
            last, lists = made, written(lists.crossJoin(others.hint("shuffle_replicate_nl")).mapInArrow(meet, schema), "lists")
            made = lists
            if last is not None:
                dropped(last)

        def rows_of(batches):
            for b in batches:
                for i in range(b.num_rows):
                    ids = _values(b, "id", i, np.int64)
                    s, other = (_values(b, c, i, t).reshape(len(ids), k) for c, t in (("s", np.float64), ("other", np.int64)))
                    r, c = np.nonzero(np.isfinite(s))
                    yield pa.record_batch([pa.array(ids[r]), pa.array((c + 1).astype(np.int32)), pa.array(other[r, c]), pa.array(value(s[r, c]))], ["id", "place", "other", "value"])

        out = written(lists.select("id", "s", "other").mapInArrow(rows_of, "id long, place int, other long, value double"), "near")
    dropped(blocks, *([made] if made is not None else []))
    return out


def leaving(asked: DataFrame, points: DataFrame, n_asked: int, n: int, most: int = ROWS) -> DataFrame:
    """id, w, lo, hi: the least edge by mutual reachability, then by its ends, of each asked vector to another component.

    Both are (id, x, core, comp).  Vectors of the component that a block of asked ones is in are passed over.
    """
    spark = asked.sparkSession
    kind = _KINDS[dict(points.dtypes)["x"]]
    left, right = packed(asked, n_asked, "asked", "comp", most), packed(points, n, "placed", "comp", most)
    far = np.iinfo(np.int64).max

    def least(a: list[np.ndarray], b: list[np.ndarray]):
        """Edges that may be the least of a row; the margin is that of single precision."""
        (ia, xa, ca, ga), (ib, xb, cb, gb) = a, b
        error = margin(xa)
        single, core = np.ascontiguousarray(xb.astype(np.float32).T), cb.astype(np.float32)
        for at in range(0, len(ia), STRIPE):
            to = slice(at, at + STRIPE)
            m = np.maximum(1 - xa[to].astype(np.float32) @ single, core)
            np.maximum(m, ca[to].astype(np.float32)[:, None], out=m)
            m[ga[to][:, None] == gb] = np.inf
            low = m.min(1)
            r, c = np.nonzero(m <= np.where(np.isfinite(low), low + 2 * error, -np.inf).astype(np.float32)[:, None])
            r = r + at
            w = np.maximum(np.maximum(ca[r], cb[c]), distance(_again(xa, xb, r, c)))
            lo, hi = np.minimum(ia[r], ib[c]), np.maximum(ia[r], ib[c])
            order = np.lexsort((hi, lo, w, r))
            order = order[np.unique(r[order], return_index=True)[1]]
            yield r[order], w[order], lo[order], hi[order]

    def meet(batches):
        now, mine, best = None, None, None

        def out():
            w, lo, hi = best
            there = np.isfinite(w)
            return pa.record_batch([pa.array(v[there]) for v in (mine[0], w, lo, hi)], ["id", "w", "lo", "hi"])

        def read(b, i, end=""):
            ids = _values(b, f"id{end}", i, np.int64)
            return [ids, unit(_values(b, f"x{end}", i, kind).reshape(len(ids), -1)), _values(b, f"core{end}", i, np.float64), _values(b, f"comp{end}", i, np.int64)]

        for b in batches:
            for i in range(b.num_rows):
                if now != (at := b.column("block")[i].as_py()):
                    if best is not None:
                        yield out()
                    now, mine = at, [v.copy() for v in read(b, i)]
                    best = [np.full(len(mine[0]), np.inf), np.full(len(mine[0]), far), np.full(len(mine[0]), far)]
                theirs = read(b, i, "2")
                groups = np.unique(mine[3])
                for g in groups if len(groups) <= 4 else [None]:
                    own = np.arange(len(mine[0])) if g is None else np.flatnonzero(mine[3] == g)
                    others = theirs if g is None else [v[theirs[3] != g] for v in theirs]
                    if not len(others[0]):
                        continue
                    for r, w, lo, hi in least([v[own] for v in mine], others):
                        r = own[r]
                        bw, bl, bh = (v[r] for v in best)
                        better = (w < bw) | ((w == bw) & ((lo < bl) | ((lo == bl) & (hi < bh))))
                        for v, new in zip(best, (w, lo, hi), strict=True):
                            v[r[better]] = new[better]
        if best is not None:
            yield out()

    columns = ["id", "x", "core", "comp"]
    pairs = left.select("block", *columns).crossJoin(right.select(*[F.col(c).alias(f"{c}2") for c in columns]).hint("shuffle_replicate_nl"))
    with _small_batches(spark, _files(spark, n)):
        found = written(pairs.mapInArrow(meet, "id long, w double, lo long, hi long").groupBy("id").agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select("id", "e.*"), "leaving")
    dropped(left, right)
    return found
