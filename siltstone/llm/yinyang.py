"""Centroid clustering with Yinyang's bounds, in integers.

Vectors become integers, floor(scale * x) of each component.  Centroids are put into groups once.  Beside its centroid each
vector keeps an upper bound of the distance to it, and for each group one lower bound of the distance to the group's other
centroids.  When centroids have moved, bounds move by as much as these: a vector whose upper bound is below all its lower
bounds keeps its centroid (the global filter), else only groups whose bound isn't above it are scanned (the group filter),
with exact distances.  Bounds are rounded outwards, and nothing is passed over unless its bound is strictly greater, so
results are those of plain rounds, ties to the smaller number included.

The state (vector, centroid, bounds) is a table that each round reads once and writes anew; nothing of it is shuffled, only
sums of clusters are.  The driver holds the centroids alone.

Vectors that are null, have another number of components, or hold null or non-finite ones, or ones of 2^62 and more as
integers, are left out.  Repeated rows and copies of a vector count each; a null vec_id is kept, and is last among the
starting vectors.  With fewer vectors than centroids there are as many centroids as vectors; an empty table gives no rows.
A distance or a sum that doesn't fit 64 bits is null.  Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, mapped, pick


@dataclass(frozen=True)
class Settings:
    k: int = 16
    rounds: int = 3
    size: int = 64
    scale: int = 64
    seed: int = 1
    #: Groups of centroids; None: one for four centroids.
    groups: int | None = None


#: Numbers below this have sums of products that doubles hold exactly, for up to 2^9 components.
EXACT = 1 << 21
LONG = 1 << 63
#: Bounds are rounded outwards by this share, which is far more than what their arithmetic loses.
SLACK = 1e-11
STATE = "vec_id long, x array<long>, cluster int, upper double, lower array<double>, distance long"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c: exact, as doubles if these hold them, else as Python's integers."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT and x.shape[1] <= 512:
        x, c = x.astype(float), c.astype(float)
        return (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)
    x, c = x.astype(object), c.astype(object)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float))


@dataclass
class Centroids:
    """Where centroids are, the group of each, and how far each has moved since the bounds were made."""

    at: np.ndarray
    group: np.ndarray
    moved: np.ndarray

    @property
    def n_groups(self) -> int:
        return int(self.group.max(initial=-1)) + 1


def grouped(at: np.ndarray, n: int) -> np.ndarray:
    """The group of each centroid: a few plain rounds over the centroids, from the first n."""
    centers, group = at[:n].astype(float), np.zeros(len(at), int)
    for _ in range(5):
        d = ((at.astype(float)[:, None] - centers) ** 2).sum(2)
        group = d.argmin(1)
        for g in range(len(centers)):
            if (group == g).any():
                centers[g] = at[group == g].mean(0)
    return np.unique(group, return_inverse=True)[1]


def assigned(x: np.ndarray, c: Centroids, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None):
    """cluster, upper, lower and the number of exact distances, after the centroids have moved; without bounds, all are scanned."""
    n, k = len(x), len(c.at)
    if cluster is None:
        cluster, upper, lower = np.zeros(n, int), np.full(n, np.inf), np.zeros((n, c.n_groups))
        look = np.arange(n)
    else:
        far = np.array([c.moved[c.group == g].max() for g in range(c.n_groups)])
        cluster, upper, lower = cluster.copy(), upper + c.moved[cluster], lower - far
        look = np.flatnonzero(lower.min(1, initial=np.inf) <= upper)
    done = len(look)
    if not len(look):
        return cluster, upper, lower, 0
    # the distance to its own centroid tightens the upper bound of what has passed the global filter
    own = np.empty(len(look), object)
    for j in np.unique(cluster[look]):
        at = cluster[look] == j
        own[at] = squared(x[look[at]], c.at[j : j + 1])[:, 0]
    upper[look] = root(own) * (1 + SLACK)
    on = lower[look].min(1) <= upper[look]
    look, own = look[on], own[on]
    before = cluster[look]
    d = np.full((len(look), k), np.inf, object if any(isinstance(v, int) for v in own) else float)
    d[np.arange(len(look)), before] = own
    for g in range(c.n_groups):
        members = np.flatnonzero(c.group == g)
        rows = np.flatnonzero(lower[look, g] <= upper[look])
        if not len(rows):
            continue
        part = squared(x[look[rows]], c.at[members])
        if part.dtype == object and d.dtype != object:
            d = d.astype(object)
        d[np.ix_(rows, members)] = part
        done += part.size
        best = d[rows].argmin(1)
        upper[look[rows]] = root(d[rows, best]) * (1 + SLACK)
        lower[look[rows], g] = np.nan  # known from the distances below
    best = d.argmin(1)  # the first of equal ones
    cluster[look] = best
    upper[look] = root(d[np.arange(len(look)), best]) * (1 + SLACK)
    others = d.astype(float)
    others[np.arange(len(look)), best] = np.inf
    for g in range(c.n_groups):
        near = np.sqrt(others[:, c.group == g].min(1)) * (1 - SLACK)
        kept = lower[look, g]
        # a group that wasn't scanned keeps its bound, but for a centroid that was left now
        lower[look, g] = np.where(np.isnan(kept), near, np.minimum(kept, near))
    return cluster, upper, lower, done


def _integers(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _pass(table: DataFrame, c: Centroids, size: int, last: bool) -> DataFrame:
    """The state after one assignment; with distances in the last one."""
    shared = table.sparkSession.sparkContext.broadcast(c)
    first = "cluster" not in table.columns

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        c = shared.value

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            x = _integers(b.column("x"), size)
            held = (None, None, None) if first else (b.column("cluster").to_numpy().astype(int), b.column("upper").to_numpy(), b.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            cluster, upper, lower, _ = assigned(x, c, *held)
            distance = np.full(b.num_rows, None, object)
            if last:
                for j in np.unique(cluster):
                    at = cluster == j
                    distance[at] = [int(v) if v < LONG else None for v in squared(x[at], c.at[j : j + 1])[:, 0]]
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * c.n_groups, pa.int32()), pa.array(lower.ravel()))
            return pa.record_batch([b.column("vec_id"), b.column("x"), pa.array(cluster, pa.int32()), pa.array(upper), bounds, pa.array(distance, pa.int64())], ["vec_id", "x", "cluster", "upper", "lower", "distance"])

        return each

    return mapped(table, make, STATE)


def _sums(state: DataFrame, size: int) -> dict[int, tuple[int, list[int]]]:
    """Per cluster, its vectors and the sums of their components: one row for each cluster and batch is summed up."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            x, of = _integers(b.column("x"), size), b.column("cluster").to_numpy()
            found, n = np.unique(of, return_counts=True)
            small = np.abs(x).max(initial=0) < 1 << 40  # then a batch's sums fit 64 bits
            sums = [[Decimal(int(v)) for v in (x[of == j] if small else x[of == j].astype(object)).sum(0)] for j in found]
            return pa.record_batch([pa.array(found, pa.int32()), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.decimal128(38, 0)))], ["cluster", "n", "sums"])

        return each

    parts = mapped(state.select("x", "cluster"), make, "cluster int, n long, sums array<decimal(38,0)>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("pos", "s")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in each.collect():  # k times the number of components
        out.setdefault(r["cluster"], (r["n"], [0] * size))[1][r["pos"]] = int(r["s"])
    return out


def clustered(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the vectors (vec_id, embedding)."""
    if settings.k < 1 or settings.rounds < 0 or settings.size < 1:
        raise ValueError("there is at least one centroid and one component, and no negative number of rounds")
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    limit = F.lit(float(1 << 62))
    whole = (F.size("embedding") == settings.size) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * settings.scale) < limit))
    state = pick(vectors, vec_id="long", embedding="array<double>").filter(F.coalesce(whole, F.lit(False)))
    state = state.select("vec_id", F.transform("embedding", lambda v: F.floor(v * settings.scale).cast("long")).alias("x"))
    order = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("vec_id").cast("string")), 256)
    start = state.orderBy(order.asc_nulls_last(), "vec_id", "x").limit(settings.k).collect()
    if not start:
        return state.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).limit(0)
    at = np.array([r["x"] for r in start], np.int64)
    c = Centroids(at, grouped(at, settings.groups or max(1, len(at) // 4)), np.zeros(len(at)))
    for i in range(settings.rounds + 1):
        table = scratch.stage(_pass(state, c, settings.size, i == settings.rounds), "state")
        if i:
            scratch.drop(state)
        state = table
        if i < settings.rounds:
            to = c.at.copy()
            for j, (n, sums) in _sums(state, settings.size).items():
                to[j] = [s // n for s in sums]
            moved = np.array([root(squared(a[None], z[None]))[0, 0] * (1 + SLACK) for a, z in zip(c.at, to, strict=True)])
            c = Centroids(to, c.group, moved)
    by = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda v: int(v) if v is not None and v < LONG else None
    total = fits(sum(v or 0 for v in by.values()))
    names = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c.at]
    facts = spark.createDataFrame([(j, fits(s), total, names[j]) for j, s in by.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return scratch.result(state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster"), "clusters").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
