"""Nearest neighbours by inner product: multi-index hashing over learned rotated binary codes.

A code holds the signs of a vector's components after rotations that are learned (iterative quantisation) from a bounded
sample of the vectors.  Codes are split into substrings of 8 bits, and each substring is an index: for each of its values,
the rows that have it.  Two codes within a radius r have, by the pigeonhole principle, a substring within r / m of the m
substrings, so probing each substring's values within that distance retrieves every code within r.  These are compared with
the query's code, and those within r are ranked by inner products of the original vectors.

The radius is a query's own.  Its k-th best inner product with the sample is a lower bound of what it looks for, so a
neighbour's angle is at most that of the bound and the row's length (rows are kept in bands of lengths), and the radius is
that angle's expected number of differing bits and `margin` deviations more.  Nothing in it depends on how rows are
partitioned.  A query that finds fewer than k rows while there are more is searched again with no radius at all.

Equal vectors are one entry of the index with their k + 1 smallest ids, which no list of k needs more of, and equal queries
are searched once; so copies, however many, are neither compared nor shuffled one by one.  Queries and entries meet in
blocks: each task holds one block of queries and streams a stripe of the entries, keeping the best of each query.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id; vectors of
another length than the query's aren't candidates.  Rows with the query's id are its own.  Repeated rows (equal id and
vector) count once.  Ties go to the smaller id.  Empty tables give no rows; extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, mapped, pick, settle


@dataclass(frozen=True)
class Settings:
    k: int = 20
    #: Vectors that the rotations and the queries' bounds are learned from, at most.
    sample: int = 16_384
    #: Rotations; a code has as many bits for each component, rounded up to 64.
    rotations: int = 2
    #: Deviations by which the radius is over the expected distance.
    margin: float = 1.5
    #: Queries of a block, and entries of a stripe, at most about that many.
    block: int = 8_192
    stripe: int = 1 << 22
    seed: int = 7


_POP = np.array([v.bit_count() for v in range(256)], np.uint8)
#: Values within each distance of 0: a substring's values within that distance of v are v ^ these.
_NEAR = [np.flatnonzero(_POP <= r) for r in range(9)]
#: Bands of lengths: eight of them double the length; lengths that are equal but for rounding share one.
_BANDS, _ROUNDED = 8, 1e-3
ENTRY = "h1 long, h2 long, dim int, band int, x array<double>, code binary, ids array<long>"
ASKED = "h1 long, h2 long, dim int, length double, bound double, x array<double>, code binary"


def learned(directions: np.ndarray, settings: Settings) -> np.ndarray:
    """Rotations side by side: signs of x @ them are codes that quantise the sample's directions well."""
    d = directions.shape[1]
    bits = 64 * math.ceil(d * settings.rotations / 64)
    rng, out = np.random.default_rng(settings.seed), []
    for _ in range(math.ceil(bits / d)):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(25 * (len(directions) > 4 * d)):
            u, _, vt = np.linalg.svd(np.where(directions @ r >= 0, 1.0, -1.0).T @ directions)
            r = (u @ vt).T
        out.append(r)
    return np.concatenate(out, 1)[:, :bits]


@dataclass
class Model:
    """What is learned from the sample, for each length of vectors."""

    settings: Settings
    sample: dict[int, np.ndarray]
    rotation: dict[int, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        for d, x in self.sample.items():
            self.rotation[d] = learned(x / np.linalg.norm(x, axis=1, keepdims=True), self.settings)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A row of bytes for each vector."""
        d = x.shape[1]
        if d not in self.rotation:  # not in the sample
            self.rotation[d] = learned(np.empty((0, d)), self.settings)
        return np.packbits(x @ self.rotation[d] >= 0, axis=1)

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The inner product that k others than the query reach for sure: the next best one in the sample."""
        s, k = self.sample.get(x.shape[1]), self.settings.k
        if s is None or len(s) <= k:
            return np.full(len(x), -np.inf)
        return np.concatenate([np.partition(x[i : i + 512] @ s.T, len(s) - k - 1, axis=1)[:, len(s) - k - 1] for i in range(0, len(x), 512)])

    def radii(self, length: np.ndarray, bound: np.ndarray, band: int, bits: int) -> np.ndarray:
        """The Hamming radius of each query among the entries of a band."""
        most = 2.0 ** ((band + _ROUNDED) / _BANDS)
        with np.errstate(over="ignore"):
            p = np.arccos(np.clip(bound / length / most, -1, 1)) / np.pi
        r = np.floor(bits * p + self.settings.margin * np.sqrt(bits * p * (1 - p)))
        return np.where(bound == -np.inf, bits, np.minimum(r, bits)).astype(int)


class Tables:
    """The index of some codes: for each substring and value, the rows that have it, as bits."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.n = codes, len(codes)
        self.rows = [np.packbits(codes[:, j] == np.arange(256, dtype=np.uint8)[:, None], axis=1) for j in range(codes.shape[1])]
        self.known: dict[tuple[int, int, int], np.ndarray] = {}

    def probe(self, j: int, value: int, r: int) -> np.ndarray:
        """Rows whose substring j is within r of the value."""
        if (got := self.known.get((j, value, r))) is None:
            got = self.known[j, value, r] = np.bitwise_or.reduce(self.rows[j][value ^ _NEAR[r]], axis=0)
        return got

    def within(self, code: np.ndarray, r: int) -> np.ndarray:
        """Every row within r of a code."""
        m = len(code)
        if r >= 8 * m:
            return np.arange(self.n)
        each, more = divmod(r, m)
        # if the first more + 1 substrings are further than `each`, and the others further than each - 1, r is exceeded
        found = np.zeros(self.rows[0].shape[1], np.uint8)
        for j in range(m):
            if (least := each - (j > more)) >= 0:
                found |= self.probe(j, int(code[j]), min(least, 8))
        at = np.flatnonzero(np.unpackbits(found, count=self.n))
        return at[_POP[self.codes[at] ^ code].sum(1, dtype=np.int32) <= r]


class Block:
    """A block of queries and the best entries of each so far."""

    def __init__(self, model: Model, t: pa.Table):
        self.model, self.keep = model, model.settings.k + 1
        self.h = t["h1"].to_numpy(), t["h2"].to_numpy()
        self.x, self.codes = vectors(t["x"].combine_chunks()), matrix(t["code"].combine_chunks())
        self.length, self.bound = t["length"].to_numpy(), t["bound"].to_numpy()
        self.best: list[tuple[np.ndarray, np.ndarray, list]] = [(np.empty(0), np.empty(0, np.int64), [])] * len(self.x)

    def meet(self, b: pa.RecordBatch, band: int) -> None:
        """Search some entries of a band."""
        x, tables, ids = vectors(b.column("x")), Tables(matrix(b.column("code"))), b.column("ids")
        first = ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]]
        long = np.linalg.norm(x, axis=1)
        for i, r in enumerate(self.model.radii(self.length, self.bound, band, 8 * self.codes.shape[1])):
            at = tables.within(self.codes[i], int(r))
            if not len(at):
                continue
            score, order, held = self.best[i]
            if len(at) > self.keep:
                near = x[at] @ self.x[i]
                slack = 1e-12 * long[at] * self.length[i]  # more than rounding can move a product
                least = np.partition(near - slack, len(at) - self.keep)[len(at) - self.keep]
                if len(score) == self.keep:
                    least = max(least, score[-1])
                at = at[near + slack >= least]
            score = np.concatenate([score, (x[at] * self.x[i]).sum(1)])
            order = np.concatenate([order, first[at]])
            held = held + [ids[int(j)] for j in at]
            top = np.lexsort((order, -score))[: self.keep]
            self.best[i] = score[top], order[top], [held[int(j)] for j in top]

    def found(self) -> Iterator[pa.RecordBatch]:
        n = [len(b[0]) for b in self.best]
        if sum(n):
            yield pa.record_batch([
                pa.array(np.repeat(self.h[0], n)), pa.array(np.repeat(self.h[1], n)), pa.array(np.concatenate([b[0] for b in self.best])),
                pa.array([v.as_py() for b in self.best for v in b[2]], pa.list_(pa.int64())),
            ], ["h1", "h2", "score", "ids"])


def vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def matrix(column: pa.Array) -> np.ndarray:
    """Byte strings of one length as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _valid(t: DataFrame, key: str) -> DataFrame:
    """(key, x, h1, h2) of rows that take part; two hashes name a vector."""
    x = F.transform("embedding", lambda v: v + F.lit(0.0))  # no negative zeros
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)) & F.exists("embedding", lambda v: v != 0)
    t = pick(t, **{key: "long", "embedding": "array<double>"}).filter(F.col(key).isNotNull() & F.coalesce(whole, F.lit(False)))
    return t.select(key, x.alias("x")).withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit("second"), "x")})


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    size = b.column("x").value_lengths().to_numpy()
    for d in np.unique(size):
        part = b.filter(pa.array(size == d))
        yield part, vectors(part.column("x"))


@dataclass
class Index:
    """The written index: `entries` holds a row for each distinct vector, `counts` their number for each length."""

    scratch: Scratch
    model: object
    entries: DataFrame
    counts: dict[int, int]


def build(table: DataFrame, settings: Settings = Settings()) -> Index:
    """The index of (id, embedding)."""
    if settings.k < 1 or settings.sample < 1 or settings.rotations < 1:
        raise ValueError("k, sample and rotations are 1 or more")
    scratch = Scratch(table.sparkSession)
    rows = _valid(table, "id").distinct()
    rank = F.row_number().over(W.partitionBy("h1", "h2", "x").orderBy("id"))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= settings.k + 1)
    plain = scratch.stage(rows.groupBy("h1", "h2", "x").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors")
    sample: dict[int, np.ndarray] = {}
    for part, x in (y for b in plain.orderBy("h1", "h2").limit(settings.sample).select("x").toArrow().to_batches() for y in _by_length(b)):
        sample[x.shape[1]] = np.concatenate([sample.get(x.shape[1], np.empty((0, x.shape[1]))), x])
    model = Model(settings, sample)
    shared = table.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        model = shared.value

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for part, x in _by_length(b):
                band = np.ceil(np.log2(np.linalg.norm(x, axis=1)) * _BANDS - _ROUNDED)
                out.append(pa.record_batch([part.column("h1"), part.column("h2"), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(band.astype(np.int32)), part.column("x"), pa.array([c.tobytes() for c in model.codes(x)], pa.binary()), part.column("ids")], names=[f.split()[0] for f in ENTRY.split(", ")]))
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

        return each

    entries = scratch.stage(mapped(plain, make, ENTRY), "index")
    scratch.drop(plain)
    counts = {r["dim"]: r["count"] for r in entries.groupBy("dim").count().collect()}
    return Index(scratch, shared, entries, counts)


def _asked(index: Index, queries: DataFrame) -> DataFrame:
    shared = index.model

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        model = shared.value

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for part, x in _by_length(b):
                out.append(pa.record_batch([part.column("h1"), part.column("h2"), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(np.linalg.norm(x, axis=1)), pa.array(model.bounds(x)), part.column("x"), pa.array([c.tobytes() for c in model.codes(x)], pa.binary())], names=[f.split()[0] for f in ASKED.split(", ")]))
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

        return each

    return mapped(queries, make, ASKED)


def _met(index: Index, asked: DataFrame, settings: Settings) -> DataFrame:
    """h1, h2, score, ids: each query's k + 1 best entries within its radius."""
    spark, shared = asked.sparkSession, index.model
    blocks = max(1, math.ceil(asked.count() / settings.block))
    stripes = max(math.ceil(sum(index.counts.values()) / settings.stripe), math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / blocks))
    n = lambda c, m: F.pmod(F.col(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asked.select("*", n("h1", blocks).alias("block"), every(stripes).alias("stripe")).select("block", "stripe", "dim", F.lit(-1).alias("kind"), F.lit(0).alias("band"), "h1", "h2", "length", "bound", "x", "code", F.lit(None).cast("array<long>").alias("ids"))
    nothing = F.lit(None).cast("double")
    right = index.entries.select("*", n("h2", stripes).alias("stripe"), every(blocks).alias("block")).select("block", "stripe", "dim", F.lit(0).alias("kind"), "band", "h1", "h2", nothing.alias("length"), nothing.alias("bound"), "x", "code", "ids")
    cells = left.unionByName(right).repartitionById(blocks * stripes, F.col("block") * stripes + F.col("stripe")).sortWithinPartitions("dim", "kind", F.desc("band"), "h1", "h2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        block, held, dim = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("dim", "kind", "band")], 1)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [b.num_rows]])
            for a, z in zip(cuts, cuts[1:], strict=False):
                d, kind, band = (int(v) for v in keys[a])
                if d != dim:
                    if block:
                        yield from block.found()
                    block, held, dim = None, [], d
                part = b.slice(a, z - a)
                if kind < 0:
                    held.append(part)
                elif held:
                    block, held = Block(model, pa.Table.from_batches(held)), []
                if kind == 0 and block:
                    block.meet(part, band)
        if block:
            yield from block.found()
        settle()

    found = cells.mapInArrow(run, "h1 long, h2 long, score double, ids array<long>")
    rank = F.row_number().over(W.partitionBy("h1", "h2").orderBy(F.desc("score"), F.col("ids")[0]))
    return found.withColumn("rank", rank).filter(F.col("rank") <= settings.k + 1).drop("rank")


def search(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for each query (query_id, embedding), its own id left out."""
    settings = index.model.value.settings
    scratch = index.scratch
    queries = scratch.stage(_valid(queries, "query_id").distinct(), "queries")
    asked = scratch.stage(_asked(index, queries.select("h1", "h2", "x").distinct()), "asked")
    met = scratch.stage(_met(index, asked, settings), "met")
    entries = F.create_map(*[F.lit(v) for d, n in sorted(index.counts.items()) for v in (d, n)]) if index.counts else F.lit(None).cast("map<int,bigint>")
    had = met.groupBy("h1", "h2").agg(F.count("*").alias("had"))
    short = asked.join(had, ["h1", "h2"], "left").filter(F.coalesce("had", F.lit(0)) < F.least(F.lit(settings.k + 1), F.coalesce(entries[F.col("dim")], F.lit(0)))).filter("bound > double('-inf')")
    short = scratch.stage(short.withColumn("bound", F.lit(-math.inf)).drop("had"), "short")
    if not short.isEmpty():
        met = met.join(short.select("h1", "h2"), ["h1", "h2"], "left_anti").unionByName(_met(index, short, settings))
    each: Column = F.flatten(F.transform("g", lambda g: F.transform(g["ids"], lambda i: F.struct((-g["score"]).alias("low"), i.alias("id")))))
    lists = met.groupBy("h1", "h2").agg(F.collect_list(F.struct("score", "ids")).alias("g")).select("h1", "h2", F.slice(F.array_sort(each), 1, settings.k + 1).alias("near"))
    own = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, settings.k)
    out = queries.select("query_id", "h1", "h2").join(lists, ["h1", "h2"]).select("query_id", F.posexplode(own).alias("pos", "x"))
    return scratch.result(out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.low")).alias("score")), "neighbours")
