"""A stored neighbour index over vectors: coarse cells with probing, in versions that are extended.

Cells are centroids of directions, learned from a bounded sample; every vector is written into the cell that is nearest to
it, and large cells into parts.  A search looks into the cells nearest to each query.  How many those are is measured when
the index is built: for a bounded trial of rows the exact neighbours are found among all rows, and the index keeps the least
number of cells that holds the wanted share of them.  With all cells a search is exact.

Deleted and replaced rows, and rows that a caller's table of live rows doesn't have, are taken out before the k best are
chosen.  Vectors that are null, or of another length than the index, take no part; a vector of norm 0 has a similarity of 0.
Ties go to the smaller id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.retrieval import nearest, top_k
from siltstone.sources.shared import written
from siltstone.sources.versions import Versions, replaced

#: Rows of a part of a cell, about; queries that meet a part at once, about.
PART, BLOCK = 8_192, 8_192


def units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def learned_cells(x: np.ndarray, n: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Directions of n cells for unit vectors x."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:n]]
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        empty = np.bincount(of, minlength=len(c)) == 0
        sums[empty] = x[rng.integers(0, len(x), int(empty.sum()))]
        c = units(sums)
    return c


@dataclass
class VectorIndex:
    """Writes versions of the index of (id, embedding)."""

    spark: SparkSession
    root: str
    #: Vectors that cells are learned from, and rows that probes are measured with, at most.
    sample: int = 20_000
    trial: int = 200
    #: Share of the trial rows' `near` neighbours that the probed cells must hold.
    recall: float = 0.95
    near: int = 10

    @property
    def versions(self) -> Versions:
        return Versions(self.spark, self.root)

    def build(self, vectors: DataFrame, cells: int | None = None) -> int:
        now = self.versions.latest()
        rows = vectors.filter("id is not null and embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
        size, n = (sizes["size"], sizes["count"]) if sizes else (0, 0)
        rows = rows.filter(F.size("embedding") == size)
        first = rows.orderBy(F.xxhash64("id"), "id").limit(self.sample).select("embedding").toArrow()
        x = units(matrix(first["embedding"].combine_chunks())) if n else np.zeros((1, 1))
        centers = learned_cells(x, max(1, min(cells or round(math.sqrt(n)), len(x))))
        segment = self._segment(rows, centers, None, [])
        manifest = {"size": size, "cells": centers.tolist(), "probes": len(centers), "measured": 1.0, "segments": [segment]}
        manifest |= self._measured(manifest, rows)
        return self.versions.publish(manifest, now[0] if now else 0)

    def extend(self, vectors: DataFrame, deleted: DataFrame | None = None) -> int:
        """A version with these rows as well, in place of former ones of their ids, and without the deleted ids (id)."""
        now = self.versions.latest()
        if not now:
            return self.build(vectors)
        number, manifest = now
        rows = vectors.filter("id is not null and embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.size("embedding") == manifest["size"])
        ids = vectors.select(F.col("id").cast("long").alias("id"))
        ids = ids if deleted is None else ids.unionByName(deleted.select(F.col("id").cast("long").alias("id")))
        segment = self._segment(rows, np.array(manifest["cells"]), ids.distinct(), manifest["segments"])
        return self.versions.publish(manifest | {"segments": [*manifest["segments"], segment]}, number)

    def _segment(self, rows: DataFrame, centers: np.ndarray, ids: DataFrame | None, before: list[dict]) -> dict:
        path = self.versions.new_segment()
        shared = self.spark.sparkContext.broadcast(centers)

        def cell(batches):
            for b in batches:
                if b.num_rows:
                    of = (units(matrix(b.column("embedding"))) @ shared.value.T).argmax(1)
                    yield pa.record_batch([b.column("id"), b.column("embedding"), pa.array(of.astype(np.int32))], ["id", "embedding", "cell"])

        placed = written(rows.select("id", "embedding").mapInArrow(cell, "id long, embedding array<double>, cell int"), "cells")
        counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
        parts = {c: max(1, -(-n // PART)) for c, n in counts.items()}
        of = F.create_map(*[F.lit(v) for c, n in sorted(parts.items()) for v in (c, n)])[F.col("cell")] if parts else F.lit(1)
        placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), of.cast("long")).cast("int"))
        # files are sorted by cell, so a search of few queries reads the row groups of their cells only
        placed.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part", "id").write.parquet(f"{path}/rows")
        out = {"path": path, "replaces": 0, "rows": sum(counts.values()), "parts": {str(c): n for c, n in parts.items()}}
        if ids is not None:
            gone = VectorReader(self.spark, {"segments": before}).rows().join(ids, "id", "left_semi").select("id").distinct()
            gone.write.parquet(f"{path}/replaced")
            out["replaces"] = self.spark.read.parquet(f"{path}/replaced").count()
        return out

    def _measured(self, manifest: dict, rows: DataFrame) -> dict:
        """The least number of cells with the wanted share of the trial rows' neighbours, and the share."""
        trial = rows.orderBy(F.xxhash64(F.lit("trial"), F.col("id")), "id").limit(self.trial).select(F.col("id").alias("query_id"), "embedding").collect()
        if not trial:
            return {}
        asked = self.spark.createDataFrame(trial, "query_id long, embedding array<double>")
        reader = VectorReader(self.spark, manifest)
        near = nearest(rows, asked, self.near + 1).filter("query_id <> id").select("query_id", "id")
        where = {(r["query_id"], r["id"]): r["cell"] for r in reader.rows().select("id", "cell").join(F.broadcast(near), "id").collect()}
        centers = np.array(manifest["cells"])
        turn = {r["query_id"]: np.argsort(np.argsort(-(units(np.array([r["embedding"]])) @ centers.T)[0], kind="stable")) for r in trial}
        at = np.sort([turn[q][c] + 1 for (q, _), c in where.items()])
        if not len(at):
            return {}
        probes = int(at[min(len(at) - 1, math.ceil(self.recall * len(at)) - 1)])
        return {"probes": probes, "measured": float((at <= probes).mean())}

    def reader(self, number: int | None = None) -> VectorReader:
        if number is None:
            number, manifest = self.versions.latest()
        else:
            manifest = self.versions.read(number)
        return VectorReader(self.spark, manifest)


@dataclass
class VectorReader:
    """Searches one version."""

    spark: SparkSession
    manifest: dict

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """id, embedding, cell, part, segment of the rows that count; of some cells only, if these are stated."""
        out = None
        for i, s in enumerate(self.manifest["segments"]):
            part = self.spark.read.schema("id long, embedding array<double>, cell int, part int").parquet(f"{s['path']}/rows").withColumn("segment", F.lit(i))
            out = part if out is None else out.unionByName(part)
        if cells is not None:
            out = out.filter(F.col("cell").isin(cells))
        gone = replaced(self.spark, self.manifest["segments"])
        if gone is None:
            return out
        return out.join(gone, "id", "left").filter(F.col("upto").isNull() | (F.col("segment") > F.col("upto"))).drop("upto")

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, unit, cell of the cells nearest to each query (query_id, embedding)."""
        shared = self.spark.sparkContext.broadcast(np.array(self.manifest["cells"]))
        n = min(probes, len(self.manifest["cells"]))

        def choose(batches):
            for b in batches:
                if b.num_rows:
                    u = units(matrix(b.column("embedding")))
                    cells = np.argsort(-(u @ shared.value.T), axis=1, kind="stable")[:, :n].astype(np.int32)
                    lists = lambda m, t: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), t))
                    yield pa.record_batch([b.column("query_id"), lists(u, pa.float64()), lists(cells, pa.int32())], ["query_id", "unit", "cells"])

        asked = queries.filter(F.size("embedding") == self.manifest["size"]).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return asked.mapInArrow(choose, "query_id long, unit array<double>, cells array<int>").select("query_id", "unit", F.explode("cells").alias("cell"))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, live: DataFrame | None = None) -> DataFrame:
        """query_id, id, score (cosine), rank of the k nearest found; only rows of `live` (id), if that is given.

        Queries meet each part of a cell in blocks, so a group holds a part and a block at most.
        """
        probes = self.manifest["probes"] if probes is None else probes
        asked = written(self.probed(queries, probes), "probes")
        few = [r["cell"] for r in asked.select("cell").distinct().limit(513).collect()]
        rows = self.rows(few if len(few) <= 512 else None)
        if live is not None:
            rows = rows.join(live.select(F.col("id").cast("long").alias("id")), "id", "left_semi")
        most = asked.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
        blocks = max(1, -(-most // BLOCK))
        parts: dict[int, int] = {}
        for s in self.manifest["segments"]:
            for c, n in s["parts"].items():
                parts[int(c)] = max(parts.get(int(c), 1), n)
        many = {c: n for c, n in parts.items() if n > 1}
        n = F.coalesce(F.create_map(*[F.lit(v) for x in sorted(many.items()) for v in x])[F.col("cell")], F.lit(1)) if many else F.lit(1)
        every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
        left = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", every(n))
        right = rows.select("id", "embedding", "cell", "part", every(F.lit(blocks)).alias("block"))
        key = ["cell", "part", "block"]

        def meet(q: pa.Table, v: pa.Table) -> pa.Table:
            out = {"query_id": [], "id": [], "score": []}
            if q.num_rows and v.num_rows:
                order = np.argsort(v["id"].to_numpy(), kind="stable")
                ids, x = v["id"].to_numpy()[order], units(matrix(v["embedding"].combine_chunks()))[order]
                unit, asked = matrix(q["unit"].combine_chunks()), q["query_id"].to_numpy()
                for i in range(0, len(unit), 512):
                    s = unit[i : i + 512] @ x.T
                    top = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :k]
                    out["query_id"].append(np.repeat(asked[i : i + 512], top.shape[1]))
                    out["id"].append(ids[top].ravel())
                    out["score"].append(np.take_along_axis(s, top, 1).ravel())
            return pa.table({c: pa.array(np.concatenate(p) if p else [], t) for (c, p), t in zip(out.items(), (pa.int64(), pa.int64(), pa.float64()), strict=True)})

        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query_id long, id long, score double")
        return top_k(found.withColumn("score", F.round("score", 12)), k)
