"""HDBSCAN over any number of vectors: all distances in blocks, a spanning tree by Borůvka's rounds, merges in batches.

Results are those of `cluster.hdbscan`, which holds everything in one task: edges are ordered by (weight, smaller id, larger
id), so there is one minimum spanning tree and one order of merges.

One pass over all pairs of blocks (`tiles`) finds the `near` closest of each vector, and with them its core distance.  In each
round every component takes its least edge to another one; edges within a component go for good.  A vector whose list has no
other component any more bounds what it could still have by the list's end, since mutual reachability is no less than
distance; only vectors whose bound isn't above what their component has found are looked up again among all others.
Components are joined by pointer jumping.  Tables of a round are deleted when the next one has been written.

The merges of the tree are followed in order, at most `batch` edges at once: the driver holds a batch with the sizes and
clusters of what it merges, and the nodes of the condensed tree (three for each merge of two clusters, so at most
3 n / min_cluster_size).  The vectors' groups and nodes stay in a table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.retrieval import tips
from siltstone.operators.tiles import distance, leaving, near_lists
from siltstone.sources.shared import dropped, written

BLOCK = 4_096
BATCH = 200_000


def spanning_tree(points: DataFrame, known: DataFrame, n: int, near: int) -> DataFrame:
    """w, lo, hi: the edges of the minimum spanning tree of (id, x, core); `known` has the lists (id, other, d) of each one's
    closest, and is deleted."""
    end = known.groupBy("id").agg(F.max("d").alias("end"), F.count("*").alias("n")).select("id", F.when(F.col("n") < min(near, n - 1), F.lit(math.inf)).when(F.lit(near >= n - 1), F.lit(math.inf)).otherwise(F.col("end")).alias("end"))
    comps = written(points.select("id", "core", F.col("id").alias("comp")).join(end, "id", "left").withColumn("end", F.coalesce("end", F.lit(math.inf))), "comps")
    # weights once, and each edge from the side that has it in its list
    of = comps.select(F.col("id").alias("other"), F.col("core").alias("other_core"))
    edges = written(known.join(comps.select("id", "core"), "id").join(of, "other").select("id", "other", F.greatest("d", "core", "other_core").alias("w")), "edges")
    dropped(known)
    chosen_edges, left = [], n
    while left > 1:
        if chosen_edges:
            across = comps.select(F.col("id").alias("other"), F.col("comp").alias("other_comp"))
            old, edges = edges, written(edges.join(comps.select("id", "comp"), "id").join(across, "other").filter("comp <> other_comp").select("id", "other", "w"), "edges")
            dropped(old)
        edge = F.struct("w", F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi"))
        mine = edges.groupBy("id").agg(F.min(edge).alias("e"))
        each = written(comps.join(mine, "id", "left").select("id", "comp", "end", "e"), "each")
        best = each.groupBy("comp").agg(F.min("e").alias("best"))
        # what isn't in a vector's list is at its end or beyond; a tie there may come first by ids
        unsure = (F.col("e").isNull() | (F.col("e.w") >= F.col("end"))) & (F.col("best").isNull() | (F.col("end") <= F.col("best.w"))) & (F.col("end") < math.inf)
        again = written(each.join(best, "comp").filter(unsure).select("id", "comp"), "again")
        n_again = again.count()
        found, more = each.select("comp", "e").filter("e is not null"), None
        if n_again:
            placed = points.join(comps.select("id", "comp"), "id")
            more = leaving(points.join(again, "id"), placed, n_again, n, BLOCK)
            found = found.unionByName(more.join(again, "id").select("comp", F.struct("w", "lo", "hi").alias("e")))
        chosen = written(found.groupBy("comp").agg(F.min("e").alias("e")).select("comp", "e.w", "e.lo", "e.hi"), "chosen")
        chosen_edges.append(chosen)
        # each component points at the one across its edge; of two that point at each other, the smaller is the end
        of_ends = chosen.select("comp", F.explode(F.array("lo", "hi")).alias("id"))
        ends = of_ends.join(comps.select("id", F.col("comp").alias("to")), "id").filter("to <> comp").select("comp", "to")
        back = ends.select(F.col("comp").alias("to"), F.col("to").alias("comp"), F.lit(True).alias("back"))
        step = written(ends.join(back, ["comp", "to"], "left").select(F.col("comp").alias("id"), F.when(F.coalesce("back", F.lit(False)) & (F.col("comp") < F.col("to")), None).otherwise(F.col("to")).alias("superseded_by")), "step")
        to = tips(step).select(F.col("id").alias("comp"), "tip")
        old, comps = comps, written(comps.join(to, "comp").select("id", "core", F.col("tip").alias("comp"), "end"), "comps")
        dropped(old, each, again, step, *([more] if more is not None else []))
        left = comps.select("comp").distinct().count()
    # both ends of an edge may have taken it, in one round
    tree = written(reduce(DataFrame.unionByName, [c.select("w", "lo", "hi") for c in chosen_edges]).distinct(), "tree")
    dropped(comps, edges, *chosen_edges)
    return tree


class Condensed:
    """The condensed tree in sums: what `cluster.Forest` does with lists of points, it does with their numbers."""

    def __init__(self, least: int):
        self.least, self.top = least, 0.0
        self.kids: list[list[int]] = []
        self.own: list[int] = []
        self.points: list[int] = []  # that are placed in the node itself
        self.birth: list[float | None] = []
        self.death: list[float] = []

    def new(self, kids: list[int], own: int, points: int, birth: float | None, death: float) -> int:
        for held, value in ((self.kids, kids), (self.own, own), (self.points, points), (self.birth, birth), (self.death, death)):
            held.append(value)
        return len(self.kids) - 1

    def follow(self, edges: list) -> list[tuple]:
        """Merges edges in order; (group, new group, size, cluster, node) of each group met, node being where its points
        go that have no node yet."""
        size: dict[int, int] = {}
        cluster: dict[int, int | None] = {}
        into: dict[int, int] = {}
        node: dict[int, int] = {}
        members: dict[int, list[int]] = {}
        for r in edges:
            for g, s, c in ((r["ga"], r["sa"], r["ca"]), (r["gb"], r["sb"], r["cb"])):
                if g not in size:
                    size[g], cluster[g], members[g] = s, c, [g]

        def find(g: int) -> int:
            while g in into:
                if into[g] in into:
                    into[g] = into[into[g]]
                g = into[g]
            return g

        def place(g: int, at: int) -> None:
            for m in members[g]:
                node.setdefault(m, at)

        for r in edges:
            a, b = find(r["ga"]), find(r["gb"])
            density = 1 / r["w"] if r["w"] > 0 else math.inf
            ca, cb = cluster[a], cluster[b]
            big_a, big_b = size[a] >= self.least, size[b] >= self.least
            made = None
            if big_a and big_b:
                halves = []
                for g, c in ((a, ca), (b, cb)):
                    halves.append(self.new([] if c is None else [c], size[g], size[g] if c is None else 0, density, density))
                    if c is None:
                        place(g, halves[-1])
                made = self.new(halves, 0, 0, None, density)
                self._seen(density)
            elif big_a or big_b:
                big, small, made = (a, b, ca) if big_a else (b, a, cb)
                if made is None:
                    made = self.new([], size[big], size[big], density, 0.0)
                    place(big, made)
                place(small, made)
                self.points[made] += size[small]
                self._seen(density)
            for c in (ca, cb):
                if c is not None and self.birth[c] is None:
                    self.birth[c] = density
            if size[a] < size[b]:
                a, b = b, a
            size[a] += size[b]
            members[a] += members.pop(b)
            into[b] = a
            cluster[a] = made
        return [(g, t := find(g), size[t], cluster[t], node.get(g)) for g in size]

    def _seen(self, density: float) -> None:
        if density < math.inf:
            self.top = max(self.top, density)

    def labels(self) -> dict[int, int]:
        """The label of what is placed in each node, for nodes of chosen clusters."""
        n, top = len(self.kids), self.top if self.top > 0 else 1.0
        gain = []
        for c in range(n):
            death = self.death[c] if 0 < self.death[c] < math.inf else top
            gain.append(self.own[c] * max(0.0, death - (self.birth[c] or 0.0)))
        chosen = [not k for k in self.kids]
        for c in range(n):
            if self.kids[c]:
                below = sum(gain[k] for k in self.kids[c])
                if gain[c] > below:
                    chosen[c] = True
                    todo = list(self.kids[c])
                    while todo:
                        k = todo.pop()
                        chosen[k] = False
                        todo += self.kids[k]
                else:
                    gain[c] = below
        out: dict[int, int] = {}
        label = 0
        for c in range(n):
            if chosen[c]:
                held, todo = [], [c]
                while todo:
                    k = todo.pop()
                    held.append(k)
                    todo += [x for x in self.kids[k] if not chosen[x]]
                if sum(self.points[k] for k in held) >= self.least:
                    out |= {k: label for k in held}
                    label += 1
        return out


def clusters(vectors: DataFrame, min_cluster_size: int, min_samples: int, near: int | None = None, batch: int = BATCH) -> DataFrame:
    """id, label (-1: noise) of (id, embedding); ids are unique, and null or empty vectors left out."""
    spark = vectors.sparkSession
    least = max(2, min_cluster_size)
    points = vectors.filter("id is not null and size(embedding) > 0").select(F.col("id").cast("long").alias("id"), F.col("embedding").alias("x"))
    n = points.count()
    if n < least:
        return points.select("id", F.lit(-1).alias("label"))
    samples = min(min_samples, n - 1)
    near = min(max(near or 2 * min_samples + 6, samples, 1), n - 1)
    lists = near_lists(points, n, near, distance, BLOCK)
    core = lists.filter(F.col("place") == samples).select("id", F.greatest("value", F.lit(0.0)).alias("core")) if samples else points.select("id", F.lit(0.0).alias("core"))
    points = written(points.join(core, "id"), "points")
    known = written(lists.select("id", "other", F.col("value").alias("d")), "known")
    dropped(lists)
    tree = spanning_tree(points, known, n, near)
    dropped(points)
    condensed, last = Condensed(least), None
    state, held = vectors.filter("id is not null and size(embedding) > 0").select(F.col("id").cast("long").alias("id")), None
    state = state.select("id", F.col("id").alias("group"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("int").alias("node"))
    for _ in range(math.ceil((n - 1) / batch)):
        rest = tree if last is None else tree.filter(F.struct("w", "lo", "hi") > F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(last, ("double", "long", "long"), ("w", "lo", "hi"), strict=True)]))
        part = rest.orderBy("w", "lo", "hi").limit(batch)
        side = lambda at, g, s, c: state.select(F.col("id").alias(at), F.col("group").alias(g), F.col("size").alias(s), F.col("cluster").alias(c))
        edges = part.join(side("lo", "ga", "sa", "ca"), "lo").join(side("hi", "gb", "sb", "cb"), "hi").collect()  # a batch
        edges.sort(key=lambda r: (r["w"], r["lo"], r["hi"]))
        last = (edges[-1]["w"], edges[-1]["lo"], edges[-1]["hi"])
        met = spark.createDataFrame(condensed.follow(edges), "group long, new_group long, new_size long, new_cluster int, new_node int").withColumn("met", F.lit(True))
        new = lambda c: F.when(F.col("met"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
        old, held = held, written(state.join(met, "group", "left").select("id", new("group"), new("size"), new("cluster"), F.coalesce("node", "new_node").alias("node")), "groups")
        state = held
        if old is not None:
            dropped(old)
    dropped(tree)
    if not condensed.kids:
        return state.select("id", F.lit(0).alias("label"))
    labels = spark.createDataFrame(list(condensed.labels().items()) or [], "node int, label int")
    return state.join(labels, "node", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))
