"""Near duplicates among memories: pairs by tiles of rows, decisions, greedy merges, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.sources.shared import written


#: Blocks whose sizes are sent to every task, at most.
BLOCKS = 100_000
#: Tokens of a block's rows in one side of a tile, about: what a task holds, twice.
SIDE = 2_000_000
#: Pairs in one batch that a task gives out.
BATCH = 1 << 18


def _tiles(rows: DataFrame, block: list[str], left: Column, right: Column, half: bool, side: int) -> DataFrame:
    """Rows of each block, dealt into tiles that bring every left row together with every right one; if `half`, where all
    rows are both, each two rows come together once.  Columns: t (hash of block and tile), tile, left, right, twice (whether
    the tile's other rows may be met as left and as right ones), id, tokens (64-bit hashes)."""
    r = rows.select(F.xxhash64(*block, F.lit(0)).alias("t"), F.struct(*block, F.lit(0)).alias("block"), "id", F.transform("tokens", lambda x: F.xxhash64(x)).alias("tokens"), left.alias("left"), right.alias("right"))
    r = r.filter(F.size("tokens") > 0)
    for c in block:  # null is in no block
        r = r.filter(F.col(f"block.{c}").isNotNull())
    r = written(r, "tokens")  # else every pass cuts the texts anew
    n = lambda c: F.greatest(F.ceil(F.sum(F.when(F.col(c), F.size("tokens")).otherwise(0)) / side), F.lit(1)).cast("int")
    sizes = written(r.groupBy("block").agg(n("left").alias("_i"), n("right").alias("_j")), "blocks")
    if sizes.limit(BLOCKS + 1).count() <= BLOCKS:
        sizes = F.broadcast(sizes)
    r = r.join(sizes, "block").withColumn("h", F.xxhash64("id"))
    at = lambda c: F.pmod("h", F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    tile = lambda i, j, x, y: F.struct(i.alias("i"), j.alias("j"), x.alias("left"), y.alias("right"))
    if half:  # both sides have all rows: tile (i, j) only for i <= j
        sent = F.transform(every("_i"), lambda q: tile(F.least(q, at("_i")), F.greatest(q, at("_i")), at("_i") <= q, at("_i") >= q))
    else:
        no, yes = F.array().cast("array<struct<i:int,j:int,left:boolean,right:boolean>>"), F.lit(True)
        sent = F.concat(F.when(F.col("left"), F.transform(every("_j"), lambda q: tile(at("_i"), q, yes, F.lit(False)))).otherwise(no), F.when(F.col("right"), F.transform(every("_i"), lambda q: tile(q, at("_j"), F.lit(False), yes))).otherwise(no))
    twice = F.col("x.left") & F.col("x.right") if half else F.col("left") & F.col("right")
    r = r.withColumn("x", F.explode(sent)).select("t", "block", F.col("x.i").alias("i"), F.col("x.j").alias("j"), "x.left", "x.right", twice.alias("twice"), "id", "tokens")
    # two blocks of one hash must not meet, so their whole keys are told apart as well
    r = r.select(F.xxhash64("t", "i", "j").alias("t"), F.to_json(F.struct("block", "i", "j")).alias("tile"), "left", "right", "twice", "id", "tokens")
    return r.repartition("t").sortWithinPartitions("t", "tile")


def _compared(tiles: DataFrame, bound: float, meet: str, use, schema: str) -> DataFrame:
    """use(shares) of each tile.  Shares are, for one left row after the other: id, the right rows' ids and their ranks
    among the tile's ids, the places of those that it shares more than the bound with, jaccard, containment.  A row meets
    right rows of other ids: `each`, or `smaller` ids only, or such that any two rows meet `once`.

    Right rows' postings are counted for each left row, so a task holds its tile, and pairs go out in batches.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def shares(t: pa.Table):
        ids = t.column("id").combine_chunks()
        rank = np.asarray(pc.rank(ids, tiebreaker="dense")).astype(np.int64)
        lists = t.column("tokens").combine_chunks()
        n = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        flat, of = np.asarray(lists.flatten()), np.repeat(np.arange(len(n)), n)
        left, right = np.asarray(t.column("left").to_numpy()), np.asarray(t.column("right").to_numpy())
        twice = np.asarray(t.column("twice").to_numpy())
        _, flat = np.unique(flat, return_inverse=True)
        r_rows = np.flatnonzero(right)
        number = np.full(len(n), -1)
        number[r_rows] = np.arange(len(r_rows))
        here = right[of]
        by = np.argsort(flat[here], kind="stable")
        post = number[of[here]][by]
        start = np.concatenate([[0], np.cumsum(np.bincount(flat, here, minlength=int(flat.max()) + 1).astype(np.int64))])
        ends, m, r_rank, r_id, r_twice = np.cumsum(n), n[r_rows], rank[r_rows], ids.take(pa.array(r_rows)), twice[r_rows]
        for i in np.flatnonzero(left).tolist():
            mine = flat[ends[i] - n[i] : ends[i]]
            hits = [post[a:z] for a, z in zip(start[mine].tolist(), start[mine + 1].tolist(), strict=True) if z > a]
            if not hits:
                continue
            both = np.bincount(np.concatenate(hits), minlength=len(m))
            c = both / np.minimum(n[i], m)
            on = c > bound  # Jaccard is never more
            if meet == "smaller":
                on &= r_rank < rank[i]
            elif meet == "once" and twice[i]:
                on &= (r_rank < rank[i]) | ~r_twice & (r_rank != rank[i])
            else:
                on &= r_rank != rank[i]
            k = np.flatnonzero(on)
            if len(k):
                yield ids[i], r_id, r_rank, k, both[k] / (n[i] + m[k] - both[k]), c[k]

    def run(batches):
        from siltstone.llm.common import groups, settle

        for _, t in groups(batches, 1):
            names = t.column("tile").unique().to_pylist()
            for name in names:
                yield from use(shares(t if len(names) == 1 else t.filter(pc.equal(t.column("tile"), name))))
        settle()

    return tiles.mapInArrow(run, schema)


def pairs(rows: DataFrame, block: list[str], bound: float, asked: DataFrame | None = None, side: int = 0) -> DataFrame:
    """Pairs a < b of one block with max(Jaccard, containment) over the bound: a, b, jaccard, containment, sim; if `asked`
    (id) is given, those that have one of it.

    rows: id, tokens (distinct) and the block's columns.  No pair is shuffled: rows of a block go to tiles of a bounded
    number of tokens, and each tile's task counts what its rows share.  Tokens are compared by 64-bit hashes.
    """
    if asked is not None:
        rows = rows.join(asked.select("id", F.lit(True).alias("_asked")).distinct(), "id", "left").withColumn("_asked", F.coalesce("_asked", F.lit(False)))
    half = asked is None
    tiles = _tiles(rows, block, F.lit(True) if half else F.col("_asked"), F.lit(True), half, side or SIDE)
    kind = dict(rows.dtypes)["id"]
    found = _compared(tiles, bound, "once", _all_pairs, f"a {kind}, b {kind}, jaccard double, containment double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard", "containment", F.greatest("jaccard", "containment").alias("sim"))


def _all_pairs(shares):
    """Left and right row of each pair, in batches."""
    import numpy as np
    import pyarrow as pa

    held, size = [], 0

    def batch():
        a = pa.array([x[0].as_py() for x in held], held[0][0].type).take(pa.array(np.repeat(np.arange(len(held)), [len(x[3]) for x in held])))
        b = pa.concat_arrays([x[1].take(pa.array(x[3])) for x in held])
        return pa.record_batch([a, b, pa.array(np.concatenate([x[4] for x in held])), pa.array(np.concatenate([x[5] for x in held]))], ["a", "b", "jaccard", "containment"])

    for x in shares:
        held.append(x)
        size += len(x[3])
        if size >= BATCH:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def candidates(rows: DataFrame, block: list[str], bound: float, left: Column | None = None, right: Column | None = None, top: int = 5, smaller: bool = False, side: int = 0) -> DataFrame:
    """id, other, jaccard, containment, sim: of what each left row shares more than the bound with among the right rows (of
    smaller ids only, if `smaller`), its `top` by sim and its first by Jaccard, ties to the smaller id, and some more.

    That is all that `decide` looks at, up to its `cap`; no other pair leaves the task that finds it.
    """
    import numpy as np
    import pyarrow as pa

    yes = F.lit(True)
    tiles = _tiles(rows, block, yes if left is None else left, yes if right is None else right, False, side or SIDE)

    def use(shares):
        def best():
            for i, ids, others, k, j, c in shares:
                if len(k) > top:
                    keep = np.lexsort((others[k], -np.maximum(j, c)))[:top]
                    keep = np.union1d(keep, np.lexsort((others[k], -j))[:1])
                    k, j, c = k[keep], j[keep], c[keep]
                yield i, ids, others, k, j, c

        yield from (pa.record_batch(b.columns, ["id", "other", "jaccard", "containment"]) for b in _all_pairs(best()))

    kind = dict(rows.dtypes)["id"]
    return _compared(tiles, bound, "smaller" if smaller else "each", use, f"id {kind}, other {kind}, jaccard double, containment double").withColumn("sim", F.greatest("jaccard", "containment"))


def tallied(rows: DataFrame, block: list[str], bound: float, duplicate: float, thetas: list[float], side: int = 0) -> DataFrame:
    """sim, is_duplicate (Jaccard over `duplicate`), n: pairs over the bound, counted; those between the same two of the
    thresholds count as one sim, the greatest among them."""
    import numpy as np
    import pyarrow as pa

    tiles = _tiles(rows, block, F.lit(True), F.lit(True), True, side or SIDE)
    steps = np.array(sorted(thetas))

    def use(shares):
        count, most = np.zeros(2 * len(steps) + 2, np.int64), np.zeros(2 * len(steps) + 2)
        for *_, j, c in shares:
            sim = np.maximum(j, c)
            at = 2 * np.searchsorted(steps, sim, "left") + (j > duplicate)
            count += np.bincount(at, minlength=len(count))
            np.maximum.at(most, at, sim)
        on = np.flatnonzero(count)
        if len(on):
            yield pa.record_batch([pa.array(most[on]), pa.array(on % 2 == 1), pa.array(count[on])], ["sim", "is_duplicate", "n"])

    return _compared(tiles, bound, "once", use, "sim double, is_duplicate boolean, n long")


#: Stored rows, and tokens of them all, up to which they are sent to every task.
STORED_ROWS, STORED_TOKENS = 50_000, 5_000_000


def against(rows: DataFrame, stored: DataFrame, schema: str, fold) -> DataFrame | None:
    """fold(id, n, shared, sizes) of each row (id, tokens): the tokens that it shares with each stored row (other, tokens)
    and their sizes.  One pass over the rows with the stored ones' postings in every task; None if they are too many."""
    import numpy as np
    import pyarrow as pa

    size = stored.agg(F.count("*"), F.sum(F.size("tokens"))).first()
    if size[0] > STORED_ROWS or (size[1] or 0) > STORED_TOKENS:
        return None
    held = stored.select("other", "tokens").orderBy("other").collect()
    post: dict[str, list[int]] = {}
    for i, r in enumerate(held):
        for t in r["tokens"]:
            post.setdefault(t, []).append(i)
    index = {t: np.array(v, np.int32) for t, v in post.items()}
    shared = rows.sparkSession.sparkContext.broadcast((index, np.array([len(r["tokens"]) for r in held], np.int64), [r["other"] for r in held]))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        index, sizes, others = shared.value
        for b in batches:
            out = []
            for i, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hits = [index[t] for t in tokens or () if t in index]
                counts = np.bincount(np.concatenate(hits), minlength=len(sizes)) if hits else np.zeros(len(sizes), np.int64)
                out.append((i, fold(len(tokens or ()), counts, sizes, others)))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out])], names)

    return rows.select(F.col("id").cast("long").alias("id"), "tokens").mapInArrow(run, schema)


def gray_bound(lexical: Column, judged: bool = True) -> Column:
    """From which lexical similarity on a judge is asked: lower while calls of the judge are left."""
    return F.when((lexical >= 0.35) & (lexical < 0.50) & F.lit(judged), 0.35).otherwise(0.50)


def band(lexical: Column, vector: Column, threshold: float = 0.7, judged: bool = True) -> Column:
    """What a candidate's two similarities ask for: merge, gray zone or new."""
    gray = (vector > 0.60) | (lexical >= gray_bound(lexical, judged))
    return F.when((vector > 0.85) | (lexical > threshold), "merge").when(gray, "gray_zone").otherwise("create_new")


def decide(candidates: DataFrame, threshold: float, window_days: float = 7, cap: int = 5, judged: bool = True) -> DataFrame:
    """new_id, action, targets: what inserting each new row does, by its candidates.

    candidates: new_id, old_id, lexical, vector, age_days, contains (the new row strongly contains the old one).  Rows
    without a candidate have old_id null.
    """
    one = W.partitionBy("new_id")
    c = candidates.withColumns({"_best_v": F.max("vector").over(one), "_hits": F.sum(F.when(F.col("lexical") > threshold, 1).otherwise(0)).over(one), "_best_l": F.max("lexical").over(one)})
    by_vector = F.col("_best_v") > 0.85
    order = F.when(by_vector & (F.col("_hits") < 2), F.coalesce("vector", F.lit(-1.0))).otherwise(F.coalesce("lexical", F.lit(-1.0)))
    c = c.withColumn("_r", F.row_number().over(one.orderBy(order.desc(), "old_id")))
    hits = c.groupBy("new_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("lexical") > threshold, F.struct("_r", "old_id")))), lambda x: x["old_id"]), 1, cap).alias("_many"))
    best = c.filter("_r = 1").join(hits, "new_id")
    supersede = (F.col("age_days") >= window_days) | F.col("contains")
    action = (
        F.when(F.col("old_id").isNull(), "create_new")
        .when(by_vector & (F.col("_hits") < 2), F.when(supersede, "supersede").otherwise("merge_into"))
        .when((F.col("_best_v") > 0.60) & (F.col("_best_l") < threshold), "gray_zone")
        .when(F.col("_hits") >= 2, F.when(supersede, "supersede").otherwise("merge_into_many"))
        .when(F.col("_hits") == 1, F.when(supersede, "supersede").otherwise("merge_into"))
        .when(F.col("_best_l") >= gray_bound(F.col("_best_l"), judged), F.when(F.col("_best_v") < 0.50, "create_new").otherwise("gray_zone"))
        .otherwise("create_new")
    )
    targets = F.when(F.col("action") == "create_new", F.array().cast("array<bigint>")).when(F.col("action") == "merge_into_many", F.col("_many")).otherwise(F.array("old_id"))
    return best.withColumn("action", action).select("new_id", "action", targets.alias("targets"))


def greedy(found: DataFrame, sizes: DataFrame, block: list[str]) -> DataFrame:
    """winner, loser: pairs resolved in their order; a row that has lost takes no further part.  The longer row wins, of
    equal ones the second.  Only pairs that chains of pairs connect matter to each other, so each component is folded by
    itself, wherever it lies."""
    import pandas as pd

    s = sizes.select(F.col("id").alias("a"), F.col("size").alias("sa")), sizes.select(F.col("id").alias("b"), F.col("size").alias("sb"))
    found = found.select("a", "b").distinct()
    root = components(found).select(F.col("id").alias("a"), "root")
    rows = found.join(root, "a").join(s[0], "a").join(s[1], "b")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        lost, out = set(), []
        for a, b, x, y in pdf.sort_values(["a", "b"])[["a", "b", "sa", "sb"]].itertuples(index=False):
            if a in lost or b in lost:
                continue
            w, l = (a, b) if x > y else (b, a)
            lost.add(l)
            out.append((w, l))
        return pd.DataFrame(out, columns=["winner", "loser"])

    return rows.groupBy("root").applyInPandas(fold, "winner long, loser long")


def merged(winner: Column, loser: Column, note: str) -> dict[str, Column]:
    """Columns of a winner's row after it took in a loser (both structs)."""
    from siltstone.schema import importance_rank

    novel = text.novel_lines(loser["content"], winner["content"])
    stronger = F.when(importance_rank(loser["importance"]) > importance_rank(winner["importance"]), loser["importance"]).otherwise(winner["importance"])
    return {
        "content": F.when(F.size(novel) == 0, winner["content"]).otherwise(F.concat_ws("\n", winner["content"], F.lit(note), F.array_join(novel, "\n"))),
        "keywords": F.array_union(winner["keywords"], loser["keywords"]),
        "importance": stronger,
        "access_count": winner["access_count"] + loser["access_count"] + 1,
        "strength": F.least(F.lit(1.0), winner["strength"] + 0.1),
        "decay_lambda": F.least(winner["decay_lambda"], loser["decay_lambda"]),
        "layer": F.when(stronger.isin("high", "critical"), "ltm").otherwise(winner["layer"]),
    }


def novelty(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """id, novelty: 1 less the greatest similarity to any stored row (tokens).

    In one pass if the stored rows are few enough to be sent to every task, else by postings.
    """
    stored = stored.select(F.col("id").alias("other"), "tokens")

    def nearest(n, shared, sizes, others):
        import numpy as np

        hit = np.flatnonzero(shared)
        if not len(hit):
            return 1.0
        c, m = shared[hit], sizes[hit]
        return 1.0 - float(np.maximum(c / (n + m - c), c / np.minimum(n, m)).max())

    if (out := against(rows, stored, "id long, novelty double", nearest)) is not None:
        return out
    a = rows.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    b = stored.select("other", F.size("tokens").alias("m"), F.explode("tokens").alias("t"))
    both = a.join(b, "t").groupBy("id", "other").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    sim = F.greatest(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), F.col("c") / F.least("n", "m"))
    return rows.select("id").join(both.groupBy("id").agg(F.max(sim).alias("s")), "id", "left").select("id", (1 - F.coalesce("s", F.lit(0.0))).alias("novelty"))


def thetas(low: int = 30, high: int = 95, step: int = 5) -> list[float]:
    return [x / 100 for x in range(low, high + 1, step)]


def sweep(labelled: DataFrame, low: int = 30, high: int = 95, step: int = 5) -> DataFrame:
    """theta, tp, fp, tn, fn, precision, recall, f1, accuracy of (sim, is_duplicate) at each threshold, in one pass; a row
    counts `n` times, if there is such a column."""
    theta = F.explode(F.array(*[F.lit(x) for x in thetas(low, high, step)]))
    at = labelled.select("sim", "is_duplicate", (F.col("n") if "n" in labelled.columns else F.lit(1)).alias("_n"), theta.alias("theta"))
    hit = F.col("sim") > F.col("theta")
    count = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0)).cast("long")
    n = at.groupBy("theta").agg(count(hit & F.col("is_duplicate")).alias("tp"), count(hit & ~F.col("is_duplicate")).alias("fp"), count(~hit & ~F.col("is_duplicate")).alias("tn"), count(~hit & F.col("is_duplicate")).alias("fn"))
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    n = n.withColumns({"precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn"))})
    return n.withColumns({"f1": safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))})


def best_threshold(swept: DataFrame) -> DataFrame:
    """The best by F1, then accuracy, then the higher; and the one of most recall without a false positive, the lower of ties."""
    return swept.agg(
        F.max_by("theta", F.struct("f1", "accuracy", "theta")).alias("best"),
        F.max_by("theta", F.when(F.col("fp") == 0, F.struct("recall", -F.col("theta")))).alias("safe"),
    )


def components(links: DataFrame) -> DataFrame:
    """id, root: the least id that links (a, b) connect it with.  Labels move along links and along labels in turn, so the
    rounds grow with the logarithm of a chain's length."""
    from siltstone.sources.shared import checkpoint_dir

    checkpoint_dir(links.sparkSession)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("root")).checkpoint()
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r"))
        new = label.join(near, "id").select("id", F.least("root", "r").alias("root"))
        jump = new.select(F.col("id").alias("root"), F.col("root").alias("r2"))
        new = new.join(jump, "root", "left").select("id", F.coalesce("r2", "root").alias("root")).checkpoint()
        if new.join(label, ["id", "root"], "left_anti").isEmpty():
            return new
        label = new


def cluster_thresholds(sims: DataFrame, members: DataFrame, least: int = 5) -> DataFrame:
    """cluster_id, threshold: the 90 % point (floor index) of pair similarities in each cluster of enough members."""
    from siltstone.operators.aggregate import floor_quantile

    q = floor_quantile(sims, ["cluster_id"], "sim", 0.9, "p90")
    return q.join(members.filter(F.col("n") >= least), "cluster_id").select("cluster_id", F.least(F.lit(0.9), F.greatest(F.lit(0.4), "p90")).alias("threshold"))
