"""Packing of documents into training sequences.

`best_fit` is bulk-synchronous best fit over a table of pieces of any size.  `pack_shards` is best-fit-decreasing with a
segment tree inside each shard, and writes the sequences as files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, fresh_name, groups, mapped, pick, spread, stage, utf8

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def pieces_of(ids: bytes, capacity: int, width: int = 4) -> list[tuple[int, bytes]]:
    """(start, ids) of a document's pieces: whole if it fits, else a shorter first piece and then full ones."""
    n = len(ids) // width
    first = n if n <= capacity else n % capacity or capacity
    cuts = [0, *range(first, n, capacity), n] if n else []
    return [(a, ids[a * width : b * width]) for a, b in zip(cuts, cuts[1:], strict=False)]


def tokenize_pieces(docs: DataFrame, vocabulary: str, capacity: int, end: int | None) -> DataFrame:
    """The pieces of every document with their ids (little-endian unsigned 32-bit).  Null text is empty; only longer
    documents than `capacity` are cut.  An empty document without an `end` has no piece.  Extra columns are ignored."""
    tail = b"" if end is None else int(end).to_bytes(4, "little")

    def make():
        from siltstone.llm.tokens import encoder

        encode = encoder(vocabulary)

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(d, k, a, len(x) // 4, x) for d, ids in zip(b.column(0).to_pylist(), encode(utf8(b.column(1))), strict=True) for k, (a, x) in enumerate(pieces_of(ids + tail, capacity))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "piece", "start", "length", "ids"])

        return each

    return mapped(pick(docs, doc_id="long", text="string"), make, PIECES)


#: What a row of the state of `best_fit` is: a piece without a place, a sequence with a gap, a piece that has its place now.
PIECE, GAP, PLACED = range(3)
_STATE = "kind int, id long, size int, sequence long, at int"
_SWEPT = "kind int, id long, size int, sequence long, gap int, part long, nth long"


def _sweep(batches):
    """Of each range of the sorted pieces and gaps: the matches within it, and what it leaves over.

    From the smallest size on, a gap takes the longest piece that it holds and that no smaller gap has taken; of equally
    long ones the last in the order of their ranks.  So gaps are left over only before all pieces that are, and each keeps
    its rank among them.
    """
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    for (part,), rows in groups(batches, 1):
        waiting, out, gaps = [], [], 0
        for kind, i, size in zip(*(rows.column(c).to_pylist() for c in ("kind", "id", "size")), strict=True):
            if kind == PIECE:
                waiting.append((i, size))
            elif waiting:
                piece, length = waiting.pop()
                out.append((PLACED, piece, length, i, size, None, None))
            else:
                out.append((GAP, None, None, i, size, int(part), gaps))
                gaps += 1
        out += [(PIECE, i, size, None, None, int(part), k) for k, (i, size) in enumerate(waiting)]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _SWEPT.split(", ")])


def carried(left: dict[tuple[int, int], int], parts: int) -> list[tuple[int, int, int, int, int]]:
    """(part, first, last, other part, rank of the piece for `first`): gaps left over in a part take the pieces left over in
    those before it, the longest first; `left` counts both by (part, kind)."""
    out, stack = [], []
    for p in range(parts):
        at, gaps = 0, left.get((p, GAP), 0)
        while at < gaps and stack:
            q, n = stack.pop()
            take = min(n, gaps - at)
            out.append((p, at, at + take - 1, q, n - 1))
            if take < n:
                stack.append((q, n - take))
            at += take
        if n := left.get((p, PIECE), 0):
            stack.append((p, n))
    return out


def _bundles(capacity: int):
    """Pieces of at most a sixteenth of a sequence, of one size and one task, as bundles of about an eighth of a sequence;
    every tenth of them stays single, to fill small gaps.  Without bundles, each superstep would put one of them into a gap."""

    def run(batches):
        held: dict[int, list[int]] = {}
        met: dict[int, int] = {}
        for b in batches:
            out = []
            for i, n in zip(b.column("id").to_pylist(), b.column("size").to_pylist(), strict=True):
                met[n] = met.get(n, 0) + 1
                if 16 * n > capacity or met[n] % 10 == 0:
                    out.append(([i], n))
                    continue
                held.setdefault(n, []).append(i)
                if n * len(held[n]) >= capacity // 8:
                    out.append((held.pop(n), n))
            if out:
                yield rows(out)
        if rest := [([i], n) for n, ids in held.items() for i in ids]:
            yield rows(rest)

    def rows(out):
        ids, each = zip(*out, strict=True)
        columns = [pa.array([x[0] for x in ids], pa.int64()), pa.array([n * len(x) for x, n in out], pa.int32()), pa.array(each, pa.int32()), pa.array(ids, pa.list_(pa.int64()))]
        return pa.record_batch(columns, ["id", "size", "each", "members"])

    return run


def best_fit(pieces: DataFrame, capacity: int, per_part: int = 250_000, few: int = 5_000) -> DataFrame:
    """pieces with sequence_id and offset: each sequence holds its pieces gapless from 0 and at most `capacity` tokens.

    Bulk-synchronous best fit.  A superstep sorts pieces without a place and gaps together by size into ranges of about
    `per_part` rows; ties go by a hash, which deals out a size that very many share.  Each range is swept: a piece's
    successor is the smallest gap that holds it, and of the pieces with one successor the longest gets it.  What ranges leave
    over is matched across them by rank, so the driver sees two counts for each range and one for each size.  All gaps are
    then updated, and the next superstep follows.  When no gap holds a piece, the longest pieces open sequences, as many as
    the volume of the pieces needs; the last `few` pieces are packed in memory.  Very small pieces go in bundles.

    `pieces` has doc_id, piece and length (1 to capacity, else an error), and keeps its other columns; it may not have
    sequence_id or offset (an error).  Equal rows are separate pieces.  No pieces give no rows.
    """
    if taken := {"sequence_id", "offset"} & {c.lower() for c in pieces.columns}:
        raise ValueError(f"pieces may not have the columns {sorted(taken)}")
    spark, scratch, item = pieces.sparkSession, Scratch(pieces.sparkSession), fresh_name(pieces, "item")
    items = scratch.stage(pieces.withColumn(item, F.monotonically_increasing_id()), "pieces")
    if (bad := items.filter(F.col("length").isNull() | ~F.col("length").between(1, capacity)).select("length").first()) is not None:
        raise ValueError(f"a piece of {bad[0]} tokens does not fit in {capacity}")
    none = [F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("int").alias("at")]
    bundles = items.select(F.col(item).alias("id"), F.col("length").cast("int").alias("size"))
    bundles = scratch.stage(bundles.mapInArrow(_bundles(capacity), "id long, size int, each int, members array<long>"), "bundles")
    state = bundles.select(F.lit(PIECE).alias("kind"), "id", "size", *none)
    placed, step, opened = [], 0, False
    while True:
        sizes = {(r["kind"], r["size"]): r["count"] for r in state.filter(F.col("kind") != PLACED).groupBy("kind", "size").count().collect()}
        waiting = {n: c for (kind, n), c in sizes.items() if kind == PIECE}
        if not waiting:
            break
        if max((n for kind, n in sizes if kind == GAP), default=0) >= min(waiting):
            state = _superstep(scratch, state, sizes, capacity, per_part, step)
        elif opened and sum(waiting.values()) <= few:
            rows = state.filter(F.col("kind") == PIECE).select("id", "size").orderBy("id").collect()
            sequence, at, _ = best_fit_decreasing(np.array([r["size"] for r in rows], np.int64), capacity)
            first = {int(s): r["id"] for r, s, a in zip(rows, sequence, at, strict=True) if a == 0}
            rest = [(PLACED, r["id"], r["size"], first[int(s)], int(a)) for r, s, a in zip(rows, sequence, at, strict=True)]
            placed.append(spark.createDataFrame(rest, _STATE))
            break
        else:
            state = _opened(scratch, state, waiting, capacity, step)
            opened = True
        placed.append(state.filter(F.col("kind") == PLACED))
        step += 1
    places = spark.createDataFrame([], _STATE)
    for p in placed:
        places = places.unionByName(p)
    places = bundles.select("id", "each", F.posexplode("members").alias("nth", item)).join(places, "id")
    places = places.select(item, F.col("sequence").alias("sequence_id"), (F.col("at") + F.col("nth") * F.col("each")).cast("long").alias("offset"))
    out = items.join(places, item).select(*[F.col(f"`{c}`") for c in pieces.columns], "sequence_id", "offset")
    return scratch.result(out, "packed")


def _opened(scratch: Scratch, state: DataFrame, waiting: dict[int, int], capacity: int, step: int) -> DataFrame:
    """The longest pieces open sequences, named by them: as many as the volume left over needs, and all over half of one,
    which never share one.  Of the last size a part goes, chosen by hash: about the number wanted, and about four at least."""
    need, share = -(-sum(n * c for n, c in waiting.items()) // capacity), {}
    for n in sorted(waiting, reverse=True):
        share[n] = 1.0 if 2 * n > capacity else min(1.0, max(need, 4 if not share else 0) / waiting[n])
        need -= waiting[n]
        if need <= 0 and 2 * n <= capacity:
            break
    table = state.sparkSession.createDataFrame([(n, s) for n, s in share.items() if s > 0], "size int, share double")
    dice = F.pmod(F.xxhash64("id", F.lit(step)), F.lit(1 << 30)) / (1 << 30)
    now = state.filter(F.col("kind") != PLACED).join(F.broadcast(table), "size", "left")  # a row for each size
    opens = (F.col("kind") == PIECE) & F.coalesce(dice < F.col("share"), F.lit(False))
    gap = F.struct(F.lit(GAP).alias("kind"), F.col("id"), (capacity - F.col("size")).alias("size"), F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("int").alias("at"))
    own = F.struct(F.lit(PLACED).alias("kind"), F.col("id"), F.col("size"), F.col("id").alias("sequence"), F.lit(0).alias("at"))
    as_is = F.struct("kind", "id", "size", "sequence", "at")
    rows = F.when(opens, F.when(F.col("size") < capacity, F.array(own, gap)).otherwise(F.array(own))).otherwise(F.array(as_is))
    return scratch.stage(now.select(F.explode(rows).alias("r")).select("r.*"), "opened")


def _superstep(scratch: Scratch, state: DataFrame, sizes: dict[tuple[int, int], int], capacity: int, per_part: int, step: int) -> DataFrame:
    spark = state.sparkSession
    order, total = [], 0
    for kind, n in sorted(sizes, key=lambda x: (x[1], x[0])):  # pieces before the gaps that just hold them
        order.append((kind, n, total, sizes[kind, n]))
        total += sizes[kind, n]
    parts = -(-total // per_part)
    table = spark.createDataFrame(order, "kind int, size int, before long, number long")
    tie = F.xxhash64("id", F.lit(step))
    rank = F.col("before") + F.floor(F.pmod(tie, F.lit(1 << 30)) / (1 << 30) * F.col("number"))
    rows = state.filter(F.col("kind") != PLACED).join(F.broadcast(table), ["kind", "size"])  # a row for each size
    rows = rows.select(F.floor(rank * parts / total).alias("part"), "size", "kind", F.pmod(tie, F.lit(1 << 30)).alias("tie"), "id")
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "size", "kind", "tie", "id")
    swept = scratch.stage(rows.mapInArrow(_sweep, _SWEPT), "swept")
    if parts > 1:
        left = {(r["part"], r["kind"]): r["count"] for r in swept.filter(F.col("kind") != PLACED).groupBy("part", "kind").count().collect()}
        links = spark.createDataFrame(carried(left, parts), "part long, first long, last long, other long, top long")
        gaps, pieces = swept.filter(F.col("kind") == GAP), swept.filter(F.col("kind") == PIECE)
        # two counts for each range make at most twice as many links
        taken = gaps.join(F.broadcast(links), "part").filter("nth between first and last").select("sequence", "gap", F.col("other").alias("part"), (F.col("top") - F.col("nth") + F.col("first")).alias("nth"))
        across = pieces.select("id", "size", "part", "nth").join(taken, ["part", "nth"])
        across = scratch.stage(across.select(F.lit(PLACED).alias("kind"), "id", "size", "sequence", "gap"), "across")
        kept = gaps.join(across.select("sequence"), "sequence", "left_anti").unionByName(pieces.join(across.select("id"), "id", "left_anti"))
        swept = swept.filter(F.col("kind") == PLACED).select("kind", "id", "size", "sequence", "gap").unionByName(across).unionByName(kept.select("kind", "id", "size", "sequence", "gap"))
    row = lambda kind, i, size, sequence, at: F.struct(F.lit(kind).alias("kind"), i.alias("id"), size.cast("int").alias("size"), sequence.cast("long").alias("sequence"), at.cast("int").alias("at"))
    no, i, size, sequence, gap = F.lit(None), F.col("id"), F.col("size"), F.col("sequence"), F.col("gap")
    fits, smaller = row(PLACED, i, size, sequence, capacity - gap), row(GAP, sequence, gap - size, no, no)
    rows = F.when(F.col("kind") == PIECE, F.array(row(PIECE, i, size, no, no))).when(F.col("kind") == GAP, F.array(row(GAP, sequence, gap, no, no)))
    rows = rows.when(gap > size, F.array(fits, smaller)).otherwise(F.array(fits))
    return scratch.stage(swept.select(F.explode(rows).alias("r")).select("r.*"), "state")


class Capacities:
    """A segment tree over open sequences that holds the largest free capacity of each range of sequences, ordered by
    capacity classes: `best(n)` gives the sequence with the least capacity of at least n."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = np.zeros(2 * self.size, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, sequence: int) -> None:
        self.open[free].append(sequence)
        i = self.size + free
        while i:
            self.count[i] += 1
            i >>= 1

    def best(self, n: int) -> tuple[int, int] | None:
        """(free, sequence) of the fullest open sequence with room for n, taken out of the tree; None if there is none."""
        i = self.size + n
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.size
        sequence = self.open[free].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return free, sequence


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences; longest first, ties in the order given."""
    tree, n_sequences = Capacities(capacity), 0
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        if (found := tree.best(n)) is None:
            found, n_sequences = (capacity, n_sequences), n_sequences + 1
        free, s = found
        sequence[i], offset[i] = s, capacity - free
        if free > n:
            tree.add(free - n, s)
    return sequence, offset, n_sequences


def positions(reset: np.ndarray) -> np.ndarray:
    """Position ids of a packed sequence: they begin at 0 again where `reset` is set."""
    at = np.arange(len(reset))
    return at - np.maximum.accumulate(np.where(reset, at, 0))


#: Bytes of 32-bit ids from which on a shard is closed.
SHARD_BYTES = 16 << 20
SHARD = "doc_id long, piece int, start long, length long, shard string, sequence long, offset long"


def pack_shards(docs: DataFrame, vocabulary: str, capacity: int, end: int | None, folder: str, fill: int = 0) -> DataFrame:
    """Tokenise, split losslessly, pack by best-fit-decreasing and write; a row for each piece says where it lies.

    Neighbouring documents of a task, up to `SHARD_BYTES` of ids and one document more, are a shard, packed in memory, so
    no token is shuffled.  A shard is four files in `folder`: `<shard>.ids.npy`, the id matrix (sequences x capacity, unsigned 16-bit
    if the vocabulary allows, filled up with `fill`), `<shard>.cu.npy`, the cumulative segment lengths of all sequences
    (each sequence's run from 0 to its length), `<shard>.at.npy`, where each sequence's run begins in them, and
    `<shard>.resets.npy`, the position resets: a matrix of bits, set where position ids begin at 0 again.  A task that is run again writes the same shards under new names;
    only shards named in the rows count.
    Null text is empty; an empty document without an `end` has no piece; an empty table writes nothing.  Texts may have any
    length; a long one is cut like any other, and its shard is closed behind it.  Repeated rows, and rows that share a doc_id
    or have none, have their own pieces.  Of equally long pieces the earlier one is placed first, and of equally full
    sequences the last one that became so takes a piece.  Columns but doc_id and text are ignored.
    """
    from siltstone.llm.files import save

    tail = b"" if end is None else int(end).to_bytes(4, "little")

    def make():
        import uuid

        from siltstone.llm.tokens import encoder, portions

        encode = encoder(vocabulary)

        def write(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
            length = np.array([len(r[3]) // 4 for r in rows], np.int64)
            sequence, offset, n = best_fit_decreasing(length, capacity)
            most = max(fill, *(int(np.frombuffer(r[3], "<u4").max()) for r in rows))
            matrix = np.full((n, capacity), fill, np.uint16 if most < 65536 else np.uint32)
            for r, s, o, k in zip(rows, sequence.tolist(), offset.tolist(), length.tolist(), strict=True):
                matrix[s, o : o + k] = np.frombuffer(r[3], "<u4")
            order = np.lexsort((offset, sequence))
            at = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=n) + 1)])
            cu = np.empty(at[-1], np.int32)
            cu[np.arange(len(order)) + sequence[order]] = offset[order]
            cu[at[1:] - 1] = np.bincount(sequence, length, n)
            reset = np.zeros((n, capacity), bool)
            reset[sequence, offset] = True
            shard = uuid.uuid4().hex
            for part, what in (("ids", matrix), ("cu", cu), ("at", at), ("resets", np.packbits(reset, axis=1))):
                save(f"{folder}/{shard}.{part}.npy", what)
            out = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array(length), pa.array([shard] * len(rows)), pa.array(sequence), pa.array(offset)]
            return pa.record_batch(out, ["doc_id", "piece", "start", "length", "shard", "sequence", "offset"])

        def each(b: pa.RecordBatch) -> pa.RecordBatch | None:
            done, rows, held = [], [], 0
            docs = iter(b.column(0).to_pylist())
            for some in portions(utf8(b.column(1))):
                for ids in encode(some):
                    d = next(docs)
                    for k, (a, x) in enumerate(pieces_of(ids + tail, capacity)):
                        rows.append((d, k, a, x))
                        held += len(x)
                    if held >= SHARD_BYTES:
                        done.append(write(rows))
                        rows, held = [], 0
            if rows:
                done.append(write(rows))
            return pa.Table.from_batches(done).combine_chunks().to_batches()[0] if done else None

        return each

    return mapped(pick(docs, doc_id="long", text="string"), make, SHARD, 2 * SHARD_BYTES)


READ = "shard string, sequence long, n_tokens long, n_segments long, segment_lengths array<int>, ids binary, position_ids binary"


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """The sequences of the written shards named in column `shard`: ids without fill, segments, and position ids from the
    stored resets, which must agree with the segments."""
    from siltstone.llm.files import load

    names = [x.split()[0] for x in READ.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary())

    def run(batches):
        for b in batches:
            for shard in b.column(0).to_pylist():
                matrix, cu, at, bits = (load(f"{folder}/{shard}.{part}.npy") for part in ("ids", "cu", "at", "resets"))
                rows = []
                for s in range(len(matrix)):
                    part = cu[at[s] : at[s + 1]]
                    lengths = np.diff(part)
                    reset = np.unpackbits(bits[s], count=part[-1]).astype(bool)
                    if not np.array_equal(np.flatnonzero(reset), part[:-1]):
                        raise ValueError(f"shard {shard}, sequence {s}: position resets and segment lengths differ")
                    ids = matrix[s, : part[-1]].astype("<u4")
                    rows.append((shard, s, len(ids), len(lengths), lengths.tolist(), ids.tobytes(), positions(reset).astype("<u4").tobytes()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spread(stage(shards.select("shard").distinct(), "shards"), "shard").mapInArrow(run, READ)
