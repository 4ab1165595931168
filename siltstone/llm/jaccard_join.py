"""Exact similarity join of documents on 5-word shingles, Jaccard 0.8, by token-combination prefixes.

A document's set has the 64-bit hashes of its distinct shingles, the tokens.  The join works on different sets; documents
with equal ones come together again at the end.

Frequencies: texts are read once.  Each block of texts sends its tokens, packed by ranges of their hashes, to the task of
the range; that counts them and returns to the block only those that stand in several sets, with their frequency class.
A token that stands in one set alone can't be shared, so a set of n needs ceil(0.8 n) others, or it is in no pair.  What
is left is a small part of any corpus, and only its shared tokens are kept.  Tokens that are frequent within a block are
sent once a block, so no range gets a row for each document of a passage that all share.

Order: unshared tokens first, then by frequency class and hash.  A set of n shares at least o = ceil(0.8 n) tokens with
each partner, so two partners share at least k tokens among the first n - o + k of either, the extended prefix.  Rare
tokens there are indexed singly.  Of the frequent ones, which are dealt into k - 1 bins by hash, the combinations of two in
one bin are indexed: partners that share no rare token share k frequent ones, and two of those lie in one bin.  k grows
with the set's size, so the combinations stay a few for each token of the prefix at any size; sets are indexed with the k
of their own band of sizes and of the next one, as a partner may lie there.

Candidates: a set carries its size, the number of its unshared tokens and a parity sketch of the others (256 bits, each
the parity of the tokens that fall on it).  Differing bits are differing tokens, so size, unshared tokens and sketch bound
the intersection of two sets from above.  The sets of a key are compared with one leader each; those within the bound are
verified on their tokens, and links are merged to components.  Keys that then lie in one component are done.  Of the
others, the sets outside the key's largest component are compared by the bound with all sets of the key, in tiles of
limited size: first the pairs that would join components are verified, as few as do that, and at last every pair within
the bound that is still between components.  So no link is lost, and a group of many similar texts costs a comparison for
each text, and for each pair only between what is not linked and the group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, groups, pick, settle, sliced, utf8
from siltstone.llm.shingles import Words, mix, shingles


class Settings(NamedTuple):
    """How the work is cut; results don't depend on it."""

    #: Bytes of text in one block, and of all texts for one range of hashes.
    block: int = 2 << 20
    range: int = 16 << 20
    #: Tokens found so often in a block are sent once for the block; they count as so many.
    local: int = 32
    #: Frequency classes are powers of two; tokens from this class on are frequent.
    frequent: int = 4
    #: Tokens of a set for each bin of its frequent tokens; smaller sets index frequent tokens singly.
    per_bin: int = 12
    #: Sets of one key that are compared in one place.
    tile: int = 2048
    leader_rounds: int = 2


_SKETCH = [f"p{i}" for i in range(4)]
#: Stands for all documents of a block.
MARK = np.uint32(0xFFFFFFFF)
_C = np.uint64(0x165667B19E3779F9)
_SENT = "part int, block long, kind int, docs binary, counts binary, tokens binary"


def least_shared(n: int) -> int:
    """Tokens that a set of n shares with each partner at least."""
    return -(-4 * n // 5)


def _bands(limit: int = 1 << 40) -> np.ndarray:
    """First size of each band; a partner of a set lies in the same band or in a neighbouring one."""
    out = [1]
    while out[-1] < limit:
        out.append(out[-1] * 5 // 4 + 1)
    return np.array(out)


BANDS = _bands()


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Ids, whether they are there, and texts of so many documents that a block has."""
    for b in batches:
        for part in sliced(b, most):
            column = part.column(0)
            yield column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False), utf8(part.column(1))


def _short(tokens: np.ndarray, part: np.ndarray, bits: int) -> np.ndarray:
    """The 48 bits behind the first `bits` of each hash, below the range that those name."""
    return ((tokens << np.uint64(bits)) >> np.uint64(16)) | (part.astype(np.uint64) << np.uint64(48))


def _packed(short: np.ndarray) -> bytes:
    return short.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes, part: int) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel() | (np.uint64(part) << np.uint64(48))


def _send(bits: int, how: Settings):
    """Blocks of texts as packed tokens by range (kind 0), the block's documents (1) and its frequent tokens' places (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, block, parts = Words(), TaskContext.get().partitionId() << 32, 1 << bits
        for ids, known, texts in _blocks(batches, how.block):
            tokens, n = shingles(words, texts)
            del texts
            ends = np.cumsum(n)
            names = [hashlib.blake2b(tokens[e - c : e].tobytes(), digest_size=16).digest() for c, e in zip(n, ends, strict=True)]
            first = dict.fromkeys(names)
            new = np.array([first.pop(x, 0) is None for x in names]) & (n > 0)  # one of equal sets is sent
            doc = np.repeat(np.arange(len(n)), n)
            sent = new[doc]
            tokens, doc = tokens[sent], doc[sent].astype(np.uint32)
            # frequent in the block: candidates by a part of the hash, then counted
            often = np.bincount(tokens >> np.uint64(44), minlength=1 << 20)[tokens >> np.uint64(44)] >= how.local
            value, count = np.unique(tokens[often], return_counts=True)
            value = value[count >= how.local]
            often[often] = np.isin(tokens[often], value)
            tokens = _short(tokens, part := tokens >> np.uint64(64 - bits), bits)
            rows = [(block % parts, block, 1, np.append(ids, known.astype(np.int64)).tobytes(), n.astype(np.int64).tobytes(), b"".join(names))]
            if len(value):
                rows.append((block % parts, block, 2, doc[often].tobytes(), b"", tokens[often].tobytes()))
                once = np.zeros(len(often), bool)
                once[np.flatnonzero(often)[np.unique(tokens[often], return_index=True)[1]]] = True
                doc[once] = MARK
                often &= ~once
            tokens, doc, part = tokens[~often], doc[~often], part[~often].astype(np.uint16 if bits <= 16 else np.uint32)
            order = np.argsort(part, kind="stable")
            tokens, doc, part = tokens[order], doc[order], part[order]
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, int)
            for a, z in zip(starts, np.append(starts[1:], len(part)), strict=False):
                d = doc[a:z]
                at = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                counts = np.diff(np.append(at, z - a)).astype(np.uint32)
                rows.append((int(part[a]), block, 0, d[at].tobytes(), counts.tobytes(), _packed(tokens[a:z])))
            yield _rows(rows, _SENT)
            block += 1
        settle()

    return run


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [f for f, _ in fields])


def _count(batches: Iterator[pa.RecordBatch], local: int) -> Iterator[pa.RecordBatch]:
    """Of each range: the tokens that stand in several sets, back to their blocks; counts are frequency classes now."""
    for (part,), rows in groups(batches, 1):
        rows = rows.to_pylist()
        out = [tuple(r.values()) for r in rows if r["kind"]]
        rows = [r for r in rows if not r["kind"]]
        if rows:
            tokens = [_unpacked(r["tokens"], int(part)) for r in rows]
            docs = [np.repeat(np.frombuffer(r["docs"], np.uint32), np.frombuffer(r["counts"], np.uint32)) for r in rows]
            _, index = np.unique(np.concatenate(tokens), return_inverse=True)
            total = np.bincount(index, weights=np.where(np.concatenate(docs) == MARK, local, 1))[index]
            level = np.log2(total).astype(np.uint8)
            at = 0
            for r, d, t in zip(rows, docs, tokens, strict=True):
                shared = total[at : at + len(t)] >= 2
                if shared.any():
                    out.append((int(part), r["block"], 0, d[shared].tobytes(), level[at : at + len(t)][shared].tobytes(), t[shared].tobytes()))
                at += len(t)
        if out:
            yield _rows(out, _SENT)
    settle()


_SETS = "doc_id long, name binary, n long, tokens array<long>, keys array<long>, u int, " + ", ".join(f"{p} long" for p in _SKETCH)


def _bins(n: int, per_bin: int) -> list[int]:
    """Bins of the frequent tokens of a set of n, for its band and the next one."""
    band = int(np.searchsorted(BANDS, n, side="right")) - 1
    return sorted({int(BANDS[b]) // per_bin for b in (band, band + 1)})


def _keys(n: int, tokens: np.ndarray, level: np.ndarray, how: Settings) -> np.ndarray:
    """Keys of a set of n with these shared tokens."""
    order = np.lexsort((tokens, level))
    tokens, level = tokens[order], level[order]
    bins = _bins(n, how.per_bin)
    free = n - least_shared(n) - (n - len(tokens))  # shared tokens in the plain prefix, less one
    rare = np.searchsorted(level, how.frequent)
    out = [mix(tokens[: min(rare, max(free + bins[-1] + 1, 0))], np.uint64(0))]
    for g in bins:
        often = tokens[rare : max(free + g + 1, 0)]
        if not g:
            out.append(mix(often, _C))
            continue
        bin_ = mix(often, np.uint64(g)) % np.uint64(g)
        order = np.argsort(bin_, kind="stable")
        often, bin_ = often[order], bin_[order]
        # every two of one bin: each token with the ones behind it, as many steps away as the fullest bin has
        for step in range(1, int(np.bincount(bin_.astype(np.int64)).max(initial=0))):
            a, b = often[:-step], often[step:]
            one = bin_[:-step] == bin_[step:]
            out.append(mix(mix(a[one], b[one]), np.uint64(g)))
    return np.unique(np.concatenate(out))


def _sketch(tokens: np.ndarray) -> np.ndarray:
    bit = np.bincount(((tokens * _C) >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(bit.astype(np.uint8)).view(np.int64)


def _assemble(batches: Iterator[pa.RecordBatch], how: Settings) -> Iterator[pa.RecordBatch]:
    """All documents of each block; those of which so many tokens are shared that they may have a partner, as sets."""
    for _, rows in groups(batches, 1):
        by: dict[int, list[dict]] = {0: [], 1: [], 2: []}
        for r in rows.to_pylist():
            by[r["kind"]].append(r)
        own = by[1][0]
        ids = np.frombuffer(own["docs"], np.int64)
        ids, known = np.split(ids, 2)
        n = np.frombuffer(own["counts"], np.int64)
        names = [own["tokens"][i : i + 16] for i in range(0, 16 * len(n), 16)]
        joined = lambda what, kind: np.concatenate([np.empty(0, kind), *(np.frombuffer(r[what], kind) for r in by[0])])
        doc, level, token = joined("docs", np.uint32), joined("counts", np.uint8), joined("tokens", np.uint64)
        marked = doc == MARK
        if marked.any():  # tokens that are frequent in the block: their class goes to all their places
            order = np.argsort(token[marked])
            value, of = token[marked][order], level[marked][order]
            places = np.frombuffer(by[2][0]["docs"], np.uint32), np.frombuffer(by[2][0]["tokens"], np.uint64)
            doc, token, level = np.append(doc[~marked], places[0]), np.append(token[~marked], places[1]), np.append(level[~marked], of[np.searchsorted(value, places[1])])
        count = np.bincount(doc, minlength=len(n))
        order = np.argsort(doc, kind="stable")
        token, level, end = token[order], level[order], np.cumsum(count)
        out = []
        for i, (c, z) in enumerate(zip(count, end, strict=True)):
            d = int(ids[i]) if known[i] else None
            if not c or c < least_shared(int(n[i])):
                out.append((d, names[i], int(n[i]), None, None, None, *[None] * len(_SKETCH)))
            else:
                t, v = token[z - c : z], level[z - c : z]
                out.append((d, names[i], int(n[i]), np.sort(t).view(np.int64), _keys(int(n[i]), t, v, how).view(np.int64), int(n[i] - c), *map(int, _sketch(t))))
        doc_id, name, size, tokens, keys, *rest = zip(*out, strict=True)
        kinds = [pa.int32(), *[pa.int64()] * len(_SKETCH)]
        columns = [pa.array(doc_id, pa.int64()), pa.array(name, pa.binary()), pa.array(size, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.record_batch([*columns, *[pa.array(c, k) for c, k in zip(rest, kinds, strict=True)]], [f.split()[0] for f in _SETS.split(", ")])


def shared_sets(docs: DataFrame, how: Settings) -> DataFrame:
    """doc_id, name (128 bits of its set), n of every document; and for one of equal sets in a block, if so many of its
    tokens stand in other sets that it may have a partner: those tokens, keys, number of the others (u), and sketch."""
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    bits = max(1, min(24, (size // how.range).bit_length()))
    parts = max(2, (1 << bits) // 2)
    sent = docs.mapInArrow(_send(bits, how), _SENT)
    counted = sent.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(lambda x: _count(x, how.local), _SENT)
    back = counted.select("block", "kind", "docs", "counts", "tokens").repartition(parts, "block").sortWithinPartitions("block")
    return back.mapInArrow(lambda x: _assemble(x, how), _SETS)


def connected(scratch: Scratch, links: DataFrame) -> DataFrame:
    """class, root: the least class that links (a, b) connect it with; only classes with links, by alternating stars."""
    edges = scratch.stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.stage(large, "star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        scratch.drop(edges)
        edges = scratch.stage(small.distinct(), "edges")
        scratch.drop(large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("u").alias("class"), F.col("v").alias("root"))
        last = now


def _bound(a: str, b: str):
    """Whether sizes, unshared tokens and sketches allow the sets a and b to link: 9 * differing tokens <= both sizes."""
    c = lambda side, name: F.col(f"{side}.{name}")
    bits = sum((F.bit_count(c(a, p).bitwiseXOR(c(b, p))) for p in _SKETCH), F.lit(0))
    differ = F.greatest(c(a, "u") + c(b, "u") + bits, F.abs(c(a, "n") - c(b, "n")))
    return 9 * differ <= c(a, "n") + c(b, "n")


def _tile(all_pairs: bool):
    """Pairs of a tile's sets in different components that are within the bound: those of the outer sets (`outer`) with
    all sets; either all such pairs, or only as many as would join the tile's components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, 3):
            cls, root, n, u = (rows.column(c).to_numpy() for c in ("class", "root", "n", "u"))
            sketch = np.stack([rows.column(p).to_numpy() for p in _SKETCH], 1).view(np.uint64)
            left, right = np.flatnonzero(rows.column("outer").to_numpy()), np.flatnonzero(~rows.column("outer").to_numpy())
            found = []
            step = max(1, (1 << 20) // max(len(right), 1))
            for i in range(0, len(left), step):
                x = left[i : i + step, None]
                differ = np.bitwise_count(sketch[x, 0] ^ sketch[right, 0]).astype(np.int64)
                for k in range(1, len(_SKETCH)):
                    differ += np.bitwise_count(sketch[x, k] ^ sketch[right, k])
                differ = np.maximum(differ + u[x] + u[right], np.abs(n[x] - n[right]))
                a, b = np.nonzero((9 * differ <= n[x] + n[right]) & (root[x] != root[right]))
                found.append(np.stack([left[i + a], right[b], differ[a, b]], 1))
            if not found or not (pairs := np.concatenate(found)).size:
                continue
            if not all_pairs:
                pairs = pairs[np.argsort(pairs[:, 2], kind="stable")]
                ends = np.sort(root[pairs[:, :2]], 1)
                pairs = pairs[np.sort(np.unique(ends, axis=0, return_index=True)[1])]
                parent: dict[int, int] = {}

                def top(x: int) -> int:
                    while (y := parent.get(x, x)) != x:
                        parent[x] = x = parent.get(y, y)
                    return x

                keep = []
                for i, (a, b) in enumerate(root[pairs[:, :2]].tolist()):
                    a, b = top(a), top(b)
                    if a != b:
                        parent[a] = b
                        keep.append(i)
                pairs = pairs[keep]
            a, b = cls[pairs[:, 0]], cls[pairs[:, 1]]
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


class _Links:
    """Components of sets, found step by step."""

    def __init__(self, scratch: Scratch, sets: DataFrame, members: DataFrame, how: Settings):
        self.scratch, self.sets, self.members, self.how = scratch, sets, members, how
        self.roots = sets.sparkSession.createDataFrame([], "class long, root long")
        self.compared: DataFrame | None = None

    def verify(self, pairs: DataFrame, name: str) -> bool:
        """Compare the pairs (a, b) that weren't before; whether any is a link."""
        pairs = pairs.distinct()
        if self.compared is not None:
            pairs = pairs.join(self.compared, ["a", "b"], "left_anti")
        pairs = self.scratch.stage(pairs, name)
        self.compared = pairs if self.compared is None else self.compared.unionByName(pairs)
        both = pairs
        for x in "ab":
            both = both.join(self.sets.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}")), x)
        shared = F.size(F.array_intersect("t_a", "t_b"))
        links = self.scratch.stage(both.filter(100 * shared >= 80 * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b"), "links")
        if links.isEmpty():
            return False
        a, b = (self.roots.select(F.col("class").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        contracted = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        new = connected(self.scratch, contracted)
        old = self.roots.join(new.select(F.col("class").alias("root"), F.col("root").alias("r2")), "root", "left").select("class", F.coalesce("r2", "root").alias("root"))
        self.roots = self.scratch.stage(old.unionByName(new.join(self.roots.select("class"), "class", "left_anti")), "roots")
        return True

    def open(self) -> DataFrame | None:
        """Members of the keys that hold several components, with their roots and the key's largest component."""
        rooted = self.members.join(self.roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
        keys = rooted.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key")
        keys = keys.agg(F.count("*").alias("roots"), F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most")).filter("roots > 1")
        found = self.scratch.stage(rooted.join(keys.select("key", "main", "all", (F.col("all") - F.col("most")).alias("out")), "key"), "open")
        if found.isEmpty():
            return None
        self.members = found.select(self.members.columns)
        return found

    def lead(self, rows: DataFrame, order: list) -> DataFrame:
        """Pairs of a leader of each key, the first in this order, with the other sets of the key."""
        one = F.struct("class", "n", "u", *_SKETCH)
        first = rows.groupBy("key").agg(F.min_by(one, F.struct(*order, "u", "class")).alias("x"))
        pairs = rows.select("key", one.alias("y")).join(first, "key").filter("x.class <> y.class").filter(_bound("x", "y"))
        return pairs.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"))

    def tiles(self, rows: DataFrame, all_pairs: bool) -> DataFrame:
        """Pairs between components: the sets outside a key's largest component with all of the key, in tiles."""
        blocks = lambda size: F.ceil(F.col(size) / self.how.tile).cast("int")
        block = lambda size: F.pmod(F.xxhash64("class"), blocks(size)).cast("int")
        spread = lambda size: F.explode(F.sequence(F.lit(0), blocks(size) - 1))
        keep = ["class", "root", "n", "u", *_SKETCH]
        right = rows.withColumn("j", block("all")).select("key", spread("out").alias("i"), "j", F.lit(False).alias("outer"), *keep)
        left = rows.filter("root <> main").withColumn("i", block("out")).select("key", "i", spread("all").alias("j"), F.lit(True).alias("outer"), *keep)
        tiles = left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return tiles.mapInArrow(_tile(all_pairs), "a long, b long")

    def run(self) -> DataFrame:
        """class, root of every set that is linked with a set of a smaller class, the root."""
        rows = self.members
        for turn in range(self.how.leader_rounds):
            self.verify(self.lead(rows, [F.col("root") == F.col("main")] if turn else []), f"led{turn}")
            if (rows := self.open()) is None:
                return self.roots
        while self.verify(self.tiles(rows, False), "joining"):
            if (rows := self.open()) is None:
                return self.roots
        self.verify(self.tiles(rows, True), "left")
        return self.roots


def components(docs: DataFrame, how: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Words are the runs of other characters than ASCII white space, A-Z in lower case.  A null text, or one without words,
    has the empty set and is linked with nothing; its component is its own doc_id, as is that of each document without a
    link.  Repeated rows, and rows of one doc_id with different texts, each count by their own text; a component has the
    smallest doc_id of its rows.  A null doc_id stays null unless a linked document has one.  Texts may have any length: a
    long one is a block of its own.  An empty table gives an empty result.  Columns but doc_id and text are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    docs = pick(docs, doc_id="long", text="string")
    table = scratch.stage(shared_sets(docs, how), "sets")
    sets = table.filter("keys is not null").dropDuplicates(["name"]).withColumn("class", F.monotonically_increasing_id())
    sets = scratch.stage(sets.select("class", "name", "n", "tokens", "keys", "u", *_SKETCH), "classes")
    members = sets.select(F.explode("keys").alias("key"), "class", "n", "u", *_SKETCH)
    several = members.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    members = scratch.stage(members.join(several, "key"), "members")
    roots = _Links(scratch, sets, members, how).run()

    # components of documents: by equal sets, then by linked ones
    equal = table.filter("n > 0").groupBy("name").agg(F.min("doc_id").alias("first"))
    linked = sets.select("class", "name").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")).join(equal, "name")
    least = linked.groupBy("root").agg(F.min("first").alias("component"))
    linked = linked.join(least, "root").select("name", "component")
    found = equal.join(linked, "name", "left").select("name", F.coalesce("component", "first").alias("component"))
    out = table.select("doc_id", "name", "n").join(found, "name", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id")).alias("component_id"))
    return scratch.result(out, "components")
