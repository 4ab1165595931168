"""Removal of byte strings that stand earlier in the corpus, by bucket-pointer refinement.

A position's bucket is the identifier of the string that begins there.  Buckets of q bytes are refined to buckets of 2q
bytes by the pair (own bucket, bucket of the position q later); each refinement reuses the one before it: 1, 2, 4, 8, 16,
32, 64 bytes, and `length` bytes from two overlapping buckets of 64.  Identifiers are 64-bit hashes of such pairs, so
positions far apart agree on them without a global sort of all positions.

Global order is only sorted where it can matter.  Each window of `length` bytes is put under the smallest 32-byte bucket
that lies in it, so that equal windows are always under equal ones; neighbouring windows mostly share it, and such a run
of windows is one row.  Rows are sorted by bucket, and a bucket is refined by the identifier of the run's whole string:
a run whose string stands earlier is removed whole.  Only where runs of one bucket differ (at the ends of repeated
passages) are the single windows sorted, by their own identifiers.

Each portion of a few megabytes of text resolves its own repeats first, so a passage that very many documents share sends
a row for each portion, not one for each document.  Where runs of one bucket differ within a portion, all of them go on
to their single windows at once and one row tells the bucket so; so a bucket gets a row or two for each portion, however
common its 32 bytes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, fresh_name, mapped, numbered, pick, settle, sliced, utf8

SEED = 32  # bytes of the buckets that windows are put under
#: Bytes of text that are worked on at once; longer texts are cut between windows.
PORTION = 4 << 20
#: Windows of one text that are worked on at once.
STRETCH = 1 << 20
#: What a row of a run says: it is to be compared; its portion has found it removed; its portion has found other runs of
#: its bucket, so its windows are to be compared; its bucket has runs that differ.
COMPARE, REMOVED, DIFFERS, TOLD = range(4)
#: `name` has that in its lowest two bits, and `bucket` of a single window whether it is removed in its lowest one; `span`
#: has the first and last window of a run, 32 bits each.
ROWS = "bucket long, name long, row long, span long"
SINGLE = "bucket long, row long, span long"

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BYTES = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket of (bucket, later bucket)."""
    x = a * _A
    x ^= x >> np.uint64(32)
    y = b * _B
    y ^= y >> np.uint64(29)
    x += y
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def buckets(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of SEED bytes and of `length` bytes (over SEED, at most 4 * SEED) at each position of a byte array."""
    b, n = _BYTES[text], 1
    while n < SEED:
        b, n = pair(b[:-n], b[n:]), 2 * n
    seed = b
    while 2 * n <= length:
        b, n = pair(b[:-n], b[n:]), 2 * n
    if n < length:
        rest = length - n
        b = pair(b[: len(b) - rest], b[rest:])
    return seed, b


def smallest(seed: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The least bucket among `width` positions from each one on; and where two of them tie (None: nowhere)."""
    powers = {1: seed}
    ties: dict[int, np.ndarray | None] = {1: None}

    def join(a, b, ta, tb):
        """Of two disjoint ranges."""
        n = min(len(a), len(b))
        a, b = a[:n], b[:n]
        same = a == b
        t = same if same.any() else None
        for x in (ta, tb):
            if x is not None:
                t = x[:n].copy() if t is None else t | x[:n]
        return np.minimum(a, b), t

    k = 1
    while 2 * k <= width:
        t = ties[k]
        powers[2 * k], ties[2 * k] = join(powers[k], powers[k][k:], t, None if t is None else t[k:])
        k *= 2
    out, tie, done = powers[k], ties[k], k
    for p in sorted(powers, reverse=True):
        while done + p <= width:
            t = ties[p]
            out, tie = join(out, powers[p][done:], tie, None if t is None else t[done:])
            done += p
    return out, tie


def runs_of(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """bucket, name, lo, hi: runs of windows [lo, hi] under one occurrence of a bucket, and the identifier of the run's
    whole string.

    A run ends where the least bucket changes or its place leaves the window, so it has at most `length` - SEED + 1
    windows, and its first and last ones hold the whole string.  A run with ties (text of a period shorter than the
    range of places) is cut into single windows.  So all windows of a run are certain to differ.
    """
    seed, name = buckets(np.frombuffer(text, np.uint8), length)
    least, tie = smallest(seed, length - SEED + 1)
    left = seed[: len(least) - 1] == least[:-1]
    lo = np.concatenate([[0], np.flatnonzero((least[1:] != least[:-1]) | left) + 1])
    if tie is not None:
        single = np.flatnonzero(np.repeat(np.logical_or.reduceat(tie, lo), np.diff(np.append(lo, len(least)))))
        lo = np.union1d(lo, np.union1d(single, single[single + 1 < len(least)] + 1))
    hi = np.append(lo[1:], len(least)) - 1
    return least[lo], pair(name[lo], name[hi] + (hi - lo).astype(np.uint64)), lo, hi


def joined(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of one document that touch, as one; the runs come in order."""
    if not len(doc):
        return doc, lo, hi
    new = np.append(True, (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + length))
    at = np.flatnonzero(new)
    return doc[at], lo[at], np.maximum.reduceat(hi, at)


def first_of(names: np.ndarray) -> np.ndarray:
    """True at the first occurrence of each value."""
    first = np.zeros(len(names), bool)
    first[np.unique(names, return_index=True)[1]] = True
    return first


def _spread(doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Buckets for rows that may go anywhere."""
    return pair(doc.view(np.uint64), lo.astype(np.uint64))


def _span(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (lo.astype(np.int64) << 32) | hi.astype(np.int64)


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], [x.split()[0] for x in schema.split(", ")])


def _portions(rows: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    """Lists of rows that begin with a byte string, of about `most` bytes together."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[0])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _cut(text: bytes, first: int, last: int, most: int, length: int) -> Iterator[tuple[bytes, int]]:
    """Windows `first` to `last` of a text, in stretches of at most `most` windows: the bytes, and their first window."""
    for at in range(first, last + 1, most):
        yield text[at : min(at + most - 1, last) + length], at


def _runs(portion: list[tuple[bytes, int, int]], length: int) -> pa.RecordBatch:
    parts = []
    for text, row, at in portion:
        bucket, name, lo, hi = runs_of(text, length)
        parts.append((bucket, name, np.full(len(lo), row, np.int64), lo + at, hi + at))
    bucket, name, row, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    keep = first_of(pair(bucket, name))
    gone = joined(row[~keep], lo[~keep], hi[~keep], length)
    bucket, name, row, lo, hi = (x[keep] for x in (bucket, name, row, lo, hi))
    value, of, count = np.unique(bucket, return_inverse=True, return_counts=True)
    differs = count[of] > 1
    told = value[count > 1]
    kind = np.concatenate([np.where(differs, DIFFERS, COMPARE), np.full(len(gone[0]), REMOVED), np.full(len(told), TOLD)]).astype(np.uint64)
    none = np.zeros(len(told), np.int64)
    bucket = np.concatenate([np.where(differs, _spread(row, lo), bucket), _spread(gone[0], gone[1]), told])
    name = np.concatenate([name & ~np.uint64(3), np.zeros(len(gone[0]) + len(told), np.uint64)]) | kind
    return _batch(ROWS, bucket, name, np.concatenate([row, gone[0], none]), np.concatenate([_span(lo, hi), _span(*gone[1:]), none]))


def _windows(portion: list[tuple[bytes, int, int]], length: int) -> pa.RecordBatch:
    """The single windows of stretches of text by their own identifiers; those that the portion has met go as removed."""
    _, name = buckets(np.frombuffer(b"".join(x[0] for x in portion), np.uint8), length)
    count = np.array([len(x[0]) - length + 1 for x in portion])
    begin = np.cumsum(count + length - 1) - (count + length - 1)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    name = name[np.repeat(begin, count) + within]
    row = np.repeat(np.array([x[1] for x in portion], np.int64), count)
    at = np.repeat(np.array([x[2] for x in portion], np.int64), count) + within
    keep = first_of(name)
    gone = joined(row[~keep], at[~keep], at[~keep], length)
    bucket = np.append(name[keep] & ~np.uint64(1), _spread(gone[0], gone[1]) | np.uint64(1))
    return _batch(SINGLE, bucket, np.append(row[keep], gone[0]), np.append(_span(at[keep], at[keep]), _span(*gone[1:])))


def _spans(rows: DataFrame) -> DataFrame:
    """row, spans: the runs of each document, in order."""
    return rows.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def _ordered(b: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch in the order of their first column, the others as Python values; texts as bytes."""
    row = b.column("row").to_numpy()
    texts = utf8(b.column("text"))
    spans = b.column("spans") if "spans" in b.schema.names else None
    for i in np.argsort(row, kind="stable"):
        yield int(row[i]), texts[i], spans[int(i)].as_py() if spans is not None else None


def removed_windows(scratch: Scratch, docs: DataFrame, length: int, portion: int = PORTION) -> DataFrame:
    """row, span: runs of positions where a string of `length` bytes begins that begins earlier, too.  docs: row, text."""
    if not 2 * SEED <= length <= 4 * SEED:
        raise ValueError(f"length must be between {2 * SEED} and {4 * SEED}")
    docs = docs.filter(F.octet_length("text") >= length)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in sliced(whole, 2 * portion)):
            stretches = ((x, row, at) for row, text, _ in _ordered(b) for x, at in _cut(text, 0, len(text) - length, min(portion, STRETCH), length))
            for p in _portions(stretches, portion):
                yield _runs(p, length)
        settle()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in sliced(whole, 2 * portion)):
            stretches = ((x, row, at) for row, text, spans in _ordered(b) for s in spans for x, at in _cut(text, s >> 32, s & 0xFFFFFFFF, min(portion, STRETCH), length))
            for p in _portions(stretches, portion):
                yield _windows(p, length)
        settle()

    rows = docs.mapInArrow(runs, ROWS).repartition("bucket").sortWithinPartitions("bucket", "name", "row", "span")
    one = W.partitionBy("bucket")
    kind = F.col("name").bitwiseAND(F.lit(3))
    rows = rows.withColumn("differ", F.min("name").over(one) != F.max("name").over(one))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("bucket", "name").orderBy("row", "span")))
    rows = rows.withColumn("removed", (kind == REMOVED) | (kind == COMPARE) & (F.col("nth") > 1)).filter((kind != TOLD) & (F.col("removed") | F.col("differ") | (kind == DIFFERS)))
    rows = scratch.stage(rows.select("removed", "row", "span"), "runs")

    pending = _spans(rows.filter("not removed"))
    single = docs.join(pending, "row").select("row", "text", "spans").mapInArrow(windows, SINGLE)
    nth = F.row_number().over(W.partitionBy("bucket").orderBy("row", "span"))
    single = single.withColumn("nth", nth).filter("bucket % 2 <> 0 or nth > 1")
    return rows.filter("removed").select("row", "span").unionByName(single.select("row", "span"))


def _removed(spans: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges of a document from its runs, which come in order."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        lo, end = s >> 32, (s & 0xFFFFFFFF) + length
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((lo, end))
    return out


def _kept(raw: bytes, removed: list[tuple[int, int]]) -> list[bytes]:
    ends = [0, *[x for s in removed for x in s], len(raw)]
    return [raw[a:z] for a, z in zip(ends[::2], ends[1::2], strict=True)]


def dedup(docs: DataFrame, length: int = 100, portion: int = PORTION) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every document.

    Each byte goes that a string of `length` bytes covers which begins earlier, too: in a document of smaller doc_id, or
    further in front in the same one.  Null and empty texts, and those shorter than `length`, stay as they are.  Texts may
    have any length; they are worked on in portions.  Of rows with one doc_id, which stand in the order of their texts,
    the first keeps what they share; rows with a null doc_id stand last.  An empty table gives an empty result.  Columns
    but doc_id and text are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    whole = numbered(scratch, pick(docs, doc_id="long", text="string"), "row")

    def cut():
        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for d, text, spans in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), b.column("spans").to_pylist(), strict=True):
                removed = _removed(spans, length)
                kept = b"".join(_kept(text, removed))
                rows.append((d, len(text), len(text) - len(kept), len(removed), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

        return each

    spans = scratch.stage(_spans(removed_windows(scratch, whole.select("row", "text"), length, portion)), "spans")
    found = whole.join(spans, "row", "left").select("doc_id", "text", "spans")
    return mapped(found, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, length: int = 100, portion: int = PORTION) -> DataFrame:
    """docs with text (and n_chars, if there) after removal, as `dedup` does it; a character of which some byte stays in
    front or behind goes with the removed span.  All other columns stay, whatever their names."""
    scratch = Scratch(docs.sparkSession)
    row, spans = fresh_name(docs, "row"), fresh_name(docs, "spans")
    whole = numbered(scratch, docs, row)
    names = docs.columns
    at, kind = names.index("text"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def cut():
        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = []
            for text, found in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if found:
                    raw = text.encode()
                    text = "".join(x.decode("utf-8", "ignore") for x in _kept(raw, _removed(found, length)))
                texts.append(text)
            columns = [b.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, columns[at].type)
            return pa.record_batch(columns, names)

        return each

    texts = whole.select(F.col(f"`{row}`").alias("row"), F.col("text").cast("string").alias("text"))
    found = scratch.stage(_spans(removed_windows(scratch, texts, length, portion)), "spans")
    found = whole.join(found.select(F.col("row").alias(row), F.col("spans").alias(spans)), row, "left")
    out = mapped(found.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{spans}`")), cut, kind)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in names])
