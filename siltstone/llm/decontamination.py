"""Benchmark decontamination: n-gram seeds join passages to benchmark items, Smith-Waterman alignment scores them.

Words are the runs of letters and digits, in lower case; the n-grams of the items' words are the seeds, all of them, however
many documents hold one.  An item of which a document doesn't have enough words can't be in it, which is seen before any
passage is looked at, so common phrases open few alignments.  A document that holds seeds of an item
is cut to the passages around them, and each passage is aligned with the item locally: a match scores 1, a substitution
or a gap costs 1 / 2.  An item is found if its best alignment reaches `threshold` of the item's length in words.

The benchmark is a stated query set: it is broadcast, in parts of about `MOST_WORDS` words, each with a pass over the texts.
Texts may be null or empty (nothing is found), and of any length.  An item with fewer words than a seed is
never found: so few words stand in clean documents, too.  Equal items are found each.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import mapped, pick, utf8

SEED = 3
THRESHOLD = 0.5
#: Words of the benchmark that are looked for in one pass.
MOST_WORDS = 2_000_000
FOUND = "doc_id long, item_id long, score double, coverage double, matched_words int, item_words int, start_word int, end_word int"

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_M = np.uint64(0x9E3779B97F4A7C15)


class Words:
    def __init__(self):
        from xxhash import xxh64_intdigest

        from siltstone.llm.tokens import Remembered

        self.memory = Remembered(xxh64_intdigest, 100_000)

    def of(self, text: bytes) -> np.ndarray:
        """Hashes of the words.  Letters outside ASCII count as word bytes and are lower-cased with the text."""
        low = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
        w = _WORD.findall(low)
        out = np.fromiter(map(self.memory.__getitem__, w), np.uint64, len(w))
        self.memory.trim()
        return out


def seeds_of(words: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams that begin at each word."""
    k = min(SEED, len(words))
    if not k:
        return words
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ words[i : len(words) - k + 1 + i]) * _M
        out ^= out >> np.uint64(32)
    return out


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int, int]:
    """Best local alignment (Smith-Waterman, linear gaps): score, matched words, start and end in the passage.

    Each cell carries where its alignment began and how many words match in it, so only one row is held; of equal ways a
    cell takes the diagonal, then the item's gap, then the passage's.
    """
    m = len(passage)
    at, steps = np.arange(m + 1), np.arange(m + 1) * 0.5
    score, start, matched = np.zeros(m + 1), at.copy(), np.zeros(m + 1, np.int64)
    best = 0.0, 0, 0, 0
    for w in item:
        same = passage == w
        row, began, count = score - 0.5, start, matched
        diagonal = score[:-1] + np.where(same, 1.0, -0.5)
        take = np.append(False, diagonal >= row[1:])
        row = np.where(take, np.append(0.0, diagonal), row)
        began = np.where(take, np.append(0, start[:-1]), began)
        count = np.where(take, np.append(0, matched[:-1] + same), count)
        none = row <= 0
        row[none], began[none], count[none] = 0.0, at[none], 0
        # gaps along the row: the running maximum of row + 0.5 * position, less 0.5 * position
        top = np.maximum.accumulate(row + steps)
        from_ = np.maximum.accumulate(np.where(row + steps >= top, at, 0))
        gap = top - steps > row
        score, start, matched = np.where(gap, top - steps, row), np.where(gap, began[from_], began), np.where(gap, count[from_], count)
        if (j := int(score.argmax())) and score[j] > best[0]:
            best = float(score[j]), int(matched[j]), int(start[j]), j
    return best


def read_items(items: DataFrame) -> dict[int, list[bytes]]:
    """item_id -> texts of a part of the benchmark."""
    out: dict[int, list[bytes]] = defaultdict(list)
    for r in items.orderBy("item_id", "text").collect():
        out[r["item_id"]].append(r["text"].encode())
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, most_words: int = MOST_WORDS) -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, score, coverage (score / words of the item),
    matched words, words of the item, and the place of the best alignment in the document (words, end exclusive).

    Of rows with one doc_id, or one item_id, the best alignment counts.  A null doc_id or item_id is one like any other.  Empty
    tables give no rows.
    """
    docs = pick(docs, doc_id="long", text="string").filter("text is not null")
    items = pick(benchmark, item_id="long", text="string").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (8 * most_words)))
    found = None
    for i in range(parts):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) if parts > 1 else items
        part = _found(docs, read_items(some), threshold)
        found = part if found is None else found.unionByName(part)
    best = F.row_number().over(W.partitionBy("doc_id", "item_id").orderBy(F.desc("score"), "start_word"))
    return found.withColumn("_nth", best).filter("_nth = 1").drop("_nth")


def _found(docs: DataFrame, texts: dict[int, list[bytes]], threshold: float) -> DataFrame:
    """Alignments over the threshold of documents with some items, of one item perhaps several."""
    spark, words = docs.sparkSession, Words()
    items = [(i, w) for i, some in texts.items() for t in some if len(w := words.of(t)) >= SEED]
    if not items:
        return spark.createDataFrame([], FOUND)
    own = [np.unique(seeds_of(w)) for _, w in items]
    order = np.argsort(np.concatenate(own), kind="stable")
    known, first = np.unique(np.concatenate(own)[order], return_index=True)
    # the items of known seed s, by their number: having[first[s] : first[s + 1]]
    having = np.repeat(np.arange(len(own)), [len(x) for x in own])[order]
    vocabulary, place = np.unique(np.concatenate([w for _, w in items]), return_inverse=True)
    plan = spark.sparkContext.broadcast((items, known, np.append(first, len(having)), having, vocabulary, np.split(place, np.cumsum([len(w) for _, w in items])[:-1])))

    def held(seeds: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Positions whose seed is known: a bitmap of the high bits first, then an exact look-up."""
        at = np.flatnonzero(bitmap_of(known)[seeds >> np.uint64(44)])
        k = np.searchsorted(known, seeds[at])
        k[k == len(known)] = 0
        return at[known[k] == seeds[at]]

    bitmaps: dict[int, np.ndarray] = {}

    def bitmap_of(known: np.ndarray) -> np.ndarray:
        if id(known) not in bitmaps:
            b = np.zeros(1 << 20, bool)
            b[known >> np.uint64(44)] = True
            bitmaps.clear()
            bitmaps[id(known)] = b
        return bitmaps[id(known)]

    def find():
        words = Words()
        items, known, first, having, vocabulary, place = plan.value
        present = np.zeros(len(vocabulary), bool)

        def each(b: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = []
            for d, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                w = words.of(text)
                seeds = seeds_of(w)
                if not len(seeds):
                    continue
                hits = held(seeds, known)
                if not len(hits):
                    continue
                s = np.searchsorted(known, seeds[hits])
                n = first[s + 1] - first[s]
                at = np.repeat(hits, n)
                k = having[np.repeat(first[s] - (np.cumsum(n) - n), n) + np.arange(len(at))]
                order = np.argsort(k, kind="stable")
                at, k = at[order], k[order]
                begin = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k))
                v = np.searchsorted(vocabulary, w)
                v[v == len(vocabulary)] = 0
                v = v[vocabulary[v] == w]
                present[v] = True
                for a, z in zip(begin[:-1], begin[1:], strict=True):
                    item, own = items[k[a]]
                    # words of the item in the document bound the score from above
                    if np.count_nonzero(present[place[k[a]]]) < threshold * len(own):
                        continue
                    if best := best_passage(own, w, at[a:z].tolist(), threshold):
                        rows.append((d, item, best[0], best[0] / len(own), best[1], len(own), best[2], best[3]))
                present[v] = False
            if not rows:
                return None
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

        return each

    return mapped(docs, find, FOUND)


def best_passage(item: np.ndarray, words: np.ndarray, at: list[int], threshold: float) -> tuple[float, int, int, int] | None:
    """The best alignment of an item with the passages around its seeds, if it reaches the threshold."""
    reach = 2 * len(item) + SEED
    passages: list[list[int]] = []
    for p in sorted(at):
        if passages and p - reach <= passages[-1][1]:
            passages[-1][1] = p + reach
        else:
            passages.append([p - reach, p + reach])
    best = None
    for lo, hi in blocks(passages, 3 * len(item) + SEED, len(words)):
        part = words[lo:hi]
        # words of the item in the passage bound the score from above
        if np.isin(item, part).sum() < threshold * len(item):
            continue
        score, matched, a, z = align(item, part)
        if score >= threshold * len(item) and (best is None or score > best[0]):
            best = score, matched, lo + a, lo + z
    return best


def blocks(passages: list[list[int]], span: int, end: int):
    """Passages within a text of `end` words, long ones in blocks that overlap by `span`: no alignment whose score is
    positive covers more, as each word beyond the item's own is a gap, and gaps cost half of what matches give."""
    for lo, hi in passages:
        lo, hi = max(0, lo), min(end, hi)
        while hi - lo > 5 * span:
            yield lo, lo + 5 * span
            lo += 4 * span
        yield lo, hi
