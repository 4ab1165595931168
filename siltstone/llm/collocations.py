"""Phrase collocations by level-wise (Apriori) passes.

A-Z are lower-cased; texts are split at `[.,;:!?\\x0A-\\x0D]` into pieces and pieces into words `[^\\x20\\x09]+`.  Everything is
counted per language.  The pass for phrases of k words emits only those whose two phrases of k - 1 words are both frequent,
so that rare phrases are never shuffled; cuts of the phrases that are frequent are then scored from the tables of levels.

What a pass needs to know of the level before it is broadcast as a table of bits over hashes.  Its size is a parameter,
however many phrases are frequent: a bit too many lets a phrase through that is counted and found rare, so counts are exact
at any size.  Phrases are told apart by their bytes, never by hashes.

A null language is `und`, a null or empty text has no words, repeated rows count as often as they stand there, an empty
table has no phrases.  Ties are broken by count and then by the phrase in the order of its UTF-8 bytes.  Extra columns don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, mapped, pick
from siltstone.llm.shingles import mix


@dataclass(frozen=True)
class Settings:
    #: Occurrences from which on a phrase is frequent.
    least: int = 10
    #: Words of the longest phrases.
    longest: int = 3
    #: A phrase goes if a longer one around it has this percentage of its occurrences.
    cover: int = 50
    #: Phrases of each language that are returned.
    top: int = 2000
    #: The table of bits has at most two to the power of this.
    bits: int = 27


#: Factor of the scores.
SCALE = 1_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE, _END = 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9]] = _SPACE
_CLASS[[*b".,;:!?", *range(10, 14)]] = _END


class Portion:
    """The words of a batch (lang, text): `code` numbers each word within `vocabulary`, `word` each pair of a language and a
    word within `lang_of` and `code_of`; `runs[i]` tells whether word i + 1 follows word i in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        lang = batch.column("lang").cast(pa.string()).dictionary_encode()
        self.langs = lang.dictionary
        text = batch.column("text").cast(pa.large_binary())
        text = pc.fill_null(text, b"")
        offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        first = offsets[:-1] - offsets[0]
        kind = _CLASS[data]
        inside = kind == 0
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = first[(first > 0) & (first < len(data))]  # a text ends a word
        begin[edges] |= inside[edges]
        end[edges - 1] |= inside[edges - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.n = len(starts)
        of = np.searchsorted(first, starts, "right") - 1
        piece = np.cumsum(kind == _END, dtype=np.int32)[starts]
        self.runs = (of[1:] == of[:-1]) & (piece[1:] == piece[:-1])
        # words and what stands between them, as one array over the lower-cased bytes
        bounds = np.empty(2 * self.n, np.int64)
        bounds[::2], bounds[1::2] = starts, ends
        parts = pa.Array.from_buffers(pa.large_binary(), max(0, 2 * self.n - 1), [None, pa.py_buffer(bounds), pa.py_buffer(_LOWER[data])])
        coded = parts.dictionary_encode()
        self.vocabulary = coded.dictionary
        self.code = coded.indices.to_numpy()[::2].astype(np.int64)
        width = max(1, len(self.vocabulary))
        pairs, self.word = np.unique(lang.indices.to_numpy()[of].astype(np.int64) * width + self.code, return_inverse=True)
        self.lang_of, self.code_of = pairs // width, pairs % width

    def hashes(self) -> np.ndarray:
        """Of each word in its language."""
        return word_hashes([self.langs[i].as_py() for i in range(len(self.langs))], self.lang_of, self.vocabulary.take(pa.array(self.code_of)).to_pylist())[self.word]

    def grams(self, at: np.ndarray, k: int) -> pa.RecordBatch | None:
        """lang, phrase, n of the phrases of k words that begin at the words `at`."""
        if not len(at):
            return None
        width = len(self.code_of)
        place, n, number = None, None, self.word[at]
        for j in range(k):
            if j:
                number = number * width + self.word[at + j]
            _, place, number, n = np.unique(number, return_index=True, return_inverse=True, return_counts=True)
        here = at[place]
        words = [self.vocabulary.take(pa.array(self.code[here + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if k > 1 else words[0]
        lang = self.langs.take(pa.array(self.lang_of[self.word[here]]))
        return pa.record_batch([lang, phrase.cast(pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])


def word_hashes(langs: list[str], lang_of: np.ndarray, words: list[bytes]) -> np.ndarray:
    of = np.array([xxhash.xxh3_64_intdigest(x.encode(), 1) for x in langs], np.uint64)
    return mix(of[lang_of], np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Of the k words from each word on."""
    out = words[: max(0, len(words) - k + 1)]
    for j in range(1, k):
        out = mix(out, words[j : len(words) - k + 1 + j])
    return out


@dataclass
class Bits:
    """A set of hashes, and a few more."""

    log: int
    table: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.log)
        return (self.table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def level_bits(level: DataFrame, k: int, most: int) -> Bits:
    """The table of bits of a staged level: 32 bits for each phrase, if two to the power of `most` are enough for that."""
    log = min(most, max(16, int(32 * level.count()).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lang = b.column("lang").dictionary_encode()
            words = [w for p in b.column("phrase").cast(pa.binary()).to_pylist() for w in p.split(b" ")]
            each = word_hashes(lang.dictionary.to_pylist(), np.repeat(lang.indices.to_numpy(), k), words).reshape(-1, k)
            h = each[:, 0]
            for j in range(1, k):
                h = mix(h, each[:, j])
            at = h >> np.uint64(64 - log)
            yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["slot", "bits"])

    got = level.select("lang", "phrase").mapInArrow(slots, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (log - 6), np.uint64)
    table[got["slot"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Bits(log, table)


def level_counts(docs: DataFrame, k: int, before: Bits | None, portion: int) -> DataFrame:
    """lang, phrase, n: occurrences of the phrases of k words whose phrases of k - 1 words are in `before`."""
    shared = docs.sparkSession.sparkContext.broadcast(before)

    def make():
        known = shared.value

        def count(b: pa.RecordBatch) -> pa.RecordBatch | None:
            p = Portion(b)
            if k == 1:
                return p.grams(np.arange(p.n), 1)
            often = known.has(gram_hashes(p.hashes(), k - 1))
            whole = p.runs[: max(0, p.n - k + 1)].copy()
            for j in range(1, k - 1):
                whole &= p.runs[j : j + len(whole)]
            return p.grams(np.flatnonzero(whole & often[: len(whole)] & often[1 : 1 + len(whole)]), k)

        return count

    return mapped(docs, make, "lang string, phrase string, n long", portion).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def scored(levels: list[DataFrame], settings: Settings) -> DataFrame:
    """lang, phrase, a, l, r, score, cut of the phrases in the tables of levels (lang, phrase, n) that no longer one covers."""
    size = lambda t, k: t.select("lang", "phrase", F.col("n").alias("a"), F.lit(k).alias("k"), F.split("phrase", " ").alias("w"))
    phrases = size(levels[1], 2)
    parts = levels[0]
    for k, t in enumerate(levels[2:], 3):
        phrases = phrases.unionByName(size(t, k))
    for t in levels[1:-1]:
        parts = parts.unionByName(t)
    cut = phrases.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut", F.concat_ws(" ", F.slice("w", 1, F.col("cut"))).alias("left"), F.concat_ws(" ", F.slice("w", F.col("cut") + 1, F.col("k"))).alias("right"))
    cut = cut.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    cut = cut.select("lang", "phrase", "a", "l", "r", "cut", (exact("a") * exact("a") * F.lit(SCALE).cast("decimal(7,0)")).alias("above"), (exact("l") * exact("r")).alias("below"))
    low = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("above div below").alias("score"), "cut", "l", "r")).alias("x"))
    inner = phrases.filter("k > 2").select("lang", "a", "w", "k", F.explode(F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> slice(w, i, m))))")).alias("s"))
    around = inner.groupBy("lang", F.concat_ws(" ", "s").alias("phrase")).agg(F.max("a").alias("around"))
    low = low.join(around, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (100 * F.col("around") < settings.cover * F.col("a")))
    return low.select("lang", "phrase", "a", "x.l", "x.r", "x.score", F.col("x.cut").cast("long").alias("cut"))


def collocations(docs: DataFrame, settings: Settings = Settings(), portion: int = 4 << 20) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score, cut: the first phrases of each language by score.

    `docs` has lang and text.  a is the phrase's count, l and r those of the two parts at its lowest-scoring cut, which is
    behind its first `cut` words, n the words of the language.
    """
    if settings.longest < 2 or settings.least < 1 or not 16 <= settings.bits <= 34:
        raise ValueError("phrases have two words at least, occur once at least, and the table has 2^16 to 2^34 bits")
    scratch = Scratch(docs.sparkSession)
    docs = pick(docs, lang="string", text="string").withColumn("lang", F.coalesce("lang", F.lit("und")))
    words = scratch.stage(level_counts(docs, 1, None, portion), "words")
    levels = [scratch.stage(words.filter(F.col("n") >= settings.least), "level")]
    for k in range(2, settings.longest + 1):
        counts = level_counts(docs, k, level_bits(levels[-1], k - 1, settings.bits), portion)
        levels.append(scratch.stage(counts.filter(F.col("n") >= settings.least), "level"))
    by = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored(levels, settings).withColumn("rank", F.row_number().over(by).cast("long")).filter(F.col("rank") <= settings.top)
    out = first.join(words.groupBy("lang").agg(F.sum("n").alias("n")), "lang")
    return scratch.result(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut"), "collocations")
