"""Words of texts without spaces: the likeliest path through the graph of a dictionary's words.

A run of CJK characters is cut into words so that the product of their shares of the dictionary's counts is greatest; a
character that no word covers stands alone, as a word of count 1.  `spaced` puts spaces between the words, so that all
functions that split texts at white space see them; texts without such characters stay as they are.

The dictionary is the caller's: a table (word, count), or what `corpus_words` finds in a corpus.  It is sent to every task,
so it is counted first and may have at most MOST words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import CJK

MOST = 1_000_000
_RUN = re.compile(f"[{CJK}]+")


@dataclass
class Dictionary:
    """Log shares of words, and the length of the longest."""

    shares: dict[str, float]
    longest: int
    unknown: float

    @classmethod
    def of(cls, counts: dict[str, int]) -> Dictionary:
        total = sum(counts.values()) or 1
        return cls({w: math.log(n / total) for w, n in counts.items() if w and n > 0}, max(map(len, counts), default=1), math.log(1 / total) if total > 1 else 0.0)

    @classmethod
    def read(cls, words: DataFrame) -> Dictionary:
        """Of a table (word, count)."""
        if words.limit(MOST + 1).count() > MOST:
            raise ValueError(f"a dictionary of more than {MOST} words isn't sent to every task")
        return cls.of({r["word"]: r["count"] for r in words.select("word", "count").filter("word is not null and count > 0").collect()})

    def cut(self, run: str) -> list[str]:
        """The words of a run, by the best path from its end; of equal ones the longer first word."""
        n = len(run)
        best: list[tuple[float, int]] = [(0.0, 0)] * (n + 1)
        for i in range(n - 1, -1, -1):
            found = None
            for j in range(min(n, i + self.longest), i, -1):
                share = self.shares.get(run[i:j])
                if share is None and j == i + 1:
                    share = self.unknown
                if share is not None and (found is None or share + best[j][0] > found[0] + 1e-12):
                    found = (share + best[j][0], j)
            best[i] = found
        out, i = [], 0
        while i < n:
            out.append(run[i : best[i][1]])
            i = best[i][1]
        return out

    def spaced(self, text: str) -> str:
        def apart(m: re.Match) -> str:
            before = " " if m.start() and not text[m.start() - 1].isspace() else ""
            after = " " if m.end() < len(text) and not text[m.end()].isspace() else ""
            return before + " ".join(self.cut(m[0])) + after

        return _RUN.sub(apart, text)


def spaced(df: DataFrame, columns: list[str], dictionary: Dictionary) -> DataFrame:
    """df with spaces between the words of its columns' CJK runs; a null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(dictionary)
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        for b in batches:
            out = list(b.columns)
            for i in at:
                out[i] = pa.array([t if t is None or not _RUN.search(t) else d.spaced(t) for t in b.column(i).to_pylist()], b.column(i).type)
            yield pa.record_batch(out, names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def corpus_words(docs: DataFrame, column: str, longest: int = 4, least: int = 5, bond: float = 4.0) -> DataFrame:
    """word, count: strings of 2 to `longest` characters within CJK runs that occur `least` times and whose parts, however it
    is cut in two, meet `bond` times as often as by chance; and all single characters."""
    runs = docs.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(f"([{CJK}]+)"), F.lit(1))).alias("r"))
    grams = None
    for k in range(1, longest + 1):
        part = runs.filter(F.length("r") >= k).select(F.explode(F.sequence(F.lit(1), F.length("r") - k + 1)).alias("i"), "r").select(F.substring("r", F.col("i"), F.lit(k)).alias("word"))
        grams = part if grams is None else grams.unionByName(part)
    counts = grams.groupBy("word").agg(F.count("*").alias("count")).filter((F.col("count") >= least) | (F.length("word") == 1))
    total = counts.filter(F.length("word") == 1).agg(F.sum("count").alias("total"))
    cut = counts.filter(F.length("word") > 1).select("word", "count", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    side = lambda name: counts.select(F.col("word").alias(name), F.col("count").alias(f"n_{name}"))
    cut = cut.withColumn("left", F.expr("substring(word, 1, i)")).withColumn("right", F.expr("substring(word, i + 1)")).join(side("left"), "left").join(side("right"), "right").crossJoin(F.broadcast(total))
    bound = cut.groupBy("word", "count").agg(F.min(F.col("count") * F.col("total") / (F.col("n_left") * F.col("n_right"))).alias("bond"))
    return counts.filter(F.length("word") == 1).unionByName(bound.filter(F.col("bond") >= bond).select("word", "count"))
