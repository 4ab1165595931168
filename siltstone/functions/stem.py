"""English stems (the public Porter2 rules), and whether a text answers what is expected, by its most frequent stems."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words and endings of the public rules
WORDS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
DONE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
PREFIXES = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
STOP_WORDS = ("a", "an", "the", "is", "are", "was", "were", "be", "been", "of", "to", "for", "in", "on", "and", "or", "but", "not")

_VOWEL = "aeiouy"
_REGION = re.compile(f"[{_VOWEL}][^{_VOWEL}]")
_SHORT = re.compile(f"(^[{_VOWEL}][^{_VOWEL}]|[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY])$")


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Of a lower-case word of ASCII letters; other words, and those of up to two letters, stay."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    if word in WORDS:
        return WORDS[word]
    w = re.sub(f"(^|(?<=[{_VOWEL}]))y", "Y", word)
    if prefix := next((p for p in PREFIXES if w.startswith(p)), ""):
        r1 = len(prefix)
    else:
        m = _REGION.search(w)
        r1 = m.end() if m else len(w)
    m = _REGION.search(w, r1)
    r2 = m.end() if m else len(w)
    vowel = lambda s: any(c in _VOWEL for c in s)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and vowel(w[:-2]):
        w = w[:-1]
    if w in DONE:
        return w
    # past and participle
    e = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and vowel(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT.search(w):
            w += "e"
    if w[-1] in "yY" and len(w) > 2 and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    # long endings
    e = _longest(w, SECOND)
    if e and len(w) - len(e) >= r1 and not (e == "ogi" and w[-4:-3] != "l") and not (e == "li" and w[-3:-2] not in tuple("cdeghkmnrt")):
        w = w[: -len(e)] + SECOND[e]
    e = _longest(w, THIRD)
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: -len(e)] + THIRD[e]
    e = _longest(w, FOURTH)
    if e and len(w) - len(e) >= r2 and not (e == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def words(text: Column) -> Column:
    """Lower-case words of three bytes or more that aren't stop words, with repeats."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: (F.octet_length(w) > 2) & ~w.isin(*STOP_WORDS))


def stemmed(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the stems of its columns of word arrays; each distinct word of a batch is stemmed once."""
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = list(b.columns)
            for i in at:
                coded = b.column(i).flatten().dictionary_encode()
                stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
                lengths = [0, *b.column(i).value_lengths().fill_null(0).to_pylist()]
                ends = list(accumulate(lengths))
                out[i] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), stems)
            yield pa.record_batch(out, names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def top_words(stems: Column, n: int = 5) -> Column:
    """The n most frequent ones; ties in their own order."""
    ordered = F.array_sort(stems)
    # in a sorted array a word's occurrences stand together
    counts = F.aggregate(
        ordered,
        F.array().cast("array<struct<n:int,w:string>>"),
        lambda a, w: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)).w == w), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct((F.try_element_at(a, F.lit(-1)).n - 1).alias("n"), w.alias("w"))))).otherwise(F.concat(a, F.array(F.struct(F.lit(-1).alias("n"), w.alias("w"))))),
    )
    return F.transform(F.slice(F.array_sort(counts), 1, n), lambda x: x.w)


def hits(cases: DataFrame, evidence: str = "evidence", canonical: str = "canonical", least: int = 3) -> DataFrame:
    """cases with `hit`: whether `least` of the evidence's five most frequent stems stand in the canonical text."""
    x = stemmed(cases.withColumn("_e", words(F.col(evidence))).withColumn("_c", words(F.col(canonical))), ["_e", "_c"])
    return x.withColumn("hit", F.size(F.array_intersect(top_words(F.col("_e")), F.col("_c"))) >= least).drop("_e", "_c")
