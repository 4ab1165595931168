"""Quality rules: a table of thresholds, compiled into one projection without user functions.

Measures of a text: n_words, word_chars, n_symbols, n_marks, n_lines, n_dup_lines, n_repeat_words, n_stop_words.  A rule
is (name, numerator, denominator, factor, least, most): the text passes if least <= factor * numerator / denominator <=
most, where a limit of None doesn't bind.  A denominator of 0 makes the ratio 0.  A null or empty text has no words and
fails the length rule.  Extra columns are kept if asked for; equal rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import WORD_SPLIT, pick

# fixed values: common words of the four languages
STOP_WORDS = """
the of and to in is that it was for on are as with be by at this from or an not
le la les de des du et un une en est que qui dans pour par sur au avec ne pas il elle
der die das und ist von zu den mit des im dem für auf ein eine nicht als auch sich
el los las y que del se por con una para al es lo como su no
""".split()


@dataclass(frozen=True)
class Rule:
    name: str
    numerator: str
    denominator: str | None
    factor: int
    least: float | None
    most: float | None


#: Those of the base come first; base_failed is true if one of them fails.
BASE = (
    Rule("min_words", "n_words", None, 1, 50, None),
    Rule("repeated_windows", "n_repeat_words", "n_words", 100, None, 50),
)
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 1, 2, 20),
    Rule("symbols", "n_symbols", "n_words", 100, None, 20),
    Rule("marks", "n_marks", "n_words", 100, None, 50),
    Rule("stop_words", "n_stop_words", "n_words", 100, 3, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 100, None, 60),
)

SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[!?]"
#: Words of a text from which on a window's position no longer fits into the low bits of its key.
PACKED = 1 << 20


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def removed(text: Column, pattern: str) -> Column:
    """Number of ASCII characters of a class in text."""
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words that lie in 3-word windows found at least twice.

    Windows are 64-bit hashes.  If all are distinct, there is nothing to do.  Otherwise they are sorted together with
    their positions: in one number each (44 bits of hash, 20 of position, the full hashes compared afterwards), or as
    pairs for a text of more than 2**20 words.
    """
    n = F.size(words)

    def covered(positions: Column) -> Column:
        """Words under windows at these positions, which are sorted."""
        return let(positions, lambda p: F.aggregate(
            p,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
            lambda a: a["n"].cast("long"),
        ))

    def packed(h: Column) -> Column:
        keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~(PACKED - 1))).bitwiseOR(i.cast("long"))))

        def positions(s: Column) -> Column:
            def twin(x: Column, k: Column) -> Column:
                def full(y: Column) -> Column:
                    return F.get(h, y.bitwiseAND(F.lit(PACKED - 1)).cast("int"))

                def same(y: Column) -> Column:
                    return F.coalesce((F.shiftright(y, 20) == F.shiftright(x, 20)) & (full(y) == full(x)), F.lit(False))

                return same(F.get(s, k - 1)) | same(F.get(s, k + 1))

            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x.bitwiseAND(F.lit(PACKED - 1)).cast("int")))

        return covered(let(keys, positions))

    def paired(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            def twin(x: Column, k: Column) -> Column:
                return F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        return covered(let(pairs, positions))

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).when(F.size(h) < PACKED, packed(h)).otherwise(paired(h)))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(some)


def measures(text: Column) -> Column:
    """An array of one struct with the measures of a text, in parts; words are the parts between runs of ASCII white
    space, lines those between newlines.  It is made to be exploded: no filter is pushed below that, so nothing is
    computed twice."""

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    def lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    def every(t: Column) -> Column:
        return F.struct(
            let(F.filter(F.split(t, WORD_SPLIT), lambda w: w != ""), of).alias("words"),
            let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lines).alias("lines"),
            F.struct(removed(t, SYMBOLS).alias("n_symbols"), removed(t, MARKS).alias("n_marks")).alias("marks"),
        )

    return F.transform(F.array(F.coalesce(text, F.lit(""))), every)


def passes(rule: Rule) -> Column:
    value = F.lit(rule.factor) * F.col(rule.numerator)
    base = F.col(rule.denominator) if rule.denominator else F.lit(1)
    ok = F.lit(True)
    if rule.least is not None:
        ok = ok & (value >= F.lit(rule.least) * base)
    if rule.most is not None:
        ok = ok & (value <= F.lit(rule.most) * base)
    return ok


def judged(docs: DataFrame, rules: tuple[Rule, ...], base: tuple[Rule, ...], row: Column) -> DataFrame:
    """The measures and verdicts of each document, and `row` as column _row."""
    found = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), row.alias("_row"), F.explode(measures(F.col("`text`").cast("string"))).alias("_m"))
    flat = found.select("doc_id", "_row", "_m.words.*", "_m.lines.*", "_m.marks.*")
    failed = F.array_compact(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in (*base, *rules)]))
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | ~passes(r)
    return flat.withColumns({"base_failed": base_failed, "failed": failed}).withColumn("kept", F.size("failed") == 0)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """doc_id, the measures, base_failed, failed (names of the rules that fail) and kept of every row.

    A null text has no words and fails the base, as an empty one does.  Texts may have any length; each is measured within its
    row.  Repeated rows, and rows that share a doc_id or have none, are measured by themselves; measures have no ties.  An empty
    table gives an empty result.  Columns but doc_id and text are ignored, whatever their names.
    """
    return judged(docs, rules, base, F.lit(None).cast("int")).drop("_row")


def good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """The rows of docs that every rule passes, with all their columns, whatever their names; see `quality_rules`."""
    return judged(docs, rules, base, F.struct("*")).filter("kept").select("_row.*")
