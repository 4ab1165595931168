"""Text functions as columns: token sets, similarities, normal forms, detectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"㐀-䶿一-鿿぀-ヿ가-힯"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Distinct lower-case words without other characters than letters and digits; with CJK characters, also their pairs."""
    words = F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: w != ""))
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"([{CJK}]+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array(r))))
    return F.when(F.coalesce(text.rlike(f"[{CJK}]"), F.lit(False)), F.array_distinct(F.concat(words, pairs))).otherwise(words)


def sorted_tokens(text: Column) -> Column:
    return F.array_sort(tokens(text))


def token_string(text: Column) -> Column:
    return F.array_join(sorted_tokens(text), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Of token sets; two empty sets have no similarity and count as 0."""
    return F.when(F.size(F.array_union(a, b)) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def similarity(a: Column, b: Column) -> Column:
    """The greater of Jaccard and containment."""
    return F.greatest(jaccard(a, b), containment(a, b))


def strongly_contains(new: Column, old: Column) -> Column:
    """The new set covers the old one, adds much, and is larger."""
    both = F.size(F.array_intersect(new, old))
    return (F.size(new) > F.size(old)) & (F.size(old) > 0) & (both / F.size(old) >= 0.85) & (both / F.size(new) <= 0.7)


def candidate_score(lexical: Column, same_topic: Column, same_cluster: Column) -> Column:
    return F.least(F.lit(1.0), lexical + F.when(same_topic, 0.05).otherwise(0.0) + F.when(same_cluster, 0.05).otherwise(0.0))


def keywords(text: Column, n: int) -> Column:
    """The n words of most bytes among those of three or more, in order of appearance where equal."""
    words = F.array_distinct(F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: F.octet_length(w) >= 3))
    ranked = F.transform(words, lambda w, i: F.struct((-F.octet_length(w)).alias("k"), i.alias("i"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(ranked), 1, n), lambda x: x["w"])


def topic_key(topic: Column) -> Column:
    """Lower case; runs of other characters than letters and digits are one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(topic)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def concept_key(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[_\s-]+", "-"), "^-+|-+$", "")


def topic_display_score(topic: Column) -> Column:
    """Which variant of a topic reads best: spaces and capitals count for it, hyphens and underscores against."""

    def count(pattern: str) -> Column:
        return F.length(topic) - F.length(F.regexp_replace(topic, pattern, ""))

    return 3 * count(" ") + count(r"\p{Lu}") - count("-") - 2 * count("_")


def has_date(text: Column) -> Column:
    return text.rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")


def dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([0-9]{4}-[0-9]{2}-[0-9]{2})"), F.lit(1))


def date_keywords(text: Column) -> Column:
    """`date:` keywords of all dates in a text, sorted, at most eight."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(dates(text), lambda d: F.concat(F.lit("date:"), d)))), 1, 8)


def contains_phrase(text: Column, phrase: str) -> Column:
    """phrase in text, not inside a longer word or identifier; a phrase of other letters than ASCII anywhere."""
    import re

    if not phrase.isascii():
        return F.contains(F.lower(text), F.lit(phrase.lower()))
    return F.lower(text).rlike(rf"(^|[^\p{{L}}\p{{N}}_]){re.escape(phrase.lower())}($|[^\p{{L}}\p{{N}}_])")


def keyword_overlap(query_words: Column, row_keywords: Column, content: Column) -> Column:
    """The share of the query's words that are a keyword, or stand in the content."""
    low = F.lower(content)
    hits = F.size(F.filter(query_words, lambda w: F.array_contains(row_keywords, w) | F.contains(low, w)))
    return F.when(F.size(query_words) == 0, 0.0).otherwise(hits / F.size(query_words))


def sanitize_query(query: Column) -> Column:
    """Words of a full-text query, without its operators and quotation marks."""
    return F.filter(F.split(F.trim(F.regexp_replace(query, r"[-*:()\"^‘’“”«»]", " ")), r"\s+"), lambda w: w != "")


def like_pattern(query: str) -> str:
    for ch in ("\\", "%", "_"):
        query = query.replace(ch, "\\" + ch)
    return f"%{query}%"


def glob_to_regex(pattern: str) -> str:
    import re

    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def stripped(c: Column) -> Column:
    """Without the Unicode spaces (no tabs or other controls) at both ends."""
    return F.regexp_replace(c, r"^\p{Zs}+|\p{Zs}+$", "")


def novel_lines(source: Column, target: Column) -> Column:
    """Lines of source that target lacks, compared trimmed and in lower case; merge markers are skipped."""
    lines = F.filter(F.transform(F.split(source, "\n"), lambda x: stripped(x)), lambda x: (x != "") & ~F.lower(x).startswith("[merged"))
    have = F.transform(F.split(F.lower(target), "\n"), lambda x: stripped(x))
    return F.filter(lines, lambda x: ~F.array_contains(have, F.lower(x)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?。！？\n]+"), lambda x: F.trim(x)), lambda x: x != "")


# fixed values: phrases by which a text states a preference, or that something has changed
PREFERENCES = ("i prefer", "i like", "i love", "my favorite", "my favourite", "i usually", "i always", "i tend to", "i often", "prefer to", "rather than", "instead of using", "i enjoy", "i favor", "i favour")
PREFERENCES_CJK = ("我喜欢", "我偏好", "我习惯", "我倾向", "我更喜欢", "我通常", "我总是", "比较喜欢", "更倾向于", "偏爱")
UPDATES = ("changed to", "switched to", "moved to", "migrated to", "replaced with", "upgraded to", "downgraded to", "updated to", "no longer", "instead of", "now using", "now uses", "deprecated", "replaced by", "superseded by", "was renamed to", "renamed to")
UPDATES_CJK = ("改为", "换成", "迁移到", "升级到", "不再使用", "替换为", "现在使用", "已弃用", "已废弃")


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def is_preference(text: Column) -> Column:
    return _any(F.lower(text), PREFERENCES) | _any(text, PREFERENCES_CJK)


def is_update(text: Column) -> Column:
    return _any(F.lower(text), UPDATES) | _any(text, UPDATES_CJK)


def word_jaccard(a: Column, b: Column) -> Column:
    """Of the words of two queries, cut at white space, in lower case."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""))
    return jaccard(words(a), words(b))


def kept_variants(query: Column, variants: Column, most: Column, alike: float = 0.8) -> Column:
    """At most so many variants of a query, without those too like it or like one before."""
    none = F.array().cast("array<string>")
    near = lambda a, b: word_jaccard(a, b) > alike
    kept = F.aggregate(variants, none, lambda have, x: F.when(near(query, x) | F.exists(have, lambda y: near(y, x)), have).otherwise(F.concat(have, F.array(x))))
    return F.slice(kept, F.lit(1), most)


def bound(value: Column, end: bool) -> Column:
    """A user's time bound: a day means its beginning or its last second; null if it is no date."""
    day = value.rlike(r"^\d{4}-\d{2}-\d{2}$")
    at = F.try_to_timestamp(value)
    return F.when(day & F.lit(end), at + F.expr("interval 86399 seconds")).otherwise(at)


def statements(text: Column) -> Column:
    """Sentences of prose: they end at . ! ? before white space, at CJK marks with the closing ones behind them, and at
    blank lines; a single line break doesn't end one."""
    cut = F.regexp_replace(text, r"[.!?](?=\s|$)|[。｡．！？][。｡．！？”’」』）】》〉)\]]*|\n(?=[ \t\r]*\n)", "$0\u0001")
    return F.filter(F.transform(F.split(cut, "\u0001"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


# fixed values: phrases that mark a line as secret (without those that name one product's variables)
SECRET_PHRASES = (
    "api_key=", "api-key=", "apikey=", "token=", "access_token=", "client_secret=", "secret=", "password=", "authorization:", "bearer ",
    "export gemini_api_key", "export openai_api_key", "sk-", "gho_", "ghp_", "sm_", "-----begin", "-----end",
)
# fixed values: patterns of secrets, and what stands in their place
SECRETS = (
    (r"(?is)-----BEGIN [^-]+-----.*?-----END [^-]+-----", "[REDACTED_PEM_BLOCK]"),
    (r"(?i)\b(authorization\s*:\s*bearer)\s+[^\s]+", "$1 [REDACTED]"),
    (r"""(?i)(["'](?:api[_-]?key|access[_-]?token|client[_-]?secret|token|secret|password)["']\s*:\s*")([^"]*)(")""", "$1[REDACTED]$3"),
    (r"""(?i)(["'](?:api[_-]?key|access[_-]?token|client[_-]?secret|token|secret|password)["']\s*:\s*')([^']*)(')""", "$1[REDACTED]$3"),
    (r"""(?i)\b((?:api[_-]?key|access[_-]?token|client[_-]?secret|token|secret|password)\s*[:=]\s*)("[^"]*"|'[^']*'|[^\s]+)""", "$1[REDACTED]"),
    (r"(?i)\b(export\s+(?:gemini_api_key|openai_api_key)\s*=\s*)[^\s]+", "$1[REDACTED]"),
    (r"\bsk-[A-Za-z0-9_-]{20,}\b", "[REDACTED_API_KEY]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", "[REDACTED_GITHUB_TOKEN]"),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}\b", "[REDACTED_GITHUB_TOKEN]"),
    (r"\bhf_[A-Za-z]{20,}\b", "[REDACTED_HF_TOKEN]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY]"),
    (r"\bAIza[0-9A-Za-z\-_]{20,}\b", "[REDACTED_GCP_KEY]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "[REDACTED_SLACK_TOKEN]"),
    (r"\bsm_[A-Za-z0-9_-]{20,}\b", "[REDACTED_SM_TOKEN]"),
)


def is_secret(line: Column) -> Column:
    low, out = F.lower(line), F.lit(False)
    for p in SECRET_PHRASES:
        out = out | F.contains(low, F.lit(p))
    for p, _ in SECRETS:
        out = out | line.rlike(p)
    return out


def redact(text: Column) -> Column:
    for p, instead in SECRETS:
        text = F.regexp_replace(text, p, instead)
    return text


def clip_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters with at most so many bytes."""
    fits = F.filter(F.sequence(F.greatest(F.lit(0), F.least(F.length(text), F.lit(most)) - F.lit(3 * most // 4) - 1), F.least(F.length(text), F.lit(most))), lambda n: F.octet_length(F.substring(text, F.lit(1), n)) <= most)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(text, F.lit(1), F.array_max(fits)))


def embedding_text(topic: Column, summary: Column, content: Column) -> Column:
    return F.concat_ws("\n", topic, summary, content)


def citations(text: Column, most: int | Column) -> Column:
    """Numbers in [n] markers from 1 to `most`, sorted."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]{1,4})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= most))))


def fold_of(key: Column, salt: str, folds: int = 5) -> Column:
    """SHA-256 of salt and key, as a big number, modulo folds."""
    digits = F.sha2(F.concat(F.lit(salt), key), 256)
    each = F.transform(F.sequence(F.lit(1), F.lit(63), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int"))
    return F.aggregate(each, F.lit(0), lambda r, b: (r * 256 + b) % folds)


def sampled(key: Column, rate: float) -> Column:
    """True for a share of keys: the first 64 bits of their SHA-256 against the rate."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("double") / F.lit(2.0**64 - 1) < F.lit(rate)


def trigrams_kept(output: Column, source: Column) -> Column:
    """The share of the output's character triples (with repeats) that the source has, white space apart."""

    def grams(x: Column) -> Column:
        return let(F.regexp_replace(F.lower(x), r"\s+", ""), lambda s: F.when(F.length(s) >= 3, F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3)))).otherwise(F.array().cast("array<string>")))

    return let(grams(source), lambda have: let(grams(output), lambda out: F.when(F.size(out) == 0, 1.0).otherwise(F.size(F.filter(out, lambda g: F.array_contains(have, g))) / F.size(out))))
