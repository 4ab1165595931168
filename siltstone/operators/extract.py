"""From texts to facts: routing of queries, sentences, triples, dates, chunks."""

from __future__ import annotations

import datetime as dt
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import segment, text

# fixed values: phrases of the query classes, in order of precedence, and the classes' settings
EPISODIC = ("what did we decide", "recap of", "session summary", "last conversation", "meeting notes", "会议记录", "上次会话", "总结一下上次")
TEMPORAL = ("when did", "when was", "what changed", "what happened", "last week", "last month", "yesterday", "recently", "recent", "this week", "this month", "changed since", "history of", "timeline", "before march", "after january", "since last")
TEMPORAL_CJK = ("什么时候", "上周", "上个月", "昨天", "最近", "变化", "历史", "改了什么", "发生了什么")
PREFERENCE = ("prefer", "favorite", "favourite", "do i like", "what do i like", "my preference", "i tend to", "usually choose", "go-to", "偏好", "喜欢", "最爱", "倾向")
EXPLORATORY = ("what do i know", "what have i", "everything about", "tell me about", "summarize", "overview", "all about", "what do we know")
EXPLORATORY_CJK = ("我知道什么", "关于", "总结", "概述", "所有")
RELATIVE = ("last week", "last month", "this week", "this month", "yesterday", "recently", "recent", "上周", "上个月", "昨天", "最近")
RELATIVE_DAYS = ((("yesterday", "昨天"), 1), (("last week", "this week", "上周"), 7), (("last month", "this month", "上个月"), 30), (("recently", "最近"), 14))
DEFAULT_DAYS = 30
NOT_KEYWORDS = ("what", "how", "why", "where", "summarize", "tell", "everything")
QUESTIONS_CJK = ("？", "什么", "怎么", "如何", "为什么", "哪里", "哪个")
SETTINGS = {"episodic": (0.5, 1.5), "temporal": (0.7, 1.5), "preference": (0.4, 2.0), "exact": (0.85, 1.0), "exploratory": (0.5, 2.0), "semantic": (0.3, 1.0)}

#: Full-width forms and their plain ones, the part of compatibility normalisation that queries need.
_WIDE, _PLAIN = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000", "".join(map(chr, range(0x21, 0x7F))) + " "


def classify(query: Column, spaced: Column | None = None) -> Column:
    """type, alpha, multiplier and days_back of a query, as a struct.

    A query with CJK characters is a keyword if it has at most three words: those of `spaced`, the query with spaces between
    its words (`segment.spaced`), or else words are taken to have two characters each.
    """
    low = F.lower(F.translate(query, _WIDE, _PLAIN))
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    n = F.size(words)

    def any_of(phrases, found=lambda p: F.contains(low, F.lit(p))):
        out = F.lit(False)
        for p in phrases:
            out = out | found(p)
        return out

    def phrase(p: str) -> Column:
        return text.contains_phrase(low, p)

    episodic = any_of(EPISODIC) | (F.contains(low, F.lit("what happened")) & any_of(("meeting", "session")))
    temporal = any_of(TEMPORAL, phrase) | any_of(TEMPORAL_CJK) | text.has_date(low)
    cjk = query.rlike(f"[{text.CJK}]")
    cjk_words = F.ceil(F.length(F.regexp_replace(query, f"[^{text.CJK}]", "")) / 2)
    if spaced is not None:
        cjk_words = F.size(F.regexp_extract_all(spaced, F.lit(f"([{text.CJK}]+)"), F.lit(1)))
    short = (n <= 3) & (F.octet_length(query) < n * 15) & ~any_of(NOT_KEYWORDS, lambda p: F.startswith(low, F.lit(p)))
    code_words = F.size(F.filter(words, lambda w: F.contains(w, F.lit("_")) | ((F.octet_length(w) > 2) & w.rlike(r"\p{Lu}") & w.rlike(r"\p{Ll}"))))
    code = query.rlike(r"::|\.rs") | low.rlike("^(fn|struct) ") | ((n <= 4) & (code_words > 0) & (code_words >= F.floor(n / 2)))
    exact = F.when(cjk, (cjk_words <= 3) & ~any_of(QUESTIONS_CJK)).otherwise(short | code | query.rlike('["`]'))
    exploratory = any_of(EXPLORATORY) | any_of(EXPLORATORY_CJK, lambda p: F.contains(low, F.lit(p)) & (F.octet_length(low) > len(p.encode()) + 6))
    kind = F.when(episodic, "episodic").when(temporal, "temporal").when(any_of(PREFERENCE), "preference").when(exact, "exact").when(exploratory, "exploratory").otherwise("semantic")
    days = F.lit(DEFAULT_DAYS)
    for phrases, k in reversed(RELATIVE_DAYS):
        days = F.when(any_of(phrases, phrase), k).otherwise(days)

    def setting(i: int, k: Column) -> Column:
        out = F.lit(None).cast("double")
        for name, v in SETTINGS.items():
            out = F.when(k == name, v[i]).otherwise(out)
        return out

    return F.struct(kind.alias("type"), setting(0, kind).alias("alpha"), setting(1, kind).alias("multiplier"), F.when((kind == "temporal") & any_of(RELATIVE, phrase), days).alias("days_back"))


# fixed values: signal words of sentences worth keeping, and what each kind counts
SIGNALS = (
    (("uses", "architecture", "pattern", "algorithm", "design", "framework"), 3),
    (("error", "fixed", "bug", "workaround", "resolved", "crash", "fail"), 3),
    (("decided", "chose", "prefer", "switched to", "selected", "picked"), 4),
    (("configured", "setup", "installed", "enabled", "env", "config"), 2),
    (("commit", "deploy", "migrate", "refactor", "release", "merge"), 2),
)


def sentence_score(sentence: Column) -> Column:
    """Each kind of signal counts once."""
    low, out = F.lower(sentence), F.lit(0)
    for words, n in SIGNALS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = out + F.when(hit, n).otherwise(0)
    return out


def facts(docs: DataFrame, least: int = 3, most_bytes: int = 10_000, alike: float = 0.6) -> DataFrame:
    """id, position, fact, score: sentences that score enough, aren't blobs, and aren't like one kept before in their text."""
    found = F.transform(text.statements(F.col("content")), lambda x, i: F.struct(i.alias("position"), x.alias("fact"), sentence_score(x).alias("score"), text.tokens(x).alias("tokens")))
    found = F.filter(found, lambda x: (F.octet_length(x["fact"]) <= most_bytes) & (x["score"] >= least))
    none = F.array().cast("array<struct<position:int,fact:string,score:int,tokens:array<string>>>")
    kept = F.aggregate(found, none, lambda have, x: F.when(F.exists(have, lambda y: text.similarity(y["tokens"], x["tokens"]) > alike), have).otherwise(F.concat(have, F.array(x))))
    return docs.select("id", F.explode(kept).alias("f")).select("id", "f.position", "f.fact", "f.score")


# fixed values: predicates and the patterns of their sentences; an object has at most four words
_OBJECT = r"(\S+(?:\s+\S+){0,3})"
PREDICATES = (
    ("prefers", rf"(?i)\b(I|\S+)\s+prefers?\s+{_OBJECT}"),
    ("prefers", rf"(?i)\b(I|\S+)\s+likes?\s+{_OBJECT}"),
    ("uses", rf"(?i)\b(I|\S+)\s+uses?\s+{_OBJECT}"),
    ("has", rf"(?i)\b(I|\S+)\s+(?:has|have)\s+{_OBJECT}"),
    ("is", rf"(?i)\b(\S+)\s+(?:is|are)\s+{_OBJECT}"),
)
# fixed values: verbs of CJK sentences, the longer ones first
PREDICATES_CJK = (("喜欢", "prefers"), ("使用", "uses"), ("用", "uses"), ("是", "is"))
_PRONOUNS = ("i", "我")


def triples(docs: DataFrame, dictionary: segment.Dictionary | None = None) -> DataFrame:
    """id, subject, predicate, object of simple sentences; `I` and its CJK form are the user.

    The subject and object of a CJK verb are the words beside it.  Without a dictionary, words are the runs of letters and
    digits.
    """
    if dictionary is not None:
        docs = segment.spaced(docs.select("id", "content"), ["content"], dictionary)
    each = docs.select("id", F.explode(text.sentences(F.col("content"))).alias("s"))

    def matches(pattern: str, name: str) -> Column:
        a, b = F.regexp_extract_all("s", F.lit(pattern), F.lit(1)), F.regexp_extract_all("s", F.lit(pattern), F.lit(2))
        return F.zip_with(a, b, lambda x, y: F.struct(x.alias("subject"), F.lit(name).alias("predicate"), y.alias("object")))

    found = [matches(pattern, name) for name, pattern in PREDICATES]
    for verb, name in PREDICATES_CJK:
        before = "(?<!使)" if verb == "用" else ""
        both = matches(rf"([\p{{L}}\p{{N}}]+?)\s*{before}{verb}\s*([\p{{L}}\p{{N}}]+)", name)
        found.append(F.when(F.col("s").rlike(f"[{text.CJK}]"), both).otherwise(F.array().cast("array<struct<subject:string,predicate:string,object:string>>")))
    rows = each.select("id", F.explode(F.concat(*found)).alias("t")).select("id", "t.*")
    object_ = F.trim(F.regexp_replace("object", "[.,!?;:。！？，；：]+$", ""))
    return rows.select("id", F.when(F.lower("subject").isin(*_PRONOUNS), "user").otherwise(F.col("subject")).alias("subject"), "predicate", object_.alias("object")).filter("subject <> '' and object <> ''").distinct()


def triple_overlap(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of triples."""
    return F.when(F.size(F.array_union(a, b)) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


_ISO = re.compile(r"\b(\d{4})-(\d{2})-(\d{2})\b")
_MONTHS = {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}
_MONTH = re.compile(rf"\b({'|'.join(_MONTHS)}) (\d{{4}})\b", re.I)
_AGO = re.compile(r"\b(\d{1,3}) (day|week|month|year)s? ago\b", re.I)
_YEAR = re.compile(r"\b(?:in|since|until|before|after) (\d{4})\b", re.I)
ANCHOR = "kind string, start date, end date, raw string"


def anchors(content: str, today: dt.date) -> list[tuple]:
    """(kind, start, end, raw) of the times that a text names; ends are exclusive, open ones are None.  A span of the text
    that one form has used isn't read by a later one."""
    out, used = [], []
    s = unicodedata.normalize("NFKC", content or "")

    def put(m, kind, a, b):
        if not any(x < m.end() and m.start() < y for x, y in used):
            used.append(m.span())
            out.append((m.start(), (kind, a, b, m.group())))

    for m in _ISO.finditer(s):
        try:
            day = dt.date(*map(int, m.groups()))
        except ValueError:
            continue
        put(m, "day", day, day + dt.timedelta(1))
    for m in _MONTH.finditer(s):
        y, k = int(m[2]), _MONTHS[m[1].lower()]
        if 1 <= y < 9999:
            put(m, "month", dt.date(y, k, 1), dt.date(y + k // 12, k % 12 + 1, 1))
    for word, n in (("yesterday", 1), ("today", 0)):
        for m in re.finditer(rf"\b{word}\b", s, re.I):
            put(m, "day", today - dt.timedelta(n), today - dt.timedelta(n - 1))
    for m in re.finditer(r"\blast week\b", s, re.I):
        monday = today - dt.timedelta(today.weekday())
        put(m, "week", monday - dt.timedelta(7), monday)
    for m in _AGO.finditer(s):
        n = int(m[1]) * {"day": 1, "week": 7, "month": 30, "year": 365}[m[2].lower()]
        put(m, "ago", today - dt.timedelta(n), today - dt.timedelta(n - 1))
    for m in _YEAR.finditer(s):
        y, word = int(m[1]), m.group().split()[0].lower()
        if 1 <= y < 9999:
            a, b = dt.date(y, 1, 1), dt.date(y + 1, 1, 1)
            put(m, "year", None if word in ("until", "before") else b if word == "after" else a, None if word in ("since", "after") else a if word == "before" else b)
    return [x for _, x in sorted(out, key=lambda p: p[0])]


def temporal_anchors(docs: DataFrame, today: str) -> DataFrame:
    """id, kind, start, end, raw."""
    day = dt.date.fromisoformat(today)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(i, *a) for i, c in zip(pdf.id, pdf.content, strict=True) for a in anchors(c, day)]
            yield pd.DataFrame(rows, columns=["id", "kind", "start", "end", "raw"])

    return docs.select("id", "content").mapInPandas(run, f"id long, {ANCHOR}")


def conflict(a: Column, b: Column) -> Column:
    """Two half-open intervals (structs of start, end) that can't both hold: they don't meet."""
    return (a["end"].isNotNull() & b["start"].isNotNull() & (a["end"] <= b["start"])) | (b["end"].isNotNull() & a["start"].isNotNull() & (b["end"] <= a["start"]))


def _size(s: str) -> int:
    return len(s.encode())


def _filled(parts: list[str], most: int, between: str) -> list[str]:
    """Neighbouring parts joined as long as they have at most `most` bytes."""
    out: list[str] = []
    for p in parts:
        if out and _size(out[-1]) + len(between) + _size(p) <= most:
            out[-1] += between + p
        else:
            out.append(p)
    return out


def _sliced(s: str, most: int) -> list[str]:
    """Pieces of whole characters with at most `most` bytes, or of one character."""
    out, now, size = [], [], 0
    for c in s:
        n = _size(c)
        if now and size + n > most:
            out.append("".join(now))
            now, size = [], 0
        now.append(c)
        size += n
    return [*out, "".join(now)] if now else out


def _sentences(block: str, most: int) -> list[str]:
    """A block as sentences joined up to the budget; a sentence beyond it is sliced, and stands by itself."""
    out: list[str] = []
    run: list[str] = []
    for s in filter(None, map(str.strip, re.split(r"(?<=[.!?])\s", block))):
        if _size(s) <= most:
            run.append(s)
        else:
            out += [*_filled(run, most, " "), *_sliced(s, most)]
            run = []
    return [*out, *_filled(run, most, " ")] or _sliced(block, most)


def _paragraphs(section: str, most: int) -> list[str]:
    blocks = _filled([p for p in map(str.strip, section.split("\n\n")) if p], most, "\n\n")
    return [x for b in blocks for x in ([b] if _size(b) <= most else _sentences(b, most))]


def _sections(content: str) -> list[str]:
    """Cut in front of headings of the second and third level that follow something."""
    groups: list[list[str]] = [[]]
    for line in content.split("\n"):
        if re.match(r"\s*#{2,3} ", line) and any(groups[-1]):
            groups.append([])
        groups[-1].append(line.removesuffix("\r"))
    if not "".join(groups[-1]).strip():
        groups.pop()
    return ["\n".join(g).strip() for g in groups]


def chunks(content: str, max_tokens: int = 512, overlap_percent: int = 10) -> list[str]:
    """Chunks of at most 4 * max_tokens bytes: sections under headings, else paragraphs joined up to the budget, else
    sentences, else characters.  Each but the first then begins with the end of the one before, from a word's beginning:
    up to overlap_percent of the budget on top of it."""
    if not content:
        return []
    most = 4 * max_tokens
    overlap = most * overlap_percent // 100
    sections = _sections(content)
    if len(sections) <= 1 and _size(content) <= most:
        return [content]
    if len(sections) > 1:
        out = [x for s in sections for x in ([s] if _size(s) <= most else _paragraphs(s, most))]
    elif len(out := _paragraphs(content, most)) <= 1:
        out = _sentences(content, most)
    if not overlap:
        return out
    tails = [""]
    for c in out[:-1]:
        tail = c.encode()[-overlap:].decode("utf-8", "ignore") if _size(c) > overlap else ""
        tails.append(tail[tail.find(" ") + 1 :].strip() + " " if tail else "")
    return [t + c for t, c in zip(tails, out, strict=True)]


def chunked(docs: DataFrame, max_tokens: int = 512, overlap_percent: int = 10) -> DataFrame:
    """id, position, chunk."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [(i, k, c) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, c in enumerate(chunks(t or "", max_tokens, overlap_percent))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string()), strict=True)], ["id", "position", "chunk"])

    return docs.select(F.col("id").cast("long").alias("id"), F.col("content").cast("string").alias("content")).mapInArrow(run, "id long, position int, chunk string")


def contracts(rows: DataFrame) -> DataFrame:
    """Checks of rewritten texts (id, source, output, max_bytes): no new facts, dates kept, length, code blocks whole."""
    fence = lambda c: F.size(F.split(F.col(c), "```")) % 2 == 1
    return rows.select(
        "id",
        (text.trigrams_kept(F.col("output"), F.col("source")) >= 0.9).alias("no_new_facts"),
        (F.size(F.array_except(text.dates(F.col("output")), text.dates(F.col("source")))) == 0).alias("anchors_preserved"),
        (F.octet_length("output") <= F.col("max_bytes")).alias("length_ok"),
        fence("output").alias("code_blocks_ok"),
    )
