"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import io
import math
import random
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltstone.llm import decontamination, jaccard_join, licenses, packing, quality, suffix_dedup, suffix_tree_lm, token_counts, tokens, warc

SCHEMA = "doc_id long, text string, n_words string, content int, bucket int, class string"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def texts():
    rng = random.Random(11)
    out = [None, "", " \n ", "a", "the the the", words(rng, 3000), "x" * 99, "ab" * 300, "é" * 260, "z" * 4000]
    out += [words(rng, rng.randint(5, 200)) for _ in range(30)]
    base = words(rng, 150)
    for _ in range(25):
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    passage = words(rng, 60)
    out += [f"{words(rng, 50)}\n{passage}\n{words(rng, 50)}" for _ in range(6)]
    out += [out[12]] * 3 + ["A  b\tc <|endoftext|> İ H̱ don't  x \n y ", "<|startoftext|>ab İ", " nbsp　ideographic x\x85y "]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(7 * i, t) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "c") for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts_and_cache(spark, docs, rows, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows}
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs, path, cache).collect()} == want
    held = spark.read.parquet(cache)
    assert held.count() == held.dropDuplicates(["content", "tokenizer"]).count() <= len({x for _, x in rows})
    assert token_counts.token_counts(empty, path).count() == 0


def test_encoder_is_the_library(rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, f = Tokenizer.from_file(path), tokens.encoder(path)
    for _, x in rows:
        x = x or ""
        got = f([x.encode()])[0]
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize(("per_part", "few"), [(250_000, 5000), (20, 0), (7, 10)])
def test_best_fit(spark, docs, rows, empty, per_part, few):
    path, capacity = public_tokenizers.path("byte_bpe_50k.json"), 256
    t = Tokenizer.from_file(path)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in rows}
    got = packing.best_fit(packing.tokenize_pieces(docs, path, capacity, end=2), capacity, per_part, few).collect()
    filled = {}
    for i, want in ids.items():
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert [x for r in mine for x in struct.unpack(f"<{r['length']}I", r["ids"])] == want
        assert all(r["length"] == capacity for r in mine[1:]) and mine[0]["start"] == 0
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        end = 0
        for a, n in sorted(parts):
            assert a == end
            end += n
        assert end <= capacity
    least = max(-(-sum(map(len, ids.values())) // capacity), 1)
    assert len(filled) <= least + 2
    assert packing.best_fit(packing.tokenize_pieces(empty, path, capacity, end=2), capacity).count() == 0


def sweep_of_all(rows):
    """(gap, piece) matches of one sweep over all rows (kind, id, size)."""
    waiting, out = [], []
    for kind, i, _ in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if kind == packing.PIECE:
            waiting.append(i)
        elif waiting:
            out.append((i, waiting.pop()))
    return out


def test_sweeps_of_ranges_and_what_they_carry():
    """Ranges swept by themselves, and their rests matched by rank, give the sweep of the whole."""
    import pyarrow as pa

    rng = random.Random(2)
    for _ in range(40):
        rows = [(rng.randint(0, 1), i, rng.randint(1, 20)) for i in range(rng.randint(0, 60))]
        ordered = sorted(rows, key=lambda r: (r[2], r[0], r[1]))
        cuts = sorted(rng.randint(0, len(rows)) for _ in range(4))
        parts = [ordered[a:z] for a, z in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        found, left = [], {}
        for p, part in enumerate(parts):
            if part:
                b = pa.record_batch([pa.array([p] * len(part), pa.int64()), pa.array([r[2] for r in part], pa.int32()), pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int64())], ["part", "size", "kind", "id"])
                for out in packing._sweep(iter([b.slice(0, 3), b.slice(3)])):
                    found += out.to_pylist()
        for r in found:
            if r["kind"] != packing.PLACED:
                left[r["part"], r["kind"]] = left.get((r["part"], r["kind"]), 0) + 1
        got = [(r["sequence"], r["id"]) for r in found if r["kind"] == packing.PLACED]
        at = {(r["kind"], r["part"], r["nth"]): r["sequence"] if r["kind"] == packing.GAP else r["id"] for r in found if r["kind"] != packing.PLACED}
        for p, first, last, q, top in packing.carried(left, len(parts)):
            got += [(at[packing.GAP, p, k], at[packing.PIECE, q, top - k + first]) for k in range(first, last + 1)]
        assert sorted(got) == sorted(sweep_of_all(rows))


def test_best_fit_of_sizes(spark):
    """Hot sizes, pieces that fill a sequence, one size alone; extra columns stay, clashing ones are refused."""
    rng = random.Random(2)
    for sizes in ([rng.randint(1, 64) for _ in range(900)], [1] * 500 + [40] * 9, [64] * 7, [33] * 20):
        df = spark.createDataFrame([(i, 0, n, "x", 5) for i, n in enumerate(sizes)], "doc_id long, piece int, length long, item string, size int").repartition(3)
        out = packing.best_fit(df, 64, 100, 3)
        assert out.columns == [*df.columns, "sequence_id", "offset"]
        used = {}
        for r in sorted(out.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
            assert used.get(r["sequence_id"], 0) == r["offset"]
            used[r["sequence_id"]] = r["offset"] + r["length"]
        assert sum(used.values()) == sum(sizes) and max(used.values()) <= 64
        least = max(-(-sum(sizes) // 64), sum(n > 32 for n in sizes))
        assert len(used) <= 1.02 * least + 4
    with pytest.raises(ValueError, match="offset"):
        packing.best_fit(df.withColumnRenamed("item", "offset"), 64)
    with pytest.raises(ValueError, match="65 tokens"):
        packing.best_fit(spark.createDataFrame([(1, 0, 65)], "doc_id long, piece int, length long"), 64)


def test_matrices(spark, docs, rows, empty, tmp_path, monkeypatch):
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/shards"
    t = Tokenizer.from_file(path)
    pieces = packing.pack_shards(docs, path, 128, end=9, folder=folder, fill=0).cache()
    read = {(r["shard"], r["sequence"]): r for r in packing.read_shards(pieces, folder).collect()}
    back = {}
    for r in pieces.collect():
        s = read[r["shard"], r["sequence"]]
        ids = struct.unpack(f"<{s['n_tokens']}I", s["ids"])
        at = struct.unpack(f"<{s['n_tokens']}I", s["position_ids"])
        assert at[r["offset"] : r["offset"] + r["length"]] == tuple(range(r["length"]))
        back[r["doc_id"], r["start"]] = ids[r["offset"] : r["offset"] + r["length"]]
    for i, x in rows:
        want = [*t.encode(x or "", add_special_tokens=False).ids, 9]
        assert [k for (d, _), v in sorted(back.items()) if d == i for k in v] == want
    assert packing.pack_shards(empty, path, 128, end=9, folder=folder).count() == 0


def test_segment_tree_finds_the_best_fit():
    rng = random.Random(3)
    tree, free = packing.Capacities(50), []
    for k in range(600):
        n = rng.randint(1, 50)
        if rng.random() < 0.5:
            tree.add(n, k)
            free.append(n)
        else:
            fits = [x for x in free if x >= n]
            got = tree.best(n)
            assert (got and got[0]) == (min(fits) if fits else None)
            if got:
                free.remove(got[0])


def test_quality_rules(docs, rows, empty):
    rows = dict(rows)
    for r in quality.quality_rules(docs).collect():
        text = rows[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        c, covered = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if c[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality_rules(empty).count() == 0
    assert quality.good(docs).columns == docs.columns


def test_quality_pairs_path_agrees(docs, monkeypatch):
    want = {r["doc_id"]: r["n_repeat_words"] for r in quality.quality_rules(docs).collect()}
    monkeypatch.setattr(quality, "PACKED", 1)
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.quality_rules(docs).collect()} == want


def brute_components(rows):
    sets = {}
    for i, x in rows:
        w = (x or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


SETTINGS = [
    jaccard_join.Settings(),
    jaccard_join.Settings(block=2000, range=3000, local=2, frequent=1, per_bin=12, tile=2),
    jaccard_join.Settings(block=500, range=500, local=4, frequent=2, per_bin=4, tile=3, leader_rounds=1),
    jaccard_join.Settings(block=5000, frequent=1, per_bin=10**6, tile=5),
]


def near_texts(seed):
    """Chains of edits, groups of near copies about the threshold, copies in other letters, short texts, shared passages."""
    rng = random.Random(seed)
    out = [None, "", "a", "A", "a b", "a  b\n", "a b c d", "A B c d e", "a b c d e", "a b c d e f", "x" * 50] + ["same text of six words here"] * 5
    for size in (6, 9, 14, 25, 60, 150, 400):
        base = words(rng, size, 10**6).split()
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(w))
        w = list(base)
        for _ in range(8):  # each the neighbour of the one before
            w[rng.randrange(len(w))] = f"c{rng.randrange(10**6)}"
            out.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
        out += [" ".join(base[: len(base) - k]) for k in range(min(6, size))]
    passage = words(rng, 80)
    out += [f"{words(rng, rng.randint(1, 30), 10**6)} {passage} {words(rng, rng.randint(1, 30), 10**6)}" for _ in range(40)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("how", SETTINGS[:2])
def test_jaccard_join(docs, rows, how):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(docs, how).collect()} == brute_components(rows)


@pytest.mark.parametrize("how", SETTINGS)
def test_jaccard_join_near_the_threshold(spark, how):
    rows = list(enumerate(near_texts(1) + near_texts(2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(docs, how).collect()} == brute_components(rows)


def test_jaccard_join_of_repeated_rows(spark):
    """Rows of one doc_id count by their own texts; a null doc_id gets the component of what it is linked with."""
    a, b = "one two three four five six seven", "other words in this text of nine or so"
    docs = spark.createDataFrame([(3, a), (3, a), (3, b), (1, b), (None, a), (None, "alone in the world"), (5, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.components(docs).collect()), key=str)
    assert got == sorted([(3, 3, 3), (3, 3, 3), (3, 5, 1), (1, 5, 1), (None, 3, 3), (None, 1, None), (5, 0, 5)], key=str)


def test_jaccard_join_of_nothing(empty):
    assert jaccard_join.components(empty).count() == 0


def brute_repeats(rows, n=100):
    seen, out = set(), {}
    for i, x in sorted(rows):
        raw = (x or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - n + 1):
            if raw[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(raw[p : p + n])
        spans = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()
    return out


def test_suffix_dedup(spark, docs, rows, empty):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.dedup(docs).collect()}
    assert got == brute_repeats(rows)
    assert suffix_dedup.dedup(empty).count() == 0
    assert suffix_dedup.without_repeats(docs).columns == docs.columns


class BruteTree:
    """The suffix tree by dictionaries: contexts as tuples of words, the oldest first."""

    def __init__(self, training, settings):
        self.count = Counter(w for t in training for w in t)
        self.total, self.settings = sum(self.count.values()), settings
        self.weight = self.total + 0.5 * (len(self.count) + 1)
        self.nodes = {}
        often = {w for w, n in self.count.items() if n >= settings.least}
        known = {(w,): self.count[w] for w in often if w != b"\n"}
        for k in range(1, settings.depth + 1):
            after = {}
            for t in training:
                for i in range(k, len(t)):
                    c = tuple(t[i - k : i])
                    if c in known and t[i] in often:
                        after.setdefault(c, Counter())[t[i]] += 1
            pairs = {c: {w: n for w, n in x.items() if n >= settings.least} for c, x in after.items()}
            for c, next_ in pairs.items():
                if next_ and (k == 1 or c[1:] in self.nodes):
                    self.grow(c, known[c], next_)
            known = {(*c, w): n for c, x in pairs.items() for w, n in x.items() if w != b"\n"}

    def grow(self, c, n, next_):
        q = {w: self.p(c[1:], w) for w in next_}
        p = {w: x / n for w, x in next_.items()}
        left, left_q = max(1 - sum(p.values()), 0), max(1 - sum(q.values()), 1e-12)
        divergence = sum(p[w] * math.log(p[w] / q[w]) for w in p) + (left * math.log(left / left_q) if left > 1e-15 else 0)
        if 2 * n * divergence > len(p) + self.settings.deviations * math.sqrt(2 * len(p)):
            smooth = {w: (x + self.settings.strength * q[w]) / (n + self.settings.strength) for w, x in next_.items()}
            self.nodes[c] = (smooth, max(1 - sum(smooth.values()), 1e-12) / left_q)

    def p(self, c, w):
        """Of a word behind a context, in the longest suffix that is a node."""
        if not c:
            return (self.count[w] + 0.5) / self.weight
        if c not in self.nodes:
            return self.p(c[1:], w)
        smooth, factor = self.nodes[c]
        return smooth[w] if w in smooth else factor * self.p(c[1:], w)

    def score(self, t):
        depth = self.settings.depth
        return sum(math.log10(self.p(tuple(t[max(0, i - depth) : i]), w)) for i, w in enumerate(t))


@pytest.mark.parametrize(("portion", "depth", "least"), [(1_000_000, 3, 4), (50, 2, 2), (300, 4, 8)])
def test_suffix_tree(spark, rows, empty, portion, depth, least):
    rng = random.Random(6)
    phrase = [words(rng, 6, 30) for _ in range(8)]
    rows = rows + [(1000 + i, " ".join(rng.choice(phrase) if rng.random() < 0.7 else words(rng, 3, 30) for _ in range(20))) for i in range(60)]
    rows += [rows[20], rows[20], (rows[21][0], "another text of the same id"), (None, "a text without an id")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    all_ = [(i, [*(x or "").encode().lower().split(), b"\n"]) for i, x in rows]
    settings = suffix_tree_lm.Settings(depth=depth, least=least, common=2e-3, deviations=0.0)
    tree = BruteTree([w for i, w in all_ if not held(i)], settings)
    assert {len(c) for c in tree.nodes} == set(range(1, depth + 1))
    count, total, distinct = tree.count, tree.total, len(tree.count)
    want = sorted(((i, held(i), len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), 6), round(tree.score(w), 6)) for i, w in all_), key=str)
    got = sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in map(tuple, suffix_tree_lm.scores(docs, settings, portion).collect())), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(sorted(got, key=lambda r: (str(r[:5]), r[5])), sorted(want, key=lambda r: (str(r[:5]), r[5])), strict=True):
        assert g[5:] == pytest.approx(w[5:], abs=1e-5), g
    out = [r for r in got if r[1]]
    assert sum(r[6] for r in out) > sum(r[5] for r in out)
    assert suffix_tree_lm.scores(empty).count() == 0


def test_pairs_are_bounded(spark, docs):
    """With few pairs allowed, the least count rises, and the model stays one."""
    settings = suffix_tree_lm.Settings(depth=2, least=2, most=40, deviations=0.0)
    got = suffix_tree_lm.scores(docs, settings).collect()
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)


@pytest.mark.parametrize(("depth", "least", "most"), [(3, 3, 8), (2, 2, 200)])
def test_tree_in_tables_is_the_tree(spark, rows, depth, least, most):
    """With more pairs or words than workers hold, every score is that of the tree that they hold otherwise."""
    rng = random.Random(8)
    phrase = [words(rng, 6, 30) for _ in range(8)]
    rows = rows + [(1000 + i, " ".join(rng.choice(phrase) if rng.random() < 0.7 else words(rng, 3, 30) for _ in range(20))) for i in range(60)]
    rows += [rows[20], (rows[21][0], "another text of the same id"), (None, "a text without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scored = lambda most: sorted(((*r[:5], round(r[5], 6), r[6]) for r in map(tuple, suffix_tree_lm.scores(docs, suffix_tree_lm.Settings(depth=depth, least=least, most=most, common=2e-3, deviations=0.0), 300).collect())), key=str)
    want, got = scored(1 << 20), scored(most)
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert sum(r[6] for r in want) > sum(r[5] for r in want) + 100
    assert [r[6] for r in got] == pytest.approx([r[6] for r in want], abs=1e-6)


def test_decontamination(spark, rows, empty):
    rng = random.Random(5)
    items = [(i, words(rng, 40, 5000)) for i in range(6)] + [(9, ""), (10, None), (11, "one two")]
    edited = items[1][1].split()
    for k in (3, 15, 30):
        edited[k] = "changed"
    del edited[20]
    planted = [(10_001, f"{words(rng, 300)} {items[0][1]} {words(rng, 300)}"), (10_002, f"{words(rng, 80)} {' '.join(edited)} {words(rng, 80)}"), (10_003, items[2][1].upper()), (10_004, "zero one two three")]
    planted += [(20_000 + k, f"{words(rng, 30)} {items[3][1]}") for k in range(60)]
    docs = spark.createDataFrame(rows + planted, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(10_001, 0), (10_002, 1), (10_003, 2)} | {(20_000 + k, 3) for k in range(60)}
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_alignment():
    import numpy as np

    a = np.arange(10, dtype=np.uint64)
    assert decontamination.align(a, a) == (10.0, 10, 0, 10)
    b = np.concatenate([np.full(5, 99, np.uint64), a[:4], a[5:], np.full(3, 77, np.uint64)])
    score, matched, lo, hi = decontamination.align(a, b)
    assert (score, matched, lo, hi) == (8.5, 9, 5, 14)


def test_warc(spark, empty, tmp_path):
    rng = random.Random(4)
    page = [(i, f"http://x/{i}", rng.choice([None, "", "short", "é" * 60, words(rng, 40), words(rng, 4000)])) for i in range(60)]
    page += [(100 + i, "http://y z\n/", page[5][2]) for i in range(5)] + [(200, None, "q" * 99), (201, None, "q" * 99), (202, None, "q" * 100), (203, None, "q" * 100)]
    pages = spark.createDataFrame(page, "page_id long, url string, html string").repartition(3)
    least = {}
    for i, _, h in page:
        least[h or ""] = min(i, least.get(h or "", i))
    want = {}
    for i, _, h in page:
        raw = (h or "").encode()
        again = len(raw) >= 100 and least[h] != i
        want[i] = len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", least[h] if again else None
    assert {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(pages, f"file://{tmp_path}/a").collect()} == want
    assert warc.round_trip(pages.limit(0), f"file://{tmp_path}/b").count() == 0


def test_damaged_archives_are_refused(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "p" * 300), (2, "u", "r" * 300)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(pages, f"file://{tmp_path}/a").first()["archive"].removeprefix("file://")
    raw = open(path, "rb").read()

    def read(data):
        return [warc.parse(r, "x") for _, r in warc.frames(io.BytesIO(data).read, "x")]

    assert len(read(raw)) == 2
    for bad in (raw[:-3], raw[8:], raw[:20], raw[:-20] + b"\0" * 20, b"\x28\xb5\x2f\xfd" + raw[4:]):
        with pytest.raises(warc.BadArchive):
            read(bad)
    good = warc.render(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), 3, None)
    for a, b in ((b"Content-Length: 3", b"Content-Length: 4"), (b"abc\r\n\r\n", b"abd\r\n\r\n"), (b"WARC/1.1", b"WARC/9"), (b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.BadArchive):
            warc.parse(good.replace(a, b), "x")


def test_licenses(spark, empty):
    model = licenses.train()
    held = licenses.variations(random.Random(123), 6)
    assert sum(model.predict(t) == c for t, c in held) / len(held) > 0.95
    assert sum(model.predict(t) != "unknown" for t, c in held if c == "unknown") <= 0.02 * len(held)
    text = "some words\nReleased under the MIT License.\n\nmore\nLicensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.\nthe license of the house"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "All rights reserved."), (5, "All rights reserved.\nAll rights reserved."), (6, words(random.Random(1), 5000))], "doc_id long, text string")
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scan(docs).collect()}
    assert got == {(1, 1, "MIT"), (1, 4, "Apache-2.0"), (1, 5, "CC-BY-NC"), (4, 0, "all-rights-reserved"), (5, 0, "all-rights-reserved"), (5, 1, "all-rights-reserved")}
    assert licenses.scan(empty).count() == 0
