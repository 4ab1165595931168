"""Collocations, multi-index hashing and group-bound clustering against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import collocations, hash_search, queries, yinyang

DOCS = "doc_id long, lang string, text string, phrase int, n string, rank string"


def phrase_rows():
    rng = random.Random(5)
    rows = [(1, "en", None), (2, None, ""), (3, "en", " . \t "), (4, None, "und und und"), (5, "und", "und und! und"), (6, "fr", "É é É é x x"), (7, "en", "word" * 5000)]
    for i in range(120):
        words = [f"W{rng.randrange(9)}" if rng.random() < 0.6 else f"v{rng.randrange(200)}" for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ","]) for w in words)
        rows.append((10 + i, rng.choice(["en", "en", "de", None]), text))
    rows += [rows[20]] * 3 + [(500, "en", "new york city " * 40), (501, "en", " ".join(f"w{rng.randrange(12)}" for _ in range(4000)))]
    return rows


def brute_phrases(rows, s):
    f, n = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, s.longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {p: a for p, a in f.items() if a >= s.least and len(p[1]) > 1}
    around = Counter()
    for (lang, p), a in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                around[lang, p[i : i + k]] = max(around[lang, p[i : i + k]], a)
    out = []
    for (lang, p), a in often.items():
        if (lang, p) in around and 100 * around[lang, p] >= s.cover * a:
            continue
        score, cut = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]], n[lang], cut))
    found, at = [], Counter()
    for lang, score, a, p, l, r, m, cut in sorted(out):
        at[lang] += 1
        if at[lang] <= s.top:
            found.append((lang, at[lang], p.decode(), -a, l, r, m, -score, cut))
    return found


@pytest.mark.parametrize("s", [collocations.Settings(), collocations.Settings(least=2, longest=4, bits=16), collocations.Settings(least=3, longest=2, top=15), collocations.Settings(least=1, cover=90, bits=16)])
def test_collocations(spark, s):
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS).repartition(3)
    got = [tuple(r) for r in collocations.collocations(docs, s, portion=3000).collect()]
    assert sorted(got) == sorted(brute_phrases(rows, s))
    assert collocations.collocations(spark.createDataFrame([], DOCS), s).count() == 0


def test_large_counts_are_exact(spark):
    big = 3_000_000_019
    level = lambda *rows: spark.createDataFrame(rows, "lang string, phrase string, n long")
    out = collocations.scored([level(("en", "a", big * 3), ("en", "b", big * 2)), level(("en", "a b", big))], collocations.Settings(longest=2)).collect()
    assert [(r["a"], r["l"], r["r"], r["score"]) for r in out] == [(big, big * 3, big * 2, 10**6 * big * big // (big * 3 * big * 2))]


VECTORS = "id long, embedding array<double>, h1 string, x int, score string"


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, "a", 1, "b") for i, v in rows], VECTORS).repartition(parts)


def brute_near(rows, queries_, k):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    rows = {(i, tuple(v)) for i, v in rows if i is not None and ok(v)}
    out = {}
    for q, v in queries_:
        if q is not None and ok(v):
            a = np.array(v)
            out[q] = sorted((-float((a * np.array(w)).sum()), i) for i, w in rows if i != q and len(w) == len(v))[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (40, 8), dtype=np.uint8)
    codes = base[rng.integers(0, 40, 700)] ^ np.packbits(rng.random((700, 64)) < 0.1, axis=1)
    tables = hash_search.Tables(codes)
    for code in codes[:12]:
        far = np.unpackbits(codes ^ code, axis=1).sum(1)
        for r in (0, 1, 7, 8, 9, 15, 16, 20, 31, 40, 63, 64):
            assert tables.within(code, r).tolist() == np.flatnonzero(far <= r).tolist()


def test_search_is_near_brute_force(spark):
    """Clusters, lengths that differ widely, a vector with a third of all rows, and near copies."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 24))
    x = centers[rng.integers(0, 12, 2400)] + 0.6 * rng.normal(size=(2400, 24))
    x *= np.exp(rng.normal(size=(2400, 1)))
    x[800:1600] = x[7]
    x[1600:1700] = x[8] + 1e-4 * rng.normal(size=(100, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    asked = [r for r in rows if r[0] % 20 == 0]
    s = hash_search.Settings(k=10, sample=1000, block=40)
    want = brute_near(rows, asked, s.k)
    results = []
    for parts, stripe in ((4, 1 << 22), (7, 300)):
        index = hash_search.build(table(spark, rows, parts), hash_search.Settings(k=10, sample=1000, block=40, stripe=stripe))
        results.append(found(hash_search.search(index, table(spark, asked).withColumnRenamed("id", "query_id"))))
    assert results[0] == results[1]  # however rows are dealt
    got = results[0]
    assert got.keys() == want.keys() and all(len(v) == s.k for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * sum(map(len, want.values()))
    copies = [q for q in got if 800 <= q < 1600]
    assert all(got[q] == want[q] for q in copies)


def test_search_of_odd_rows(spark):
    """Nulls, zeros, non-finite numbers, several lengths, ties, repeated rows, few rows: all exact, since few are there."""
    rows = [(i, [float((i * 7) % 5), 1.0, -2.0]) for i in range(30)] + [(40 + i, [1.0, float(i)]) for i in range(6)]
    rows += [(60, None), (61, [0.0, 0.0, 0.0]), (62, [math.nan, 1.0, 1.0]), (63, [math.inf, 1.0, 1.0]), (64, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (65, []), (66, [-0.0, 1.0, 0.0]), (67, [0.0, 1.0, -0.0])]
    rows += [rows[3]] * 5 + [(70, [2.5])]
    asked = [r for r in rows if r[0] is None or r[0] % 4 == 0] + [(500, [1.0, 1.0, 1.0]), (501, [1.0] * 9)]
    for k in (1, 20, 100):
        index = hash_search.build(table(spark, rows), hash_search.Settings(k=k, margin=0.0))
        got = found(hash_search.search(index, table(spark, asked).withColumnRenamed("id", "query_id")))
        want = brute_near(rows, asked, k)
        if k > 1:
            assert got == {q: v for q, v in want.items() if v}
        assert got.keys() == {q for q, v in want.items() if v}
    nothing = table(spark, [])
    assert hash_search.search(hash_search.build(nothing), nothing.withColumnRenamed("id", "query_id")).count() == 0
    assert hash_search.search(hash_search.build(nothing), table(spark, rows).withColumnRenamed("id", "query_id")).count() == 0
    assert hash_search.search(hash_search.build(table(spark, rows)), nothing.withColumnRenamed("id", "query_id")).count() == 0


def test_search_query_recall(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got, want = found(queries.op12_hash_search(spark, d)), brute_near(rows, [r for r in rows if r[0] % 20 == 0], 20)
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert got.keys() == want.keys() and hit >= 0.9 * sum(map(len, want.values()))


def brute_clusters(rows, s):
    kept = [(i, [math.floor(s.scale * x) for x in v]) for i, v in rows if v is not None and len(v) == s.size and all(x is not None and math.isfinite(x) and abs(x * s.scale) < 2**62 for x in v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"{s.seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    at = [r[1] for r in sorted(kept, key=name)[: s.k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for i in range(s.rounds + 1):
        of = [min((far(v, c), j) for j, c in enumerate(at)) for _, v in kept]
        if i < s.rounds:
            for j in range(len(at)):
                mine = [v for (_, v), (_, c) in zip(kept, of, strict=True) if c == j]
                if mine:
                    at[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    by = Counter()
    for d, j in of:
        by[j] += d
    fits = lambda d: d if d < 2**63 else None
    return sorted(((i, j, fits(d), by[j], sum(by.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, of, strict=True)), key=str)


@pytest.mark.parametrize(("seed", "s"), [(1, yinyang.Settings(size=6)), (2, yinyang.Settings(k=5, rounds=6, size=6, groups=2)), (3, yinyang.Settings(k=40, rounds=4, size=6, scale=1)), (4, yinyang.Settings(k=1, size=6)), (5, yinyang.Settings(rounds=0, size=6)), (6, yinyang.Settings(k=9, size=6, rounds=5, groups=9))])
def test_clusters(spark, seed, s):
    """Clusters, many ties (small integers), a vector with a third of all rows, odd rows."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(300, 6)) + 4 * rng.integers(0, 3, (300, 1)), rng.integers(-2, 3, (200, 6)).astype(float)])
    x[100:250] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [None] + [1.0] * 5), (903, [math.nan] * 6), (904, [math.inf] * 6), (905, [1e300] * 6), (None, [0.5] * 6)]
    rows += [rows[11]] * 3
    got = yinyang.clustered(table(spark, rows, 5).withColumnRenamed("id", "vec_id"), s)
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows, s)


def test_clusters_of_large_and_few_vectors(spark):
    s = yinyang.Settings(k=4, size=2, rounds=2)
    for scale in (1e5, 1e6):
        rows = [(i, [float(i % 7) * scale, float((i * i) % 11) * scale]) for i in range(60)]
        assert sorted(map(tuple, yinyang.clustered(table(spark, rows).withColumnRenamed("id", "vec_id"), s).collect()), key=str) == brute_clusters(rows, s)
    few = [(1, [0.5, 1.0]), (2, [0.25, 0.0])]
    assert sorted(map(tuple, yinyang.clustered(table(spark, few).withColumnRenamed("id", "vec_id"), s).collect()), key=str) == brute_clusters(few, s)
    assert yinyang.clustered(table(spark, []).withColumnRenamed("id", "vec_id"), s).count() == 0


def test_bounds_spare_distances():
    """After the first round most vectors pass a filter, and what bounds say holds."""
    rng = np.random.default_rng(8)
    at = rng.integers(-400, 400, (40, 8))
    x = at[rng.integers(0, 40, 3000)] + rng.integers(-30, 30, (3000, 8))
    c = yinyang.Centroids(at, yinyang.grouped(at, 10), np.zeros(40))
    cluster, upper, lower, done = yinyang.assigned(x, c, None, None, None)
    assert done >= x.shape[0] * 40
    for step in range(4):
        to = c.at + rng.integers(-3, 4, c.at.shape)
        moved = np.sqrt(((to - c.at) ** 2).sum(1)) * (1 + yinyang.SLACK)
        c = yinyang.Centroids(to, c.group, moved)
        cluster, upper, lower, done = yinyang.assigned(x, c, cluster, upper, lower)
        d = ((x[:, None] - to) ** 2).sum(2).astype(float)
        assert (cluster == d.argmin(1)).all() and done < 0.3 * d.size
        assert (upper >= np.sqrt(d.min(1))).all()
        d[np.arange(len(x)), cluster] = np.inf
        assert all((lower[:, g] <= np.sqrt(d[:, c.group == g].min(1))).all() for g in range(c.n_groups))
