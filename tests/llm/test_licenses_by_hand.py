"""License scans against a plain version that looks at every line and every group of lines by itself."""

import math
import random

from siltstone.llm import licenses as L


def plain_scan(text, model):
    """(paragraph, family, probability, similarity) of one text."""
    lines = [L.words_of(x) for x in (text or "").split("\n")]
    most = 2 * max(len(L.words_of(t)) for texts in L.TEMPLATES.values() for t in texts)
    telling = {w for g in model.weights for w in g.split() if w not in L.COMMON and not w.isdigit()}
    cut = [(i, 1, w) for i, w in enumerate(lines) if telling & set(w)]
    for i in range(len(lines)):
        inner = []
        for j in range(i + 1, min(len(lines), i + most)):
            if not lines[i] or not lines[j]:
                break
            if j > i + 1:
                inner += lines[j - 1]
            if len(inner) > most - 2:
                break
            w = lines[i][-(most - 1) :] + inner + lines[j][: most - 1]
            if any(telling & set(x) for x in lines[i : j + 1]):
                cut.append((i, j - i + 1, w))
    found = []
    for i, n, w in cut:
        held = set(w) | {" ".join(w[k : k + 2]) for k in range(len(w) - 1)}
        like = {f: max(len(held & set(L._both(t))) / len(L._both(t)) for t in texts) for f, texts in L.TEMPLATES.items()}
        if n > 1 and max(like.values()) < L.CONFIRM:
            continue
        grams = {" ".join(w[k : k + o]) for o in L.ORDERS for k in range(len(w) - o + 1)}
        known = [model.weights[g] for g in grams if g in model.weights]
        if not known:
            continue
        s = [b + sum(x[k] for x in known) for k, b in enumerate(model.bias)]
        top = max(s)
        e = [math.exp(x - top) for x in s]
        p = [x / sum(e) for x in e]
        best = p.index(max(p))
        if best == len(p) - 1 or p[best] < model.threshold or like[model.classes[best]] < L.CONFIRM:
            continue
        found.append((n > 1, -like[model.classes[best]], n, i, model.classes[best], p[best]))
    kept = []
    for x in sorted(found):
        if not any(x[3] < y[3] + y[2] and y[3] < x[3] + x[2] for y in kept):
            kept.append(x)
    return sorted((i, f, round(p, 4), round(-u, 4)) for _, u, _, i, f, p in kept)


def texts():
    rng = random.Random(21)
    filler = ["house", "river", "the", "of", "is", "blue", "software", "free", "copy", "without", "table", "2019"]
    notices = [t for some in L.TEMPLATES.values() for t in some]
    out = [None, "", "\n\n", "no licence here at all"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = L.words_of(rng.choice(notices))
            if rng.random() < 0.5:
                for _ in range(rng.randint(0, max(1, len(w) // 6))):
                    w[rng.randrange(len(w))] = rng.choice(filler)
            if rng.random() < 0.3:
                w = w[: rng.randint(1, len(w))]
            step = rng.choice([3, 6, 100])
            parts.append("\n".join(rng.choice(["", "# ", "  "]) + " ".join(w[k : k + step]) for k in range(0, len(w), step)))
            if rng.random() < 0.6:
                parts.append(rng.choice(["", " ".join(rng.choice(filler) for _ in range(rng.randint(1, 12)))]))
        out.append("\n".join(parts))
    out.append("\n".join(["filler words of the text"] * 300 + [notices[0]] + ["more words"] * 300))
    return out


def test_scan_against_a_plain_one(spark):
    model = L.train()
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())]
    want = sorted((i, *r) for i, t, *_ in rows for r in plain_scan(t, model))
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, line int").repartition(3)
    got = sorted((r["doc_id"], r["paragraph"], r["family"], round(r["probability"], 4), round(r["similarity"], 4)) for r in L.scan(df).collect())
    assert got == want and len(got) > 40


def test_scan_of_repeated_rows(spark):
    """Rows that repeat, share a doc_id or have none are scanned by themselves."""
    model = L.train()
    some = [t for t in texts() if t][5:9]
    rows = [(1, some[0]), (1, some[0]), (1, some[1]), (2, some[2]), (None, some[3]), (None, some[0]), (3, None)]
    want = sorted(((i, *r) for i, t in rows for r in plain_scan(t, model)), key=str)
    got = sorted(((r["doc_id"], r["paragraph"], r["family"], round(r["probability"], 4), round(r["similarity"], 4)) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == want
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
