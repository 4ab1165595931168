"""Stems by the public rules, hits by frequent stems, and evaluation gates."""

import random
from collections import Counter

from pyspark.sql import functions as F

from siltstone.functions import stem
from siltstone.operators import gates

PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consolation consol
consolatory consolatori consolidate consolid consolidating consolid consols consol constancy constanc constant constant knack knack knackeries knackeri knacks knack knave knave knavery knaveri knavish knavish
kneaded knead kneading knead kneel kneel kneeled kneel knees knee knightly knight knitting knit knives knive knotted knot generate generat generously generous general general communion communion
skis ski dying die news news happy happi hopping hop hoping hope running run caresses caress ponies poni ties tie cries cri agreed agre relational relat conditional condit operator oper feed feed
national nation digitizer digit formally formal bled bled proceed proceed exceeding exceed extract extract extracting extract extraction extract by by say say enjoy enjoy gas gas this this kiwis kiwi
luxuriated luxuri disabled disabl fitted fit falling fall controll control""".split()


def test_stems():
    for word, want in zip(PAIRS[::2], PAIRS[1::2], strict=True):
        assert stem.stem(word) == want, word
    assert [stem.stem(w) for w in ("用户", "v0", "é", "", "a1b")] == ["用户", "v0", "é", "", "a1b"]


def test_hits(spark):
    rng = random.Random(3)
    bag = ["extract", "extracting", "extraction", "node", "nodes", "links", "linked", "the", "of", "is", "rust", "用户", "ab", "run", "running"]
    text = lambda: rng.choice([None, "", " ".join(rng.choice(bag) for _ in range(rng.randrange(40)))])
    rows = [(i, text(), text()) for i in range(200)] + [(900, "Neural wiki renders concepts with concepts wiki links and concepts links.", "Neural wiki renders concepts with links between concepts."), (901, "Rust borrow checker ownership", "Python garbage collector")]

    def tokens(t):
        return [stem.stem(w) for w in (t or "").lower().replace(".", " ").split() if len(w.encode()) > 2 and w not in stem.STOP_WORDS]

    def want(e, c):
        top = [w for w, _ in sorted(Counter(tokens(e)).items(), key=lambda x: (-x[1], x[0]))[:5]]
        return len(set(top) & set(tokens(c))) >= 3

    got = {r["id"]: r["hit"] for r in stem.hits(spark.createDataFrame(rows, "id long, evidence string, canonical string").repartition(3)).collect()}
    assert got == {i: want(e, c) for i, e, c in rows} and got[900] and not got[901] and 10 < sum(got.values()) < 190


def test_gates(spark):
    cases = spark.createDataFrame([("a", [1]), ("b", [2, 3]), ("c", [9])], "case_id string, expected array<long>")
    found = spark.createDataFrame([("a", 1, 3), ("a", 4, 1), ("b", 3, 4), ("c", 8, 1)], "case_id string, id long, rank int")
    pairs = spark.createDataFrame([("d", "a b c d", "a b c", True), ("e", "a b c", "x y z", False), ("f", "a b c d", "a x y z", True)], "case_id string, text_a string, text_b string, is_duplicate boolean")
    wanted = spark.createDataFrame([("g", "admit_new"), ("h", "duplicate")], "case_id string, expected string")
    decided = spark.createDataFrame([("g", "admit_new")], "case_id string, decision string")
    timed = spark.createDataFrame([("i", [70.0, 40.0, 55.0], 50), ("j", [60.0], 50), ("k", [], 50)], "case_id string, runs_ms array<double>, budget_ms long")
    card = gates.scorecard({"recall": gates.recall_gate(cases, found), "dedup": gates.dedup_gate(pairs), "admission": gates.decision_gate(wanted, decided), "latency": gates.latency_gate(timed), "none": gates.dedup_gate(pairs.limit(0))})
    got = {r["gate"]: (r["passed"], r["total"], round(r["score"], 6)) for r in card.collect()}
    assert got == {"recall": (1, 3, 0.333333), "dedup": (2, 3, 0.666667), "admission": (1, 2, 0.5), "latency": (1, 3, 0.333333), "none": (0, 0, 0.0)}
    assert {r["case_id"] for r in gates.recall_gate(cases, found).filter(F.col("passed")).collect()} == {"a"}
