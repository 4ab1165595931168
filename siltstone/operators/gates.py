"""Evaluation gates: cases with what is expected of them, and the share that is met."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text


def recall_gate(cases: DataFrame, found: DataFrame, top: int = 3) -> DataFrame:
    """case_id, passed: whether an expected row (case_id, expected ids) is among the first of a case's rows (case_id, id, rank)."""
    want = cases.select("case_id", F.explode("expected").alias("id"))
    hit = want.join(found.filter(F.col("rank") <= top), ["case_id", "id"], "left_semi").select("case_id").distinct().withColumn("passed", F.lit(True))
    return cases.select("case_id").join(hit, "case_id", "left").na.fill(False, ["passed"])


def dedup_gate(cases: DataFrame, above: float = 0.5) -> DataFrame:
    """case_id, passed: whether the similarity of two texts (text_a, text_b) tells what is_duplicate says."""
    sim = text.similarity(text.tokens(F.col("text_a")), text.tokens(F.col("text_b")))
    return cases.select("case_id", ((sim > above) == F.col("is_duplicate")).alias("passed"))


def decision_gate(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """case_id, passed: whether the decision (case_id, decision) is the expected one (case_id, expected)."""
    return cases.join(decisions, "case_id", "left").select("case_id", F.coalesce(F.col("decision") == F.col("expected"), F.lit(False)).alias("passed"))


def latency_gate(cases: DataFrame) -> DataFrame:
    """case_id, passed: whether the least of the measured times (runs_ms) is below the case's budget (budget_ms)."""
    return cases.select("case_id", F.coalesce(F.array_min("runs_ms") < F.col("budget_ms"), F.lit(False)).alias("passed"))


def scorecard(gates: dict[str, DataFrame]) -> DataFrame:
    """gate, passed, total, score of each gate's cases."""
    out = None
    for name, cases in gates.items():
        part = cases.agg(F.sum(F.col("passed").cast("int")).cast("long").alias("passed"), F.count("*").alias("total")).select(F.lit(name).alias("gate"), F.coalesce("passed", F.lit(0)).alias("passed"), "total")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("score", F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(0.0))
