"""The stages of the corpus pipeline.  Each works on all that the one before it kept.

All stages take documents with any extra columns, whatever their names, and all but the last return exactly those columns.  An
empty table gives an empty one.  Texts may be null, empty, or of any length.  Rows that repeat, share a doc_id or have none are
rows of their own, in the order of doc_id (nulls last) and then of their texts, where a stage needs an order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common, packing, quality

CAPACITY = 1024


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """docs with a column that is a key, (that key as doc_id, text), and the column's name."""
    row = common.fresh_name(docs, "row")
    whole = common.numbered(common.Scratch(docs.sparkSession), docs, row)
    return whole, whole.select(F.col(f"`{row}`").alias("doc_id"), "text"), row


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule passes.  Null and empty texts have too few words and go; repeated rows pass or go
    together."""
    return quality.good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of at least 0.8 connect, the first.  Texts without words are linked with nothing
    and stay; of repeated rows one stays."""
    from siltstone.llm import jaccard_join

    whole, texts, row = _keyed(docs)
    groups = jaccard_join.components(texts)
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(row))
    return whole.join(first, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes and more that stand in an earlier one, or further in front; those with no
    word left go, as do null and empty texts.  Of repeated rows of that length the first keeps its text."""
    from siltstone.llm import suffix_dedup

    kept = suffix_dedup.without_repeats(docs)
    return kept.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found.  Null and empty texts stay; repeated rows stay or go together."""
    from siltstone.llm import decontamination

    whole, texts, row = _keyed(docs)
    found = decontamination.contaminated(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = common.stage(found.select(F.col("doc_id").alias(row)).distinct(), "leaks")
    return whole.join(leaks, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null
    or empty text is a piece of its end alone; each repeated row has its own pieces."""
    pieces = packing.tokenize_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, end=2)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.best_fit(pieces, CAPACITY)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeats_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        path = f"{common.shared_dir(spark)}/siltstone-pipeline/{name}-{common.new_name()}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.drop_path(spark, before)
        before = path
    out = STAGES[-1][1](spark, docs, sf_dir)
    common.drop_path(spark, before)
    return out
