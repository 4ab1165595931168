"""Token counts through a cache of digests.

The digest of a text's normalised content (runs of ASCII white space are one blank, none at the ends: the vocabulary
drops white space) and the digest of the tokenizer's file make the key of a stored count.  Only distinct contents that
the cache doesn't hold are encoded; their counts are appended to the cache.

Texts may be null or empty (no tokens) and of any length.  Equal rows are equal rows of the result.  Extra columns of
the input are ignored.  An empty table gives an empty table and leaves the cache as it is.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import WORD_SPLIT, mapped, pick, stage, utf8

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_bytes and content: the digest of the normalised text."""
    docs = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    normal = F.trim(F.regexp_replace("text", WORD_SPLIT, " "))
    return docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode(normal, "utf-8"), 256).alias("content"))


def read_cache(spark: SparkSession, cache: str | None, version: str) -> DataFrame:
    """content, n_tokens for one tokenizer; a cache that doesn't exist yet is empty."""
    empty = spark.createDataFrame([], CACHE_SCHEMA)
    if cache:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            empty = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    return empty.filter(F.col("tokenizer") == version).dropDuplicates(["content"]).select("content", "n_tokens")


def token_counts(docs: DataFrame, vocabulary: str, cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of docs.  `cache`: a folder of counts to use and to append to, or None.

    A null text is empty and has no tokens.  Texts may have any length.  Repeated rows, and rows that share a doc_id or have
    none, are counted each; equal contents are encoded once.  An empty table gives an empty result.  Columns but doc_id and
    text are ignored.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(vocabulary)
    docs = digested(docs)

    def first_of_batches():
        seen: set[bytes] = set()

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            """Rows whose content this task hasn't met among its last ones: hot contents are thinned before they are dealt out."""
            keep = []
            for d in b.column("content").to_pylist():
                k = bytes.fromhex(d)[:12]
                keep.append(k not in seen)
                seen.add(k)
            if len(seen) > 500_000:
                seen.clear()
            return b.filter(pa.array(keep))

        return each

    def encode_misses():
        from siltstone.llm.tokens import counter

        count = counter(vocabulary)
        seen: set[str] = set()

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for d in b.column("content").to_pylist():
                keep.append(d not in seen)
                seen.add(d)
            b = b.filter(pa.array(keep))
            return pa.record_batch([b.column("content"), pa.array(count(utf8(b.column("text"))), pa.int64())], ["content", "n_tokens"])

        return each

    known = read_cache(spark, cache, version)
    # dealt out by content once, thinned before that; the cache is then dealt out to the same places
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    missing = mapped(docs.select("content", "text"), first_of_batches, "content string, text string").repartition(parts, "content")
    if cache:
        missing = missing.join(known, "content", "left_anti")
    fresh = stage(mapped(missing, encode_misses, "content string, n_tokens long"), "counts")
    if cache:
        # `known` keeps to the files that were there when it was made, so what is appended now isn't in it
        fresh.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    known = known.unionByName(fresh)
    return docs.select("doc_id", "n_bytes", "content").join(known, "content").select("doc_id", "n_bytes", "n_tokens")
