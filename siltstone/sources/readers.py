"""Sources besides tables: Markdown memories, session files, job queues, foreign stores, external search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.schema import SESSION


def markdown(spark: SparkSession, glob: str, query: str | None = None, limit: int = 20, head_bytes: int = 4000) -> DataFrame:
    """path, title, body of Markdown files with front matter; with a query, the best by shared words."""
    raw = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    front = r"(?s)^---\n(.*?)\n---\n?"
    body = F.regexp_replace("value", front, "")
    title = F.coalesce(F.nullif(F.regexp_extract(F.regexp_extract("value", front, 1), r"(?m)^(?:title|name):\s*(.+)$", 1), F.lit("")), F.nullif(F.regexp_extract(body, r"(?m)^#+\s+(.+)$", 1), F.lit("")))
    files = raw.select("path", title.alias("title"), text.clip_bytes(body, head_bytes).alias("body"))
    if query is None:
        return files
    words = text.tokens(F.lit(query))
    scored = files.withColumn("score", F.size(F.array_intersect(text.tokens(F.concat_ws(" ", "title", "body")), words)))
    return scored.filter("score > 0").orderBy(F.desc("score"), "path").limit(limit)


def session_files(spark: SparkSession, path: str) -> DataFrame:
    """Sessions from nested JSON, with their transcript."""
    s = spark.read.schema(SESSION).json(path, multiLine=False)
    line = F.transform("turns", lambda t: F.concat_ws(": ", t["role"], t["content"]))
    return s.withColumns({"transcript": F.array_join(line, "\n"), "n_turns": F.size("turns")})


def queued(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON jobs as a stream; each file is a job once it is there."""
    return spark.readStream.schema(schema).json(path)


def imported(spark: SparkSession, url: str, table: str, mapping: dict[str, str], key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """Rows of a foreign store through JDBC, in parallel by a numeric key, under the names of the mapping."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load().select(*[F.expr(e).alias(n) for n, e in mapping.items()])


def external(results: DataFrame, source: str) -> DataFrame:
    """Results of an external search (key, title, text, score) as memories under ids of their own."""
    return results.select(F.concat(F.lit(f"{source}:"), F.col("key").cast("string")).alias("id"), F.col("title").alias("summary"), F.col("text").alias("content"), F.lit(source).alias("source"), "score")
