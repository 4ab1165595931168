"""Event-sourced consumers on Structured Streaming: offsets, counters, correlation, deduplication, matching, retention."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def consume(events: DataFrame, fold: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes to fold(batch, batch_id) once its predecessors are done; the offsets are committed after it,
    so a batch may come again after a failure, under its old batch_id.  Runs until all that is there has been read."""
    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versioned(path: str) -> Callable[[SparkSession], DataFrame | None]:
    """The last state that a fold has written under path, or None."""

    def read(spark: SparkSession) -> DataFrame | None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return None
        done = [int(s.getPath().getName()[6:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return spark.read.parquet(f"{path}/batch={max(done)}") if done else None

    return read


def counter_fold(path: str, keys: list[str], counts: dict[str, str]) -> Callable[[DataFrame, int], None]:
    """Adds each batch's counts by key to the state before it.  State of batch n is a function of the state before and the
    batch, and is written under n: a batch that comes again replaces its own state, and nothing is counted twice."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(*keys).agg(*[F.sum(F.when(F.expr(c), 1).otherwise(0)).cast("long").alias(n) for n, c in counts.items()], F.max("event_id").alias("last_id"))
        old = [spark.read.parquet(f"{path}/batch={batch_id - 1}")] if batch_id else []
        state = reduce(DataFrame.unionByName, [*old, new]).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in counts], F.max("last_id").alias("last_id"))
        state.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return fold


def bucket_counts(events: DataFrame, keys: list[str], counts: dict[str, str], late: str = "1 day") -> DataFrame:
    """Counts by key and day, with state dropped once a day is over by `late`."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), *keys).agg(*[F.sum(F.when(F.expr(c), 1).otherwise(0)).cast("long").alias(n) for n, c in counts.items()])


def matched(recalls: DataFrame, answers: DataFrame, hours: int = 24) -> DataFrame:
    """Recalls with their answers within some hours; recalls that no answer can reach any more come without one."""
    r = recalls.withWatermark("recall_ts", f"{hours} hours")
    a = answers.withWatermark("answer_ts", f"{hours} hours")
    return r.join(a, F.expr(f"request = answer_request and answer_ts >= recall_ts and answer_ts <= recall_ts + interval {hours} hours"), "leftOuter")


def half_pairs(judge: DataFrame, human: DataFrame, days: int = 7) -> DataFrame:
    """Judge's and human's verdicts on one item, at most some days apart."""
    j, h = judge.withWatermark("judge_ts", f"{days} days"), human.withWatermark("human_ts", f"{days} days")
    return j.join(h, F.expr(f"item = human_item and human_ts between judge_ts - interval {days} days and judge_ts + interval {days} days"))


def unique_buffers(texts: DataFrame, within: str = "1 hour") -> DataFrame:
    """Texts whose content hash wasn't seen within a span of time."""
    return texts.withColumn("hash", F.sha2("text", 256)).withWatermark("ts", within).dropDuplicatesWithinWatermark(["hash"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def expired(events: DataFrame, offsets: DataFrame, cutoff) -> DataFrame:
    """Events that every consumer is past and that are older than the cutoff."""
    least = offsets.agg(F.min("last_id").alias("_m"))
    return events.crossJoin(F.broadcast(least)).filter((F.col("event_id") <= F.col("_m")) & (F.col("ts") < F.lit(cutoff).cast("timestamp"))).drop("_m")


def committed(offsets: DataFrame, new: DataFrame) -> DataFrame:
    """Offsets never go back."""
    return offsets.unionByName(new).groupBy("consumer").agg(F.max("last_id").alias("last_id"))
