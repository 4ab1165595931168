"""The memory model over the synthetic tables: documents stand for memories, events for feedback, and so on.

MEMORIES is SQL that Spark and other engines read alike; every time is a function of a row's key, and AS_OF is fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-03-01 00:00:00"

MEMORIES = """
select doc_id as id, source as topic, lang, coalesce(text, '') as content, substr(coalesce(text, ''), 1, 120) as summary,
       case doc_id % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high' else 'critical' end as importance,
       case when doc_id % 4 >= 2 then 'ltm' else 'stm' end as layer,
       0.06 * case doc_id % 4 when 0 then 1.0 when 1 then 0.7 when 2 then 0.4 else 0.1 end as decay_lambda,
       cast(doc_id * 7 % 23 as int) as access_count,
       cast((doc_id * 37 % 101) / 100.0 as double) as strength,
       case when doc_id % 11 = 5 then 'deprecated' when doc_id % 5 = 2 then 'updated' else 'active' end as status,
       case doc_id % 3 when 0 then 'hot' when 1 then 'warm' else 'cold' end as tier,
       case when doc_id % 9 in (4, 7) and doc_id > 3 then doc_id - 3 end as superseded_by,
       cast(doc_id % 13 as int) as cluster_id,
       cast(1 + doc_id % 5 as int) as support, cast(1 + doc_id % 3 as int) as diversity,
       cast(doc_id * 17 % 1400 as int) as age_hours
from documents
"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MEMORIES.replace("from documents", "from {documents}"), documents=table(spark, sf_dir, "documents"))


def memories_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With created_at and last_accessed."""
    from pyspark.sql import functions as F

    m = memories(spark, sf_dir)
    hours = F.col("age_hours")
    at = F.lit(AS_OF).cast("timestamp")
    return m.withColumns({"created_at": at - F.make_dt_interval(hours=hours), "last_accessed": at - F.make_dt_interval(hours=F.floor(hours / 3).cast("int"))})


WITH = f"with memories as ({MEMORIES})\n"
