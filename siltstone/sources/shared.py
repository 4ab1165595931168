"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one is made only where none is set and the session is local, as in tests."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir", None):
        return found
    if found := context.getCheckpointDir():
        return found
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="siltstone-checkpoint-")
    context.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes at exit."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/siltstone-{name}-{uuid.uuid4().hex}"
    _stored[path, ""] = (spark, path)
    return path


#: Spark's setting by which the shuffle files of a finished execution are deleted.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    """Writes whose shuffle files nothing reads afterwards, so that Spark deletes them at each one's end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and what is read twice is made once.  It goes at exit."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, name)
    with cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._siltstone_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for t in tables:
        spark, path = _stored.pop((t._siltstone_path, ""))
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_stored: dict[tuple[str, str], tuple[SparkSession, str]] = {}


def fingerprint(df: DataFrame) -> str:
    """Of the files that df reads: their names, sizes and times."""
    context = df.sparkSession.sparkContext
    found = []
    for name in sorted(df.inputFiles()):
        p = context._jvm.org.apache.hadoop.fs.Path(name)
        s = p.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(p)
        found.append(f"{name} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(found).encode()).hexdigest()


def stored(spark: SparkSession, source: DataFrame, kind: str, write: Callable[[str], object], read: Callable[[str], T]) -> T:
    """What is derived from the files of `source`: written into the shared folder when this application first asks for it,
    and read from there afterwards, as long as the files stay as they are.  It goes at exit."""
    key = (f"{spark.sparkContext.applicationId} {kind}", fingerprint(source))
    if key not in _stored:
        root = f"{checkpoint_dir(spark).rstrip('/')}/siltstone-{kind}-{uuid.uuid4().hex}"
        write(root)
        _stored[key] = (spark, root)
    return read(_stored[key][1])


def _drop_stored() -> None:
    for spark, root in _stored.values():
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


atexit.register(_drop_stored)
