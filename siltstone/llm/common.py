"""What the operators of this subpackage share: scratch tables in the shared folder, size-checked joins, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: A side is broadcast only if it has been counted and has no more rows than this.
BROADCAST_ROWS = 1_000_000

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  In local mode only, a new one is set if none is."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_name() -> str:
    return uuid.uuid4().hex


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/siltstone/{name}-{new_name()}"
    _scratch.append((spark, path))
    return path


#: Spark's setting by which the shuffle files of a finished execution are deleted.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, a lost executor costs nothing.

    Nothing reads the shuffle files of the writing afterwards, so Spark may delete them at its end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._siltstone_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """The scratch tables of one call.  Only what the call has made is ever deleted, and not what its result reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        out = stage(df, name)
        self.made.append(out._siltstone_path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for t in tables:
            self.made.remove(t._siltstone_path)
            _forget(self.spark, t._siltstone_path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """df, written; all other tables of the call go."""
        out = stage(df, name)
        for path in self.made:
            _forget(self.spark, path)
        self.made = []
        return out


def _forget(spark: SparkSession, path: str) -> None:
    drop_path(spark, path)
    _scratch.remove((spark, path))


def _drop_all() -> None:
    """At exit: delete every scratch table that is left."""
    while _scratch:
        spark, p = _scratch.pop()
        try:
            drop_path(spark, p)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


atexit.register(_drop_all)


def bounded(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table as one side of a join: with the broadcast hint if counting shows at most `limit` rows, else plain."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def spread(files: DataFrame, column: str, most: int = 50_000) -> DataFrame:
    """A staged table of files, dealt out by a number of partitions that follows the number of files: a partition of a few
    bytes of names is hours of reading, so adaptive execution must not merge them."""
    return files.repartition(max(1, min(files.count(), most)), column)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast: extra columns and their names never matter afterwards."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()])


def fresh_name(df: DataFrame, name: str) -> str:
    """name, or the first of name_, name__ ... that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_key(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty()


def numbered(scratch: Scratch, docs: DataFrame, row: str) -> DataFrame:
    """docs with a column `row`, a key in the order of doc_id: doc_id itself if it is one, and else numbers.

    Rows of one doc_id are in the order of their texts, and a null doc_id comes last; only then is the table sorted and
    written once more.
    """
    if is_key(docs):
        return docs.withColumn(row, F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    return scratch.stage(ordered.withColumn(row, F.monotonically_increasing_id()), "numbered")


def settle() -> None:
    """At the end of a task: give memory that isn't used back to the system.  Python workers live on, beside the tasks that
    follow."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sliced(b: pa.RecordBatch, portion: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `portion` bytes."""
    step = max(1, b.num_rows // (1 + b.nbytes // portion))
    for at in range(0, b.num_rows, step):
        yield b.slice(at, step)


def mapped(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, portion: int = 8 << 20) -> DataFrame:
    """df through Arrow batches of about `portion` bytes at most; make() is called once a task and returns the function of a
    batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for b in batches:
            for part in sliced(b, portion):
                if (out := each(part)) is not None and out.num_rows:
                    yield out
        settle()

    return df.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of sorted batches with the same first n columns."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(i).to_numpy() for i in range(n)]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        at = np.append(np.flatnonzero(new), b.num_rows)
        for a, z in zip(at, at[1:], strict=False):
            key = tuple(k[a] for k in keys)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(a, z - a))
    if held:
        yield now, pa.Table.from_batches(held)


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [b or b"" for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
