"""Published versions of a stored index: immutable segments, and a pointer that moves at once.

A folder holds segments (tables that are never changed) and `_versions/<number>.json`, a manifest for each version that says
which segments it has.  A version appears by one rename that fails if its number is taken, so readers see whole versions
only, and of two writers that began at the same version one gets `Conflict`.  A reader keeps the manifest that it began
with; what newer versions no longer name stays until `vacuum`.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has published meanwhile."""


@dataclass
class Versions:
    spark: SparkSession
    root: str

    def __post_init__(self):
        self.root = self.root.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        p = self._path(f"{self.root}/_versions")
        fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self._fs().open(self._path(f"{self.root}/_versions/{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict] | None:
        numbers = self._numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else None

    def new_segment(self) -> str:
        """A folder that no version names yet."""
        return f"{self.root}/segment-{uuid.uuid4().hex}"

    def publish(self, manifest: dict, after: int) -> int:
        """The manifest as version after + 1."""
        jvm, number = self.spark.sparkContext._jvm, after + 1
        made = self._path(f"{self.root}/_versions/.{uuid.uuid4().hex}")
        out = self._fs().create(made, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(made, self._path(f"{self.root}/_versions/{number}.json"), none)
        except Exception as e:
            self._fs().delete(made, False)
            if number in self._numbers():
                raise Conflict(f"version {number} is there already") from e
            raise
        return number

    def vacuum(self, keep: int = 1) -> None:
        """Delete all versions but the last `keep`, and the segments that only they name.  Not while a writer is at work."""
        numbers = self._numbers()
        fs, kept = self._fs(), numbers[-keep:] if keep else []
        named = {s["path"].rsplit("/", 1)[1] for n in kept for s in self.read(n)["segments"]}
        for n in numbers[: len(numbers) - len(kept)]:
            fs.delete(self._path(f"{self.root}/_versions/{n}.json"), False)
        for status in fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if name.startswith("segment-") and name not in named:
                fs.delete(status.getPath(), True)


def replaced(spark: SparkSession, segments: list[dict]) -> DataFrame | None:
    """id, upto: ids whose rows in the segments up to number `upto` don't count any more."""
    out = None
    for i, s in enumerate(segments):
        if s["replaces"]:
            part = spark.read.parquet(f"{s['path']}/replaced").select("id", F.lit(i - 1).alias("upto"))
            out = part if out is None else out.unionByName(part)
    return None if out is None else out.groupBy("id").agg(F.max("upto").alias("upto"))
