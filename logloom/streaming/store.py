"""A table of kept groups: changed groups batch by batch, merged in levels, with a manifest per batch.

Folder ``parts`` holds one Parquet table per batch and per merge. A manifest
``manifests/<batch>`` names the parts that together hold everything up to its
batch; it appears in one step, after all it names was written. Whoever reads
takes the newest manifest and its parts. FAN parts of one level are merged
into one of the next level, so their number grows with the logarithm of the
batches and a row is written again once per level.
"""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..session import remove_path

# Parts of one level that are merged into one of the next.
FAN = 8
# Column that says which batch wrote a row.
BATCH = "__batch"


class GroupStore:
    """The kept groups of one stream, one row per ``keys`` and batch that changed it.

    A group's later row replaces its earlier ones.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], fan: int = FAN):
        self.spark, self.path, self.keys, self.fan = spark, path.rstrip("/"), list(keys), fan
        self._home = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _names(self, folder: str) -> list[str]:
        where = self._at(folder)
        if not self._fs.exists(where):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(where)]

    def _manifest(self, before: int | None = None) -> dict:
        """The newest manifest, or the newest of the batches before one."""
        numbers = [int(n) for n in self._names("manifests") if n.isdigit() and (before is None or int(n) < before)]
        if not numbers:
            return {"parts": [], "left": []}
        stream = self._fs.open(self._at("manifests", str(max(numbers))))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, number: int, manifest: dict) -> None:
        """Written aside, then renamed: it is there whole or not at all."""
        aside, there = self._at("manifests", f"_{number}"), self._at("manifests", str(number))
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self._fs.exists(there):
            self._fs.delete(there, False)
        if not self._fs.rename(aside, there):
            raise OSError(f"could not publish {self.path}/manifests/{number}")

    def write(self, batch: DataFrame, number: int) -> None:
        """Add a batch's changed groups. A batch that is repeated, after a
        failure at any point, starts from the manifest of the batches before it."""
        manifest = self._manifest(before=number)
        name = f"b{number}"
        (batch.withColumn(BATCH, F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.path}/parts/{name}"))
        parts, merged, dropped = plan_merges([*manifest["parts"], [name, 0]], self.fan, number)
        for into, of in merged:
            _latest(self._read(of, batch.schema), self.keys).write.mode("overwrite").parquet(f"{self.path}/parts/{into}")
        # parts that the last merge replaced stay for readers that still hold them, until the next one
        left = dropped if dropped else manifest["left"]
        self._publish(number, {"parts": parts, "left": left})
        if dropped:
            self._tidy(number, {n for n, _ in parts} | set(left))

    def _tidy(self, number: int, named: set[str]) -> None:
        """Remove what neither this batch's manifest nor the one before it names."""
        keep = named | {n for n, _ in self._manifest(before=number)["parts"]}
        for name in self._names("parts"):
            if name not in keep:
                remove_path(self.spark, f"{self.path}/parts/{name}")
        older = sorted(int(n) for n in self._names("manifests") if n.isdigit() and int(n) < number)[:-1]
        for n in older:
            self._fs.delete(self._at("manifests", str(n)), False)

    def _read(self, names: list[str], schema: StructType) -> DataFrame:
        full = StructType([*schema.fields]).add(BATCH, LongType())
        return self.spark.read.schema(full).parquet(*[f"{self.path}/parts/{n}" for n in names])

    def current(self, schema: StructType) -> DataFrame:
        """The last row of every group, of one manifest."""
        names = [n for n, _ in self._manifest()["parts"]]
        if not names:
            return self.spark.createDataFrame([], schema)
        return _latest(self._read(names, schema), self.keys).drop(BATCH)


def plan_merges(parts: list[list], fan: int, number: int) -> tuple[list[list], list[tuple[str, list[str]]], list[str]]:
    """Parts [name, level] after merging, the merges to make in turn as (new
    name, merged names), and the names that go. A level that has ``fan`` parts
    becomes one part of the next, which may fill that level in turn."""
    parts, merges, dropped = [list(p) for p in parts], [], []
    level = 0
    while sum(p[1] == level for p in parts) >= fan:
        of = [n for n, at in parts if at == level]
        into = f"m{number}-{level + 1}"
        parts = [p for p in parts if p[1] != level] + [[into, level + 1]]
        merges.append((into, of))
        dropped += of
        level += 1
    return parts, merges, dropped


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last written row of every group; null keys are keys. Values are
    taken one by one: of numbers, that aggregates without sorting rows."""
    values = [c for c in rows.columns if c not in keys and c != BATCH]
    last = rows.groupBy(*keys).agg(*[F.max_by(v, BATCH).alias(v) for v in values], F.max(BATCH).alias(BATCH))
    return last.select(*keys, *values, BATCH)
