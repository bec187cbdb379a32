"""Versioned tables as lists of parts.

A table is a folder with ``data/``, one folder of parquet files for each part, and
``versions/``, one small file for each version that lists the parts in order.  A change
writes its own rows as a new part and then a new version file; what is written is in
proportion to the change, not to the table.  A version becomes visible by a rename that fails
if that version exists, so a reader sees a whole version or the one before it, and of two
writers one is told to start again.

A part either adds rows or replaces those of the same key in the parts before it; replaced
rows are set aside when the table is read, and left out for good by ``compact``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_PARTS = 24


@dataclass(frozen=True)
class Part:
    """A folder of a table, and the key by which its rows replace earlier ones, if they do."""

    folder: str
    replaces: tuple[str, ...] = ()

    def line(self) -> str:
        return "\t".join([self.folder, *self.replaces])


class Conflict(RuntimeError):
    """Another writer has made the version that was to be made."""


class Store:
    """Tables under one folder of any file system Spark can read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[str]:
        at = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _versions(self, name: str) -> list[int]:
        return [int(n) for n in self._list(f"{self.root}/{name}/versions") if n.isdigit()]

    def version(self, name: str) -> int:
        """The current version, 0 if there is none."""
        return max(self._versions(name), default=0)

    def exists(self, name: str) -> bool:
        return self.version(name) > 0

    def parts(self, name: str, version: int | None = None) -> list[Part]:
        version = version or self.version(name)
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.root}/{name}/versions/{version:08d}"))
        try:
            text = bytes(b & 255 for b in stream.readAllBytes()).decode()
        finally:
            stream.close()
        return [Part(folder, tuple(on)) for folder, *on in (line.split("\t") for line in text.splitlines())]

    def _publish(self, name: str, based_on: int, parts: list[Part]) -> int:
        new = based_on + 1
        draft = self._path(f"{self.root}/{name}/.{uuid.uuid4().hex}")
        target = self._path(f"{self.root}/{name}/versions/{new:08d}")
        self._fs.mkdirs(target.getParent())
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray("\n".join(p.line() for p in parts).encode()))
        finally:
            stream.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {new} of {name} is there already")
        return new

    def _data(self, name: str, part: Part) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/data/{part.folder}")

    def _add(self, name: str, df: DataFrame, partition_by: str | None = None, files: int | None = None) -> Part:
        part = Part(uuid.uuid4().hex)
        writer = (df.repartition(files) if files else df).write.mode("error")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/data/{part.folder}")
        return part

    def read(self, name: str, without: tuple[str, list] | None = None, version: int | None = None) -> DataFrame:
        """A version, the current one by default; ``without`` names a column and the values that are set aside, whose files are not read where the column partitions the table."""
        parts = self.parts(name, version)
        if not parts:
            raise ValueError(f"there is no table {name}")
        # runs of parts between which nothing is replaced are read together
        later: dict[tuple[str, ...], list[DataFrame]] = {}
        pieces: list[DataFrame] = []
        for part in reversed(parts):
            df = self._data(name, part)
            for on, keys in later.items():
                df = df.join(reduce(DataFrame.unionByName, keys), list(on), "left_anti")
            pieces.append(df)
            if part.replaces:
                later.setdefault(part.replaces, []).append(self._data(name, part).select(*part.replaces))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reversed(pieces))
        return df.filter(~F.col(without[0]).isin(*without[1]) | F.col(without[0]).isNull()) if without and without[1] else df

    def write(self, name: str, df: DataFrame, partition_by: str | None = None, files: int | None = None) -> int:
        """The table becomes the rows of df; readers see the old version until then."""
        based_on = self.version(name)
        return self._publish(name, based_on, [self._add(name, df, partition_by, files)])

    def append(self, name: str, df: DataFrame, partition_by: str | None = None) -> int:
        """Adds the rows of df as a part."""
        based_on = self.version(name)
        return self._publish(name, based_on, [*self.parts(name, based_on), self._add(name, df, partition_by)])

    def upsert(self, name: str, new: DataFrame, on: list[str]) -> int:
        """Rows of the keys in ``new`` are replaced, other new rows added; only the new rows are written."""
        based_on = self.version(name)
        part = self._add(name, new)
        parts = [*self.parts(name, based_on), Part(part.folder, tuple(on)) if based_on else part]
        version = self._publish(name, based_on, parts)
        return self.compact(name) if len(parts) > MOST_PARTS else version

    def append_new(self, name: str, new: DataFrame, on: list[str]) -> int:
        """Adds the rows whose key is not there yet, once each, so that a batch given twice changes nothing; only those are written."""
        once = new.dropDuplicates(on)
        fresh = once.join(self.read(name).select(*on), on, "left_anti") if self.exists(name) else once
        version = self.append(name, fresh)
        return self.compact(name) if len(self.parts(name)) > MOST_PARTS else version

    def compact(self, name: str, partition_by: str | None = None) -> int:
        """The same rows as one part."""
        return self.write(name, self.read(name), partition_by)

    def attach(self, name: str, folder: str) -> int:
        """Takes a part back that ``detach`` has set aside."""
        based_on = self.version(name)
        return self._publish(name, based_on, [*self.parts(name, based_on), Part(folder)])

    def detach(self, name: str, folder: str) -> int:
        """Leaves a part out of the table without deleting its files."""
        based_on = self.version(name)
        return self._publish(name, based_on, [p for p in self.parts(name, based_on) if p.folder != folder])

    def write_sorted(self, name: str, df: DataFrame, keys: list[str], files: int) -> int:
        """The rows in files of disjoint ranges of the keys, so that filters on them skip files."""
        return self.write(name, df.repartitionByRange(files, *keys).sortWithinPartitions(*keys))

    def shard(self, name: str, df: DataFrame, key: str, shards: int) -> int:
        """The rows as parts, one a shard by the hash of the key, that can be detached and attached; rows may come from the table itself."""
        based_on = self.version(name)
        own = F.pmod(F.xxhash64(key), F.lit(shards))
        return self._publish(name, based_on, [self._add(name, df.filter(own == i)) for i in range(shards)])

    def view(self, name: str, alias: str | None = None) -> DataFrame:
        """The current version as a view for SQL; called again, the view is that of the version then current."""
        df = self.read(name)
        df.createOrReplaceTempView(alias or name)
        return df

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Deletes all but the ``keep`` newest versions and the parts that none of those names."""
        versions = self._versions(name)
        kept = versions[-keep:]
        needed = {p.folder for v in kept for p in self.parts(name, v)}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/{name}/versions/{v:08d}"), False)
        for folder in self._list(f"{self.root}/{name}/data"):
            if folder not in needed:
                self._fs.delete(self._path(f"{self.root}/{name}/data/{folder}"), True)

    def size(self, name: str) -> int:
        """Bytes of the table's files, those of old versions included."""
        path = self._path(f"{self.root}/{name}/data")
        return self._fs.getContentSummary(path).getLength() if self._fs.exists(path) else 0

    def count(self, name: str) -> int:
        return self.read(name).count() if self.exists(name) else 0

    def largest(self, name: str, key: str) -> int:
        return int(self.read(name).agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).first()["m"]) if self.exists(name) else 0
