"""Keyed tables that batches change: copy-on-write buckets and a manifest per version.

Rows are hashed by their key into a fixed number of buckets. A batch reads and
rewrites only the buckets of the keys it touches; all others keep their files. A
manifest names the live files of a version, is written once, and is what commits a
batch: files without a manifest are never read, and a batch that runs again after its
commit changes nothing.

    data/version=7/_bucket=12/part-….parquet
    manifest/000000007          {"12": [7], "13": [2, 5], …, "end": true}

The number of buckets is chosen so that one is a task's work; what comes to the
driver is the touched buckets' numbers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions that an appended bucket may consist of before it is written anew.
MOST_PARTS = 8


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class KeyedTable:
    """A table of ``schema`` whose rows are dealt into ``buckets`` by ``keys``.

    Example:
        table = KeyedTable(spark, folder, "id long, name string", ["id"])
        table.upsert(0, rows)
        table.latest()
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str], *, buckets: int = 64):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder, schema, list(keys), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        at = self._path(f"{self.folder}/manifest")
        if not self._files.exists(at):
            return []
        return sorted(n for n in (int(s.getPath().getName()) for s in self._files.listStatus(at) if s.getPath().getName().isdigit()) if self._read(n) is not None)

    def manifest(self, version: int) -> dict[int, list[int]]:
        """The versions that hold each bucket's rows."""
        found = self._read(version)
        if found is None:
            raise ValueError(f"version {version} is not committed")
        return found

    def _manifest_path(self, version: int):
        return self._path(f"{self.folder}/manifest/{version:09d}")

    def _read(self, version: int) -> dict[int, list[int]] | None:
        at = self._manifest_path(version)
        if not self._files.exists(at):
            return None
        stream = self._files.open(at)
        try:
            size = self._files.getFileStatus(at).getLen()
            text = bytes(stream.readNBytes(size)).decode()
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        # A writer that was lost halfway leaves no end mark: such a version is not committed.
        return {int(b): v for b, v in found.items() if b != "end"} if found.get("end") else None

    def _commit(self, version: int, live: dict[int, list[int]]) -> None:
        at = self._manifest_path(version)
        torn = self._files.exists(at) and self._read(version) is None
        try:
            stream = self._files.create(at, torn)
        except Exception as error:
            raise Conflict(f"version {version} is committed already") from error
        try:
            stream.write(bytearray(json.dumps({str(b): v for b, v in sorted(live.items())} | {"end": True}).encode()))
        finally:
            stream.close()

    def _rows(self, live: dict[int, list[int]], only: Sequence[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/data/version={v}/_bucket={b}" for b, parts in live.items() if only is None or b in only for v in parts]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def at(self, version: int) -> DataFrame:
        return self._rows(self.manifest(version))

    def latest(self) -> DataFrame:
        every = self.versions()
        return self.at(every[-1]) if every else self.spark.createDataFrame([], self.schema)

    def bucket(self):
        """The bucket of a row, as a column."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _before(self, version: int) -> dict[int, list[int]]:
        earlier = [v for v in self.versions() if v < version]
        return self.manifest(earlier[-1]) if earlier else {}

    def touched(self, changes: DataFrame) -> list[int]:
        """The buckets that hold the keys of ``changes``."""
        return sorted(r["b"] for r in changes.select(self.bucket().alias("b")).distinct().collect())

    def before(self, version: int) -> DataFrame:
        """The rows before ``version``."""
        return self._rows(self._before(version))

    def held(self, changes: DataFrame, version: int) -> DataFrame:
        """The rows, before ``version``, of all buckets that ``changes`` touch."""
        return self._rows(self._before(version), self.touched(changes))

    def near(self, changes: DataFrame, version: int) -> DataFrame:
        """The rows of ``version`` of all buckets that ``changes`` touch."""
        return self._rows(self.manifest(version), self.touched(changes))

    def _write(self, rows: DataFrame, version: int) -> None:
        dealt = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.spark.createDataFrame([], self.schema).schema]).withColumn("_bucket", self.bucket())
        dealt.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/data/version={version}")

    def _written(self, version: int) -> list[int]:
        at = self._path(f"{self.folder}/data/version={version}")
        names = [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("_bucket="))

    def merge(self, version: int, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Replace the touched buckets by ``combine(their rows, changes)``; False if the version is committed already.

        ``combine`` must give rows of the touched buckets only: those of its two inputs' keys.
        """
        if self._read(version) is not None:
            return False
        before, touched = self._before(version), self.touched(changes)
        if touched:
            self._write(combine(self._rows(before, touched), changes), version)
        written = set(self._written(version)) if touched else set()
        if written - set(touched):
            raise ValueError(f"rows outside the touched buckets: {sorted(written - set(touched))}")
        live = {b: parts for b, parts in before.items() if b not in touched} | {b: [version] for b in touched if b in written}
        self._commit(version, live)
        return True

    def upsert(self, version: int, rows: DataFrame) -> bool:
        """Rows replace those of their keys, null keys included; of one key in ``rows`` any row may stay."""

        def newest(old: DataFrame, new: DataFrame) -> DataFrame:
            new = new.dropDuplicates(self.keys)
            mark = new.select(*[F.col(k).alias(f"_{k}") for k in self.keys])
            same = [old[k].eqNullSafe(mark[f"_{k}"]) for k in self.keys]
            return old.join(mark, same, "left_anti").unionByName(new.select(*old.columns))

        return self.merge(version, rows, newest)

    def append(self, version: int, rows: DataFrame) -> bool:
        """Add rows; a bucket only grows by a file, until it has MOST_PARTS and is written anew."""
        if self._read(version) is not None:
            return False
        before, touched = self._before(version), self.touched(rows)
        full = [b for b in touched if len(before.get(b, [])) >= MOST_PARTS]
        if touched:
            self._write(rows.unionByName(self._rows(before, full)) if full else rows, version)
        live = dict(before)
        for b in touched:
            live[b] = [version] if b in full else [*before.get(b, []), version]
        self._commit(version, live)
        return True

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete manifests but for the last ``keep`` and every file that none of these names; the deleted folders."""
        every = self.versions()
        if not every:
            return []
        for v in every[:-keep]:
            self._files.delete(self._manifest_path(v), False)
        used = {(v, b) for n in every[-keep:] for b, parts in self.manifest(n).items() for v in parts}
        gone = []
        data = self._path(f"{self.folder}/data")
        for status in self._files.listStatus(data) if self._files.exists(data) else []:
            version = int(status.getPath().getName().split("=")[1])
            if version > every[-1]:
                continue  # a batch that is being written
            mine = self._written(version)
            for b in mine:
                if (version, b) not in used:
                    gone.append(f"version={version}/_bucket={b}")
                    self._files.delete(self._path(f"{self.folder}/data/version={version}/_bucket={b}"), True)
            if not any((version, b) in used for b in mine):
                self._files.delete(status.getPath(), True)
        return gone
