"""Tables that change together: immutable parts and a ledger of versions.

A change writes new parts, and last of all one row to the ledger, which names the
parts of every table; until that row is there readers see the version before, and
what an interrupted change has written is never read.  A row also holds the last
batch of each stream, so a batch that is run again finds itself committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import written

_COMMIT = "version long, batches map<string,long>, parts array<struct<name: string, bucket: int, path: string>>"
#: Bytes of a row group of sorted buckets: what a reader skips or reads.
_SORTED_ROW_GROUP = 8 << 20


class Table(NamedTuple):
    """A table that is only appended to, or, with a key, one of a row a key, laid out
    by ``buckets`` hashes of the key so that an upsert rewrites what it touches.  With
    ``order`` the rows of a bucket's files are sorted, so that readers skip row
    groups and pages by their bounds; such a table may hold many rows a key."""

    schema: str
    key: tuple[str, ...] = ()
    buckets: int = 64
    order: tuple[str, ...] = ()


class Part(NamedTuple):
    name: str
    bucket: int | None
    path: str


class Store:
    """The tables under a folder of a file system that all machines share.  One
    writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table]) -> None:
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        self.reload()

    def _ledger(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_COMMIT).parquet(f"{self.path}/ledger")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _at(self, version: int | None) -> tuple[int, dict[str, int], list[Part]]:
        rows = self._ledger()
        if rows is not None:
            rows = rows if version is None else rows.where(F.col("version") == version)
            if row := rows.orderBy(F.col("version").desc()).limit(1).first():
                return row["version"], dict(row["batches"]), [Part(*p) for p in row["parts"]]
        if version:
            raise ValueError(f"the store has no version {version}")
        return 0, {}, []

    def reload(self) -> None:
        """Takes the last version, if another process has written one."""
        self.version, self.batches, self.parts = self._at(None)

    def holds(self, stream: str, batch: int) -> bool:
        """Whether a batch of a stream is committed (batches are numbered upwards)."""
        return self.batches.get(stream, -1) >= batch

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as it is, or was at a version; or only some of its buckets."""
        parts = self.parts if version is None else self._at(version)[2]
        return self._rows(name, parts, buckets)

    def _rows(self, name: str, parts: list[Part], buckets: list[int] | None = None) -> DataFrame:
        asked = None if buckets is None else set(buckets)
        paths = [p.path for p in parts if p.name == name and (asked is None or p.bucket in asked)]
        schema = self.tables[name].schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, name: str) -> Column:
        """The bucket of a row of a table with a key."""
        t = self.tables[name]
        return F.pmod(F.xxhash64(*t.key), F.lit(t.buckets)).cast("int")

    def change(self) -> "Change":
        return Change(self)


class Change:
    """Changes to tables that become visible together with :meth:`commit`."""

    def __init__(self, store: Store) -> None:
        self.store, self.parts = store, list(store.parts)

    def _path(self, name: str) -> str:
        return f"{self.store.path}/{name}/{uuid.uuid4().hex}"

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Adds rows as one part, and gives them back as read from it.  Where the
        table has a key the rows' keys must be new to it; each bucket gets a part."""
        t, path = self.store.tables[name], self._path(name)
        wanted = self.store.spark.createDataFrame([], t.schema).schema
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in wanted))
        if t.key:
            self.parts += self._write_buckets(name, path, rows)
        else:
            rows.write.parquet(path)
            self.parts.append(Part(name, None, path))
        return self.store.spark.read.schema(wanted).option("recursiveFileLookup", "true").parquet(path)

    def _write_buckets(self, name: str, path: str, rows: DataFrame) -> list[Part]:
        t = self.store.tables[name]
        rows = rows.withColumn("_bucket", self.store.bucket(name)).hint("rebalance", "_bucket")
        if t.order:
            rows = rows.sortWithinPartitions("_bucket", *t.order)
            rows.write.partitionBy("_bucket").option("parquet.block.size", _SORTED_ROW_GROUP).option("parquet.writer.version", "v2").parquet(path)
        else:
            rows.write.partitionBy("_bucket").parquet(path)
        full = self.store.spark.read.schema(f"{t.schema}, _bucket int").parquet(path).select("_bucket").distinct()
        return [Part(name, b, f"{path}/_bucket={b}") for b in sorted(r[0] for r in full.collect())]  # at most t.buckets

    def upsert(self, name: str, rows: DataFrame, gone: DataFrame | None = None) -> list[int]:
        """Puts rows (one a key) in place of those with their keys, and takes those
        with the keys of ``gone`` away.  Only buckets that either touches are read
        and written; gives back their numbers."""
        t = self.store.tables[name]
        if not t.key:
            raise ValueError(f"{name} has no key: append")
        wanted = self.store.spark.createDataFrame([], t.schema).schema
        bucket = self.store.bucket(name).alias("_bucket")
        new = rows.select(*(F.col(f.name).cast(f.dataType) for f in wanted), F.lit(True).alias("_kept"))
        if gone is not None:
            new = new.unionByName(gone.select(*t.key, F.lit(False).alias("_kept")), allowMissingColumns=True)
        new = written(new.select("*", bucket), "delta")
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most t.buckets
        if not touched:
            return []
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in t.key]
        old = self.store._rows(name, self.parts, touched).alias("o").join(new.select(*t.key).alias("n"), same, "left_anti")
        merged = old.unionByName(new.where("_kept").drop("_kept", "_bucket"))
        others = [p for p in self.parts if p.name != name or p.bucket not in set(touched)]
        self.parts = others + self._write_buckets(name, self._path(name), merged)
        return touched

    def compact(self, name: str, most: int = 32, merge: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Rewrites what has more than ``most`` parts as one part each: a table that
        is appended to, or buckets.  ``merge`` may fold its rows."""
        parts: dict[int | None, int] = {}
        for p in self.parts:
            if p.name == name:
                parts[p.bucket] = parts.get(p.bucket, 0) + 1
        many = {b for b, n in parts.items() if n > most}
        if not many:
            return
        own = [p for p in self.parts if p.name == name and p.bucket in many]
        self.replace(own, merge(self.store._rows(name, own)))

    def replace(self, parts: list[Part], rows: DataFrame) -> list[Part]:
        """Puts rows in place of some parts of one table; gives back the new parts."""
        name = parts[0].name
        path, gone = self._path(name), set(parts)
        if self.store.tables[name].key:
            new = self._write_buckets(name, path, rows)
        else:
            rows.hint("rebalance").write.parquet(path)
            new = [Part(name, None, path)]
        self.parts = [p for p in self.parts if p not in gone] + new
        return new

    def commit(self, stream: str | None = None, batch: int = 0) -> int:
        """Writes the ledger's next row, in one file, and with it the new version."""
        s = self.store
        batches = s.batches | ({stream: batch} if stream else {})
        row = (s.version + 1, batches, self.parts)
        s.spark.createDataFrame([row], _COMMIT).coalesce(1).write.mode("append").parquet(f"{s.path}/ledger")
        s.version, s.batches, s.parts = s.version + 1, batches, self.parts
        return s.version
