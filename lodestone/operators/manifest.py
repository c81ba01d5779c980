"""Versioned tables: immutable data folders, and a manifest for each version that says which of them make up the table.

A version is published by renaming its finished manifest to the version's number, which fails where that number is taken already; so
of two writers one wins, and the other has to look at the new state first. Readers name the folders of one version, which no
later write touches: they keep their snapshot. What was written but never published is not part of any version.

KeyedTable deals its rows to a fixed number of buckets by key; an upsert rewrites only the buckets that its rows fall into. A
batch's number, its stream's offset and the writer's fencing token are published in the same manifest as its rows, so a batch
that is replayed after a crash, before or after the publication, changes the table once, and a worker with an older token
changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer published this version first."""


class StaleWriter(RuntimeError):
    """The writer's token is older than the one that the table was last written with."""


class Manifest:
    """Numbered JSON documents in a folder, through Hadoop's file system API."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._folder = self._hadoop.Path(f"{self.path}/versions")
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, version: int) -> Any:
        return self._hadoop.Path(self._folder, f"{version:012d}.json")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._folder))
        return sorted(int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit())

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """A version's number and content, the latest one's where none is named; -1 and nothing where there is none."""
        if version is None:
            version = max(self.versions(), default=-1)
        if version < 0:
            return -1, {}
        stream = self._fs.open(self._file(version))
        try:
            return version, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, after: int, content: dict) -> int:
        """Makes content the version that follows `after`; Conflict where that version exists."""
        self._fs.mkdirs(self._folder)
        draft = self._hadoop.Path(self._folder, f"draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(content, sort_keys=True).encode())
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._folder.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(draft, self._file(after + 1), none)
        except Exception as e:  # py4j wraps whatever the file system throws
            self._fs.delete(draft, False)
            if after + 1 in self.versions():
                raise Conflict(f"version {after + 1} of {self.path} exists") from e
            raise
        return after + 1

    def change(self, make: Callable[[dict], dict | None], tries: int = 20) -> int:
        """Publishes make(latest content), again on the newest content where another writer came first; None changes nothing."""
        for _ in range(tries):
            version, content = self.read()
            new = make(content)
            if new is None:
                return version
            try:
                return self.publish(version, new)
            except Conflict:
                continue
        raise Conflict(f"{self.path} changes too fast")

    def remove(self, folder: str) -> None:
        self._fs.delete(self._hadoop.Path(folder), True)

    def folders(self, under: str) -> list[str]:
        p = self._hadoop.Path(f"{self.path}/{under}")
        return [s.getPath().toString() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []


BUCKET, GONE = "__bucket", "__gone"


class KeyedTable:
    """A table with one row for each key."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.manifest = spark, Manifest(spark, path)
        content = self.manifest.read(0)[1] if self.manifest.versions() else None
        if content is None:
            raise ValueError(f"no table at {path}")
        self.schema = T.StructType.fromJson(content["schema"])
        self.keys, self.buckets = content["keys"], content["buckets"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], buckets: int = 16) -> KeyedTable:
        """buckets: so many that one fits a few tasks; it can't change later."""
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        Manifest(spark, path).publish(-1, {"schema": json.loads(kind.json()), "keys": keys, "buckets": buckets, "data": {}, "applied": {}, "offsets": {}, "token": 0})
        return cls(spark, path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, paths: list[str]) -> DataFrame:
        """Stored rows, those of deleted keys included: their places in the order are needed when a late row comes."""
        whole = T.StructType([*self.schema.fields, T.StructField(GONE, T.BooleanType())])
        return self.spark.read.schema(whole).parquet(*paths) if paths else self.spark.createDataFrame([], whole)

    def read(self, version: int | None = None) -> DataFrame:
        content = self.manifest.read(version)[1]
        return self._rows(sorted(content["data"].values())).filter(f"NOT {GONE}").drop(GONE)

    def offset(self, stream: str) -> Any:
        """What the stream's last applied batch published as its place."""
        return self.manifest.read()[1]["offsets"].get(stream)

    def upsert(self, rows: DataFrame, order: list[str], *, gone: Column | None = None, newer: bool = False, stream: str = "", batch: int | None = None, offset: Any = None, token: int | None = None, before_publish: Callable[[], None] | None = None) -> int:
        """Rows replace those of their keys; of several rows of a key the last by `order` counts, and where `gone` holds the key
        is deleted. newer: rows of the table take part in that order, deleted ones, too, so that a late row replaces no later one and brings no
        deleted key back.
        stream, batch: a batch that isn't after the stream's last one changes nothing. token: see StaleWriter.
        before_publish: called between writing and publishing, for tests of a crash there."""
        kept = [c for c in self.schema.names if c not in self.keys]
        flagged = rows.withColumn(GONE, F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False))
        flagged = flagged.select(*self.schema.names, GONE, self._bucket().alias(BUCKET))
        mine = last_rows(flagged, self.keys, order, [*kept, GONE, BUCKET])
        touched = sorted(r[0] for r in flagged.select(BUCKET).distinct().collect())  # at most `buckets` numbers

        def make(content: dict) -> dict | None:
            if batch is not None and content["applied"].get(stream, -1) >= batch:
                return None
            if token is not None and token < content["token"]:
                raise StaleWriter(f"token {token} is older than {content['token']}")
            data = dict(content["data"])
            if touched:
                old = self._rows([data[str(b)] for b in touched if str(b) in data]).withColumn(BUCKET, self._bucket())
                if newer:
                    merged = last_rows(old.unionByName(flagged), self.keys, order, [*kept, GONE, BUCKET])
                else:
                    merged = old.join(mine.select(*self.keys), self.keys, "left_anti").unionByName(mine)
                out = f"{self.manifest.path}/data/{uuid.uuid4().hex}"
                merged.select(*self.schema.names, GONE, BUCKET).repartition(BUCKET).write.partitionBy(BUCKET).parquet(out)
                there = {p.rsplit("=", 1)[1]: p for p in self.manifest.folders(out.removeprefix(f"{self.manifest.path}/")) if f"{BUCKET}=" in p}
                for b in map(str, touched):
                    data.pop(b, None)
                    if b in there:
                        data[b] = there[b]
            if before_publish:
                before_publish()
            new = content | {"data": data}
            if batch is not None:
                new["applied"] = content["applied"] | {stream: batch}
            if offset is not None:
                new["offsets"] = content["offsets"] | {stream: offset}
            if token is not None:
                new["token"] = token
            return new

        return self.manifest.change(make)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the last `keep` versions names; the number of them. No writer may be at work."""
        named = {p.rsplit("/", 1)[0].rsplit("/", 1)[-1] for v in self.manifest.versions()[-keep:] for p in self.manifest.read(v)[1]["data"].values()}
        old = [p for p in self.manifest.folders("data") if p.rsplit("/", 1)[-1] not in named]
        for p in old:
            self.manifest.remove(p)
        return len(old)


def last_rows(rows: DataFrame, keys: list[str], order: list[str], rest: list[str]) -> DataFrame:
    """The last row of each key by order, ties by all columns."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) if c not in keys else F.col(c) for c in rest])


def upsert_stream(stream: DataFrame, table: KeyedTable, order: list[str], name: str, checkpoint: str, **options: Any) -> Any:
    """A query that upserts each micro-batch once, however often it is replayed; started, to be awaited by the caller."""

    def each(rows: DataFrame, batch: int) -> None:
        table.upsert(rows, order, stream=name, batch=batch, offset=batch, **options)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
