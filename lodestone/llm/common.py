"""Shared helpers: stored intermediate tables, row keys, connected components."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The contracts' white space class, for Java regular expressions.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"

_live: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = f"file:///tmp/lodestone-{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a stored table through Hadoop's file system API, which also reaches remote stores."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _live:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Bounds what one Arrow batch of texts holds, on the JVM's side and on Python's, for what runs inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def arrow_bytes(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Bounds an Arrow batch by bytes, for rows that are large or small, for what runs inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bounded(batch: pa.RecordBatch, column: int, rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `rows` rows and about `size` bytes of a text or binary column each; at least a row."""
    ends = np.cumsum(pc.binary_length(batch.column(column).fill_null("" if pa.types.is_string(batch.column(column).type) else b"")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = min(batch.num_rows, at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, to - at)
        at = to


class Stored:
    """A DataFrame written as Parquet into the shared folder: its lineage ends here, and lost executors lose nothing."""

    def __init__(self, df: DataFrame, name: str, **options: str) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/lodestone/{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        with arrow_rows(self.spark):
            df.write.options(**options).parquet(self.path)
        _live.append((self.spark, self.path))

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)
        _live.remove((self.spark, self.path))


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    return Stored(df, name, **options).df


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished plans now instead of at some later garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of the input's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def slim(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra or clashing ones never reach an operator; a missing source or lang is null."""
    have = {c.lower() for c in docs.columns}
    return docs.select(*[F.col(c) if c.lower() in have else F.lit(None).cast("string").alias(c) for c in columns])


def held_out_modulus(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node of its component) of the graph with edges (a, b)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(a)
    x, y = flat[:n], flat[n:]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before[x], low)
        np.minimum.at(label, before[y], low)
        while not np.array_equal(up := label[label], label):
            label = up
        if np.array_equal(label, before):
            break
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def contract(edges: DataFrame) -> DataFrame:
    """Each task's edges, a bounded number at a time, reduced to stars that connect the same nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                ab = np.concatenate(held)
                a, b = _forest(ab[:, 0], ab[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                held.clear()

        for batch in batches:
            held.append(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]))
            n += batch.num_rows
            if n >= 1 << 20:
                yield from flush()
                n = 0
        yield from flush()

    return edges.mapInArrow(run, EDGE)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge (a, b: long), root the least node of its component.

    Alternates the large-star and small-star steps, each a keyed minimum and a join, after each task has reduced
    its own edges to stars; every round is a stored table. Rows without an edge to another node don't come back.
    """
    first = contract(edges.select("a", "b").filter("a <> b"))
    now = Stored(first.filter("a > b").distinct(), "cc")
    for _ in range(most_rounds):
        e = now.df
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(low.filter("a <> m").select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        new = Stored(small.union(low2.select("a", F.col("m").alias("b"))).distinct(), "cc")
        sums = "count(1) AS n", "bit_xor(xxhash64(a, b)) AS x"
        same = now.df.selectExpr(*sums).first() == new.df.selectExpr(*sums).first()
        now.drop()
        now = new
        if same:
            return now.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle; raise most_rounds")
