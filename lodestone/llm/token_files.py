"""Token ids in Parquet list columns, with chosen encodings, row groups and page indexes.

Layout of a folder written by write_tokens: files in ascending doc_id order, each sorted, with columns doc_id, part (the
file's place in that order), local_start (ids before the document in its part), n_tokens, ids list<int>. Ids are stored
by dictionary (encoding="dictionary") or by delta binary packing ("delta"); row groups and pages are bounded, and the page
indexes let a reader of a few doc_ids skip whole pages. A reader of metadata never touches the id pages.

A null text is empty: only the end id. Null doc_ids sort first; rows that share a doc_id come in the order of their texts, and
equal ones stand beside each other. A very long text is encoded whole, with few beside it; an empty table gives no rows. Only
doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _live, arrow_rows, bounded, documents, shared_dir, slim
from .tokens import encoder, vocabulary_path

FILES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
])
CRCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, enc, tail = TaskContext.get().partitionId(), 0, encoder(path), np.array([end], "<u4").tobytes()
        for whole in batches:
            for batch in bounded(whole, 1, 512):
                found = enc.encode(batch.column(1).to_pylist())
                n = np.fromiter((len(x) // 4 + 1 for x in found), np.int64, len(found))
                stops = np.cumsum(n)
                flat = np.frombuffer(b"".join(x + tail for x in found), "<i4")
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(at + stops - n), pa.array(n), ids], FILES.names)
                at += int(stops[-1])

    return run


def write_tokens(docs: DataFrame, path: str, *, vocabulary: str | None = None, end_id: int = 2, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 128 << 10, page_rows: int = 1000) -> None:
    """Encodes the documents and writes them as described above. Texts are shuffled once, by ranges of doc_id."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(encoding)
    d = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "parquet.writer.version": "v2" if encoding == "delta" else "v1", "parquet.enable.dictionary": encoding == "dictionary", "compression": "zstd"}
    with arrow_rows(docs.sparkSession):
        sorted_.mapInArrow(_encode(vocabulary or vocabulary_path(), end_id), FILES).write.options(**{k: str(v).lower() for k, v in options.items()}).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens; no page of ids is read."""
    return _started(read_tokens(spark, path).drop("ids"), spark, path).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows, or those of some doc_ids: the filter reaches the row groups' and pages' indexes."""
    rows = spark.read.schema(FILES).parquet(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def _started(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """rows with start: the totals of the parts before (one row a part) and the place in its own part."""
    parts = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return rows.join(before, "part").withColumn("start", F.col("before") + F.col("local_start"))


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = batch.column(4)
        data, cuts = memoryview(np.ascontiguousarray(col.values.to_numpy(), "<i4")).cast("B"), (4 * col.offsets.to_numpy().astype(np.int64)).tolist()
        crc = [zlib.crc32(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        n = np.diff(col.offsets.to_numpy()).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(crc, pa.int64())], CRCS.names)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    return _started(read_tokens(spark, path).mapInArrow(_check, CRCS), spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/lodestone/tokens-{uuid.uuid4().hex}"
    _live.append((spark, path))
    write_tokens(documents(spark, sf_dir), path)
    return digests(spark, path)
