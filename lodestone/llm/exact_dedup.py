"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Each task hashes its normalised texts to short fingerprints, sorts the distinct ones, cuts them by owner (a range of
   the fingerprint space) and stores per owner one message: gaps in Golomb-Rice code, with the rows' ids beside it.
2. An owner decodes its messages and answers each with a bitmap of the fingerprints that occur more than once.
   A sender sends each fingerprint once, however many copies it holds, so a hot text costs one code per sender.
3. Rows whose bit is set are suspects. Only their texts are shuffled, and grouped by their bytes.

Very long texts are hashed and compared whole, an empty table gives no row, and only doc_id and text are read, so other
columns may have any name. Null text counts as empty. Rows that repeat both doc_id and text are copies of each other: each comes back, the first
as kept. Null doc_ids are ordinary rows; a null keep_id arises only where all copies have a null doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS, Stored, documents, slim, stored, unused

#: Rows from which on owners and senders take more of them.
WIDE = 1 << 31

PACKS = T.StructType([
    T.StructField("sender", T.LongType()), T.StructField("owner", T.IntegerType()), T.StructField("n", T.IntegerType()),
    T.StructField("k", T.IntegerType()), T.StructField("unary", T.BinaryType()), T.StructField("rest", T.BinaryType()),
    T.StructField("own", T.BinaryType()), T.StructField("grp", T.ArrayType(T.IntegerType())),
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("shas", T.ArrayType(T.StringType())),
])
BITMAPS = T.StructType([T.StructField("sender", T.LongType()), T.StructField("owner", T.IntegerType()), T.StructField("dup", T.BinaryType())])
ROWS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_sha256", T.StringType()), T.StructField("suspect", T.BooleanType())])


def golomb_encode(values: np.ndarray, low: int) -> tuple[int, bytes, bytes]:
    """Rice parameter, unary quotients and binary remainders of the gaps of ascending distinct uint64 values from low on."""
    gaps = np.diff(values, prepend=np.uint64(low))
    gaps[1:] -= np.uint64(1)
    k = max(0, int(gaps.mean()).bit_length() - 1) if len(gaps) else 0
    q = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(q.sum()) + len(q), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    bits = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return k, np.packbits(unary).tobytes(), np.packbits(bits.astype(np.uint8)).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, rest: bytes, low: int) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
        gaps |= (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    gaps[1:] += np.uint64(1)
    return np.cumsum(gaps) + np.uint64(low)


def _pack(bits: int, owners: int, chunk: int):
    span = -(-(1 << bits) // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, turn, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            fp = t["fp"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            order = np.argsort(fp, kind="stable")
            t, fp = t.take(pa.array(order)), fp[order]
            distinct, grp, counts = np.unique(fp, return_inverse=True, return_counts=True)
            owner = (distinct // np.uint64(span)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            starts = np.concatenate([[0], np.cumsum(counts)])
            out = {name: [] for name in PACKS.names}
            for a, b in zip(cuts, [*cuts[1:], len(distinct)], strict=True):
                k, unary, rest = golomb_encode(distinct[a:b], int(owner[a]) * span)
                i, j = int(starts[a]), int(starts[b])
                values = ((part << 24) + turn, int(owner[a]), int(b - a), k, unary, rest, np.packbits(counts[a:b] > 1).tobytes(), grp[i:j] - a)
                for name, v in zip(PACKS.names, values, strict=False):
                    out[name].append(v)
                out["ids"].append(t["doc_id"][i:j].to_pylist())
                out["shas"].append(t["sha"][i:j].to_pylist())
            turn += 1
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], ty) for n, ty in zip(PACKS.names, types, strict=True)], PACKS.names)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= chunk:
                yield from flush()
                rows = 0
        if rows:
            yield from flush()

    return run


def _answer(bits: int, owners: int):
    span = -(-(1 << bits) // owners)

    def run(table: pa.Table) -> pa.Table:
        m = table.to_pydict()
        low = m["owner"][0] * span
        codes = [golomb_decode(*x, low) for x in zip(m["n"], m["k"], m["unary"], m["rest"], strict=True)]
        own = [np.unpackbits(np.frombuffer(o, np.uint8))[:n].astype(bool) for o, n in zip(m["own"], m["n"], strict=True)]
        _, at, counts = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        dup = (counts > 1)[at]
        cuts = np.cumsum([len(c) for c in codes])[:-1]
        maps = [np.packbits(d | o).tobytes() for d, o in zip(np.split(dup, cuts), own, strict=True)]
        return pa.table({"sender": pa.array(m["sender"], pa.int64()), "owner": pa.array(m["owner"], pa.int32()), "dup": pa.array(maps, pa.binary())})

    return run


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            bits = np.unpackbits(np.frombuffer(row["dup"], np.uint8))[: row["n"]].astype(bool)
            suspect = bits[np.asarray(row["grp"], np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["shas"], pa.string()), pa.array(suspect)], ROWS.names)


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WS + "+", " ")


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = lambda x: F.sha2(x, 256), *, spare_bits: int = 14, owner_rows: int = 1 << 21, chunk_rows: int = 1 << 19) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    spare_bits: fingerprints have log2(rows) + spare_bits bits, so about one row in 2^spare_bits is a needless suspect.
    owner_rows: rows per owner, which bounds its memory, and chunk_rows: rows per sender; above WIDE rows both grow with the
    root of the rows, up to eightfold, so that messages, a sender's to each owner, don't grow with the square. digest: names a text in joins; texts that share a digest are told
    apart by their bytes.
    """
    d = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm"))
    n = max(1, docs.count())
    owner_rows, chunk_rows = (min(8 * x, int(x * max(1.0, (n / WIDE) ** 0.5))) for x in (owner_rows, chunk_rows))
    bits = min(62, max(16, n.bit_length() + spare_bits))
    owners = -(-n // owner_rows)
    hashed = d.select("doc_id", digest(F.col("norm")).alias("sha"), F.xxhash64("norm").alias("fp"))
    packs = Stored(hashed.mapInArrow(_pack(bits, owners, chunk_rows), PACKS), "packs")
    sent = packs.df.select("sender", "owner", "n", "k", "unary", "rest", "own")
    answers = sent.groupBy("owner").applyInArrow(_answer(bits, owners), BITMAPS)
    back = packs.df.select("sender", "owner", "n", "grp", "ids", "shas").join(answers, ["sender", "owner"])
    rows = Stored(back.mapInArrow(_suspects, ROWS), "suspects").df
    packs.drop()

    names = rows.filter("suspect").select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("s")).distinct()
    texts = d.withColumn("sha", digest(F.col("norm")))
    texts = texts.join(names, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s")), "left_semi")
    classes = texts.groupBy("sha", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    by_sha = stored(classes.groupBy("sha").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")), "classes")
    row = rows.groupBy("doc_id", "text_sha256", "suspect").agg(F.count("*").alias("times"))
    out = row.join(by_sha.filter("texts = 1").withColumnRenamed("sha", "text_sha256"), "text_sha256", "left")
    out = out.select("doc_id", "text_sha256", "times", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", "times").alias("group_size"))
    if clashes := by_sha.filter("texts > 1").limit(1).count():
        bad = by_sha.filter("texts > 1").select("sha")
        told = texts.join(bad, "sha", "left_semi").groupBy("doc_id", "sha", "norm").agg(F.count("*").alias("times"))
        told = told.join(classes.join(bad, "sha", "left_semi"), ["sha", "norm"]).select("doc_id", F.col("sha").alias("text_sha256"), "times", "keep_id", "group_size")
        out = out.join(bad.withColumnRenamed("sha", "text_sha256"), "text_sha256", "left_anti").unionByName(told)
    assert clashes in (0, 1)
    out = out.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; one row of each group of equal texts."""
    id_, sha, many, own = unused(docs, "kept_id", "kept_sha", "kept_many", "own_sha")
    names = exact_groups(docs).filter("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha), (F.col("group_size") > 1).alias(many))
    mine = docs.withColumn(own, F.sha2(normalised(), 256))
    stay = mine.join(names, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(sha)))
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():  # rows that repeat a doc_id and a text stay once
        stay = stay.filter(~F.col(many)).unionByName(stay.filter(F.col(many)).dropDuplicates(["doc_id", own]))
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
