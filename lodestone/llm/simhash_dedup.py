"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints are collapsed to distinct ones first, so copies never meet in a bucket. For radius r each of the 64 bits
gets a vector m(i) of r+1 bits, and each non-zero v of r+1 bits makes a table that keeps the bits with <m(i), v> = 1.
Up to r differing bits always leave some v orthogonal to their vectors, whose table then keeps none of them: every pair
within the radius collides in at least one table. Buckets of up to BUCKET fingerprints are compared outright and give a
spanning forest of their links. Larger buckets take another exact way: two fingerprints differ in at most two bits if
and only if some word is within one bit of both, so each fingerprint emits itself and its one-bit neighbours (over the
bits that its table drops) as keys, and the at most 65 fingerprints of a key, all linked, form a star.

Very long texts are read whole, their hashes counted in pieces; an empty table gives no row; only doc_id and text are read, so
other columns may have any name. Null or wordless texts have the fingerprint zero, linked like any other. Rows repeating a doc_id come back each, with a
fingerprint of their own and the component that it lies in. A null doc_id comes back; it is never the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import EDGE, Stored, _forest, connected_components, documents, slim, stored, unused

RADIUS = 2
BUCKET = 512
FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])


def simhash(text: str | None, width: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the text's word shingles; 0 without words."""
    from xxhash import xxh64_intdigest as h

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    if len(w) <= width:
        return h(b" ".join(w), 42)
    whole = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    ones = np.zeros(64, np.int64)
    hashes = np.array([h(whole[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], "<u8")
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.array([simhash(x) for x in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], FINGERPRINTS.names)


def masks(radius: int = RADIUS) -> list[int]:
    """The tables' masks, as unsigned 64-bit words: one for each non-zero vector of radius + 1 bits."""
    vectors = [v for v in product((0, 1), repeat=radius + 1) if any(v)]
    dealt = [vectors[i * 5 % len(vectors)] for i in range(64)]
    return [sum(1 << i for i in range(64) if sum(a * b for a, b in zip(dealt[i], v, strict=True)) % 2) for v in vectors]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links in each bucket."""
    for batch in batches:
        col = batch.column(0)
        offsets, values = col.offsets.to_numpy(), col.values.to_numpy().view(np.uint64)
        left, right = [], []
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            x = values[s:e]
            i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= RADIUS, 1))
            if len(i):
                a, b = _forest(x[i].view(np.int64), x[j].view(np.int64)) if len(i) > 1 else (x[i].view(np.int64), x[j].view(np.int64))
                left.append(a)
                right.append(b)
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], EDGE.names)


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) over distinct fingerprints fp that connect exactly the pairs within RADIUS bits, directly or by others."""
    tables = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(signed(m)).alias("m")) for v, m in enumerate(masks())])
    keys = distinct.select("fp", F.explode(tables).alias("t")).select("t.v", "t.m", F.col("fp").bitwiseAND(F.col("t.m")).alias("key"), "fp")
    sizes = Stored(keys.groupBy("v", "key").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    small = keys.join(sizes.df.filter(F.col("size") <= bucket), ["v", "key"], "left_semi").groupBy("v", "key").agg(F.collect_list("fp").alias("fps"))
    edges = small.select("fps").mapInArrow(_compare, EDGE)
    large = keys.join(sizes.df.filter(F.col("size") > bucket), ["v", "key"], "left_semi")
    flips = F.concat(F.array(F.lit(0).cast("long")), F.filter(F.array(*[F.lit(signed(1 << i)) for i in range(64)]), lambda x: x.bitwiseAND(F.col("m")) == 0))
    near = large.select("v", "fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("middle"))
    stars = near.groupBy("v", "middle").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return edges.union(stars)


def near_groups(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, fp (the fingerprint as a long)."""
    d = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = stored(d.mapInArrow(_fingerprint, FINGERPRINTS), "simhash")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links(distinct, bucket))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(ids, "root").select("fp", "component_id")
    out = prints.join(by_fp, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each component the row with the smallest doc_id, with all its columns."""
    (name,) = unused(docs, "stay_id")
    stay = near_groups(docs).filter("doc_id <=> component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(stay, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():  # a doc_id that repeats stays once
        kept = kept.dropDuplicates(["doc_id"])
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).drop("fp")
