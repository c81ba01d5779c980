"""Filter interaction audit over a packed bitmap index.

Five filters judge each document; the audit tells, for each part of the table and each order of the filters, what every step
removes. A task turns its rows into blocks of packed bitsets: one for each filter's failures, one for each label, and one for each
part, which is a run of 64-bit words of its own, since a block's rows are laid out part by part and every part begins at a
word. What a set of filters leaves is `part AND NOT f AND NOT g ...`, counted by popcount. As the order within a prefix changes nothing, the
32 subsets are enough for all 120 orders. Counts are added over blocks, tasks and partitions; only they travel.

Filters, a document fails if: A: fewer than 50 words; B: 100 * distinct words < 65 * words; C: 100 * characters A-Z > 5 * code
points; D: any of # $ % & * |; E: its text is that of a row with a smaller doc_id. A null text is empty and fails A only (and E
after another empty one). A null doc_id is neither smaller than another nor has a smaller one, so it never fails E; rows that
repeat doc_id and text don't fail E by each other. A null source is the part "". A document counts as good or toxic if any label row of
its doc_id says so. An empty table gives no rows. Texts are read whole and once, and never shuffled: E compares SHA-256
digests, whose smallest doc_id is found by partial aggregation, so a group of copies costs one row a task. Only doc_id, text
and source are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, documents, slim, stored

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Rows of a block, and parts whose sums a task holds before it sends them.
BLOCK, PARTS = 1 << 16, 1 << 12

_UPPER, _MARKS, _TAILS = bytes(range(65, 91)), b"#$%&*|", bytes(range(128, 192))
FEATURES = "doc_id long, part string, fails int, sha binary"
COUNTS = T.StructType([T.StructField("part", T.StringType()), T.StructField("subset", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("kept", "good", "toxic")]])
STEPS = T.StructType([
    T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()),
    *[T.StructField(c, T.LongType()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")],
])


def failures(text: bytes) -> int:
    """The filters A to D that a text fails, as bits 0 to 3."""
    words = text.split()  # of bytes: at [\x20\x09-\x0D] exactly
    n, chars = len(words), len(text.translate(None, _TAILS))
    upper = len(text) - len(text.translate(None, _UPPER))
    marked = len(text.translate(None, _MARKS)) < len(text)
    return (n < 50) | (100 * len(set(words)) < 65 * n) << 1 | (100 * upper > 5 * chars) << 2 | marked << 3


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in bounded(whole, 2, 4096):
            texts = batch.column(2).to_pylist()
            fails = pa.array([failures(t) for t in texts], pa.int32())
            sha = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fails, sha], ["doc_id", "part", "fails", "sha"])


class Bitmaps:
    """A block's bitsets. flags: the rows' failing filters (bits 0 to 4), good (5) and toxic (6); part: the rows' parts as numbers below n."""

    def __init__(self, flags: np.ndarray, part: np.ndarray, n: int) -> None:
        order = np.argsort(part, kind="stable")
        rows = np.bincount(part, minlength=n)
        words = -(-rows // 64)
        self.starts = np.cumsum(words) - words
        place = np.arange(len(part)) - np.repeat(np.cumsum(rows) - rows, rows) + np.repeat(64 * self.starts, rows)
        self.size = int(words.sum())
        flags = flags[order]

        def packed(chosen: np.ndarray) -> np.ndarray:
            bits = np.zeros(64 * self.size, np.uint8)
            bits[place] = chosen
            return np.packbits(bits, bitorder="little").view("<u8")

        self.every = packed(np.ones(len(part), np.uint8))
        self.filters = [packed(flags >> i & 1) for i in range(len(FILTERS))]
        self.good, self.toxic = (packed(flags >> i & 1) for i in (5, 6))

    def count(self, bits: np.ndarray) -> np.ndarray:
        """The set bits of each part; every part has rows, so none of its runs of words is empty."""
        return np.add.reduceat(np.bitwise_count(bits).astype(np.int64), self.starts)

    def survivors(self) -> np.ndarray:
        """[part, subset, (all, good, toxic)]: what is left when the filters of a subset are through."""
        left = [self.every]
        out = np.empty((len(self.starts), SUBSETS, 3), np.int64)
        for s in range(SUBSETS):
            if s:
                last = s.bit_length() - 1
                left.append(left[s ^ 1 << last] & ~self.filters[last])
            for k, bits in enumerate((left[s], left[s] & self.good, left[s] & self.toxic)):
                out[:, s, k] = self.count(bits)
        return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    held: list[pa.RecordBatch] = []
    rows = 0

    def block() -> None:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        coded = t["part"].combine_chunks().dictionary_encode()
        flags = t["flags"].to_numpy().astype(np.uint8)
        found = Bitmaps(flags, coded.indices.to_numpy(), len(coded.dictionary)).survivors()
        for name, x in zip(coded.dictionary.to_pylist(), found, strict=True):
            sums[name] = sums[name] + x if name in sums else x

    def flush() -> pa.RecordBatch:
        names, x = list(sums), np.stack(list(sums.values()))
        sums.clear()
        part = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), SUBSETS)))
        subset = pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(names)))
        return pa.RecordBatch.from_arrays([part, subset, *[pa.array(x[:, :, k].ravel()) for k in range(3)]], COUNTS.names)

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            held.append(batch.slice(at, BLOCK))
            rows += held[-1].num_rows
            if rows >= BLOCK:
                block()
                rows = 0
                if len(sums) >= PARTS:
                    yield flush()
    if rows:
        block()
    if sums:
        yield flush()


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part's survivors by subset: every order's steps."""
    n, full = len(FILTERS), SUBSETS - 1
    orders = list(permutations(range(n)))
    names = pa.array(["".join(FILTERS[f] for f in o) for o in orders])
    f = np.array(orders)
    after = np.bitwise_or.accumulate(1 << f, axis=1)
    before = after ^ 1 << f
    label = names.take(pa.array(np.repeat(np.arange(len(orders)), n)))
    step = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)))
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            kept = np.zeros((SUBSETS, 3), np.int64)
            for x in counts:
                kept[x["subset"]] = x["kept"], x["good"], x["toxic"]
            lost = kept[before] - kept[after]
            failing = kept[0, 0] - kept[1 << np.arange(n), 0]
            only = np.array([kept[full ^ 1 << i, 0] - kept[full, 0] for i in range(n)])
            shapley = np.array([sum(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * int(kept[s, 0] - kept[s | 1 << i, 0]) for s in range(SUBSETS) if not s >> i & 1) for i in range(n)])
            columns = kept[after, 0], lost[..., 0], failing[f] - lost[..., 0], only[f], lost[..., 1], lost[..., 2], shapley[f]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(label), pa.string()), label, step, *[pa.array(c.ravel()) for c in columns]], STEPS.names)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, flags per document: failing filters A to E in bits 0 to 4, good in 5, toxic in 6."""
    d = slim(docs, "doc_id", "source", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = stored(d.mapInArrow(_judge, FEATURES), "judged")
    first = rows.filter("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("first")).select("sha", "first", F.lit(0).alias("again"))
    told = labels.groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # a row is the first of its text if its own id is: joined by doc_id, so that a large group of copies meets nowhere
    out = rows.join(first.withColumnRenamed("sha", "its"), (F.col("doc_id") == F.col("first")) & (F.col("sha") == F.col("its")), "left").join(told, F.col("doc_id") == F.col("of"), "left")
    again = F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("again", F.lit(1)))
    bit = F.col("fails") + 16 * again + 32 * F.coalesce("good", F.lit(0)) + 64 * F.coalesce("toxic", F.lit(0))
    return out.select("part", bit.cast("int").alias("flags"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part."""
    counts = judged(docs, labels).mapInArrow(_index, COUNTS).groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])
    per = counts.groupBy("part").agg(F.collect_list(F.struct("subset", "kept", "good", "toxic")).alias("counts"))
    return per.mapInArrow(_orders, STEPS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
d AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
j AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM j GROUP BY ALL),
f AS (SELECT i, 1 << i AS bit, chr(CAST(65 + i AS INT)) AS name FROM range(5) t(i)),
o AS (SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, a.name || b.name || c.name || d.name || e.name AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM o, range(1, 6) t(k)),
r AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (fails & bit > 0 AND fails & before = 0), 0) AS removed,
  coalesce(sum(n) FILTER (fails & bit > 0 AND fails & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (fails & bit > 0 AND fails & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails & bit > 0 AND fails & before = 0), 0) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
