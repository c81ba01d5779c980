"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of its documents' ids in one fixed order. Its stream of T_s ids is cut into P blocks at
floor(p * T_s / P): block p of every source goes to packing partition p, so that each partition holds the target mixture
and what rounding leaves, the fraction of p * T_s / P, is the deficit with which a source enters partition p. Inside a
partition each round adds to every source its share of a window as credit; a source is served once its credit reaches
MIN_PIECE ids, so pieces are that long unless a document or a window ends, and what it is still owed is carried on. Windows
are full; what is left at the end of a partition is cut into sequences whose lengths are powers of two, so nothing is padded.

A null text is empty and gives its end id alone; an empty table gives no piece. A null source is a queue of its own. Rows
that repeat a doc_id, or doc_id and text, are documents of their own, in the order in which their tasks read them. A very long
text is encoded whole and cut at the partitions' borders. Only doc_id, source and text are read, so other columns may have any
name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, bounded, documents, slim, stored
from .tokens import encoder, vocabulary_path

MIN_PIECE = 32

TOKENS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("part", T.IntegerType()),
    T.StructField("local", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()),
])
QUEUED = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("source", T.StringType()), T.StructField("at", T.LongType()), T.StructField("share", T.DoubleType()),
    T.StructField("credit", T.DoubleType()), T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
])
PIECES = T.StructType([T.StructField(c, T.StringType() if c == "source" else T.LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")])


def _encode(path: str, end: int, wide: int):
    kind = f"<u{wide}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, tail, ends = TaskContext.get().partitionId(), encoder(path), np.array([end], "<u4").tobytes(), {}
        for whole in batches:
            for batch in bounded(whole, 2, 512):
                found = [np.frombuffer(x + tail, "<u4").astype(kind).tobytes() for x in enc.encode(batch.column(2).to_pylist())]
                local = []
                for s, x in zip(batch.column(1).to_pylist(), found, strict=True):
                    local.append(ends.get(s, 0))
                    ends[s] = local[-1] + len(x) // wide
                n = pa.array([len(x) // wide for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([part] * len(found), pa.int32()), pa.array(local, pa.int64()), n, pa.array(found, pa.binary())], TOKENS.names)

    return run


def _deal(blocks: int, total: int, wide: int):
    """Cuts each document at its source's block boundaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                u, all_, stop = r["before"] + r["local"], r["of_source"], r["before"] + r["local"] + r["n"]
                at = u
                while at < stop:
                    p = ((at + 1) * blocks - 1) // all_
                    to = min(stop, (p + 1) * all_ // blocks)
                    out.append((p, r["source"], at, all_ / total, p * all_ % blocks / blocks, r["doc_id"], at - u, r["n"], r["ids"][wide * (at - u) : wide * (to - u)]))
                    at = to
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(QUEUED.names, x, strict=True)) for x in out], pa.schema([("block", pa.int64()), ("source", pa.string()), ("at", pa.int64()), ("share", pa.float64()), ("credit", pa.float64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]))

    return run


def sizes(total: int, window: int) -> list[int]:
    """Full windows, then the powers of two of what is left, the largest first."""
    left = total % window
    return [window] * (total // window) + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def round_robin(queues: list[list[int]], shares: list[float], credit: list[float], window: int, least: int = MIN_PIECE) -> np.ndarray:
    """Rows (window, queue, item, start in the item, length) in the order of the windows' content; every id once.

    A round gives every source its share of a window as credit. A source is served all its whole credit once that reaches
    `least`; since credit grows by a constant, that is every so many rounds, and what a source has got after each round has
    a closed form. The rounds' pieces follow one another and are cut where windows end."""
    total = sum(map(sum, queues))
    rounds = max(1, -(-total // window))
    parts = []
    for s, (queue, share, owed) in enumerate(zip(queues, shares, credit, strict=True)):
        ends = np.cumsum(np.array(queue, np.int64))
        every = max(1, math.ceil(least / max(share * window, 1e-9))) if share * window < least else 1
        # the rounds in which a source is served, no more than its ids can fill, and the last one
        most = int((ends[-1] - owed) // max(share * window * every, 1e-9)) + 2
        turn = np.arange(every - s % every, rounds, every)[:most]
        turn = np.append(turn, rounds)
        got = np.maximum(0, np.minimum(ends[-1], np.floor(share * window * turn + owed).astype(np.int64)))
        got[-1] = ends[-1]
        cuts = np.unique(np.concatenate([ends, got[got > 0]]))
        begin = np.concatenate([[0], cuts[:-1]])
        item = np.searchsorted(ends, begin, side="right")
        parts.append((turn[np.searchsorted(got, begin, side="right")], np.full(len(cuts), s), item, begin - np.concatenate([[0], ends])[item], cuts - begin))
    at, queue, item, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, item, queue, at))
    queue, item, start, n = queue[order], item[order], start[order], n[order]
    edges = np.cumsum(sizes(total, window))
    stop = np.cumsum(n)
    to = np.union1d(stop, edges)
    begin = np.concatenate([[0], to[:-1]])
    k = np.searchsorted(stop, begin, side="right")
    return np.column_stack([np.searchsorted(edges, begin, side="right"), queue[k], item[k], start[k] + begin - (stop - n)[k], to - begin])


def _pack(window: int, per_block: int, least: int, wide: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.select([c for c in QUEUED.names if c != "ids"]).to_pydict()
        ids = table["ids"].combine_chunks() if table.num_rows else table["ids"]
        block = rows["block"][0]
        order = sorted(range(table.num_rows), key=lambda i: (rows["source"][i] is None, rows["source"][i] or "", rows["at"][i]))
        by_source: dict[str | None, list[int]] = {}
        for i in order:
            by_source.setdefault(rows["source"][i], []).append(i)
        items = list(by_source.values())
        data = [np.frombuffer(ids[i].as_buffer(), f"<u{wide}").astype("<u4").view(np.uint8).data for i in range(table.num_rows)]
        queues = [[len(data[i]) // 4 for i in q] for q in items]
        first = [q[0] for q in items]
        w, q, k, at, n = round_robin(queues, [rows["share"][i] for i in first], [rows["credit"][i] for i in first], window, least).T
        bounds = np.cumsum([0, *map(len, items)])[:-1]
        item = np.array([i for mine in items for i in mine], np.int64)[bounds[q] + k]
        stop = np.cumsum(n)
        opened = np.flatnonzero(np.diff(w, prepend=-1))  # the first piece of each sequence
        offset = stop - n - np.repeat((stop - n)[opened], np.diff(np.append(opened, len(w))))
        crc = [zlib.crc32(data[i][a:b]) for i, a, b in zip(item.tolist(), (4 * at).tolist(), (4 * (at + n)).tolist(), strict=True)]
        of = table.select(["doc_id", "start", "doc_tokens", "source"]).take(pa.array(item))
        start = pa.array(of["start"].to_numpy() + at)
        return pa.table([of["doc_id"], start, pa.array(n), pa.array(crc, pa.int64()), of["doc_tokens"], pa.array(block * per_block + w), pa.array(offset), of["source"]], PIECES.names)

    return run


def packed(docs: DataFrame, *, vocabulary: str | None = None, end_id: int = 0, window: int = 1024, block_windows: int = 1024, least: int = MIN_PIECE) -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source. block_windows: windows of a
    packing partition, which bounds its memory."""
    d = slim(docs, "doc_id", "source", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    path = vocabulary or vocabulary_path()
    wide = 2 if max(encoder(path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4  # bytes that an id takes
    tokens = stored(d.mapInArrow(_encode(path, end_id, wide), TOKENS), "tokens")
    parts = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("source")
    starts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), (F.sum("n").over(by.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(by).alias("of_source"))
    starts = Stored(starts, "starts").df
    total = starts.select("s", "of_source").distinct().agg(F.sum("of_source")).first()[0] or 0
    blocks = max(1, -(-total // (window * block_windows)))
    placed = tokens.join(starts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).drop("s", "p")
    queued = placed.mapInArrow(_deal(blocks, total, wide), QUEUED)
    return queued.groupBy("block").applyInArrow(_pack(window, 2 * (block_windows + 64), least, wide), PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
