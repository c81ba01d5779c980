"""Vectors: validity, exact cosine search, coverage, batching and activation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def unit(v: Column) -> Column:
    """The vector at length one; null where it isn't valid. The length is taken once, not for each element."""
    d = _double(v)
    length = F.array(_norm(d))
    return F.element_at(F.transform(length, lambda n: F.when(n > 0, F.transform(d, lambda x: x / n))), 1)


def valid(v: Column, dims: int) -> Column:
    d = _double(v)
    return (F.size(v) == dims) & ~F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (_norm(d) > 0)


def vector(embeddings: DataFrame, vec_id: int) -> list[float]:
    """One stored vector, as a request's."""
    row = embeddings.filter(F.col("vec_id") == vec_id).select("embedding").first()
    if row is None:
        raise ValueError(f"no vector {vec_id}")
    return [float(x) for x in row["embedding"]]


def similarity(embeddings: DataFrame, q: list[float]) -> DataFrame:
    """embeddings with s, their cosine with q, in double precision."""
    length = float(np.sqrt(np.sum(np.square(q))))
    v = _double(F.col("embedding"))
    dot = F.aggregate(F.zip_with(v, F.array(*map(F.lit, q)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return embeddings.withColumn("s", dot / (_norm(v) * length))


def top_k(embeddings: DataFrame, q: list[float], k: int) -> DataFrame:
    """vec_id, similarity, rank of the k nearest; ties by vec_id."""
    near = similarity(embeddings, q).select("vec_id", F.round("s", 6).alias("similarity"))
    order = F.desc("similarity"), F.asc("vec_id")
    return near.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and unit vectors in ascending order of id; vectors of length zero are left out."""
    ids, labels = t["vec_id"].to_numpy(), t["label"].to_numpy()
    flat = pc.list_flatten(t["embedding"]).to_numpy().astype(np.float64).reshape(len(ids), -1)
    length = np.linalg.norm(flat, axis=1)
    order = np.argsort(ids, kind="stable")
    order = order[length[order] > 0]
    return ids[order], labels[order], flat[order] / length[order, None]


def block_pairs(queries: DataFrame, corpus: DataFrame, choose: Callable[[np.ndarray], np.ndarray], *, decimals: int | None = 6, query_block: int = 8192, corpus_block: int = 1 << 16) -> DataFrame:
    """(q, vec_id, s, hit) for pairs of a query and another vector, as far as `choose` takes them of each query's similarities with
    a block in ascending order of vec_id (it returns places). hit: the labels are equal.

    Both sides are dealt to blocks of bounded size, and each pair of blocks meets in one task: queries are sent once for each block of the
    corpus, the corpus once for each block of queries; nothing passes the driver."""
    nq, nc = (max(1, -(-x.count() // n)) for x, n in ((queries, query_block), (corpus, corpus_block)))
    columns = [F.col(c).alias(c) for c in ("vec_id", "label", "embedding")]  # of their own, even where both sides come from one table
    q = queries.select(*columns, F.pmod(F.xxhash64("vec_id"), F.lit(nq)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nc - 1).cast("long"))).alias("cb"))
    c = corpus.select(*columns, F.pmod(F.xxhash64("vec_id"), F.lit(nc)).alias("cb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qb"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, ...] = [], [], [], []
        if a.num_rows and b.num_rows:
            (qi, ql, m), (ci, cl, v) = _matrix(a), _matrix(b)
            for at in range(0, len(qi), 64):
                s = m[at : at + 64] @ v.T
                s = s if decimals is None else np.round(s, decimals)
                for row, i, label in zip(s, qi[at : at + 64], ql[at : at + 64], strict=True):
                    row[ci == i] = -np.inf
                    found = choose(row)
                    found = found[np.isfinite(row[found])]
                    for o, x in zip(out, (np.full(len(found), i), ci[found], row[found], cl[found] == label), strict=True):
                        o.append(x)
        empty = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool)
        return pa.table({n: pa.array(np.concatenate([e, *o])) for n, o, e in zip(("q", "vec_id", "s", "hit"), out, empty, strict=True)})

    return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(run, "q long, vec_id long, s double, hit boolean")


def _best(k: int) -> Callable[[np.ndarray], np.ndarray]:
    def choose(row: np.ndarray) -> np.ndarray:
        """The k largest; of equal ones those that come first."""
        if len(row) <= k:
            return np.arange(len(row))
        least = np.partition(row, len(row) - k)[len(row) - k]
        above = np.flatnonzero(row > least)
        return np.concatenate([above, np.flatnonzero(row == least)[: k - len(above)]])

    return choose


def neighbours(queries: DataFrame, corpus: DataFrame, k: int, **blocks: int) -> DataFrame:
    """(q, hit, rk, vec_id, s): for each query its k nearest other vectors, ties by vec_id. Each pair of blocks keeps k of a query."""
    near = block_pairs(queries, corpus, _best(k), **blocks)
    w = Window.partitionBy("q").orderBy(F.desc("s"), "vec_id")
    return near.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).select("q", "hit", "rk", "vec_id", "s")


def within(queries: DataFrame, corpus: DataFrame, least: float, *, query_block: int = 512, corpus_block: int = 4096) -> DataFrame:
    """(q, vec_id, s): for each query every other vector whose cosine distance is at most 1 - least. All of a pair of blocks may be near enough, and
    a task holds what it finds, so the blocks are small."""
    near = block_pairs(queries, corpus, lambda row: np.flatnonzero(1 - row <= 1 - least), decimals=None, query_block=query_block, corpus_block=corpus_block)
    return near.select("q", "vec_id", "s")


# --- approximate search -------------------------------------------------------------------------------------------------


class InvertedLists:
    """Vectors in lists by their nearest of `lists` centroids, which a bounded sample trains; every vector is indexed.

    A search probes the lists whose centroids are nearest to a query and ranks what they hold exactly. Lists larger than `split` vectors
    are dealt to parts, each of which meets the query apart, so a hot list is no hot task."""

    def __init__(self, corpus: DataFrame, *, lists: int = 64, sample: int = 20_000, rounds: int = 8, split: int = 1 << 16, seed: int = 1) -> None:
        held = corpus.select("embedding").orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(sample).toArrow()
        flat = pc.list_flatten(held["embedding"]).to_numpy().astype(np.float64).reshape(held.num_rows, -1)
        length = np.linalg.norm(flat, axis=1)
        x = flat[length > 0] / length[length > 0, None]
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(lists, len(x)), replace=False)] if len(x) else x
        for _ in range(rounds if len(c) else 0):
            near = np.argmax(x @ c.T, axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
        self.centroids, self.spark, self.split = c, corpus.sparkSession, split
        self.rows = self._dealt(corpus, 1)

    def _dealt(self, rows: DataFrame, probes: int) -> DataFrame:
        """rows with `list`, once for each of the probes nearest centroids."""
        c = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not len(c):
                    continue
                v = b.column(2).flatten().to_numpy().astype(np.float64).reshape(b.num_rows, -1)
                near = np.argsort(-(v @ c.T), axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([*[x.take(at) for x in b.columns], pa.array(near.ravel().astype(np.int32))], [*b.schema.names, "list"])

        kind = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString(), rows.schema["embedding"].dataType.simpleString()
        return rows.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kind[0]}, label {kind[1]}, embedding {kind[2]}, list int")

    def probes_for(self, k: int, target: float = 0.95, sample: int = 64) -> int:
        """The fewest probes by which at least `target` of the k nearest of some vectors are found: these are searched exactly, and the
        place is taken of each neighbour's list among its query's lists."""
        q = self.rows.select("vec_id", "label", "embedding").orderBy(F.xxhash64("vec_id", F.lit(7))).limit(sample)
        c = self.centroids
        told = {r["vec_id"]: np.argsort(-(np.asarray(r["embedding"], np.float64) @ c.T), kind="stable") for r in q.collect()}  # `sample` vectors
        found = neighbours(q, self.rows, k).join(self.rows.select("vec_id", "list"), "vec_id").select("q", "list").collect()  # `sample` * k rows
        places = sorted(int(np.flatnonzero(told[r["q"]] == r["list"])[0]) + 1 for r in found)
        return places[min(len(places) - 1, int(target * len(places)))] if places else 1

    def neighbours(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """(q, vec_id, s, rk) of what the probed lists hold."""
        sizes = self.rows.groupBy("list").agg(F.ceil(F.count("*") / self.split).cast("int").alias("parts"))
        told = self.rows.join(sizes, "list").select("vec_id", "label", "embedding", F.col("list"), F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"))
        c = told.select(*[F.col(x).alias(x) for x in told.columns])
        asked = self._dealt(queries, probes).join(sizes.select(F.col("list").alias("of"), F.col("parts").alias("n")), F.col("list") == F.col("of"))
        q = asked.select("vec_id", "label", "embedding", "list", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
        choose = _best(k)

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            out: tuple[list, ...] = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
            if a.num_rows and b.num_rows:
                (qi, _, m), (ci, _, v) = _matrix(a), _matrix(b)
                for at in range(0, len(qi), 64):
                    for row, i in zip(np.round(m[at : at + 64] @ v.T, 6), qi[at : at + 64], strict=True):
                        row[ci == i] = -np.inf
                        found = choose(row)
                        found = found[np.isfinite(row[found])]
                        for o, x in zip(out, (np.full(len(found), i), ci[found], row[found]), strict=True):
                            o.append(x)
            return pa.table({n: pa.array(np.concatenate(o)) for n, o in zip(("q", "vec_id", "s"), out, strict=True)})

        near = q.groupBy("list", "part").cogroup(c.groupBy("list", "part")).applyInArrow(run, "q long, vec_id long, s double")
        w = Window.partitionBy("q").orderBy(F.desc("s"), "vec_id")
        return near.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


def coverage(passages: DataFrame, vectors: DataFrame, keys: list[str], on: str = "doc_id") -> DataFrame:
    """keys, total, ready, active: a group is active when all of it has vectors."""
    has = vectors.select(on).distinct().withColumn("has", F.lit(1))
    out = passages.select(on, *keys).join(has, on, "left").groupBy(*keys).agg(F.count("*").alias("total"), F.count("has").alias("ready"))
    return out.withColumn("active", F.col("total") == F.col("ready"))


def profile_key(model: Column, revision: Column, dims: Column, form: Column) -> Column:
    """What tells vectors of one kind from all others: vectors of two profiles are never compared, counted or published together."""
    return F.sha2(F.to_json(F.array(model, revision, dims.cast("string"), form)), 256)


def profile_coverage(passages: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """profile, keys, total, ready, active: for each profile that `stored` (passage, profile, input_hash, embedding) knows, and each group of
    passages (passage, input_hash, keys), how many have a vector of that profile that was made from what they say now. A group is active under a
    profile when all of it has; one that has no vector at all under it counts with none."""
    named = [r[0] for r in stored.select("profile").distinct().orderBy("profile").collect()]  # a few kinds of vectors
    totals = passages.groupBy(*keys).agg(F.count("*").alias("total"))
    good = stored.filter(F.col("embedding").isNotNull()).select("passage", "input_hash", "profile").distinct()
    ready = passages.join(good, ["passage", "input_hash"]).groupBy("profile", *keys).agg(F.count("*").alias("ready"))
    every = totals.withColumn("profile", F.explode(F.array(*map(F.lit, named)).cast("array<string>")))
    return every.join(ready, ["profile", *keys], "left").select("profile", *keys, "total", F.coalesce("ready", F.lit(0)).alias("ready"), (F.coalesce("ready", F.lit(0)) == F.col("total")).alias("active"))


def batches(rows: DataFrame, digest: str, size: int) -> DataFrame:
    """Distinct digests, numbered in their order, in batches. Ranked within the digests' leading digits and shifted by the
    counts before, so nothing is ordered in one task."""
    d = rows.select(digest).distinct().withColumn("lead", F.substring(digest, 1, 3))
    counts = d.groupBy("lead").agg(F.count("*").alias("n"))
    before = counts.select("lead", (F.sum("n").over(Window.orderBy("lead")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("lead").orderBy(digest))
    return d.withColumn("place", place).join(before, "lead").select(digest, F.ceil((F.col("before") + F.col("place")) / size).cast("bigint").alias("batch"))
