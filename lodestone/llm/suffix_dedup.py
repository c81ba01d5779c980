"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if some string of `length` bytes that covers it also starts earlier (smaller doc_id, or earlier in the same
document); strings lie inside one document and are judged on the input. The suffixes that must be compared are found
first, so that only they are sorted:

1. A string's anchor is the place of the least hash among its `gram`-byte grams (polynomial prefix hashes). Equal strings
   have equal anchors at equal places, so strings with anchors of different hashes never meet. Neighbouring strings
   mostly share their anchor; such a run is one row, named by the anchor's hash and a hash of the run's bytes.
2. Rows of the same name are taken for the same strings: all but the earliest go. Each task settles its own rows first and
   compares their bytes; what tasks settle between them, a row per task and string, is verified by digests of the bytes,
   and an anchor whose names collided is settled by its strings' bytes. What is left are anchors with runs of several names.
   An anchor that shows more than HOT names to one task is dealt by name instead, and all its runs are told.
3. Their bytes are fetched and met again by the half beside the anchor that a string must contain. In each such group a
   bottom-up mergesort orders the suffixes at the strings' starts: two suffixes are compared by a binary search over
   prefix polynomial hashes for their common extension, then by the byte after it. Equal neighbours are one string. The
   order is verified byte by byte; where a collision misled it, the group is sorted by its bytes.
   Groups above group_rows runs, which only dealt anchors can have, are not brought together but settled a string at a
   time by a distributed aggregation over the bytes.

A null text is empty. Rows with equal doc_id and text are one document, and each gets its result; rows that share only the
doc_id are documents in the order of their texts' hashes. A null doc_id comes first. A very long text is read in pieces of
2^21 bytes that overlap by a string. An empty table gives no row. Only doc_id and text are read, so other columns may have
any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, documents, release, slim, stored

LENGTH = 100
GRAM = 32
CHUNK = 1 << 21
_B = 0x9E3779B97F4A7C15 | 1
_LOW = 24
#: Names that an anchor shows to one task at most before it is dealt by them, and the parts that it is dealt to.
HOT, SALTS = 64, 251
NO_DOC = -(1 << 63)


def _long(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


RUNS = _long("g", "c", "doc", "pos", "salt")
FOUND = _long("kind", "g", "c", "doc", "a", "q", "b")
#: Kinds of found rows: removed intervals, runs to compare, runs of names to verify, runs of dealt anchors to compare.
GONE, RUN, NAMED, DEALT = range(4)
CONTEXTS = T.StructType([*_long("kind", "sub", "doc", "q", "a", "b"), T.StructField("bytes", T.BinaryType())])
SETTLED = T.StructType([*_long("kind", "doc", "a", "b", "q"), T.StructField("bytes", T.BinaryType())])
DIGESTS = T.StructType([*_long("doc", "n_bytes", "n_removed", "n_spans"), T.StructField("kept_sha256", T.StringType())])


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64."""
    up, down = np.full(n, _B, np.uint64), np.full(n, pow(_B, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_size(len(data)))[0][: len(data)], dtype=np.uint64)])


def _size(n: int) -> int:
    return max(CHUNK * 2, 1 << max(1, n).bit_length())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def _name(data: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(data)


def anchor_runs(pieces: list[bytes], length: int, gram: int, name: Callable[[bytes], int] = _name) -> tuple[np.ndarray, ...]:
    """piece, first start, anchor and last start (in the piece), gram hash, content hash and place in the joined pieces of
    each run of strings."""
    sizes = np.array([len(p) for p in pieces])
    joined = b"".join(pieces)
    data = np.frombuffer(joined, np.uint8)
    stop = np.cumsum(sizes)
    p = prefix_hashes(data)
    down = _powers(_size(len(data)))[1]
    h = _mix((p[gram:] - p[:-gram]) * down[: len(data) - gram + 1])
    low = np.uint64((1 << _LOW) - 1)
    least = _least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    at = (least & low).astype(np.int64)
    s = np.arange(len(at))
    piece = np.repeat(np.arange(len(pieces)), sizes)[: len(at)]
    s = s[s + length <= stop[piece]]
    new = np.concatenate([[True], (at[s[1:]] != at[s[:-1]]) | (s[1:] != s[:-1] + 1)])
    first = s[new]
    last = s[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])]
    q = at[first]
    c = np.array([name(joined[i:j]) for i, j in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64)
    c ^= _mix(((q - first) << 32 | (last - first)).astype(np.uint64))
    piece = piece[first]
    base = (stop - sizes)[piece]
    return piece, first - base, q - base, last - base, h[q].view(np.int64), c.view(np.int64), first


def _merge(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching intervals [a, b) of a document joined; sorted by document and start."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    group = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)]))
    width = int(b.max()) + 1
    top = np.maximum.accumulate(b + group * width) - group * width
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (a[1:] > top[:-1])])
    first = np.flatnonzero(new)
    return doc[first], a[first], np.maximum.reduceat(b, first)


def _scan(length: int, gram: int, name: Callable[[bytes], int], held: int = 1 << 20, every: bool = False):
    """The runs of each text. Runs of the same name in one task are compared byte by byte: the first one stands for all, the
    others' intervals are told at once (pos < 0), and one with other bytes gets another name. every: all runs as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        buffers: list[bytes] = []
        rows = base = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            g, c, doc, a, q, b, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            pos = a << 16 | (q - a) << 8 | (b - a)
            none = np.zeros(0, np.int64)
            gone, salt, hot = (none, none, none), np.zeros(len(g), np.int64), none
            if not every:
                order = np.lexsort((a, doc, c, g))
                g, c, doc, a, b, at, pos = (x[order] for x in (g, c, doc, a, b, at, pos))
                data = b"".join(buffers)
                first = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
                rep = np.flatnonzero(first)[np.cumsum(first) - 1]
                copy, end = np.flatnonzero(~first), at + b - a + length
                same = np.fromiter((data[i:j] == data[k:m] for i, j, k, m in zip(at[copy].tolist(), end[copy].tolist(), at[rep[copy]].tolist(), end[rep[copy]].tolist(), strict=True)), bool, len(copy))
                for i in copy[~same].tolist():
                    c[i] = int.from_bytes(hashlib.sha256(data[at[i] : end[i]]).digest()[:8], "little", signed=True)
                gone = _merge(doc[copy[same]], a[copy[same]], b[copy[same]] + length)
                keep = np.ones(len(g), bool)
                keep[copy[same]] = False
                names, many = np.unique(g[keep], return_counts=True)
                hot = names[many > HOT]
                g, c, doc, pos = (x[keep] for x in (g, c, doc, pos))
                salt = np.where(np.isin(g, hot), 1 + (c.view(np.uint64) % np.uint64(SALTS)).astype(np.int64), 0)
            buffers.clear()
            base = 0
            k = len(hot)
            out = [np.concatenate(x) for x in ((g, gone[0], hot), (c, gone[1], np.full(k, NO_DOC)), (doc, gone[0], np.full(k, NO_DOC)), (pos, -gone[2], np.zeros(k, np.int64)), (salt, np.zeros(len(gone[0]) + k, np.int64)))]
            for i in range(0, len(out[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[i : i + 100_000], np.int64)) for x in out], RUNS.names)

        for batch in batches:
            docs, texts = batch.column(0).to_numpy(), batch.column(1)
            pieces, owner, offset, size = [], [], [], 0
            for i in range(batch.num_rows + 1):
                data = texts[i].as_py() if i < batch.num_rows else b""
                at = 0
                while len(data) - at >= length or i == batch.num_rows:
                    part = data[at : at + CHUNK]
                    if pieces and (size + len(part) > CHUNK or i == batch.num_rows):
                        piece, a, q, b, g, c, place = anchor_runs(pieces, length, gram, name)
                        move = np.array(offset)[piece]
                        parts.append((g, c, np.array(owner)[piece], a + move, q + move, b + move, place + base))
                        buffers.extend(pieces)
                        base += size
                        rows += len(a)
                        pieces, owner, offset, size = [], [], [], 0
                    if i == batch.num_rows:
                        break
                    pieces.append(part)
                    owner.append(docs[i])
                    offset.append(at)
                    size += len(part)
                    at += max(1, len(part) - length + 1)
            if rows >= held:
                yield from flush()
                rows = 0
        if parts:
            yield from flush()

    return run


def _settle(length: int):
    """Rows sorted by g, salt, c, doc, pos: the later runs of each name as removed intervals, every run of a name that has
    several, and the earliest runs of anchors that have several names or are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, dealt = None, False  # the last row's anchor and part, and whether all of its runs are told
        held: list[int] | None = None  # the last name's earliest run; it stands before the next batch's rows
        alone = told = named = False  # is it its anchor's first; has it been told as a run to compare, to verify
        for batch in batches:
            if not batch.num_rows:
                continue
            g, c, doc, pos, salt = (x.to_numpy() for x in batch.columns)
            own = pos < 0
            out = [(np.full(own.sum(), GONE), g[own], c[own], doc[own], c[own], c[own], -pos[own])]
            rows = [x[~own] for x in (g, c, doc, pos, salt)]
            if len(rows[0]):
                opens = np.concatenate([[(rows[0][0], rows[4][0]) != last], (rows[0][1:] != rows[0][:-1]) | (rows[4][1:] != rows[4][:-1])])
                mark = (rows[1] == NO_DOC) & (rows[2] == NO_DOC)
                group = np.cumsum(opens)
                all_ = np.concatenate([[dealt], (mark | (rows[4] > 0))[opens]])[group]
                last, dealt = (rows[0][-1], rows[4][-1]), bool(all_[-1])
                if opens[0]:
                    held = None
                rows, group, all_ = [x[~mark] for x in rows], group[~mark], all_[~mark]
            if len(rows[0]):
                before = held is not None
                if before:
                    rows = [np.concatenate([[x], y]) for x, y in zip(held, rows, strict=True)]
                    group, all_ = np.concatenate([[0], group]), np.concatenate([all_[:1], all_])
                g, c, doc, pos, _ = rows
                a = pos >> 16
                q, b = a + (pos >> 8 & 255), a + (pos & 255)
                first = np.concatenate([[True], (group[1:] != group[:-1]) | (c[1:] != c[:-1])])
                late, reps = np.flatnonzero(~first), np.flatnonzero(first)
                heads = np.concatenate([[alone if before else True], group[reps[1:]] != group[reps[:-1]]])
                tell = ~heads | np.concatenate([~heads[1:], [False]]) | all_[reps]
                shared = np.concatenate([~first[1:], [False]])[reps]
                new = np.ones((2, len(reps)), bool)
                new[:, 0] = (not told, not named) if before else True
                for kind, i in ((NAMED, np.concatenate([late, reps[shared & new[1]]])), (RUN, reps[tell & new[0]])):
                    out.append((np.where(all_[i] & (kind == RUN), DEALT, kind), g[i], c[i], doc[i], a[i], q[i], b[i]))
                out.append((np.full(len(late), GONE), g[late], c[late], doc[late], a[late], a[late], b[late] + length))
                i = reps[-1]
                old = before and len(reps) == 1
                held, alone = [int(x[i]) for x in rows], bool(heads[-1])
                told, named = bool(tell[-1] or old and told), bool(shared[-1] or old and named)
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x, np.int64)) for x in cols], FOUND.names)

    return run


def _contexts(length: int, gram: int):
    """Cuts the runs' bytes out of their documents; half of them meet by the bytes right of the anchor, half by those left.
    Of a named run it tells a digest, with the name's two halves in sub and q."""
    half = (length - gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        types = [pa.int64()] * 6 + [pa.binary()]
        for batch in batches:
            out: list[tuple] = []

            def flush() -> Iterator[pa.RecordBatch]:
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], CONTEXTS.names)
                    out.clear()

            for k in range(batch.num_rows):
                doc, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                for r in batch.column(2)[k].as_py():
                    kind, a, q, b = r["kind"], r["a"], r["q"], r["b"]
                    if kind == NAMED:
                        out.append((kind, r["g"], doc, r["c"], a, b, hashlib.sha256(data[a : b + length]).digest()[:16]))
                        continue
                    if b >= q - half:
                        s = max(a, q - half)
                        out.append((kind, digest(data[q : q + gram + half], 1) - (1 << 63), doc, q, s, b, data[s : b + length]))
                    if a < q - half:
                        e = min(b, q - half - 1)
                        out.append((kind, digest(data[q - half - 1 : q + gram], 2) - (1 << 63), doc, q, a, e, data[a : e + length]))
                if len(out) > 20_000:
                    yield from flush()
            yield from flush()

    return run


class Suffixes:
    """Suffixes of one buffer, compared on their first `length` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, length: int) -> None:
        self.data, self.length = data, length
        self.p, self.down = prefix_hashes(data), _powers(_size(len(data)))[1]

    def hashed(self, s: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.p[s + n] - self.p[s]) * self.down[s]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many first bytes two suffixes share, up to length."""
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), self.length)
        for _ in range(self.length.bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.hashed(x, mid) == self.hashed(y, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        n = self.extension(x, y)
        end = len(self.data) - 1
        return np.where(n == self.length, ties, self.data[np.minimum(x + n, end)] < self.data[np.minimum(y + n, end)])

    def sort(self, starts: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """An order of the suffixes, within segments that are given one after another: all segments merge side by side."""
        n = len(starts)
        order = np.arange(n)
        begin = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        count = np.diff(np.append(begin, n))
        base, size = np.repeat(begin, count), np.repeat(count, count)
        width = 1
        while width < count.max(initial=0):
            i = np.flatnonzero(size > width)
            local, b, z = (np.arange(n) - base)[i], base[i], size[i]
            run = local // width
            sib = run ^ 1
            lo = np.minimum(sib * width, z)
            hi = np.minimum(lo + width, z)
            start, left = lo.copy(), run % 2 == 0
            x = starts[order[i]]
            while (open_ := lo < hi).any():
                k = np.flatnonzero(open_)
                mid = (lo[k] + hi[k]) >> 1
                # before: the sibling's element stands before x; ties keep the left run's elements first
                before = self.less(starts[order[b[k] + mid]], x[k], ~left[k])
                lo[k], hi[k] = np.where(before, mid + 1, lo[k]), np.where(before, hi[k], mid)
            to = b + (run // 2) * 2 * width + (local - run * width) + (lo - start)
            new = order.copy()
            new[to] = order[i]
            order, width = new, width * 2
        return order

    def classes(self, starts: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, same): the sorted suffixes, and whether each equals the one before it in its segment, by their bytes."""
        order = self.sort(starts, segment)
        view = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        within = np.concatenate([[False], segment[1:] == segment[:-1]])  # sorting stays inside segments
        same, wrong = np.zeros(len(order), bool), []
        for i in range(0, len(order), 50_000):
            j = np.arange(max(1, i), min(len(order), i + 50_000))
            j = j[within[j]]
            x, y = view[starts[order[j - 1]]], view[starts[order[j]]]
            differ = x != y
            any_ = differ.any(axis=1)
            at = differ.argmax(axis=1)
            k = np.arange(len(j))
            same[j] = ~any_
            wrong.append(j[any_ & (x[k, at] > y[k, at])])
        bad = np.unique(segment[np.concatenate(wrong)]) if wrong else []
        for s in bad:  # a hash collision misled the comparisons
            k = np.flatnonzero(segment == s)
            rows = sorted(k, key=lambda i: view[starts[i]].tobytes())
            order[k] = rows
            text = [view[starts[i]].tobytes() for i in rows]
            same[k] = [False, *(a == b for a, b in zip(text, text[1:], strict=False))]
        return order, same


def repeated(contexts: dict[str, np.ndarray | list[bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removed intervals (doc, a, b) of runs that are sorted by sub, doc and q."""
    a, b, q, doc, sub, data = (contexts[k] for k in ("a", "b", "q", "doc", "sub", "bytes"))
    joined = np.frombuffer(b"".join(data), np.uint8)
    base = np.cumsum([0, *map(len, data)])[:-1]
    n = b - a + 1
    run = np.repeat(np.arange(len(a)), n)
    k = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    start, t = base[run] + k, q[run] - a[run] - k
    group = np.cumsum(np.concatenate([[0], sub[1:] != sub[:-1]]))[run]
    by = np.lexsort((run, t, group))
    run, k, start = run[by], k[by], start[by]
    segment = group[by] * (length + 1) + t[by]
    order, same = Suffixes(joined, length).classes(start, segment)
    class_ = np.cumsum(~same)
    least = np.full(class_[-1] + 1 if len(class_) else 1, len(a))
    np.minimum.at(least, class_, run[order])
    gone = order[run[order] != least[class_]]
    return _merge(doc[run[gone]], a[run[gone]] + k[gone], a[run[gone]] + k[gone] + length)


def _compare(length: int, group_rows: int, most: int = 60_000):
    """Rows sorted by sub, doc, q. kind 0: removed intervals [a, b); kind 1: the runs of groups that are too large to hold."""
    types = [pa.int64()] * 5 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        large: int | None = None

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            sub = table["sub"].to_numpy()
            count = np.unique(sub, return_counts=True)
            small = np.isin(sub, count[0][(count[1] > 1) & (count[1] <= group_rows)])
            if small.any():
                t = table.filter(pa.array(small))
                doc, a, b = repeated({c: t[c].to_pylist() if c == "bytes" else t[c].to_numpy() for c in CONTEXTS.names[1:]}, length)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip((np.zeros(len(doc), np.int64), doc, a, b, a, [None] * len(doc)), types, strict=True)], SETTLED.names)
            if (wide := np.isin(sub, count[0][count[1] > group_rows])).any():
                yield from hot(table.filter(pa.array(wide)))

        def hot(t: pa.Table) -> Iterator[pa.RecordBatch]:
            one = pa.array(np.ones(len(t), np.int64))
            yield from pa.table([one, t["doc"], t["a"], t["b"], t["q"], t["bytes"]], SETTLED.names).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.table(batch)
            if large is not None:
                on = t["sub"].to_numpy() == large
                if on.any():
                    yield from hot(t.filter(pa.array(on)))
                    t = t.filter(pa.array(~on))
                if not len(t):
                    continue
                large = None
            held.append(t)
            whole = pa.concat_tables(held)
            if len(whole) >= most:
                sub = whole["sub"].to_numpy()
                cut = int(np.flatnonzero(sub != sub[-1])[-1]) + 1 if (sub != sub[-1]).any() else 0
                if cut:
                    yield from settle(whole.slice(0, cut).combine_chunks())
                tail = whole.slice(cut).combine_chunks()
                if len(tail) > group_rows:
                    large = int(sub[-1])
                    yield from hot(tail)
                    tail = tail.slice(0, 0)
                held = [tail]
        if held:
            yield from settle(pa.concat_tables(held).combine_chunks())

    return run


def _wide(rows: DataFrame, length: int) -> DataFrame:
    """Intervals (doc, a, b) of the strings of large groups that start earlier elsewhere; keyed by the strings' bytes."""
    each = rows.select("doc", "bytes", "a", F.explode(F.sequence("a", "b")).alias("s"))
    each = each.select("doc", "s", F.substring("bytes", (F.col("s") - F.col("a") + 1).cast("int"), F.lit(length)).alias("w"))
    first = each.groupBy("w").agg(F.min(F.struct("doc", "s")).alias("f"))
    late = each.join(first, "w").filter(F.struct("doc", "s") > F.col("f"))
    return late.select("doc", F.col("s").alias("a"), (F.col("s") + length).alias("b"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, data, gone in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = data.as_py()
            kept, at, spans, h = 0, 0, 0, hashlib.sha256()
            end = -1
            for r in sorted((r["a"], r["b"]) for r in gone or ()):
                if r[0] > end:
                    spans += 1
                    h.update(data[at : r[0]])
                    kept += r[0] - at
                    end = r[1]
                end = at = max(end, r[1])
            h.update(data[at:])
            kept += len(data) - at
            out.append((doc, len(data), len(data) - kept, spans, h.hexdigest()))
        types = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], DIGESTS.names)


def _anchored(docs: DataFrame, bad: DataFrame, length: int, gram: int, name: Callable[[bytes], int]) -> DataFrame:
    """All runs of some anchors (g), with their bytes: (doc, a, b, bytes)."""
    runs = docs.filter(F.length("data") >= length).mapInArrow(_scan(length, gram, name, every=True), RUNS).join(bad, "g", "left_semi")
    a = F.shiftright("pos", 16)
    runs = runs.select("doc", a.alias("a"), (a + F.col("pos").bitwiseAND(F.lit(255))).alias("b"))
    return runs.join(docs, "doc").select("doc", "a", "b", F.substring("data", F.col("a").cast("int") + 1, (F.col("b") - F.col("a") + length).cast("int")).alias("bytes"))


def removed(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, group_rows: int = 4096, name: Callable[[bytes], int] = _name) -> DataFrame:
    """Intervals (doc, a, b), half open, in bytes, that go from the texts of docs (doc: unique, ascending; data: binary).
    name: hashes a run's bytes; it may collide."""
    spark = docs.sparkSession
    runs = docs.filter(F.length("data") >= length).mapInArrow(_scan(length, gram, name), RUNS)
    sorted_ = runs.repartition("g", "salt").sortWithinPartitions("g", "salt", "c", "doc", "pos")
    found = Stored(sorted_.mapInArrow(_settle(length), FOUND), "runs").df
    release(spark)
    asked = found.filter(F.col("kind") != GONE).groupBy("doc").agg(F.collect_list(F.struct("kind", "g", "c", "a", "q", "b")).alias("runs"))
    cut = Stored(docs.join(asked, "doc").select("doc", "data", "runs").mapInArrow(_contexts(length, gram), CONTEXTS), "contexts").df
    release(spark)
    gone, wide = found.filter(F.col("kind") == GONE), []
    named = cut.filter(F.col("kind") == NAMED).groupBy(F.col("sub").alias("g"), F.col("q").alias("c")).agg(F.min("bytes").alias("x"), F.max("bytes").alias("y"))
    bad = stored(named.filter("x <> y").select("g", "c"), "collisions")
    if bad.limit(1).count():
        gone = gone.join(bad, ["g", "c"], "left_anti")
        wide.append(_anchored(docs, bad.select("g").distinct(), length, gram, name))
    meet = cut.filter(F.col("kind").isin(RUN, DEALT))
    large = stored(cut.filter(F.col("kind") == DEALT).groupBy("sub").count().filter(F.col("count") > group_rows).select("sub"), "large")
    if large.limit(1).count():
        wide.append(meet.join(large, "sub", "left_semi").select("doc", "a", "b", "bytes"))
        meet = meet.join(large, "sub", "left_anti")
    met = meet.drop("kind").repartition("sub").sortWithinPartitions("sub", "doc", "q")
    settled = Stored(met.mapInArrow(_compare(length, group_rows), SETTLED), "strings").df
    release(spark)
    gone = gone.select("doc", "a", "b").union(settled.filter("kind = 0").select("doc", "a", "b"))
    if settled.filter("kind = 1").limit(1).count():
        wide.append(settled.filter("kind = 1").select("doc", "a", "b", "bytes"))
    if wide:
        gone = gone.union(stored(_wide(reduce(DataFrame.unionByName, wide), length), "wide"))
    return gone


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc, data) with a unique ascending doc, which is doc_id itself where that is unique; else also (doc, doc_id, times)."""
    d = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    if not d.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count():
        return d.select(F.col("doc_id").alias("doc"), "data"), None
    d = d.withColumn("h", F.sha2("data", 256))
    names = d.groupBy("doc_id", "h").agg(F.count("*").alias("times")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    names = stored(names.withColumn("doc", F.monotonically_increasing_id()), "names")
    one = d.dropDuplicates(["doc_id", "h"]).join(names.select(F.col("doc_id").alias("i"), F.col("h").alias("hh"), "doc"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("hh")))
    return one.select("doc", "data"), names


def suffix_dedup(docs: DataFrame, **options: int) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    mine, names = keyed(docs)
    gone = removed(mine, **options).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    out = mine.join(gone, "doc", "left").select("doc", "data", "gone").mapInArrow(_digest, DIGESTS)
    if names is None:
        return out.withColumnRenamed("doc", "doc_id")
    out = out.join(names, "doc").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(suffix_dedup(documents(spark, sf_dir)), "kept")
