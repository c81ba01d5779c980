"""Phrase collocations, level by level: minimal perfect hashes over Apriori-safe candidates, counted by slot.

1. Texts become chunks of word numbers (a document is never cut; 0 stands between pieces). A chunk numbers its own words; one
   shuffle of (language, word) gives each word its count, and the frequent ones a number for the whole table, which goes back
   to the chunks. So no task and no broadcast holds the vocabulary.
2. Level k: a position where two frequent phrases of k - 1 words begin side by side is an occurrence of an Apriori-safe
   candidate, whose exact key is the pair of their numbers. A chunk sends each owner block (a share of the hashed keys) its
   distinct keys and how often it holds them. A block keeps the keys that can be frequent at all (in two chunks, or often enough in one), and builds
   a minimal perfect hash over them, with the keys stored by slot.
3. Mappers, one for a block and a share of the chunks, look the keys up, verify them by the stored ones and bincount the slots into an array;
   the arrays of a block are summed as a tree. Slots that reach `least` are the frequent phrases of level k: they get numbers, which
   go back to the chunks for level k + 1.
4. A frequent phrase points to the slots of its first and its last k - 1 words, so the counts of all its beginnings and ends, and
   with them every cut, are read along these pointers.

A key comes at most once from a chunk, so a hot phrase weighs no more than the number of chunks, and blocks of hot phrases are shared out by
chunks. A null text is empty; a null lang is "und"; repeated rows count each; null doc_ids don't matter, since no id is read. Texts
are read whole; an empty table gives no rows; only text and lang are read, so other columns may have any name. The keys of a level are
exact 64-bit integers while it follows fewer than 3 * 10^9 frequent phrases of one length; beyond that it stops with an error.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored, arrow_bytes, bounded, documents, release, slim

LEAST, LONGEST, TOP = 100, 5, 2000
#: Words of a chunk, occurrences of a block, chunks whose arrays one mapper sums, arrays summed at once.
CHUNK_WORDS, BLOCK_KEYS, SHARE, FAN = 1 << 18, 1 << 18, 1 << 18, 16
#: Rows of chunks are some MB each: few of them in a row group, which a reader holds at once.
CHUNK_FILES = {"compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.block.row.count.limit": "8"}

#: A-Z to a-z, every mark or line end that ends a piece to ".", tab to blank.
_FOLD = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of integers."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct integers: levels of bits, two for each key that is left. A key that alone hits a bit of its level
    owns it, and its slot is the number of owned bits before; keys that share a bit go to the next level."""

    def __init__(self, sizes: list[int], bits: bytes, keys: np.ndarray) -> None:
        self.sizes, self.bits, self.keys = sizes, bits, keys
        flat = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes), bitorder="little")
        ranks = np.cumsum(flat, dtype=np.int64) - flat
        cuts = np.cumsum(sizes)[:-1]
        self.levels = list(zip(np.split(flat, cuts), np.split(ranks, cuts), strict=True)) if sizes else []

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, order, left, level = [], [], [], keys, 0
        while len(left):
            at = mix(left, level) % np.uint64(2 * len(left))
            hits = np.bincount(at.astype(np.int64), minlength=2 * len(left))
            alone = hits[at.astype(np.int64)] == 1
            sizes.append(2 * len(left))
            bits.append(hits == 1)
            order.append(left[alone][np.argsort(at[alone])])
            left, level = left[~alone], level + 1
        packed = np.packbits(np.concatenate(bits), bitorder="little").tobytes() if bits else b""
        return cls(sizes, packed, np.concatenate(order) if order else keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for one that isn't stored."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(self.levels):
            at = (mix(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        return np.where(known, out, -1)


# --- words --------------------------------------------------------------------------------------------------------------

VOCAB = "chunk long, local binary, vocab array<struct<lang:string,word:binary,n:int>>"
_VOCAB = pa.struct([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int32())])


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, turn = TaskContext.get().partitionId(), 0
        parts: list[np.ndarray] = []
        n = 0

        def fresh():
            number = count(1).__next__
            return defaultdict(lambda: defaultdict(number, {b".": 0}))

        words, stop = fresh(), np.zeros(1, np.int32)

        def flush() -> pa.RecordBatch:
            nonlocal turn, words, n
            local = np.concatenate(parts)
            m = sum(len(w) - 1 for w in words.values())
            lang, text = np.empty(m, object), np.empty(m, object)
            for name, own in words.items():
                del own[b"."]
                at = np.fromiter(own.values(), np.int64, len(own)) - 1
                lang[at] = name
                text[at] = list(own)
            n_of = np.bincount(local, minlength=m + 1)[1:].astype(np.int32)
            vocab = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(text, pa.binary()), pa.array(n_of)], fields=list(_VOCAB))
            row = pa.RecordBatch.from_arrays([pa.array([(part << 32) + turn], pa.int64()), pa.array([_squeezed(local)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), vocab)], ["chunk", "local", "vocab"])
            turn, words, n = turn + 1, fresh(), 0
            parts.clear()
            return row

        for whole in batches:
            for batch in bounded(whole, 1, 1024):
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = text.translate(_FOLD).replace(b".", b" . ").split()  # only blanks are left to split at
                    parts += np.fromiter(map(words[name].__getitem__, found), np.int32, len(found)), stop
                    n += len(found) + 1
                    if n >= size:
                        yield flush()
        if n:
            yield flush()

    return run



def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers a partition's words, whose rows stand together: a row for each word, and for each chunk (and some of the rows) its
    places and their numbers, packed."""
    from pyspark import TaskContext

    part, no, last = TaskContext.get().partitionId(), 0, None
    held: list[tuple[np.ndarray, ...]] = []

    def row(**columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _NUMBERED], schema=_NUMBERED)

    def flush() -> pa.RecordBatch:
        chunk, at, numbers = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(chunk, kind="stable")
        chunk, at, numbers = chunk[order], at[order].astype("<i4"), numbers[order].astype("<i4")
        cuts = np.flatnonzero(np.diff(chunk, prepend=-1))
        pairs = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(chunk)], strict=True))
        return row(chunk=pa.array(chunk[cuts]), part=pa.array(np.full(len(cuts), part, np.int32)), ats=pa.array([at[a:b].tobytes() for a, b in pairs], pa.binary()), nos=pa.array([numbers[a:b].tobytes() for a, b in pairs], pa.binary()))

    for batch in batches:
        if not batch.num_rows:
            continue
        lang, word = batch.column(2), batch.column(3)
        new = np.ones(batch.num_rows, bool)
        if batch.num_rows > 1:
            same = pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(word[1:], word[:-1]))
            new[1:] = ~same.to_numpy(zero_copy_only=False)
        new[0] = last != (lang[0].as_py(), word[0].as_py())
        last = lang[-1].as_py(), word[-1].as_py()
        numbers = no + np.cumsum(new)
        no = int(numbers[-1])
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), numbers))
        if new.any():
            fresh = pa.array(np.flatnonzero(new))
            yield row(part=pa.array(np.full(len(fresh), part, np.int32)), no=pa.array(numbers[new]), **{c: batch.column(k).take(fresh) for k, c in ((2, "lang"), (3, "word"), (4, "f"))})
        if sum(len(x[0]) for x in held) >= 1 << 20:
            yield flush()
    if held:
        yield flush()


NUMBERED = "chunk long, part int, ats binary, nos binary, no long, lang string, word binary, f long"
_NUMBERED = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("ats", pa.binary()), ("nos", pa.binary()), ("no", pa.int64()), ("lang", pa.string()), ("word", pa.binary()), ("f", pa.int64())])
CHUNK = "chunk long, g binary, pairs long"


def _squeezed(a: np.ndarray) -> bytes:
    """Non-negative integers, in 32 bits where they fit, compressed."""
    kind = "<i4" if a.max(initial=0) < 1 << 31 else "<i8"
    return kind.encode() + len(a).to_bytes(8, "little") + pa.compress(a.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _loose(data: object) -> np.ndarray:
    data = data.as_py() if hasattr(data, "as_py") else data
    kind, n = data[:3].decode(), int.from_bytes(data[3:11], "little")
    return np.frombuffer(pa.decompress(data[11:], decompressed_size=n * int(kind[2]), codec="zstd", asbytes=True), kind).astype(np.int64)


def _row(chunk: int, g: np.ndarray) -> pa.Table:
    """A chunk with the number of the frequent phrase that begins at each place, 0 where none does."""
    pairs = int(np.count_nonzero(g[:-1].astype(bool) & g[1:].astype(bool)))
    if not pairs:
        return pa.table({"chunk": pa.array([], pa.int64()), "g": pa.array([], pa.binary()), "pairs": pa.array([], pa.int64())})
    return pa.table({"chunk": pa.array([chunk], pa.int64()), "g": pa.array([_squeezed(g)], pa.binary()), "pairs": pa.array([pairs], pa.int64())})


def _renamed(chunks: pa.Table, numbers: pa.Table) -> pa.Table:
    if not chunks.num_rows:
        return _row(0, np.zeros(2, np.int64))
    local = _loose(chunks["local"][0])
    to = np.zeros(int(local.max(initial=0)) + 1, np.int64)
    for before, ats, nos in zip(numbers["before"].to_pylist(), numbers["ats"], numbers["nos"], strict=True):
        to[_ints(ats, np.int32)] = before + _ints(nos, np.int32)
    return _row(chunks["chunk"][0].as_py(), to[local])


def frequent_words(docs: DataFrame, least: int, chunk_words: int) -> tuple[DataFrame, DataFrame, Stored]:
    """n per lang; the frequent words (id from 1, f, lang, phrase); the chunks with their words' ids."""
    d = slim(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    chunks = Stored(d.mapInArrow(_chunks(chunk_words), VOCAB), "phrase-chunks", **CHUNK_FILES)
    words = chunks.df.select("chunk", F.posexplode("vocab").alias("at", "v")).select("chunk", (F.col("at") + 1).alias("at"), "v.lang", "v.word", "v.n")
    totals = Stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals").df
    own = Window.partitionBy("lang", "word")
    found = words.withColumn("f", F.sum("n").over(own)).filter(F.col("f") >= least).select("chunk", "at", "lang", "word", "f")
    rows = Stored(found.mapInArrow(_number, NUMBERED), "phrase-words", compression="zstd")
    sums = rows.df.groupBy("part").agg(F.max("no").alias("most"))  # a row for each partition
    before = sums.select("part", (F.sum("most").over(Window.orderBy("part")) - F.col("most")).alias("before"))
    named = rows.df.join(before, "part").withColumn("id", F.col("before") + F.col("no"))
    level = Stored(named.filter("chunk IS NULL").select("id", "f", "lang", F.col("word").cast("string").alias("phrase")), "phrases-1").df
    with arrow_bytes(docs.sparkSession):
        sides = chunks.df.select("chunk", "local").groupBy("chunk"), named.filter("chunk IS NOT NULL").select("chunk", "before", "ats", "nos").groupBy("chunk")
        out = Stored(sides[0].cogroup(sides[1]).applyInArrow(_renamed, CHUNK), "phrase-chunks", **CHUNK_FILES)
    chunks.drop()
    rows.drop()
    return totals, level, out


# --- longer phrases -----------------------------------------------------------------------------------------------------

SENT = "block int, share int, chunk long, keys binary, counts binary, often binary"
SEEN = "block int, share int, keys binary, often binary"
HASH = "block int, sizes array<int>, bits binary, keys binary"
SUMS = "block int, share int, counts binary"
HITS = "block int, n long, keys binary, counts binary"
BACK = "chunk long, keys binary, ids binary"


def _keys(g: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The places where two frequent phrases begin side by side, and the key of each pair."""
    at = np.flatnonzero((g[:-1] != 0) & (g[1:] != 0))
    return at, g[at] * span + g[at + 1]


def _ints(x: object, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(x.as_py() if hasattr(x, "as_py") else x, kind)


def _table(schema: str, **columns: list) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.table({name: pa.array(columns[name], types[kind]) for name, kind in (x.split(" ") for x in schema.split(", "))})


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys: the first and the gaps in 32 bits, where they fit."""
    gaps = np.diff(keys)
    if len(gaps) and gaps.max() >= 1 << 32:
        return b"\0" + keys.astype("<i8").tobytes()
    return b"\1" + keys[:1].astype("<i8").tobytes() + gaps.astype("<u4").tobytes()


def _unpacked(data: object) -> np.ndarray:
    data = data.as_py() if hasattr(data, "as_py") else data
    if data[:1] == b"\0":
        return np.frombuffer(data, "<i8", offset=1)
    return np.cumsum(np.concatenate([np.frombuffer(data, "<i8", 1, 1), np.frombuffer(data, "<u4", offset=9).astype(np.int64)]))


def _small(counts: np.ndarray) -> bytes:
    """Counts in 8 bits where they fit, otherwise in 32."""
    return b"\1" + counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b"\0" + counts.astype("<i4").tobytes()


def _counts(data: object) -> np.ndarray:
    data = data.as_py()
    return np.frombuffer(data, np.uint8 if data[:1] == b"\1" else "<i4", offset=1)


def _send(span: int, blocks: int, shares: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, g in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, n = np.unique(_keys(_loose(g), span)[1], return_counts=True)
                block = (mix(keys, 99) % np.uint64(blocks)).astype(np.int32)
                order = np.argsort(block, kind="stable")
                keys, n, block = keys[order], n[order], block[order]
                cuts = np.flatnonzero(np.diff(block, prepend=-1))
                share = int(mix(np.array([chunk]), 98)[0] % np.uint64(shares))
                pairs = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True))
                often = [np.packbits(n[a:b] >= least).tobytes() if n[a:b].max() >= least else b"" for a, b in pairs]
                yield from _table(SENT, block=block[cuts].tolist(), share=[share] * len(pairs), chunk=[chunk] * len(pairs), keys=[_packed(keys[a:b]) for a, b in pairs], counts=[_small(n[a:b]) for a, b in pairs], often=often).to_batches()

    return run


def _merged(keys: list[np.ndarray], often: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and whether each can be frequent: often in one chunk, or in more than one."""
    every = np.concatenate(keys)
    out, at, n = np.unique(every, return_inverse=True, return_counts=True)
    sure = n > 1
    sure[at[np.concatenate(often)]] = True
    return out, sure


def _seen(t: pa.Table) -> pa.Table:
    keys = [_unpacked(k) for k in t["keys"]]
    often = [np.unpackbits(np.frombuffer(o, np.uint8), count=len(k)).astype(bool) if o else np.zeros(len(k), bool) for k, o in zip(keys, t["often"].to_pylist(), strict=True)]
    found, sure = _merged(keys, often)
    return _table(SEEN, block=[t["block"][0].as_py()], share=[t["share"][0].as_py()], keys=[found.tobytes()], often=[sure.tobytes()])


def _seen_more(t: pa.Table) -> pa.Table:
    keys, sure = _merged([_ints(k) for k in t["keys"]], [_ints(c, np.bool_) for c in t["often"]])
    return _table(SEEN, block=[t["block"][0].as_py()], share=[t["share"][0].as_py()], keys=[keys.tobytes()], often=[sure.tobytes()])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            keys = _ints(batch.column(2)[i])[_ints(batch.column(3)[i], np.bool_)]
            if len(keys):
                h = PerfectHash.build(keys)
                yield from _table(HASH, block=[batch.column(0)[i].as_py()], sizes=[h.sizes], bits=[h.bits], keys=[h.keys.tobytes()]).to_batches()


def _hash(t: pa.Table) -> PerfectHash:
    return PerfectHash(t["sizes"][0].as_py(), t["bits"][0].as_py(), _ints(t["keys"][0]))


def _count(sent: pa.Table, hashes: pa.Table) -> pa.Table:
    """A mapper: the counts of a share's keys by slot."""
    if not sent.num_rows or not hashes.num_rows:
        return _table(SUMS, block=[], share=[], counts=[])
    h = _hash(hashes)
    total = np.zeros(len(h.keys), np.int64)
    slots = h.slots(np.concatenate([_unpacked(k) for k in sent["keys"]]))
    n = np.concatenate([_counts(c) for c in sent["counts"]])
    total += np.bincount(slots[slots >= 0], weights=n[slots >= 0], minlength=len(total)).astype(np.int64)
    return _table(SUMS, block=[sent["block"][0].as_py()], share=[sent["share"][0].as_py()], counts=[total.tobytes()])


def _add(t: pa.Table) -> pa.Table:
    total = np.sum([_ints(c) for c in t["counts"]], axis=0)
    return _table(SUMS, block=[t["block"][0].as_py()], share=[t["share"][0].as_py()], counts=[total.tobytes()])


def _tree(rows: DataFrame, merge: object, schema: str, shares: int) -> DataFrame:
    """One row a block of the rows of its shares, merged FAN at a time."""
    while shares > 1:
        shares = -(-shares // FAN)
        rows = rows.withColumn("share", F.expr(f"cast(share div {FAN} as int)")).groupBy("block", "share").applyInArrow(merge, schema)
    return rows


def _frequent(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = _ints(batch.column(1)[i])
                hot = n >= least
                if hot.any():
                    keys = _ints(batch.column(2)[i])[hot]
                    order = np.argsort(keys)
                    yield from _table(HITS, block=[batch.column(0)[i].as_py()], n=[len(keys)], keys=[keys[order].tobytes()], counts=[n[hot][order].tobytes()]).to_batches()

    return run


def _flat(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = _ints(batch.column(2)[i])
                ids = batch.column(0)[i].as_py() + 1 + np.arange(len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_ints(batch.column(3)[i])), pa.array(keys // span), pa.array(keys % span)], ["id", "f", "head", "tail"])

    return run


def _give_back(sent: pa.Table, found: pa.Table) -> pa.Table:
    """For each chunk the frequent ones of the keys that it sent, with their numbers."""
    out = {"chunk": [], "keys": [], "ids": []}
    if sent.num_rows and found.num_rows:
        known, first = _ints(found["keys"][0]), found["before"][0].as_py() + 1
        for chunk, keys in zip(sent["chunk"].to_pylist(), sent["keys"], strict=True):
            keys = _unpacked(keys)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[at] == keys
            if hit.any():
                out["chunk"].append(chunk)
                out["keys"].append(keys[hit].tobytes())
                out["ids"].append((first + at[hit]).astype(np.int64).tobytes())
    return _table(BACK, **out)


def _next(span: int):
    def run(chunks: pa.Table, back: pa.Table) -> pa.Table:
        if not chunks.num_rows or not back.num_rows:
            return _row(0, np.zeros(2, np.int64))
        g = _loose(chunks["g"][0])
        known, ids = np.concatenate([_ints(k) for k in back["keys"]]), np.concatenate([_ints(k) for k in back["ids"]])
        order = np.argsort(known)
        known, ids = known[order], ids[order]
        at, keys = _keys(g, span)
        found = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        out = np.zeros(len(g), np.int64)
        hit = known[found] == keys
        out[at[hit]] = ids[found[hit]]
        return _row(chunks["chunk"][0].as_py(), out)

    return run


def next_level(chunks: Stored, span: int, k: int, least: int, block_keys: int, share_chunks: int) -> tuple[DataFrame, Stored | None]:
    """The frequent phrases of k words (id, f, head, tail: the numbers of their first and last k - 1 words), and the chunks
    with these phrases' numbers, if a longer level follows. span: above every number of level k - 1."""
    spark = chunks.spark
    size = chunks.df.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).first()
    blocks, shares = -(-size["pairs"] // block_keys) or 1, -(-size["chunks"] // share_chunks) or 1
    with arrow_bytes(spark):
        sent = Stored(chunks.df.select("chunk", "g").mapInArrow(_send(span, blocks, shares, least), SENT), f"phrase-keys-{k}")
        seen = _tree(sent.df.select("block", "share", "keys", "often").groupBy("block", "share").applyInArrow(_seen, SEEN), _seen_more, SEEN, shares)
        hashes = Stored(seen.mapInArrow(_hashes, HASH), f"phrase-hashes-{k}")
        each = hashes.df.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        sums = _tree(sent.df.select("block", "share", "keys", "counts").groupBy("block", "share").cogroup(each.groupBy("block", "share")).applyInArrow(_count, SUMS), _add, SUMS, shares)
        hits = sums.select("block", "counts").join(hashes.df.select("block", "keys"), "block")
        hits = Stored(hits.mapInArrow(_frequent(least), HITS), f"phrase-hits-{k}")
        before = F.sum("n").over(Window.orderBy("block")) - F.col("n")  # a slim row for each block
        starts = hits.df.select("block", "n").select("block", before.alias("before"))
        found = hits.df.join(starts, "block")
        level = Stored(found.select("before", "n", "keys", "counts").mapInArrow(_flat(span), "id long, f long, head long, tail long"), f"phrases-{k}").df
        release(spark)
        out = None
        if k < LONGEST:
            each = found.select("block", "before", "keys").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
            back = sent.df.select("block", "share", "chunk", "keys").groupBy("block", "share").cogroup(each.groupBy("block", "share")).applyInArrow(_give_back, BACK)
            out = Stored(chunks.df.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_next(span), CHUNK), "phrase-chunks", **CHUNK_FILES)
    sent.drop()
    hashes.drop()
    hits.drop()
    release(spark)
    return level, out


def frequent_phrases(docs: DataFrame, *, least: int = LEAST, chunk_words: int = CHUNK_WORDS, block_keys: int = BLOCK_KEYS, share_chunks: int = SHARE) -> tuple[DataFrame, list[DataFrame]]:
    """n per lang, and for k = 1 to 5 the frequent phrases of k words: id, f, lang, phrase, last (its last word), heads and tails
    (the counts of its first and of its last 1, 2, ... words), head and tail (ids of the level before)."""
    totals, first, chunks = frequent_words(docs, least, chunk_words)
    none = F.array().cast("array<bigint>")
    levels = [first.select("id", "f", "lang", "phrase", F.col("phrase").alias("last"), none.alias("heads"), none.alias("tails"), F.lit(0).cast("long").alias("head"), F.lit(0).cast("long").alias("tail"))]
    for k in range(2, LONGEST + 1):
        span = (levels[-1].agg(F.max("id")).first()[0] or 0) + 1
        if span > 3_000_000_000:
            raise ValueError(f"{span - 1} frequent phrases of {k - 1} words: their pairs need more than 64 bits")
        bare, after = next_level(chunks, span, k, least, block_keys, share_chunks)
        chunks.drop()
        chunks = after
        a = levels[-1].select(F.col("id").alias("head"), "lang", F.col("phrase").alias("start"), "heads", F.col("f").alias("f_head"))
        b = levels[-1].select(F.col("id").alias("tail"), "last", "tails", F.col("f").alias("f_tail"))
        rows = bare.join(a, "head").join(b, "tail")
        levels.append(Stored(rows.select("id", "f", "lang", F.concat("start", F.lit(" "), "last").alias("phrase"), "last", F.array_append("heads", F.col("f_head")).alias("heads"), F.array_append("tails", F.col("f_tail")).alias("tails"), "head", "tail"), f"phrases-{k}").df)
    return totals, levels


def _wide(c: str) -> str:
    return f"cast({c} as decimal(38, 0))"


def collocations(docs: DataFrame, *, top: int = TOP, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's best-scoring phrases that no longer one explains."""
    totals, levels = frequent_phrases(docs, **sizes)
    kept = []
    for k, rows in enumerate(levels[1:], 2):
        if k < LONGEST:  # what holds a phrase and is as frequent holds one of k + 1 words that is, too
            longer = levels[k].select(F.explode(F.array("head", "tail")).alias("id"), F.col("f").alias("around")).groupBy("id").agg(F.max("around").alias("around"))
            rows = rows.join(longer, "id", "left").filter("around IS NULL OR 100 * around < 100 * f")
        kept.append(rows.select("lang", "phrase", F.col("f").alias("a"), "heads", "tails"))
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    every = every.join(totals, "lang")
    score = f"({_wide('a')} * {_wide('n')} * {_wide('1000')}) div ({_wide('x.l')} * {_wide('x.r')})"
    cut = F.expr(f"array_min(transform(zip_with(heads, reverse(tails), (l, r) -> struct(l, r)), (x, k) -> struct({score} AS score, k, x.l AS l, x.r AS r)))")
    scored = Stored(every.withColumn("cut", cut).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), "phrases-scored").df
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    deal = max(1, int((scored.count() / top) ** 0.5))
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(deal))).orderBy(*order)
    best = scored.withColumn("place", F.row_number().over(some)).filter(F.col("place") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))
