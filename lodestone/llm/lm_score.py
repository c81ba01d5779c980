"""Language-model scores by logistic context mixing over bits.

A text is its lower-cased words (A-Z alone are folded) and one end, read in order and coded bit by bit: a word of the
vocabulary is a path in a Huffman tree over words; any other is the tree's escape and then its bytes and a blank, each a path
in a Huffman tree over bytes. Each bit is predicted from several hashed contexts together with its node: nothing, the
language that most words of the last WINDOW have, the word before, the two before, the one before that alone; for a spelled
word its last one, two and three bytes, its bytes so far, and the language with the last byte. Their counts come from all
training documents, those whose crc32(doc_id) mod 5 is not 1. One more input follows the text itself: what the
node's bits were in it so far. Predictions are stretched, weighted by weights that the context's
count gates, added and squashed. The weights are learned online by gradient descent on the coding cost over the training
documents in every task, each bit's own occurrence left out of its counts, and averaged; the inputs come as codes then. A
spelled word costs what its bytes and language say, so distinct ones are counted, learned from (in the order of a hash, as often as
they occur) and scored once, and joined with the documents that hold them. A last adaptive map from the mixed
prediction and the depth in the tree to the frequency that was seen refines it. A text's score is the sum over its bits.

The vocabulary are the words of LEAST training occurrences or more, with a higher bound where there are more than FREQUENT of
them. A word's language is the column lang (KINDS - 1 commonest and a rest) of half its occurrences or more; a scored text's
own lang is not used. Word counts stay distributed; collected are count tables of fixed size, weights and the vocabulary.

A null or empty text is an end alone. Rows that repeat a doc_id come back each; a null doc_id's remainder is that of the
empty string. A very long text is read BULK bytes at a time, with the words before as context; what it follows of itself
starts anew there. Without training documents all counts are zero and the base is one of an empty vocabulary; an empty table
gives no row. Only doc_id, lang and text are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, bounded, documents, held_out_modulus, release, slim, stored

FREQUENT = 1 << 16
LEAST = 2
LONGEST = 64  # bytes of a word of the vocabulary
KINDS = 8
WINDOW = 16
NODE_BITS = 17
#: Slots, as powers of two, of the words' contexts and of the bytes'.
WORD_BITS = (NODE_BITS, NODE_BITS + 3, 22, 22, 21)
BYTE_BITS = (17, 18, 19, 19, 18)
OFFSETS = np.cumsum([0, *(1 << b for b in WORD_BITS + BYTE_BITS)])
SLOTS, WORD_SLOTS = int(OFFSETS[-1]), int(OFFSETS[len(WORD_BITS)])
FOLLOWED = 1
INPUTS = (len(WORD_BITS) + FOLLOWED, len(BYTE_BITS))
GATES = 8
#: Weights at first: of the node alone or the byte before, and of each other prediction.
FIRST, WEIGHT = 1.0, 0.0
RATE = 0.15
STEPS = 1 << 15, 1 << 12  # bits between two changes of the weights; those of a distinct spelled word stand for several
BLOCK = 1 << 16  # counts that travel together
BULK = 1 << 16
HELD = 1 << 14  # bytes of distinct words that are spelled at once
MANY = 300_000  # words that a task counts before it passes them on
MOST = 1_000_000  # words with counts of some texts each, before those of one word are added
GATHERED = 1 << 20  # words that a task reads before it counts the distinct ones among them
LEVELS = 4  # of a tree, whose nodes lie side by side
BASE = 0x9E3779B97F4A7C15

WORDS = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("kind", T.IntegerType()), T.StructField("c", T.LongType())])
BYTES = T.StructType([T.StructField("counts", T.BinaryType())])
TABLE = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("counts", T.BinaryType())])
COUNTED = T.StructType([*TABLE.fields, T.StructField("word", T.BinaryType()), T.StructField("kind", T.IntegerType()), T.StructField("n", T.LongType())])
LEARNED = T.StructType([T.StructField("w", T.BinaryType()), T.StructField("seen", T.BinaryType()), T.StructField("n", T.LongType())])
SPELLED = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("kind", T.IntegerType()), T.StructField("c", T.LongType()), T.StructField("cost", T.DoubleType())])
PARTS = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("word", T.BinaryType()), T.StructField("kind", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()),
])


class Code:
    """A Huffman code: for symbol s the nodes and bits of its path are node[first[s] : first[s] + size[s]] and bit[...]."""

    def __init__(self, counts: list[int]) -> None:
        tie = count()
        heap: list[tuple] = [(c + 1, next(tie), s, None, None) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        while len(heap) > 1:
            x, y = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (x[0] + y[0], next(tie), None, x, y))
        names, at, tops = {}, 0, [heap[0]]
        while tops:  # LEVELS levels of nodes have numbers side by side, so that a path meets few cache lines of a table
            level, block = [tops.pop()], []
            for _ in range(LEVELS):
                level = [x for x in level if x[2] is None]
                block += level
                level = [x for _, _, _, *both in level for x in both]
            tops += [x for x in level if x[2] is None]
            line = 1 << LEVELS
            at += -at % line if at % line + len(block) > line else 0
            names |= {x[1]: at + i for i, x in enumerate(block)}
            at += len(block)
        paths: list[tuple] = [()] * len(counts)
        todo = [(heap[0], ())]
        while todo:
            (_, tie_, s, x, y), path = todo.pop()
            if s is not None:
                paths[s] = path
            else:
                todo += [(x, (*path, (names[tie_], 0))), (y, (*path, (names[tie_], 1)))]
        self.size = np.array([len(p) for p in paths])
        self.first = np.cumsum(self.size) - self.size
        self.node = np.array([n for p in paths for n, _ in p], np.int32)
        self.bit = np.array([b for p in paths for _, b in p], np.uint8)
        depth = np.array([min(i, 7) for p in paths for i in range(len(p))], np.int32)
        self.step = self.node << 4 | depth << 1 | self.bit
        self.turn = self.node << 1 | self.bit

    def _at(self, n: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        at = np.repeat(self.first[symbols] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return at

    def turns(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the bits of some symbols: how many each has, and 2 * node + bit."""
        n = self.size[symbols]
        return n, self.turn.take(self._at(n, symbols))

    def spell(self, symbols: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the bits of some symbols: how many each has, and their nodes, depths (to 7), bits."""
        n = self.size[symbols]
        step = self.step.take(self._at(n, symbols))
        return n, step >> 4, step >> 1 & 7, (step & 1).astype(np.uint8)


class Model:
    """The vocabulary (word -> symbol), the symbols' languages, and the codes of words and bytes."""

    def __init__(self, words: list[tuple[bytes, int, int]], rest: int, letters: np.ndarray) -> None:
        """words: (word, count, kind), the end, the empty word, among them; rest: training tokens that are none of them."""
        self.symbol = {w: i for i, (w, _, _) in enumerate(words)}
        self.end, self.escape = self.symbol[b""], len(words)
        self.words_ = pa.array([w for w, _, _ in words], pa.binary())
        self.kind = np.array([k for _, _, k in words] + [KINDS - 1], np.int64)
        self.words, self.bytes = Code([c for _, c, _ in words] + [rest]), Code(letters.tolist())


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


POWERS = [_powers(b, 4 * BULK) for b in (BASE, pow(BASE, -1, 1 << 64))]


def _slots(k: int, bits: int, context: np.ndarray, n: np.ndarray, node: np.ndarray, turns: int = 0) -> np.ndarray:
    """Slots in table k of hashed contexts (uint32), each with n nodes; with turns, of two entries a slot, node being 2 * node + bit."""
    x = context * np.uint32(0x27D4EB2F)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x165667B1)
    return _joined((x >> np.uint32(32 - bits)).astype(np.int32) + np.int32(OFFSETS[k]), n, node, turns)


def _joined(first: np.ndarray, n: np.ndarray, node: np.ndarray, turns: int) -> np.ndarray:
    """Tables begin at multiples of what a node may be, so that a node changes the lower bits of a slot alone."""
    out = np.repeat(first << turns, n)
    out ^= node
    return out


def _so_far(node: np.ndarray, bit: np.ndarray, begin: np.ndarray, codes: bool = False) -> np.ndarray:
    """The inputs from how many bits of the same node were 0 and 1 before each bit of its piece; begin: where pieces begin."""
    size = np.diff(begin, append=len(node))
    shift = int(size.max(initial=1)).bit_length()
    number = np.uint32 if NODE_BITS + shift <= 32 else np.uint64
    ahead = np.repeat(begin, size)
    keys = node.astype(number)
    keys <<= number(shift)
    keys |= (np.arange(len(node)) - ahead).astype(number)  # nodes with their places: any sort is stable
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(node)]):
        keys[a:b].sort()
    order = (keys & number((1 << shift) - 1)).astype(np.intp)
    order += ahead
    keys >>= number(shift)
    new = np.empty(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    new[begin] = True
    start = np.flatnonzero(new)
    now = bit.take(order)
    ones = np.cumsum(now, dtype=np.int32)
    ones -= now
    zeros = np.arange(len(keys), dtype=np.int32)
    zeros -= ones
    count = np.diff(start, append=len(keys))
    before = ones.take(start)
    ones -= np.repeat(before, count)
    zeros -= np.repeat(start.astype(np.int32) - before, count)
    found = _followed(zeros, ones, codes)
    out = np.empty_like(found)
    out[order] = found
    return out


def _window(kind: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The kind that most of the WINDOW words before each have, words of no kind aside; the least of several."""
    sums = np.zeros(len(kind) + 1, np.uint64)  # a byte for each kind
    np.cumsum(_ONE.take(kind), out=sums[1:])
    at = np.arange(len(kind))
    near = sums[:-1] - sums[at - np.minimum(place, WINDOW)]
    best = np.zeros(len(kind), np.uint8)
    for k in np.flatnonzero(np.bincount(kind, minlength=KINDS)[: KINDS - 1]).tolist():
        n = (near >> np.uint64(8 * k)).astype(np.uint8)  # WINDOW and less
        np.maximum(best, np.where(n > 0, n * np.uint8(KINDS) + np.uint8(KINDS - 1 - k), 0), out=best)
    return np.where(best > 0, KINDS - 1 - best % KINDS, KINDS - 1).astype(np.int32)


_ONE = np.array([*(1 << 8 * k for k in range(KINDS - 1)), 0], np.uint64)


class Read:
    """The words of pieces of texts, all at once: each coded word's symbol, piece and the language of the words before it; and
    the same of those that are spelled.

    A piece begins with a lead, which is context and isn't coded. counts and leads: words of each piece and of its lead."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray, leads: np.ndarray, model: Model, words: Callable[[np.ndarray], pa.Array]) -> None:
        self.all, self.end = symbols, model.end
        piece = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(symbols)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.coded = np.flatnonzero(self.place >= np.repeat(leads, counts)) if leads.any() else slice(None)
        kind = _window(model.kind[symbols], self.place)
        self.symbol, self.piece, self.kind = symbols[self.coded], piece[self.coded], kind[self.coded]
        rare = np.flatnonzero(self.symbol == model.escape)
        rare = self.coded[rare] if leads.any() else rare
        self.rare, self.rare_kind, self.rare_piece = words(rare), kind[rare], piece[rare]

    @classmethod
    def lists(cls, pieces: list[tuple[list[bytes], list[bytes]]], model: Model) -> Read:
        """pieces: (lead, words)."""
        flat = [w for piece in pieces for some in piece for w in some]
        symbols = np.array(list(map(model.symbol.get, flat, repeat(model.escape))), np.int64)
        return cls(symbols, np.array([len(a) + len(b) for a, b in pieces]), np.array([len(a) for a, _ in pieces]), model, lambda at: pa.array([flat[i] for i in at.tolist()], pa.binary()))

    def contexts(self) -> list[list[np.ndarray]]:
        """For each of the words' tables what stands for its context."""
        before = []
        for k in (1, 2):
            x = np.full(len(self.all), self.end)
            x[k:] = np.where(self.place[k:] >= k, self.all[:-k], self.end)
            before.append(x[self.coded])
        one, two = before
        return [[], [self.kind], [one], [one, two], [two]]


def _table(k: int, context: list[np.ndarray], n: np.ndarray, node: np.ndarray, turns: int = 0) -> np.ndarray:
    """Slots in the words' table k of the symbols or kinds that are its context, each with n nodes; turns: see _slots."""
    mix = np.uint32(0x9E3779B1)
    if k == 0:
        return node
    if k == 1:
        return _joined((context[0].astype(np.int32) << NODE_BITS) + np.int32(OFFSETS[1]), n, node, turns)
    x = [c.astype(np.uint32) for c in context]
    if k == 3:
        h = ((x[0] + np.uint32(7)) * mix ^ (x[1] + np.uint32(3))) * np.uint32(0xC2B2AE35)
    else:
        h = (x[0] + np.uint32(1)) * mix if k == 2 else (x[0] + np.uint32(11)) * np.uint32(0xC2B2AE3D)
    return _slots(k, WORD_BITS[k], h, n, node, turns)


class Bits:
    """The bits of pieces of texts in two groups, words and spelled bytes: (slots of each context, bit, depth, piece, inputs
    from the text so far). Without spell there is the first group alone; codes: the inputs as codes, and slots of two entries, by bit.
    begin and pieces: where the bits of each piece's words begin, and the piece."""

    def __init__(self, pieces: Read | list[tuple[list[bytes], list[bytes]]], model: Model, follow: bool = True, spell: bool = True, codes: bool = False) -> None:
        read = pieces if isinstance(pieces, Read) else Read.lists(pieces, model)
        n, node, depth, bit = model.words.spell(read.symbol)
        at = node << 1 | bit if codes else node
        slots = [_table(k, c, n, at, int(codes)) for k, c in enumerate(read.contexts())]
        own = np.repeat(read.piece, n)
        first = np.flatnonzero(np.diff(read.piece, prepend=-1))
        self.begin, self.pieces = (np.cumsum(n) - n)[first], read.piece[first]
        seen = [_so_far(node, bit, self.begin, codes)] if follow else []
        self.groups = [(slots, bit, depth, own, seen)]
        if spell:
            slots, bit, depth, word = spelled(read.rare.to_pylist(), read.rare_kind, model)
            self.groups.append((slots, bit, depth, read.rare_piece[word], []))


def spelled(words: list[bytes], kind: np.ndarray, model: Model, turns: int = 0) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The bits of words and the blanks after them: slots of each context, bit, depth, the word's place. A word's bits depend on
    its bytes and its kind alone; turns: see _slots."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    data = np.frombuffer(b"".join([x for w in words for x in (w, b" ")]), np.uint8)
    start = np.repeat(np.cumsum(size) - size, size)
    owner, at = np.repeat(np.arange(len(words)), size), np.arange(len(data))
    up, down = POWERS if len(data) <= 4 * BULK else [_powers(b, len(data)) for b in (BASE, pow(BASE, -1, 1 << 64))]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=sums[1:])
    prefix = (sums[:-1] - sums[start]) * down[start]
    h, contexts = np.zeros(len(data), np.uint32), []
    for k in (1, 2, 3):
        back = np.where(at - k >= start, data[np.maximum(at - k, 0)] if len(data) else data, 0).astype(np.uint32)
        h = (h ^ (back + np.uint32(k << 10))) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        contexts.append(h)
    contexts.append(((prefix ^ (prefix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32))
    contexts.append((contexts[0] + kind[owner].astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA77))
    n, node, depth, bit = model.bytes.spell(data.astype(np.int64))
    at = node << 1 | bit if turns else node
    slots = [_slots(len(WORD_BITS) + k, BYTE_BITS[k], c, n, at, turns) for k, c in enumerate(contexts)]
    return slots, bit, depth, np.repeat(owner, n)


def _words(text: bytes) -> list[bytes]:
    """A text's words in order and its end, the empty word."""
    return [*text.lower().split(), b""]


def _bulks(texts: Iterator[list[bytes]]) -> Iterator[tuple[list[int], list[tuple[list[bytes], list[bytes]]]]]:
    """Pieces of the texts in order with their texts' places, about BULK bytes at a time; a longer text is cut between words."""
    held, places, size = [], [], 0
    for place, words in enumerate(texts):
        n = sum(map(len, words)) + len(words)
        if n <= BULK:
            cuts = [0, len(words)]
        else:
            cuts = _cuts(np.cumsum([len(w) + 1 for w in words]))
        for a, b in zip(cuts, cuts[1:]):
            mine = n if len(cuts) == 2 else sum(map(len, words[a:b])) + b - a
            if held and size + mine > BULK:
                yield places, held
                held, places, size = [], [], 0
            held.append((words[max(0, a - WINDOW) : a], words[a:b]))
            places.append(place)
            size += mine
    if held:
        yield places, held


def _cuts(ends: np.ndarray) -> list[int]:
    """Where a text is cut into pieces, between its words with these ends in bytes, the blanks after them included."""
    return [0, *(np.flatnonzero(np.diff(ends // BULK)) + 1).tolist(), len(ends)]


def _split(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts without their ends, the text of each, and its size."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(column.view(pa.string())))
    words, text = found.flatten().view(pa.binary()), np.repeat(np.arange(len(column)), pc.list_value_length(found).to_numpy())
    size = pc.binary_length(words).to_numpy()
    if not (some := size > 0).all():  # blanks at a text's ends leave empty strings
        words, text, size = words.filter(pa.array(some)), text[some], size[some]
    return words, text, size


def _reads(column: pa.Array, model: Model) -> Iterator[tuple[np.ndarray, Read]]:
    """_bulks of a batch's texts with their words read; the words never become Python objects."""
    n = len(column)
    words, text, size = _split(column)
    count = np.bincount(text, minlength=n)
    last = np.cumsum(count + 1) - 1
    inner = np.ones(len(size) + n, bool)
    inner[last] = False
    symbols, told = np.full(len(inner), model.end, np.int64), np.ones(len(inner), np.int64)
    symbols[inner] = pc.index_in(words, value_set=model.words_).fill_null(model.escape).to_numpy()
    told[inner] += size
    where, ends = np.cumsum(inner) - 1, np.cumsum(told)
    begin, sizes = (last - count).tolist(), np.diff(ends[last], prepend=0).tolist()

    def read(held: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, Read]:
        places, leads, a, b = np.array(held, np.int64).T
        at = np.arange(a[0], b[-1]) if not leads.any() else np.concatenate([np.arange(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        return places, Read(symbols[at], b - a, leads, model, lambda i: words.take(pa.array(where[at[i]])))

    held, total = [], 0
    for i, (first, end, mine) in enumerate(zip(begin, last.tolist(), sizes, strict=True)):
        before = int(ends[first - 1]) if first else 0
        cuts = [0, end + 1 - first] if mine <= BULK else _cuts(ends[first : end + 1] - before)
        for x, y in zip(cuts, cuts[1:]):
            bytes_ = mine if len(cuts) == 2 else int(ends[first + y - 1] - (ends[first + x - 1] if first + x else 0))
            if held and total + bytes_ > BULK:
                yield read(held)
                held, total = [], 0
            lead = min(x, WINDOW)
            held.append((i, lead, first + x - lead, first + y))
            total += bytes_
    if held:
        yield read(held)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, kind, count in training documents of that kind) of many documents at a time, kind -1 for other documents'
    words, with count 0; the end is the empty word."""
    held: dict[int, list[pa.Table]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for kind, tables in held.items():
            for b in tables[0].to_batches(max_chunksize=50_000):
                n = b.column(1) if kind >= 0 else pa.array(np.zeros(b.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([kind] * b.num_rows, pa.int32()), n], WORDS.names)
        held.clear()

    def rows() -> int:
        return sum(t.num_rows for tables in held.values() for t in tables)

    def add() -> None:
        for kind, tables in held.items():
            held[kind] = [pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])]

    for whole in batches:
        for kind in pc.unique(whole.column(1)).to_pylist():
            for batch in bounded(whole.filter(pc.equal(whole.column(1), kind)), 0, 1000):
                found = _split(batch.column(0))[0].value_counts()
                words, n = pa.concat_arrays([found.field(0), pa.array([b""], pa.binary())]), pa.concat_arrays([found.field(1), pa.array([batch.num_rows], pa.int64())])
                held.setdefault(kind, []).append(pa.table({"word": words, "c": n}))
        if rows() > MOST:
            add()
            if rows() > MANY:
                yield from flush()
    add()
    yield from flush()


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of words and the blanks after them, as often as the words occur."""
    total = np.zeros(256, np.int64)
    for batch in batches:
        words = batch.column(0).to_pylist()
        times = np.repeat(batch.column(1).to_numpy(), [len(w) + 1 for w in words])
        total += np.bincount(np.frombuffer(b"".join([x for w in words for x in (w, b" ")]), np.uint8), weights=times, minlength=256).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], BYTES.names)


def _pack(table: np.ndarray) -> bytes:
    return pa.compress(table.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * BLOCK, codec="zstd", asbytes=True), "<i4")


def _blocks(table: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
    """A task's table in blocks, the first of which has a number of its own."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for block in range(len(table) // BLOCK):
        x = np.minimum(table[block * BLOCK : (block + 1) * BLOCK], 1 << 30)
        if x.any():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first + block], pa.int32()), pa.array([_pack(x)])], TABLE.names)


def _count_distinct(table: np.ndarray, gathered: list[tuple[np.ndarray, list[list[np.ndarray]]]], model: Model) -> None:
    """Adds the bits of (symbols, contexts) to the words' table: each word alone and with each kind once, as often as it occurs, and
    one by one in the contexts that are mostly met once."""
    if not gathered:
        return
    symbols, base = np.concatenate([x for x, _ in gathered]), len(model.kind)
    for k in (0, 1):
        keys = np.concatenate([c[1][0] for _, c in gathered]) * base + symbols if k else symbols
        times = np.bincount(keys)
        keys = np.flatnonzero(times)
        kind, symbol = np.divmod(keys, base)
        for i in range(0, len(keys), BULK):
            some = slice(i, i + BULK)
            n, turn = model.words.turns(symbol[some])
            np.add.at(table, _table(k, [kind[some]], n, turn, 1), np.repeat(times[keys[some]].astype(np.int32), n))
    for symbols, contexts in gathered:
        n, turn = model.words.turns(symbols)
        for k in range(2, len(WORD_BITS)):
            np.add.at(table, _table(k, contexts[k], n, turn, 1), np.int32(1))
    gathered.clear()


def _count_bits(model: object):
    """Of (text, whether it is one to train on): the words' table in blocks, and (word, kind, count in training documents) of
    spelled words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, m = np.zeros(2 * WORD_SLOTS, np.int32), model.value
        gathered: list[tuple[np.ndarray, list[list[np.ndarray]]]] = []
        held: tuple[Counter, Counter] = Counter(), Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            for train, counts in enumerate(held):
                keys = list(counts)
                n = [*counts.values()] if train else [0] * len(keys)
                for i in range(0, len(keys), 50_000):
                    some = keys[i : i + 50_000]
                    given = [pa.array([w[:-1] for w in some], pa.binary()), pa.array([w[-1] for w in some], pa.int32()), pa.array(n[i : i + 50_000], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(len(some), pa.int32())] * 2, pa.nulls(len(some), pa.binary()), *given], COUNTED.names)
                counts.clear()

        for batch in batches:
            for wanted in (False, True):
                for texts in bounded(batch.filter(pc.equal(batch.column(1), wanted)), 0, 1000):
                    for _, read in _reads(texts.column(0), m):
                        if wanted:
                            gathered.append((read.symbol, read.contexts()))
                            if sum(len(x) for x, _ in gathered) > GATHERED:
                                _count_distinct(table, gathered, m)
                        held[wanted].update([w + _KIND[k] for w, k in zip(read.rare.to_pylist(), read.rare_kind.tolist(), strict=True)])
            if sum(map(len, held)) > MANY:
                yield from rows()
        yield from rows()
        _count_distinct(table, gathered, m)
        for b in _blocks(table, 0):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())], COUNTED.names)

    return run


_KIND = [bytes([k]) for k in range(KINDS)]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """(words, kinds, counts with that kind, counts) about HELD bytes at a time, of rows (word, c, n0, n1, ...), where a word
    that never has a kind has a null."""
    for batch in batches:
        for b in bounded(batch, 0, 4096, HELD):
            words = b.column(0).to_pylist()
            n = np.column_stack([b.column(2 + k).fill_null(-1).to_numpy(zero_copy_only=False) for k in range(KINDS)])
            row, kind = np.nonzero(n >= 0)
            yield [words[i] for i in row.tolist()], kind, n[row, kind], b.column(1).to_numpy(zero_copy_only=False)[row]


def _count_spelled(model: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(-(-2 * (SLOTS - WORD_SLOTS) // BLOCK) * BLOCK, np.int64)
        for words, kind, n, _ in _distinct(batches):
            slots, _, _, word = spelled(words, kind, model.value, 1)
            times = n[word]
            for s in slots:
                np.add.at(table, (s - 2 * WORD_SLOTS).astype(np.int64), times)
        yield from _blocks(table, 2 * WORD_SLOTS // BLOCK)

    return run


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for x in table["counts"]:
        total += _unpack(x.as_py())
    total = np.minimum(total, 1 << 30)  # beyond it a frequency doesn't change
    return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "block": pa.array([table["block"][0].as_py()], pa.int32()), "counts": pa.array([_pack(total)])})


def _gate(n: np.ndarray) -> np.ndarray:
    """By the count of a context: 0, 1, 2, 3-4, 5-8, ... up to GATES - 1."""
    return np.minimum(np.ceil(np.log2(n + 1)).astype(np.int64), GATES - 1)


def _stretch(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.log((one + 0.4) / (zero + 0.4))


def _input(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Stretched predictions with their gates in the last three bits of the float, so that one look-up gives both."""
    x = _stretch(zero, one).astype(np.float32).view(np.int32)
    return (x & -GATES | _gate(zero + one).astype(np.int32)).view(np.float32)


#: Inputs by small counts, which a text's own mostly are.
_SMALL = _input(*np.divmod(np.arange(1 << 12), 64))


def _code(x: np.ndarray) -> np.ndarray:
    """Inputs as codes: the gate and one of CODES steps of the prediction, which are finer near zero."""
    level = np.rint(x / (np.abs(x) + 4) * (CODES // 2 - 1)).astype(np.int32) + CODES // 2
    return (level * GATES + (x.view(np.int32) & (GATES - 1))).astype(np.uint16)


CODES = 512
_LEVEL = (np.arange(CODES) - CODES // 2).clip(1 - CODES // 2, CODES // 2 - 1) / (CODES // 2 - 1)
#: The prediction that a code stands for; nothing is as far out as the ends.
_CODED = np.repeat(4 * _LEVEL / (1 - np.abs(_LEVEL).clip(0, 0.99)), GATES)
_CODED_SINGLE, _CODED_SQUARE = _CODED.astype(np.float32), _CODED * _CODED
_SMALL_CODES = _code(_SMALL)


def _followed(zero: np.ndarray, one: np.ndarray, codes: bool = False) -> np.ndarray:
    """Inputs of what a text showed so far."""
    high = np.maximum(zero, one)
    small = (_SMALL_CODES if codes else _SMALL)
    if high.max(initial=0) < 64:
        return small.take((zero << 6) + one)
    x = small.take((np.minimum(zero, 63) << 6) + np.minimum(one, 63))
    big = np.flatnonzero(high > 63)
    far = _input(zero[big], one[big])
    x[big] = _code(far) if codes else far
    return x


def _left_out(table: np.ndarray) -> np.ndarray:
    """Inputs by slot and the bit whose own occurrence is left out of the counts; but not where the node is the whole context:
    the tree balances those counts, so the lesser one would give the bit away."""
    x = np.empty(len(table), np.float32)
    for i in range(0, len(table), BLOCK):
        zero, one = table[i : i + BLOCK][0::2].astype(np.float64), table[i : i + BLOCK][1::2].astype(np.float64)
        x[i : i + BLOCK][0::2], x[i : i + BLOCK][1::2] = _input(np.maximum(zero - 1, 0), one), _input(zero, np.maximum(one - 1, 0))
    plain = 2 << WORD_BITS[0]
    x[:plain] = np.repeat(_input(table[0:plain:2].astype(np.float64), table[1:plain:2].astype(np.float64)), 2)
    return x


def _map(z: np.ndarray, depth: np.ndarray) -> np.ndarray:
    u = z * np.float32(3)
    u += np.float32(32)
    out = np.clip(u, 0, 63, out=u).astype(np.intp)
    out += depth << 6
    return out


def _start() -> list[np.ndarray]:
    return [np.vstack([np.full((1, GATES), FIRST), np.full((n - 1, GATES), WEIGHT)]) for n in INPUTS]


def learn_step(w: np.ndarray, inputs: list[np.ndarray], bit: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Mixes one stretch of bits and moves the weights w (inputs x gates) along the coding cost's gradient, each by its own
    curvature; a bit may count several times. Returns the mixed predictions, stretched."""
    gates = [(x.view(np.int32) & (GATES - 1)).astype(np.intp) for x in inputs]
    z, now = np.zeros(len(bit), np.float32), w.astype(np.float32)
    for k, (g, x) in enumerate(zip(gates, inputs, strict=True)):
        z += now[k].take(g) * x
    p = 1 / (1 + np.exp(-np.clip(z, -20, 20)))
    error, bend = bit - p, p * (1 - p)
    if times is not None:
        error, bend = error * times, bend * times
    for k, (g, x) in enumerate(zip(gates, inputs, strict=True)):
        slope = error * x
        x = x * x
        x *= bend
        w[k] += RATE * np.bincount(g, weights=slope, minlength=GATES) / (np.bincount(g, weights=x, minlength=GATES) + 20)
    np.maximum(w, 0, out=w)  # what was left out of a count must not count against it
    return z


def code_step(w: np.ndarray, codes: list[np.ndarray], bit: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """learn_step for inputs as codes: sums by code instead of sums by gate of products. Errors and curvatures are whole numbers of
    small steps, both in one float, so that one sum by code gives both: of at most STEPS[0] bits, repeats counted, it is exact;
    more are summed apart."""
    z = np.zeros(len(bit), np.float32)
    codes = [c.astype(np.intp) for c in codes]
    for now, c in zip(w, codes, strict=True):
        z += (np.tile(now.astype(np.float32), CODES) * _CODED_SINGLE).take(c)
    p = np.clip(z, -20, 20)
    np.negative(p, out=p)
    np.exp(p, out=p)
    p += 1
    np.reciprocal(p, out=p)
    error = np.rint((bit - p) * np.float32(ERROR)).astype(np.float64)
    p -= p * p
    p *= np.float32(BEND)
    bend = np.rint(p, out=p)
    if times is not None:
        error, bend = error * times, bend * times
    both = error * APART + bend if (len(bit) if times is None else times.sum()) <= STEPS[0] else None
    for now, c in zip(w, codes, strict=True):
        if both is None:
            slope, curve = (np.bincount(c, weights=x, minlength=CODES * GATES) for x in (error, bend))
        else:
            sums = np.bincount(c, weights=both, minlength=CODES * GATES)
            slope = np.floor(sums * (1 / APART))
            curve = sums - slope * APART
        now += RATE * _by_gate(slope, _CODED) / ERROR / (_by_gate(curve, _CODED_SQUARE) / BEND + 20)
    np.maximum(w, 0, out=w)
    return z


def _by_gate(sums: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Sums over the codes of each gate, in two steps of wide rows."""
    return (sums * factor).reshape(64, -1).sum(axis=0).reshape(-1, GATES).sum(axis=0)


#: Steps of errors and curvatures (at most a quarter); APART is more than STEPS[0] curvatures, and all fit a float's 53 bits.
ERROR, BEND, APART = 1 << 14, 1 << 10, 1 << 24


def _learn(group: int, counts: object, bits: object):
    """Weights and the map of a group; bits gives a task's (slots of two entries, bit, depth, inputs from the text so far, times or None, how many
    bits of the same texts are in the other group). A task's weights count by all its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = counts.value
        w, seen, n = _start()[group], np.zeros((2, 512)), 0
        for slots, bit, depth, own, times, more in bits(batches):
            for i in range(0, len(bit), STEPS[group]):
                some = slice(i, i + STEPS[group])
                often = None if times is None else times[some]
                seen_ = [*[inputs.take(s[some]) for s in slots], *[x[some] for x in own]]
                z = code_step(w, seen_, bit[some], often)
                m = np.bincount(_map(z, depth[some]) << 1 | bit[some], weights=often, minlength=1024).reshape(512, 2)
                seen += [m.sum(axis=1), m[:, 1]]
            n += more + (len(bit) if times is None else int(times.sum()))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([seen.tobytes()]), pa.array([n], pa.int64())], LEARNED.names)

    return run


def _word_bits(model: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, read in (r for whole in batches for batch in bounded(whole, 0, 1000) for r in _reads(batch.column(0), model.value)):
            slots, bit, depth, _, own = Bits(read, model.value, spell=False, codes=True).groups[0]
            letters = np.frombuffer(b" ".join([*read.rare.to_pylist(), b""]), np.uint8)
            yield slots, bit, depth, own, None, int(model.value.bytes.size[letters].sum())

    return run


def _spelled_bits(model: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for words, kind, n, _ in _distinct(batches):
            some = np.flatnonzero(n)
            slots, bit, depth, word = spelled([words[i] for i in some.tolist()], kind[some], model.value, 1)
            yield [s - 2 * WORD_SLOTS for s in slots], bit, depth, [], n[some][word], 0

    return run


FINE = 512


def _fine(x: np.ndarray) -> np.ndarray:
    """Weighted predictions in steps of 1 / FINE, so that five sum up within 16 bits; more than 12 is 12 in the mix."""
    out = np.empty(len(x), np.int16)
    for i in range(0, len(x), BLOCK):
        out[i : i + BLOCK] = np.rint(np.clip(x[i : i + BLOCK], -12.7, 12.7) * FINE)
    return out


def _logs(slots: list[np.ndarray], bit: np.ndarray, depth: np.ndarray, own: list[np.ndarray], weighted: np.ndarray, w: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """The natural log-probability of each bit; weighted: as numbers, or as _fine has them."""
    z = weighted.take(slots[0])
    for s in slots[1:]:
        z += weighted.take(s)
    if z.dtype == np.int16:
        z = z * np.float32(1 / FINE)
    for now, x in zip(w[len(w) - len(own) :], own, strict=True):
        z += now.astype(np.float32).take(x.view(np.int32) & (GATES - 1)) * x
    # the adaptive map, read between its two nearest entries, and the mix itself have half each
    u = z * np.float32(3)
    u += np.float32(31.5)
    np.clip(u, 0, np.float32(62.99), out=u)
    i = u.astype(np.int32)
    u -= i
    i += depth << 6
    low = refined.take(i)
    q = refined[1:].take(i)
    q -= low
    q *= u
    q += low
    np.clip(z, -12, 12, out=z)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    np.reciprocal(z, out=z)
    q += z
    q *= np.float32(0.5)
    q -= np.float32(1) - bit  # bit 0: of 1 - q
    np.abs(q, out=q)
    return np.log(q, out=q)


def _costs(texts: list[list[bytes]], model: Model, weighted: np.ndarray, w: list[np.ndarray], refined: np.ndarray) -> np.ndarray:
    """The natural log-probability of each text."""
    out = np.zeros(len(texts))
    for places, pieces in _bulks(iter(texts)):
        for group, (slots, bit, depth, piece, own) in enumerate(Bits(pieces, model).groups):
            out += np.bincount(np.array(places).take(piece), weights=_logs(slots, bit, depth, own, weighted, w[group], refined[group]), minlength=len(texts))
    return out


def _spelled_costs(model: object, tables: object):
    """(word, kind, count, log10 of the spelling's probability) of distinct words and kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, w, refined = tables.value
        weighted = np.array(weighted)
        for words, kind, _, c in _distinct(batches):
            slots, bit, depth, word = spelled(words, kind, model.value)
            cost = np.bincount(word, weights=_logs([s - WORD_SLOTS for s in slots], bit, depth, [], weighted, w, refined), minlength=len(words)) / np.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(kind, pa.int32()), pa.array(c, pa.int64()), pa.array(cost)], SPELLED.names)

    return run


def fit(shared: object, counted: DataFrame, rare: DataFrame, texts: DataFrame) -> tuple[object, object]:
    """Broadcast tables (weighted predictions by slot, weights, adaptive map) of words and of spelled bytes. shared: the model;
    counted: COUNTED; rare: (word, c, n0, n1, ...); texts: one column, binary."""
    spark = texts.sparkSession
    tasks = max(1, spark.sparkContext.defaultParallelism)  # a task's table is large however little it reads
    texts, rare = texts.coalesce(tasks), rare.filter("c > 0").coalesce(tasks)
    sums = counted.filter("block IS NOT NULL").select(*TABLE.names).unionByName(rare.mapInArrow(_count_spelled(shared), TABLE))
    if tasks > 64:  # many tables are added in two steps
        sums = sums.groupBy(F.pmod("part", F.lit(64)).alias("p"), "block").applyInArrow(_add, TABLE)
    sums = sums.groupBy("block").applyInArrow(_add, TABLE)
    table = np.zeros(-(-2 * SLOTS // BLOCK) * BLOCK, np.int32)
    with arrow_rows(spark):
        for r in sums.toLocalIterator():  # a fixed number of blocks
            table[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = _unpack(r["counts"])
    inputs, ends, found = _left_out(table), (0, WORD_SLOTS, SLOTS), []
    for group, (rows, bits) in enumerate(((texts, _word_bits(shared)), (rare, _spelled_bits(shared)))):
        a, b = ends[group : group + 2]
        mine = inputs[2 * a : 2 * b]
        left = spark.sparkContext.broadcast(np.concatenate([_code(mine[i : i + BLOCK]) for i in range(0, len(mine), BLOCK)]))
        with arrow_rows(spark):
            learned = rows.mapInArrow(_learn(group, left, bits), LEARNED).filter("n > 0").collect()  # one small row a task
        left.destroy()
        seen, n, w = np.zeros((2, 512)), sum(r["n"] for r in learned), _start()[group]
        if learned:
            w = sum(np.frombuffer(r["w"]).reshape(w.shape) * r["n"] for r in learned) / n
            seen = sum(np.frombuffer(r["seen"]).reshape(seen.shape) for r in learned)
        weighted = np.empty(b - a, np.float32)
        first = (0, len(WORD_BITS))[group]
        for k, bits_ in enumerate((WORD_BITS, BYTE_BITS)[group]):
            start = int(OFFSETS[first + k])
            for i in range(start, start + (1 << bits_), BLOCK):
                zero, one = (table[2 * i + x : 2 * min(i + BLOCK, start + (1 << bits_)) : 2].astype(np.float64) for x in (0, 1))
                weighted[i - a : i - a + len(zero)] = w[k][_gate(zero + one)] * _stretch(zero, one)
        if group == 0:  # a kind's nodes take what the node alone says, which is then looked up with it
            weighted[int(OFFSETS[1]) : int(OFFSETS[2])].reshape(KINDS, -1)[:] += weighted[: int(OFFSETS[1])]
        weighted = _fine(weighted)
        middle = np.tile(1 / (1 + np.exp(-(np.arange(64) - 31.5) / 3)), 8)
        found.append(spark.sparkContext.broadcast((weighted, w, ((seen[1] + 20 * middle) / (seen[0] + 20)).astype(np.float32))))
    return tuple(found)


def _documents(model: object, tables: object, bases: object):
    """Per document a row with the sums over the vocabulary's words and the escapes' cost, and one for each other word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, m, base, (weighted, w, refined) = TaskContext.get().partitionId() << 33, model.value, bases.value, tables.value
        weighted = np.array(weighted)  # a copy has large memory pages, what was unpickled has not
        for whole in batches:
            for batch in bounded(whole, 1, 1000):
                size, sums = batch.num_rows, np.zeros((4, batch.num_rows))
                for of, read in _reads(batch.column(1), m):
                    bits = Bits(read, m, spell=False)
                    _, *slots = bits.groups[0][0]  # what the node alone says is in the kinds' table
                    _, bit, depth, _, own = bits.groups[0]
                    logs = _logs(slots, bit, depth, own, weighted, w, refined)
                    in_ = read.symbol != m.escape
                    place, old = of[read.piece[in_]], base[read.symbol[in_]]
                    sums += [
                        np.bincount(place, minlength=size), np.bincount(place, weights=old[:, 0] > 0, minlength=size), np.bincount(place, weights=old[:, 1], minlength=size),
                        np.bincount(of[bits.pieces], weights=np.add.reduceat(logs, bits.begin, dtype=np.float64), minlength=size),
                    ]
                    if n := len(read.rare):
                        given = pa.array(row + of[read.rare_piece]), read.rare, pa.array(read.rare_kind)
                        yield pa.RecordBatch.from_arrays([*given, *[pa.nulls(n, pa.int64())] * 4, *[pa.nulls(n, pa.float64())] * 2], PARTS.names)
                longs, doubles = [pa.array(x.astype(np.int64)) for x in (pc.binary_length(batch.column(1)).to_numpy(), *sums[:2])], [pa.array(sums[2]), pa.array(sums[3] / np.log(10))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + size)), pa.nulls(size, pa.binary()), pa.nulls(size, pa.int32()), batch.column(0), *longs, *doubles], PARTS.names)
                row += size

    return run


def _kind(langs: list[str]) -> F.Column:
    """A training document's language by its place in langs, or the place after the last; -1 for held-out ones."""
    out = F.lit(len(langs))
    for i, x in enumerate(langs):
        out = F.when(F.col("lang") == x, i).otherwise(out)
    return F.when(held_out_modulus() == 1, -1).otherwise(out).cast("int")


def vocabulary(words: DataFrame, kinds: int, most: int = FREQUENT, least: int = LEAST) -> list[tuple[bytes, int, int]]:
    """(word, count, kind) of the words that occur often enough, by count and word; the end is always one of them. Their number
    is bounded by a threshold that comes from how many words have each count."""
    usable = words.filter((F.col("c") >= least) & (F.length("word") <= LONGEST) & (F.col("word") != F.lit(b"")))
    level = F.when(F.col("c") < 1024, F.col("c")).otherwise(F.floor(F.log2("c") * 64) + 1024)  # a bounded number of levels
    held, threshold = 0, None
    for r in usable.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("c")).collect():
        held += r["n"]
        if held >= most:
            break
        threshold = r["c"]
    end = words.filter(F.col("word") == F.lit(b""))
    chosen = end if threshold is None else end.unionByName(usable.filter(F.col("c") >= threshold))
    main = F.coalesce(*[F.when(F.col(f"c{k}") * 2 >= F.col("c"), k) for k in range(kinds)], F.lit(KINDS - 1))
    got = chosen.select("word", "c", main.alias("kind")).collect()
    found = sorted(((bytes(r["word"]), r["c"], r["kind"]) for r in got), key=lambda x: (-x[1], x[0]))
    return found if got and any(not w for w, *_ in found) else [*found, (b"", 0, KINDS - 1)]


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    d = slim(docs, "doc_id", "lang", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    common = d.filter((held_out_modulus() != 1) & F.col("lang").isNotNull()).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(KINDS - 1).collect()
    langs = [r["lang"] for r in common]
    kinds = len(langs)
    counted = d.select("text", _kind(langs).alias("kind")).mapInArrow(_count_words, WORDS)
    own = [F.sum(F.when(F.col("kind") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(kinds)]
    words = stored(counted.groupBy("word").agg(F.sum("c").alias("c"), *own), "words")
    release(spark)
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    tokens, distinct = sums["n"], sums["v"]
    known = vocabulary(words, kinds)
    unknown = words.filter("c > 0").join(F.broadcast(spark.createDataFrame([(bytearray(w),) for w, *_ in known], "word binary")), "word", "left_anti")
    letters = np.zeros(256, np.int64)
    for r in unknown.select("word", "c").mapInArrow(_count_bytes, BYTES).collect():
        letters += np.frombuffer(r["counts"], np.int64)
    train = held_out_modulus() != 1
    tasks = max(1, spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast(Model(known, tokens - sum(c for _, c, _ in known), letters))
    counted = stored(d.select("text", train.alias("train")).coalesce(tasks).mapInArrow(_count_bits(shared), COUNTED), "counted")
    release(spark)
    each = [F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(f"n{k}") for k in range(KINDS)]
    rare = stored(counted.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c"), *each).sortWithinPartitions(F.xxhash64(F.lit(1), "word"), "word"), "spelled")
    whole, parts_of = fit(shared, counted, rare, d.filter(train).select("text"))
    release(spark)

    def base(c: object) -> object:
        return (c + 0.5) / (tokens + 0.5 * (distinct + 1))

    counts = np.array([c for _, c, _ in known], np.float64)
    bases = spark.sparkContext.broadcast(np.column_stack([counts, np.log10(base(counts))]))
    parts = stored(d.select("doc_id", "text").mapInArrow(_documents(shared, whole, bases), PARTS), "parts")
    release(spark)
    costs = rare.mapInArrow(_spelled_costs(shared, parts_of), SPELLED)
    told = parts.filter("word IS NOT NULL").select("row", "word", "kind").join(costs, ["word", "kind"])
    nothing, c = F.lit(0).cast("long"), F.col("c")
    told = told.select("row", F.lit(None).cast("long").alias("doc_id"), nothing.alias("n_bytes"), F.lit(1).cast("long").alias("n"), (c > 0).cast("long").alias("known"), F.log10(base(c)).alias("base"), F.col("cost").alias("score"))
    every = told.unionByName(parts.filter("word IS NULL").drop("word", "kind"))
    out = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_bytes", "n", "known", "base", "score")])
    return out.select("doc_id", (held_out_modulus() == 1).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", "n_bytes", (-F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))
