"""Byte-level BPE by a sentencepiece model that is written straight from a file of ranks.

A rank file lists byte strings by rank. Each byte is mapped to a printable character (those of byte-level vocabularies), so
that a token becomes a piece of a sentencepiece model of kind BPE whose score is its negative rank: the library then merges the
adjacent pair of the lowest rank first, the leftmost of equal ones, which is what byte-level BPE does. The model's normalizer is the
identity, so pieces go in and come out as they are. No trainer is involved: the model's protobuf message is serialised here.

A text is cut into pre-tokens by the vocabulary's pattern, pre-tokens are encoded apart, and ids are decoded by the
inverse mapping of the model's pieces. A pre-token that is itself in the vocabulary is one id even where merges end elsewhere;
those few are found when the model is built. No pre-token goes from a non-space character into white space, nor from a letter to
what isn't one, so a text falls into stretches (white space, marks, a run of letters) whose ids depend on nothing else; distinct
stretches are encoded once and kept while they are met again.

A null text is empty and has no ids. Texts are encoded whole, however long; rows keep their order and number, so null or
repeated doc_ids stay as they are; an empty table gives no rows; only doc_id and text are read, so other columns may have any name.
Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, documents, slim, stored
from .tokens import vocabulary_path

CACHE = 600_000
#: The code points that Unicode calls white space, which the pattern's \s means.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters in every version of Unicode, and what ends a run of them for certain.
LETTER, END = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f", "\\x00-@\\[-`{-\\x7f"
#: Numbers of the fields of sentencepiece's public model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
UNKNOWN_KIND = 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 4, 40, 41, 42, 43
BPE = 2
NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5


def byte_alphabet() -> dict[int, str]:
    """A printable character for each byte: those that print in Latin-1 for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in the order of their ranks, which run from 0 without a gap."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"ranks of {path} have gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialised_model(tokens: list[bytes]) -> bytes:
    """The model's protobuf message: a piece for each token, scored by its negative rank, then the obligatory unknown piece."""
    to = byte_alphabet()
    out = []
    for rank, token in enumerate(tokens):
        piece = "".join(map(to.__getitem__, token)).encode()
        out.append(_block(PIECES, _block(PIECE, piece) + _varint(SCORE << 3 | 5) + np.float32(-rank).tobytes()))
    out.append(_block(PIECES, _block(PIECE, b"<unk>") + _varint(SCORE << 3 | 5) + np.float32(0).tobytes() + _number(KIND, UNKNOWN_KIND)))
    none = b"".join(_number(f, -1) for f in (BOS_ID, EOS_ID, PAD_ID))
    out.append(_block(TRAINER, _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, len(tokens) + 1) + _number(UNK_ID, len(tokens)) + none))
    out.append(_block(NORMALIZER, _block(NAME, b"identity") + b"".join(_number(f, 0) for f in (ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES))))
    return b"".join(out)


class ByteBpe:
    """Encodes and decodes by a rank file and a pattern. cache: distinct stretches held at most when a group of texts begins, half of them those met last."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE) -> None:
        import re

        import regex
        from sentencepiece import SentencePieceProcessor

        tokens = read_ranks(path)
        self.model = SentencePieceProcessor(model_proto=serialised_model(tokens))
        self.to = byte_alphabet()
        back = {c: b for b, c in self.to.items()}
        self.bytes_of = [bytes(map(back.__getitem__, self.model.id_to_piece(i))) for i in range(len(tokens))]
        if missing := set(range(256)) - {t[0] for t in tokens if len(t) == 1}:
            raise ValueError(f"{path} has no token for bytes {sorted(missing)}")
        self.pre = regex.compile(pattern).findall
        self.plain = pattern == default_pattern()
        self.stretches = re.compile(f"[{SPACE}]*[^{SPACE}{LETTER}]*[{LETTER}]++(?=[{END}]|\\Z)|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall if self.plain else self.pre
        self.word = re.compile(f" ?[{LETTER}]+").fullmatch
        merged = self.model.encode([self.mapped(t) for t in self.bytes_of], num_threads=1)
        self.whole = {}  # a token that isn't UTF-8 is never a whole pre-token
        for i, ids in enumerate(merged):
            if ids != [i]:
                with suppress(UnicodeDecodeError):
                    self.whole[self.bytes_of[i].decode()] = [i]
        self.decimal = list(map(str, range(len(tokens))))
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = cache

    def mapped(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.to)

    def _learn(self, stretches: list[str]) -> None:
        """Encodes stretches that weren't met yet, pre-token by pre-token, all of them in one call of the library."""
        cut = [[s] if not self.plain or self.word(s) else self.pre(s) for s in stretches]
        pieces = list({p for c in cut for p in c})
        merged = self.model.encode([p.translate(self.to) if p.isascii() else self.mapped(p.encode()) for p in pieces], num_threads=1)
        ids = dict(zip(pieces, merged, strict=True))
        ids |= {p: self.whole[p] for p in pieces if p in self.whole}
        for s, c in zip(stretches, cut, strict=True):
            self.cache[s] = array("i", ids[c[0]] if len(c) == 1 else [i for p in c for i in ids[p]]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        on = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the cache is large
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.stretches(t) for t in texts]
        if len(self.cache) > self.most // 2:
            self.old, self.cache = self.cache, {}
        new = [s for s in set().union(*cut) if s not in self.cache]
        self.cache.update((s, self.old[s]) for s in new if s in self.old)
        if new := [s for s in new if s not in self.old]:
            self._learn(new)
        return [b"".join(map(self.cache.__getitem__, c)) for c in cut]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids: the token ids of each text."""
    where, cut = path or vocabulary_path("byte_bpe_50k.tiktoken"), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(where, cut)
        for whole in batches:
            for batch in bounded(whole, 1, 64, 256 << 10):
                found = bpe.encode(batch.column(1).to_pylist())
                ends = np.cumsum([0, *[len(x) // 4 for x in found]])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    d = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, data: the bytes that each row's ids stand for; a null list stands for none."""
    where, cut = path or vocabulary_path("byte_bpe_50k.tiktoken"), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(where, cut)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bpe.decode(x or ()) for x in part.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Of encode()'s rows: doc_id, n_tokens, ids_sha256 of the decimal ids, decoded_sha256 of the bytes that the ids decode to."""
    where, cut = path or vocabulary_path("byte_bpe_50k.tiktoken"), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(where, cut)
        for batch in batches:
            ends, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            shas = [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                ids = flat[a:b].tolist()
                shas[0].append(hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                shas[1].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), *map(pa.array, shas)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(digests(encode(documents(spark, sf_dir))), "byte_bpe")
