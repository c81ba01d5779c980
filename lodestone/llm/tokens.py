"""Byte-pair token ids for whole texts, by the tokenizers library with a cache of words.

The vocabulary's pre-tokenizer never lets a token cross from a non-space character into white space, so a text falls into
independent pieces at its blanks and line ends, and before a full stop or comma that follows a letter or digit; a piece's
ids depend on nothing else. Distinct pieces are encoded by the library once and looked up afterwards, which gives the ids
of encode() on the whole text. Pieces of letters go straight to the library's model, in the alphabet of byte-level
vocabularies. Texts with uneven white space or marks are cut at blanks alone, and those that hold one of the vocabulary's
special tokens go to the library whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

CACHE = 900_000
_split = re.compile(r"(?<=\S) ").split
_marked = re.compile(r"[\W_][.,]").search
_runs = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+").findall
_PLAIN = bytes(c < 128 and chr(c).isalnum() for c in range(256))


def _hard(text: str) -> bool:
    """Whether the quick cut can't take a text: white space but blanks and line ends, or a stop or comma after another mark."""
    if not text.replace("\n", "").isprintable():
        return True
    data = text.encode()
    before = set()
    for mark in b".", b",":
        before.update(part[-1:] for part in data.split(mark)[:-1])
    if any(not x or x[0] < 128 and not _PLAIN[x[0]] for x in before):
        return True
    return any(x[0] >= 128 for x in before) and bool(_marked(text))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _splits_at_blanks(path: str) -> bool:
    """Whether a vocabulary file is of the kind that the quick cut knows: byte-level pieces by the pattern of GPT-2 (the library's
    own), no normalizer and no blank put in front. Any other is encoded by the library, text by text."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    pre = told.get("pre_tokenizer") or {}
    return (told.get("model") or {}).get("type") == "BPE" and not told.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


class Pieces(dict):
    """ids by piece; a piece that is looked up for the first time is learned."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = self.learn(piece)
        return ids


class Encoder:
    """cache: distinct pieces held at most when a text begins, half of them those met last, the others from before."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.known = self.tokenizer.model, _splits_at_blanks(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))).search if special else None
        self.cache, self.old, self.most = Pieces(self.learn), {}, cache
        self.line = self.whole("\n")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow from 256 on
        rest = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        """The first piece, which has no blank before it, then those that have one, or "\\0" where there is none."""
        if not text or self.special and self.special(text):
            return [text]
        if not _hard(text):
            cut = text.replace("\n", " \0\n").replace(".", " \0.").replace(",", " \0,")
            if "  " not in cut and "\0\n " not in cut and cut[0] != " " and cut[-1] not in " \n":
                return cut.split(" ")
        return [text] if "\0" in text else _split(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if not self.known:
            return [self.whole(t) for t in texts]
        out, on = [], gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the cache is large
        try:
            for text in texts:
                if len(self.cache) > self.most // 2:
                    self.old, self.cache = self.cache, Pieces(self.learn)
                first, *rest = self.pieces(text)
                start = self.cache["\0" + first] if rest and 0 < len(first) < 32 else self.whole(first) if first else b""
                out.append(start + b"".join(map(self.cache.__getitem__, rest)))
        finally:
            if on:
                gc.enable()
        return out

    def learn(self, piece: str) -> bytes:
        """A piece's ids: by the library's model for runs of letters, digits and marks, otherwise by the tokenizer."""
        if (ids := self.old.get(piece)) is not None:
            return ids
        bare, after_line = piece[:1] == "\0", piece[:2] == "\0\n"
        word = piece[1 + after_line :] if bare else piece
        if word.isalpha():
            runs = [word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)]
        elif word and word.isascii() and word.isprintable() and " " not in word and "'" not in word:
            runs = _runs(word)
        else:
            return self.whole(piece[1:] if bare else " " + piece)
        if not bare:
            runs[0] = self.alphabet[32] + runs[0]
        ids = array("I", [t.id for run in runs for t in self.model.tokenize(run)]).tobytes()
        return self.line + ids if after_line else ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
