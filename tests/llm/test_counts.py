"""Filter audit, byte-level BPE and collocations against plain Python."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from lodestone.llm import byte_bpe, collocations, filter_audit
from lodestone.llm.tokens import vocabulary_path

from .conftest import NASTY, frame, prose

# --- filter audit -------------------------------------------------------------------------------------------------------


def audited(rows, labels):
    """rows: (doc_id, text, lang, source). The contract, document by document."""
    docs = []
    first = {}
    for d, t, _, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, t, _, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = "".join(f for f, x in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t), d is not None and first[t] < d), strict=True) if x)
        docs.append((part or "", bad, any(q == 1 for i, q, _ in labels if i == d and d is not None), any(x == 1 for i, _, x in labels if i == d and d is not None)))
    out = {}
    for part in {x[0] for x in docs}:
        mine = [x for x in docs if x[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                failing = [x for x in mine if f in x[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(x[1] == f for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


LABELS = "doc_id long, quality int, toxic int"


def test_audit(spark, nasty, monkeypatch):
    rows = [(d, t, x, s) for d, t, x, s in (((*r, *["en", "src0"][len(r) - 2 :]) if len(r) < 4 else r) for r in NASTY)]
    labels = [(4, 1, 0), (5, 1, None), (6, 0, 1), (6, 1, 0), (10, 1, 1), (99, 1, 1), (None, 1, 1)]
    got = filter_audit.audit(nasty, spark.createDataFrame(labels, LABELS)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == audited(rows, labels)
    assert len(got) == 600 * len({r[3] or "" for r in rows})


def test_audit_of_many_parts_and_blocks(spark, monkeypatch):
    r = random.Random(5)
    texts = [prose(i % 40, r.choice([20, 60, 200])) + r.choice(["", " #", " SHOUT" * 30]) for i in range(300)]
    rows = [(i, t, "en", f"s{i % 90}" if i % 3 else "hot") for i, t in enumerate(texts)]
    found = filter_audit.judged(frame(spark, rows), spark.createDataFrame([], LABELS)).toArrow().to_batches()
    monkeypatch.setattr(filter_audit, "BLOCK", 37)
    monkeypatch.setattr(filter_audit, "PARTS", 11)
    sums = defaultdict(int)
    for b in filter_audit._index(iter(found)):
        for x in b.to_pylist():
            sums[x["part"], x["subset"]] += x["kept"]
    want = audited(rows, [])
    for part in {x[3] for x in rows}:
        assert sums[part, 0] == sum(x[3] == part for x in rows)
        assert sums[part, 31] == want[part, "ABCDE", 5][0] and sums[part, 5] == want[part, "ACBDE", 2][0]


def test_audit_of_nothing(spark, nothing):
    assert filter_audit.audit(nothing, spark.createDataFrame([], LABELS)).count() == 0


# --- byte-level BPE -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def rank_path():
    return vocabulary_path("byte_bpe_50k.tiktoken")


def tiktoken_of(path):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["a", "Ab.", "foo", "Zü!?", " ", "  ", "\n", "\t", "'s", "don't", "x'there", "1,", "é", "\x1c", "\xa0", "中", "<|endoftext|>", "\0", "\r\n", " \n", ".", "?.", "_", "(", ",", "　", "́", "ſ", "я", "'ll", "a" * 40, "\U0001f600"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_are_those_of_the_rank_file(name):
    path = vocabulary_path(name)
    bpe, other = byte_bpe.ByteBpe(path, byte_bpe.default_pattern(), cache=200), tiktoken_of(path)
    r = random.Random(4)
    texts = ["".join(r.choice(ODD) for _ in range(r.randrange(14))) for _ in range(3000)] + [prose(1, 500), "", "ab" * 100_000]
    for i in range(0, len(texts), 50):
        for t, x in zip(texts[i : i + 50], bpe.encode(texts[i : i + 50]), strict=True):
            ids = np.frombuffer(x, "<i4").tolist()
            assert ids == other.encode_ordinary(t)
            assert bpe.decode(ids) == t.encode()


def test_every_character(rank_path):
    bpe, other = byte_bpe.byte_bpe(rank_path, byte_bpe.default_pattern()), tiktoken_of(rank_path)
    for base in range(0, 0x30000, 256):
        t = "".join(f"a{c}b {c}{c} 1{c}!{c}'{c}" for c in map(chr, range(base, base + 256)) if not "\ud800" <= c <= "\udfff")
        assert np.frombuffer(bpe.encode([t])[0], "<i4").tolist() == other.encode_ordinary(t)


def test_tokens_that_merges_miss_and_other_patterns(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abcd"]  # "abcd" merges to a, bc, d
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    bpe = byte_bpe.ByteBpe(str(path), byte_bpe.default_pattern())
    assert set(bpe.whole) == {"abcd"}
    for pattern in (byte_bpe.default_pattern(), r"[a-c]+|(?s:.)"):
        import tiktoken

        other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        bpe = byte_bpe.ByteBpe(str(path), pattern)
        for t in ("abc abcd abcde", "abcd", "ab\ncd", "aabbccdd"):
            assert np.frombuffer(bpe.encode([t])[0], "<i4").tolist() == other.encode_ordinary(t)
    path.write_bytes(b"YQ== 0\nYg== 5\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(path))


def test_bpe_rows(nasty, nothing, rank_path):
    other = tiktoken_of(rank_path)
    got = byte_bpe.digests(byte_bpe.encode(nasty)).collect()
    want = []
    for d, t, *_ in NASTY:
        ids = other.encode_ordinary(t or "")
        want.append((str(d), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    back = byte_bpe.decode(byte_bpe.encode(nasty)).collect()
    assert sorted((str(r["doc_id"]), bytes(r["data"])) for r in back) == sorted((str(d), (t or "").encode()) for d, t, *_ in NASTY)
    assert byte_bpe.digests(byte_bpe.encode(nothing)).count() == 0


# --- collocations -------------------------------------------------------------------------------------------------------


def mined(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def test_perfect_hash():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(1, 1 << 62, 5000))
    h = collocations.PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(len(keys)))
    again = collocations.PerfectHash(h.sizes, h.bits, h.keys)
    assert (again.keys[again.slots(keys)] == keys).all()
    others = np.setdiff1d(r.integers(1, 1 << 62, 5000), keys)
    assert (h.slots(others) == -1).all() and len(h.slots(keys[:0])) == 0
    assert (collocations.PerfectHash.build(keys[:0]).slots(keys) == -1).all()


@pytest.mark.parametrize("sizes", [{}, {"chunk_words": 300, "block_keys": 64, "share_chunks": 1}])
def test_collocations(spark, nasty, sizes):
    r = random.Random(3)
    more = [(100 + i, prose(i % 9, 120).title() + r.choice(["", "\tNew  York;new york\x0bnew YORK", "é" * 3 + "\x1cx"]), r.choice(["en", "de", None, ""]), "a") for i in range(60)]
    rows = [(*x, *["en", "src0"][len(x) - 2 :]) if len(x) < 4 else x for x in NASTY] + more
    got = collocations.collocations(frame(spark, rows), least=5, top=40, **sizes).collect()
    assert sorted(map(tuple, got)) == mined(rows, 5, 40)


def test_collocations_of_little(spark, nothing):
    assert collocations.collocations(nothing).count() == 0
    assert collocations.collocations(frame(spark, [(1, None), (2, "..,,"), (3, "one"), (4, "a b")])).count() == 0
    hot = frame(spark, [(i, "go go go go go go go.") for i in range(40)])
    assert sorted(map(tuple, collocations.collocations(hot).collect())) == mined([(i, "go " * 7, "en") for i in range(40)], 100, 2000)
