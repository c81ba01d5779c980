import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, simhash_dedup, suffix_dedup
from lodestone.llm.common import connected_components

from .conftest import NASTY, frame, prose


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_golomb_round_trip():
    r = np.random.default_rng(1)
    for n in (1, 2, 1000):
        for bits in (10, 40, 62):
            v = np.unique(r.integers(5, 1 << bits, n).astype(np.uint64))
            k, unary, rest = exact_dedup.golomb_encode(v, 5)
            assert (exact_dedup.golomb_decode(len(v), k, unary, rest, 5) == v).all()


def exact_brute(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(normal(t), []).append(d)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, first = (min(known) if known else None), True
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups_hard_rows(nasty):
    got = sorted(map(tuple, exact_dedup.exact_groups(nasty).collect()), key=str)
    assert got == exact_brute(NASTY)


def test_exact_dedup_keeps_one_row_a_text(nasty):
    got = exact_dedup.exact_dedup(nasty)
    assert got.columns == nasty.columns
    assert sorted(normal(r["text"]) for r in got.collect()) == sorted({normal(t) for _, t, *_ in NASTY})


def test_exact_digest_clashes_are_told_apart_by_bytes(spark):
    rows = [(i, f"text {i % 40}") for i in range(120)]
    got = exact_dedup.exact_groups(frame(spark, rows), digest=lambda c: F.substring(F.sha2(c, 256), 1, 1), spare_bits=1, owner_rows=16, chunk_rows=10)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()) == [(i, i % 40, 3, i < 40) for i in range(120)]


def test_exact_empty(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert exact_dedup.exact_dedup(nothing).count() == 0


def simhash_brute(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components_brute(prints):
    n = len(prints)
    label = list(range(n))
    for _ in range(n):
        new = [min(label[j] for j in range(n) if bin(prints[i] ^ prints[j]).count("1") <= 2) for i in range(n)]
        if new == label:
            return label
        label = new
    return label


def test_simhash_hard_rows(nasty):
    got = simhash_dedup.near_groups(nasty).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(d), f"{simhash_brute(t):016x}") for d, t, *_ in NASTY)
    rows = sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got), key=str)
    label = components_brute([r[1] for r in rows])
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        assert r[2] == (min(ids) if ids else None)


@pytest.mark.parametrize("bucket", [1, 3, 512])
def test_simhash_links_equal_brute_force(spark, bucket):
    """Balls, chains and random words; small buckets take the way for large ones."""
    r = random.Random(5)
    words = {r.getrandbits(64) for _ in range(60)}
    for c in [r.getrandbits(64) for _ in range(4)]:
        at = c
        for _ in range(25):
            words.add(c ^ 1 << r.randrange(64) ^ 1 << r.randrange(64))
            at ^= 1 << r.randrange(64)
            words.add(at)
    words = sorted(words)
    df = spark.createDataFrame([(simhash_dedup.signed(w),) for w in words], "fp long")
    roots = dict(map(tuple, connected_components(simhash_dedup.links(df, bucket)).collect()))
    got = {}
    for w in words:
        got.setdefault(roots.get(simhash_dedup.signed(w), simhash_dedup.signed(w)), set()).add(w)
    want = {}
    for w, k in zip(words, components_brute(words), strict=True):
        want.setdefault(k, set()).add(w)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_masks_cover_the_radius():
    m = simhash_dedup.masks()
    assert len(m) == 7
    assert all(any(not (x & (1 << i | 1 << j)) for x in m) for i in range(64) for j in range(64))


def test_near_dedup_keeps_the_smallest(spark, nothing):
    same = prose(9, 400)
    got = simhash_dedup.near_dedup(frame(spark, [(3, same), (1, same + " "), (2, prose(10, 400)), (3, same)]))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2]
    assert simhash_dedup.near_dedup(nothing).count() == 0


def suffix_brute(docs, length):
    seen, out = set(), {}
    for d, x in docs:
        gone = bytearray(len(x))
        for s in range(len(x) - length + 1):
            w = x[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out[d] = (len(x), sum(gone), sum(1 for i in range(len(x)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("alphabet", "group_rows"), [("ab", 4096), ("ab", 3), ("abcdefgh", 2)])
def test_suffix_dedup_equals_brute_force(spark, alphabet, group_rows):
    r = random.Random(3)
    parts = ["".join(r.choice(alphabet) for _ in range(r.randrange(5, 40))) for _ in range(12)]
    docs = [(i, "".join(r.choice(parts) if r.random() < 0.7 else r.choice(alphabet) * r.randrange(9) for _ in range(r.randrange(7)))) for i in range(60)]
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.suffix_dedup(frame(spark, docs), length=12, gram=5, group_rows=group_rows).collect()}
    assert got == suffix_brute([(d, t.encode()) for d, t in docs], 12)


@pytest.mark.parametrize("bits", [1, 3, 64])
def test_suffix_dedup_survives_colliding_names(spark, bits):
    """Names that collide in a task, between tasks or always: distinct bytes stay, repeats go."""
    r = random.Random(6)
    parts = ["".join(r.choice("abcd") for _ in range(r.randrange(5, 40))) for _ in range(12)]
    docs = [(i, "".join(r.choice(parts) for _ in range(r.randrange(7)))) for i in range(50)]
    mine, _ = suffix_dedup.keyed(frame(spark, docs).repartition(5))
    gone = suffix_dedup.removed(mine, length=12, gram=5, name=lambda x: xxhash.xxh3_64_intdigest(x) & ((1 << bits) - 1)).collect()
    want = suffix_brute([(d, t.encode()) for d, t in docs], 12)
    for d, t in docs:
        flags = bytearray(len(t))
        for x in gone:
            if x["doc"] == d:
                flags[x["a"] : x["b"]] = b"\1" * (x["b"] - x["a"])
        assert sum(flags) == want[d][1], (d, bits)


@pytest.mark.parametrize(("hot", "group_rows"), [(2, 4096), (2, 5), (64, 4096)])
def test_suffix_dedup_deals_anchors_that_all_documents_hold(spark, monkeypatch, hot, group_rows):
    """A phrase shorter than a string stands in every document with other words around it."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(9)
    phrase = "".join(r.choice("abcdefgh") for _ in range(14))
    docs = [(i, "".join(r.choice("abcdefgh") for _ in range(r.randrange(30))) + phrase + r.choice(["", "xyzxyz", "uvwuvwuvw"]) + "".join(r.choice("abcdefgh") for _ in range(r.randrange(12)))) for i in range(80)]
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.suffix_dedup(frame(spark, docs).repartition(6), length=18, gram=5, group_rows=group_rows).collect()}
    assert got == suffix_brute([(d, t.encode()) for d, t in docs], 18)


def test_suffix_settle_is_the_same_in_batches_of_any_size():
    r = np.random.default_rng(3)
    rows = sorted((int(g), int(salt), int(c), int(d), int(p) << 16 | 5 << 8 | 7) for g, salt, c, d, p in zip(r.integers(0, 6, 300), np.where(r.random(300) < 0.2, 1, 0), r.integers(0, 9, 300), r.integers(0, 40, 300), r.integers(0, 3, 300), strict=True))
    rows = sorted([*rows, (2, 0, suffix_dedup.NO_DOC, suffix_dedup.NO_DOC, 0), (2, 0, suffix_dedup.NO_DOC, suffix_dedup.NO_DOC, 0), (9, 0, suffix_dedup.NO_DOC, suffix_dedup.NO_DOC, 0), (11, 0, 5, 1, 0)])

    def run(step):
        cols = [np.array(x, np.int64) for x in zip(*[(g, c, d, p, s) for g, s, c, d, p in rows], strict=True)]
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + step]) for x in cols], suffix_dedup.RUNS.names) for i in range(0, len(rows), step)]
        return sorted(tuple(x.values()) for b in suffix_dedup._settle(20)(iter(batches)) for x in b.to_pylist())

    want, groups = [], {}
    for g, s, c, d, p in rows:
        groups.setdefault((g, s), []).append((c, d, p))
    for (g, s), mine in groups.items():
        dealt = s > 0 or any(d == suffix_dedup.NO_DOC for _, d, _ in mine)
        names = {}
        for c, d, p in mine:
            if d != suffix_dedup.NO_DOC:
                names.setdefault(c, []).append((d, p >> 16, (p >> 16) + 5, (p >> 16) + 7))
        for c, runs in names.items():
            d, a, q, b = runs[0]
            if dealt or len(names) > 1:
                want.append((3 if dealt else 1, g, c, d, a, q, b))
            want += [(2, g, c, *x) for x in runs] if len(runs) > 1 else []
            want += [(0, g, c, d, a, a, b + 20) for d, a, _, b in runs[1:]]
    for step in (1, 2, 7, 50, 1000):
        assert run(step) == sorted(want), step


def test_suffix_dedup_hard_rows(nasty, nothing):
    got = suffix_dedup.suffix_dedup(nasty).collect()
    assert len(got) == len(NASTY)
    docs = sorted({(d is not None, d or 0, hashlib.sha256((t or "").encode()).hexdigest(), (t or "").encode()) for d, t, *_ in NASTY})
    want = suffix_brute([(k[:3], k[3]) for k in docs], 100)
    assert sorted(str(tuple(x)[1:]) for x in got if x["doc_id"] != 6) == sorted(str(want[(d is not None, d or 0, hashlib.sha256((t or "").encode()).hexdigest())]) for d, t, *_ in NASTY if d != 6)
    six = [tuple(x)[1:] for x in got if x["doc_id"] == 6]
    assert len(six) == 2 and six[0] == six[1] and six[0][1] == 0
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_suffix_sort_survives_hash_collisions():
    """Thue-Morse words of 2048 letters collide under every polynomial modulo 2^64; the bytes decide."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    data = (a + b + a).encode()
    n = len(a)
    s = suffix_dedup.Suffixes(np.frombuffer(data, np.uint8), n)
    assert s.hashed(np.array([0]), n) == s.hashed(np.array([n]), n)
    starts, segment = np.array([0, n, 2 * n]), np.zeros(3, np.int64)
    order, same = s.classes(starts, segment)
    assert [data[starts[i] : starts[i] + n] for i in order] == sorted(data[i : i + n] for i in starts) and same.tolist() == [False, True, False]


def test_suffix_sort_order():
    r = random.Random(8)
    data = "".join(r.choice("ab") for _ in range(400)).encode()
    s = suffix_dedup.Suffixes(np.frombuffer(data, np.uint8), 20)
    starts = np.array([r.randrange(380) for _ in range(150)])
    segment = np.sort(np.array([r.randrange(5) for _ in range(150)]))
    order, same = s.classes(starts, segment)
    for k in range(5):
        mine = [data[starts[i] : starts[i] + 20] for i in order[segment == k]]
        assert mine == sorted(data[x : x + 20] for x in starts[segment == k])
        assert same[segment == k].tolist() == [False, *(x == y for x, y in zip(mine, mine[1:], strict=False))]
