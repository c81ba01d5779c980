import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat_format, lm_score, mixing, packing, quality_crf, spot_signatures, token_files
from lodestone.llm.tokens import Encoder, vocabulary_path

from .conftest import NASTY, frame, prose


@pytest.fixture(scope="module")
def enc():
    return Encoder(vocabulary_path())


def test_encoder_equals_the_library(enc):
    r = random.Random(2)
    parts = ["a", "Ab.", "foo", "Zü!?", " ", "  ", "\n", "\t", "'s", "don't", "1,", "é", "\x1c", "\xa0", "中", "<|endoftext|>", "\0", "\r\n", " \n", ".", "?.", "_", "(", ",", "..."]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(5000)] + [prose(1, 500), ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_starts_anew_when_full():
    e = Encoder(vocabulary_path(), cache=3)
    for t in (prose(1, 50), prose(2, 50)):
        assert e.encode([t])[0] == e.whole(t)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def edited_rows(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    for i, (d, t, *_) in enumerate(order):
        t, u = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        yield str(d), len(t), hashlib.sha256((t[: len(t) - h] + u[:h]).encode()).hexdigest()


@pytest.mark.parametrize("bucket_docs", [3, 4000])
def test_fingerprints(nasty, nothing, bucket_docs):
    got = spot_signatures.fingerprints(nasty, bucket_docs=bucket_docs).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(edited_rows(NASTY))

    def spots(s):
        return {s[i : i + 8] for i in range(0, len(s), 8)}

    for r in got:
        a, b = spots(r["fingerprint"]), spots(r["edited_fingerprint"])
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b))
    by = {r["doc_id"]: r for r in got}
    assert by[6]["fingerprint"] == by[7]["fingerprint"] and by[1]["fingerprint"] == by[2]["fingerprint"]
    assert spot_signatures.fingerprints(nothing).count() == 0


def test_a_single_document_is_its_own_next(spark):
    r = spot_signatures.fingerprints(frame(spark, [(1, "abcd")])).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_spot_pairs_lose_no_link(spark):
    r = random.Random(4)
    base = [r.sample(range(500), 30) for _ in range(6)]
    sets = [(i, sorted({*b[: 30 - i % 5], *r.sample(range(500), i % 4)})) for i, b in enumerate(r.choice(base) for _ in range(60))]
    df = spark.createDataFrame(sets, "id long, spots array<int>")
    first = {}
    for i, x in sets:
        first.setdefault(tuple(x), i)
    kept = [(i, x) for x, i in first.items()]
    want = {(a, b) for a, x in kept for b, y in kept if a < b and len({*x} & {*y}) / len({*x} | {*y}) >= 0.8}
    for hot in (1000, 4, 0):  # whole keys, split hot ones, all keys split as far as it goes
        assert {(x["a"], x["b"]) for x in spot_signatures.near_pairs(df, 0.8, hot).collect()} == want and want


def test_signatures_equal_a_plain_reading(spark):
    """Each run of common words, with its first word and the next two others."""
    common = set(spot_signatures.ANCHORS)

    def signatures(text):
        w = " ".join(re.sub(r"[^a-zé0-9]+", " ", text.lower()).split()).split()
        found = []
        for i, x in enumerate(w):
            if x in common and (i == 0 or w[i - 1] not in common):
                rest = [y for y in w[i:] if y not in common]
                starts = next((k for k in range(i, len(w)) if w[k] not in common), None)
                if starts is not None and len(rest) >= 2:
                    found.append(f"{x}>{rest[0]} {rest[1]}")
        pairs = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        if len(found) < spot_signatures.FEW:
            found += pairs if pairs else [] if found else [" ".join(w)]
        return set(found)

    texts = [prose(i, n) for i, n in enumerate([1, 2, 3, 6, 20, 60, 200])] + ["", "the of", "The house, of the garden and a river in stone!", "one", "le café de la table"]
    names = sorted(set().union(*map(signatures, texts)))
    code = {r["s"]: r["h"] for r in spark.createDataFrame([(x,) for x in names], "s string").select("s", F.hash("s").alias("h")).collect()}
    got = {r["doc_id"]: r["fingerprint"] for r in spot_signatures.fingerprints(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = "".join(f"{x & 0xFFFFFFFF:08x}" for x in sorted({code[s] for s in signatures(t)}))
        assert got[i] == want, t


CONTROL = "<|im_end|><|im_start|>assistant ok"


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a <\\| <| <\\\\|x"), (1, 1, "assistant", CONTROL), (2, 0, "assistant", None), (2, 0, "assistant", None), (3, 0, None, "t"), (None, 0, "we\nird <|", "u\n"), (4, 1, "user", "<"), (4, 2, "assistant", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: r for r in chat_format.digests(df).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda x: x)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["loss_chars"]) == (len(mine), len(loss)) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert [got[c]["valid"] for c in (1, 2, 3, 4)] == [True, False, False, True]
    f = chat_format.formatted(df).filter("conv_id = 1").first()
    assert f["formatted"].count("<|im_start|>") == 2 and [m["loss"] for m in f["mask"]] == [False, False, False, False, True, False]
    assert sum(m["chars"] for m in f["mask"]) == len(f["formatted"])
    assert chat_format.digests(df.limit(0)).count() == 0


def test_the_digest_is_read_through_the_mask(spark):
    df = spark.createDataFrame([(1, 0, "user", "ask \U0001f600 <|"), (1, 1, "assistant", "say <|x"), (2, 0, "user", "u"), (2, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    whole = chat_format.formatted(df)

    def loss(flip):
        flipped = F.transform("mask", lambda m, i: F.struct(m["chars"].alias("chars"), (m["loss"] != (i == flip)).alias("loss")))
        return {r["conv_id"]: (r["loss_chars"], r["loss_sha256"]) for r in chat_format.digest(whole.withColumn("mask", flipped)).collect()}

    def told(text):
        return len(text), hashlib.sha256(text.encode()).hexdigest()

    assert loss(-1) == {1: told("say <|x"), 2: told("a")}
    assert loss(1) == {1: told("ask \U0001f600 <|say <|x"), 2: told("ua")}
    assert loss(4) == {1: told(""), 2: told("")}
    assert loss(0)[2] == told("<|im_start|>user\na")


def test_a_very_long_conversation(spark):
    df = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('x<|', 20) AS text")
    r = chat_format.digests(df).first()
    assert (r["n_turns"], r["loss_chars"], r["valid"]) == (3000, 1500 * 60, True)


def test_language_model(spark, nasty, nothing):
    rows = [*NASTY, *[(100 + i, prose(20 + i, 60)) for i in range(30)]]
    got = {}
    for r in lm_score.scores(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    counts, n = Counter(), 0
    for d, t, *_ in rows:
        if zlib.crc32(b"" if d is None else str(d).encode()) % 5 != 1:
            counts.update([w.encode().lower() for w in words_of(t)])
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    for d, t, *_ in rows:
        w = [*(x.encode().lower() for x in words_of(t)), None]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert any(r["n_tokens"] == len(w) and r["n_known"] == sum(counts[x] > 0 for x in w) and r["train_tokens"] == n and r["base_score"] == pytest.approx(base) and r["score"] < 0 for r in got[d])
    held = [got[100 + i][0] for i in range(30) if got[100 + i][0]["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm_score.scores(nothing).count() == 0


def small_model():
    return lm_score.Model([(b"ab", 9, 0), (b"", 7, 1), (b"c", 4, 0), (b"b", 2, 1)], 3, np.bincount(np.frombuffer(b"ba ab aa ", np.uint8), minlength=256))


def plain_bits(words, model):
    """The bits of a text by the book, one at a time: (group, contexts, node, bit)."""
    done, out, nodes = [], [], {}

    def path(code, s):
        at = int(code.first[s])
        return [(int(code.node[i]), int(code.bit[i])) for i in range(at, at + int(code.size[s]))]

    for w in words:
        s = model.symbol.get(w, model.escape)
        one, two = ([model.end, model.end, *done])[-1], ([model.end, model.end, *done])[-2]
        near = Counter(int(model.kind[x]) for x in done[-lm_score.WINDOW :] if model.kind[x] < lm_score.KINDS - 1)
        kind = min((k for k in near if near[k] == max(near.values())), default=lm_score.KINDS - 1)
        for node, bit in path(model.words, s):
            seen = nodes.setdefault(node, [0, 0])
            out.append((0, ((), (kind,), (one,), (one, two), (two,)), node, bit, tuple(seen)))
            seen[bit] += 1
        if s == model.escape:
            for i, byte in enumerate(w + b" "):
                back = [w[i - k] if i >= k else 0 for k in (1, 2, 3)]
                for node, bit in path(model.bytes, byte):
                    out.append((1, ((back[0],), tuple(back[:2]), tuple(back), (w[:i],), (kind, back[0])), node, bit, None))
        done.append(s)
    return out


def test_mixing_equals_the_plain_way(monkeypatch):
    """Counts by context and node, the mix of stretched predictions by gated weights, the map and the sum, bit by bit."""
    model = small_model()
    texts = [b"ab c AB zz b ab", b"", b"ba ba c c zz q ab b", b"b " * 20]
    table = np.zeros(2 * lm_score.SLOTS, np.int64)
    plain = Counter()
    for text in texts:
        words = lm_score._words(text)
        for slots, bit, *_ in lm_score.Bits([([], words)], model, follow=False).groups:
            for s in slots:
                np.add.at(table, 2 * s + bit, 1)
        plain.update((g, k, c, node, bit) for g, contexts, node, bit, _ in plain_bits(words, model) for k, c in enumerate(contexts))
    r = np.random.default_rng(4)
    w = [r.random((n, lm_score.GATES)) for n in lm_score.INPUTS]
    refined = r.random((2, 512)) * 0.8 + 0.1
    gate = lambda n: min(math.ceil(math.log2(n + 1)), lm_score.GATES - 1)
    stretch = lambda a, b: math.log((b + 0.4) / (a + 0.4))
    weighted = np.zeros(lm_score.SLOTS, np.float32)
    for k in range(10):
        a, b = int(lm_score.OFFSETS[k]), int(lm_score.OFFSETS[k + 1])
        zero, one = table[2 * a : 2 * b : 2], table[2 * a + 1 : 2 * b : 2]
        weighted[a:b] = w[k // 5][k % 5][lm_score._gate(zero + one)] * lm_score._stretch(zero, one)
    got = lm_score._costs([lm_score._words(t) for t in texts], model, weighted, w, refined.astype(np.float32))
    for text, cost in zip(texts, got, strict=True):
        want, depth, last = 0.0, 0, None
        for at, (g, contexts, node, bit, seen) in enumerate(bits := plain_bits(lm_score._words(text), model)):
            starts = at == 0 or bits[at - 1][0] != g or node == (model.words, model.bytes)[g].node[0]
            depth = 0 if starts else depth + 1
            z = 0.0
            for k, c in enumerate(contexts):
                n = [plain[g, k, c, node, b] for b in (0, 1)]
                z += w[g][k][gate(sum(n))] * stretch(*n)
            if seen:
                z += w[g][5][gate(sum(seen))] * stretch(*seen)
            u = min(max(z * 3 + 31.5, 0), 62.99)
            i = min(depth, 7) * 64 + int(u)
            p = 0.5 * (refined[g][i] * (1 - u % 1) + refined[g][i + 1] * (u % 1)) + 0.5 / (1 + math.exp(-min(max(z, -12), 12)))
            want += math.log(p if bit else 1 - p)
        assert cost == pytest.approx(want, rel=1e-4)


def test_learning_follows_the_gradient():
    """The weights' first step is the coding cost's slope by the curvature, as finite differences find it."""
    r = np.random.default_rng(2)
    inputs = [lm_score._input(r.integers(0, 9, 400), r.integers(0, 9, 400)) for _ in range(3)]
    gates = [x.view(np.int32) & 7 for x in inputs]
    bit = r.integers(0, 2, 400)

    def cost(w):
        z = sum(w[k][g] * x for k, (g, x) in enumerate(zip(gates, inputs, strict=True)))
        return -np.where(bit == 1, -np.log1p(np.exp(-z)), -np.log1p(np.exp(z))).sum()

    before = np.full((3, lm_score.GATES), 0.3)
    after = before.copy()
    lm_score.learn_step(after, inputs, bit)
    for k in range(3):
        for g in range(lm_score.GATES):
            d = np.zeros_like(before)
            d[k, g] = 1e-3
            slope, bend = (cost(before - d) - cost(before + d)) / 2e-3, (cost(before + d) + cost(before - d) - 2 * cost(before)) / 1e-6
            assert after[k, g] == pytest.approx(max(0, before[k, g] + lm_score.RATE * slope / (bend + 20)), abs=1e-3)
    assert cost(after) < cost(before)


def test_codes_are_complete():
    code = lm_score.Code([5, 0, 9, 1, 1, 30])
    assert sum(0.5 ** int(n) for n in code.size) == 1.0
    paths = {tuple(code.bit[f : f + n].tolist()) for f, n in zip(code.first.tolist(), code.size.tolist(), strict=True)}
    assert len(paths) == 6 and code.size[5] == 1


def test_the_score_reads_words_in_order(spark):
    """Shuffled words and a text that repeats a training passage get other scores than a unigram model's, and the contexts
    reach across blanks; pieces of a long text cost what the whole does."""
    phrases = [prose(s, 8).split() for s in range(4)]
    train = [(i, " ".join(w for s in range(3) for w in phrases[(i + s) % 4])) for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1]
    ordered = phrases[0] + phrases[1]
    shuffled = [random.Random(i).sample(ordered, len(ordered)) for i in range(len(held) - 1)]
    got = {r["doc_id"]: r for r in lm_score.scores(frame(spark, [*train, *[(i, " ".join(w)) for i, w in zip(held, [ordered, *shuffled], strict=True)]])).collect()}
    first, *rest = [got[i] for i in held]
    assert all(r["base_score"] == pytest.approx(first["base_score"]) for r in rest)
    assert all(r["score"] < first["score"] - 3 for r in rest)


def test_pieces_of_a_long_text(monkeypatch):
    """Contexts from the training counts reach back over a piece's start; only what follows the text itself starts anew."""
    words = [*prose(3, 700).lower().encode().split(), b"x" * 300, *prose(4, 300).lower().encode().split(), b""]
    model = lm_score.Model([(w, 5, i % 3) for i, w in enumerate(dict.fromkeys([*words[::3], b""]))], 9, np.ones(256, np.int64))
    whole = [g for _, p in lm_score._bulks(iter([words])) for g in lm_score.Bits(p, model).groups]
    monkeypatch.setattr(lm_score, "BULK", 200)
    pieces = [lm_score.Bits(p, model).groups for _, p in lm_score._bulks(iter([words]))]
    assert len(pieces) > 10 and sum(len(w) for _, p in lm_score._bulks(iter([words])) for _, w in p) == len(words)
    for g in (0, 1):
        for k, s in enumerate(whole[g][0]):
            assert np.array_equal(np.concatenate([p[g][0][k] for p in pieces]), s)


def test_texts_are_read_alike_as_lists_and_in_arrow():
    """Symbols, contexts, languages and spelled words of texts, a cut one too, don't depend on the way they are read."""
    words = prose(3, 400).lower().encode().split()
    model = lm_score.Model([(w, 5, i % 3) for i, w in enumerate(dict.fromkeys([*words[::3], b""]))], 9, np.ones(256, np.int64))
    texts = [b" ".join(words), b"", b" \t\n", b"  A\x0bTable\xc3\x89 a ", b"table zz " * 20_000, b"x"]

    def told(places, r):
        return [list(places), *[x.tolist() for x in (r.symbol, r.piece, r.kind, r.rare_kind, r.rare_piece)], r.rare.to_pylist(), [[c.tolist() for c in k] for k in r.contexts()]]

    plain = [told(p, lm_score.Read.lists(x, model)) for p, x in lm_score._bulks(map(lm_score._words, texts))]
    assert len(plain) > 3 and [told(p, r) for p, r in lm_score._reads(pa.array(texts, pa.binary()), model)] == plain


def test_distinct_words_count_and_cost_what_each_occurrence_does():
    """Counted once with how often they occur, words give the same tables as bit by bit; a repeated word is spelled once."""
    model = small_model()
    pieces = [([], lm_score._words(t)) for t in [b"ab c ab zz b zz ab", b"ba ba c c zz q ab b", b"b " * 20]]
    groups, read = lm_score.Bits(pieces, model, follow=False).groups, lm_score.Read.lists(pieces, model)
    want, got = np.zeros(2 * lm_score.SLOTS, np.int32), np.zeros(2 * lm_score.WORD_SLOTS, np.int32)
    for slots, bit, *_ in groups:
        for s in slots:
            np.add.at(want, 2 * s + bit, 1)
    lm_score._count_distinct(got, [(read.symbol, read.contexts())], model)
    assert np.array_equal(got, want[: 2 * lm_score.WORD_SLOTS])
    times = Counter(zip(read.rare.to_pylist(), read.rare_kind.tolist(), strict=True))
    cols = {"word": sorted({w for w, _ in times}), "c": [0] * len({w for w, _ in times})}
    cols |= {f"n{k}": pa.array([times.get((w, k)) for w in cols["word"]], pa.int64()) for k in range(lm_score.KINDS)}
    batch = pa.RecordBatch.from_pydict(cols, pa.schema([("word", pa.binary()), *[(c, pa.int64()) for c in cols if c != "word"]]))
    rest, n = np.zeros_like(want), 0
    for words, kind, often, _ in lm_score._distinct(iter([batch])):
        slots, bit, _, word = lm_score.spelled(words, kind, model)
        n += len(words)
        for s in slots:
            np.add.at(rest, 2 * s + bit, often[word])
    assert n == len(times) < sum(times.values()) and np.array_equal(rest[2 * lm_score.WORD_SLOTS :], want[2 * lm_score.WORD_SLOTS :])


def test_learning_from_codes_follows_the_inputs():
    r = np.random.default_rng(5)
    inputs = [lm_score._input(r.integers(0, 90, 4000), r.integers(0, 9, 4000)) for _ in range(3)]
    codes, bit = [lm_score._code(x) for x in inputs], r.integers(0, 2, 4000).astype(np.uint8)
    assert all(np.allclose(lm_score._CODED[c], x, atol=0.02, rtol=0.02) and np.array_equal(c % lm_score.GATES, x.view(np.int32) & 7) for c, x in zip(codes, inputs, strict=True))
    one, two = np.full((3, lm_score.GATES), 0.3), np.full((3, lm_score.GATES), 0.3)
    assert np.allclose(lm_score.learn_step(one, inputs, bit), lm_score.code_step(two, codes, bit), atol=0.05) and np.allclose(one, two, atol=0.01)


def test_one_sum_by_code_gives_errors_and_curvatures():
    """Bits that count several times move the weights as repeated bits do, in one sum or apart."""
    r = np.random.default_rng(8)
    inputs = [lm_score._input(r.integers(0, 90, 3000), r.integers(0, 9, 3000)) for _ in range(3)]
    bit = r.integers(0, 2, 3000).astype(np.uint8)
    for most in (8, 40):
        times = r.integers(1, most, 3000)
        assert (times.sum() > lm_score.STEPS[0]) == (most == 40)
        one, two, three = (np.full((3, lm_score.GATES), 0.3) for _ in range(3))
        z = lm_score.code_step(one, [lm_score._code(x) for x in inputs], bit, times)
        lm_score.code_step(two, [lm_score._code(x).repeat(times) for x in inputs], bit.repeat(times))
        assert len(z) == 3000 and np.allclose(one, two, atol=1e-9)
        lm_score.learn_step(three, inputs, bit, times)
        assert np.allclose(one, three, atol=0.01)


def test_slots_of_two_entries_and_what_a_text_showed():
    model = small_model()
    pieces = [([], lm_score._words(t)) for t in [b"ab c ab zz b zz ab", b"", b"ba ba c c zz q ab b", b"b ab " * 9000, b"c"]]
    plain, paired = lm_score.Bits(pieces, model), lm_score.Bits(pieces, model, codes=True)
    (slots, bit, _, own, (seen,)), (twice, *_, (codes,)) = plain.groups[0], paired.groups[0]
    assert all(np.array_equal(2 * a + bit, b) for a, b in zip(slots, twice, strict=True)) and plain.pieces.tolist() == [0, 1, 2, 3, 4]
    assert np.array_equal(np.repeat(plain.pieces, np.diff(plain.begin, append=len(bit))), own)
    counts, want = {}, []
    for piece, node, b in zip(own.tolist(), slots[0].tolist(), bit.tolist(), strict=True):
        n = counts.setdefault((piece, node), [0, 0])
        want.append(tuple(n))
        n[b] += 1
    want = lm_score._input(*np.array(want).T)
    assert len(bit) > 1 << 15 and np.array_equal(seen, want) and np.array_equal(codes, lm_score._code(want))
    words, kind = [b"zz", b"q", b"ba"], np.array([0, 7, 1])
    (a, bit, *_), (b, *_) = lm_score.spelled(words, kind, model), lm_score.spelled(words, kind, model, 1)
    assert all(np.array_equal(2 * x + bit, y) for x, y in zip(a, b, strict=True))


def test_fine_steps_and_a_kind_with_its_node_cost_the_same():
    r = np.random.default_rng(5)
    bits = lm_score.Bits([([], lm_score._words(b"ab c ab zz b zz ab ba c " * 200))], small_model(), spell=False)
    slots, bit, depth, _, own = bits.groups[0]
    weighted, w = r.normal(0, 2, lm_score.WORD_SLOTS).astype(np.float32), r.random((6, lm_score.GATES))
    refined = np.linspace(0.05, 0.95, 512).astype(np.float32)
    want = lm_score._logs(slots, bit, depth, own, weighted, w, refined)
    plain, kinds = int(lm_score.OFFSETS[1]), weighted[int(lm_score.OFFSETS[1]) : int(lm_score.OFFSETS[2])]
    kinds.reshape(lm_score.KINDS, plain)[:] += weighted[:plain]
    got = lm_score._logs(slots[1:], bit, depth, own, lm_score._fine(weighted), w, refined)
    assert np.allclose(got, want, atol=0.02) and got.sum() == pytest.approx(want.sum(), rel=1e-3)
    assert int(lm_score._fine(np.full(3, 1e9, np.float32)).max()) * 5 < 1 << 15


def test_words_are_counted_in_arrow(monkeypatch):
    texts = [b"A b b", b"", b" \t\n", b"b  C\x0bb\xc3\x89 ", b"x y", b"b x"]
    kinds = [0, 0, 1, 1, -1, 0]
    want, got = Counter(), Counter()
    for t, k in zip(texts, kinds, strict=True):
        for x in lm_score._words(t):
            want[x, k] += k >= 0
    monkeypatch.setattr(lm_score, "MOST", 3)
    for many in (0, 1000):
        monkeypatch.setattr(lm_score, "MANY", many)
        batches = [pa.RecordBatch.from_arrays([pa.array([t], pa.binary()), pa.array([k], pa.int32())], ["text", "kind"]) for t, k in zip(texts, kinds, strict=True)]
        rows = [r for b in lm_score._count_words(iter(batches)) for r in b.to_pylist()]
        got = Counter()
        for r in rows:
            got[r["word"], r["kind"]] += r["c"]
        assert got == want and set(got) == set(want) and (many == 0 or len(rows) == len(want))
    assert not list(lm_score._count_words(iter([])))


def test_vocabulary_is_bounded_by_a_threshold(spark):
    rows = [(bytearray(f"w{i}".encode()), c, c) for i, c in enumerate([9, 9, 7, 7, 7, 5, 2, 2, 1, 0])] + [(bytearray(b""), 3, 3)]
    words = spark.createDataFrame(rows, "word binary, c long, c0 long")
    assert [(w, c) for w, c, _ in lm_score.vocabulary(words, 1, most=100)] == [(b"w0", 9), (b"w1", 9), (b"w2", 7), (b"w3", 7), (b"w4", 7), (b"w5", 5), (b"", 3), (b"w6", 2), (b"w7", 2)]
    assert [c for _, c, _ in lm_score.vocabulary(words, 1, most=6)] == [9, 9, 7, 7, 7, 3]
    assert lm_score.vocabulary(words.limit(0), 0) == [(b"", 0, lm_score.KINDS - 1)]


def filled(sizes, weights, total, most):
    """Water filling by bisection on the level."""
    low, high = 0.0, max([most * s / w for s, w in zip(sizes, weights, strict=True)], default=0.0)
    total = min(total, most * sum(sizes))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most * s, w * mid) for s, w in zip(sizes, weights, strict=True)) < total else (low, mid)
    return [min(most * s, w * high) for s, w in zip(sizes, weights, strict=True)]


@pytest.mark.parametrize("sizes", [[0, 10], [], [1000, 1, 1, 1, 500, 3]])
def test_water_fill(spark, sizes):
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    df = spark.createDataFrame(list(zip(range(len(sizes)), weights, sizes)), "s long, weight double, size long")
    got = [r["target"] for r in mixing.water_fill(df, 1.5, 2).orderBy("s").collect()]
    assert got == pytest.approx(filled(sizes, weights, 1.5 * sum(sizes), 2))


def mix_docs(spark, nasty):
    return nasty.union(frame(spark, [(1000 + i, prose(i, 5 + i % 50), "en", f"s{i % 4}") for i in range(120)]))


@pytest.mark.parametrize("point", ["corput", "ordered"])
def test_mix_equals_brute_force(spark, nasty, nothing, point):
    """Slots map to sources, ranks to blocks, blocks to words; what is taken is what the slots hold."""
    docs = mix_docs(spark, nasty)
    mix = mixing.Mix(docs, bucket_docs=20, point=point)
    rows = mix.docs.collect()
    names = sorted({r["source"] for r in rows}, key=lambda x: (x is None, x or ""))
    sizes = [sum(r["size"] for r in rows if r["source"] == x) for x in names]
    targets = filled(sizes, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2)
    n = 1 << mix.bits
    ends = [round(sum(targets[: i + 1]) / sum(targets) * n) for i in range(len(names))]
    want, rank = {}, Counter()
    for slot in range(n):
        at = int(f"{slot:0{mix.bits}b}"[::-1], 2) if point == "corput" else slot
        s = next(i for i, e in enumerate(ends) if at < e)
        w, r = mix.block_words, rank[s]
        rank[s] += 1
        for word in range(math.floor(r * w), math.floor((r + 1) * w)):
            if word < 2 * sizes[s]:
                d = next(x for x in rows if x["source"] == names[s] and x["at"] <= word % sizes[s] < x["at"] + x["size"])
                key = (slot, s, str(d["doc_id"]), d["at"], word // sizes[s])
                low, many = want.get(key, (word % sizes[s] - d["at"], 0))
                want[key] = low, many + 1
    got = {(r["slot"], r["s"], str(r["doc_id"]), r["at"], r["epoch"]): (r["first_word"], r["words"]) for r in mix.plan.collect()}
    assert got == want
    took = Counter()
    for (_, s, d, at, _), (_, many) in want.items():
        took[names[s], d, at] += many
    assert {(r["source"], str(r["doc_id"])): 0 for r in rows}.keys() == {(r["source"], str(r["doc_id"])): 0 for r in mix.taken().collect()}.keys()
    assert sum(r["taken"] for r in mix.taken().collect()) == sum(took.values())
    assert mixing.mixed(nothing).count() == 0 and mixing.Mix(nothing).taken().count() == 0


def test_mix_comes_near_its_targets(spark, nasty):
    docs = mix_docs(spark, nasty)
    mix = mixing.Mix(docs)
    rows = mix.taken().collect()
    assert len(rows) == docs.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], [r["target"], 0, 0])
        by[r["source"]][1] += r["taken"]
        by[r["source"]][2] += r["size"]
    assert all(abs(t - k) <= mix.block_words + 1 and t <= 2 * s for t, k, s in by.values())
    assert sum(t for t, _, _ in by.values()) == pytest.approx(1.5 * sum(s for _, _, s in by.values()))
    assert sorted(map(str, rows)) == sorted(map(str, mixing.Mix(docs.repartition(3)).taken().collect()))


def test_mixed_holds_whole_texts_in_slot_order(spark, nasty):
    docs = mix_docs(spark, nasty)
    texts = {r["text"] for r in docs.collect()}

    def rows(point):
        out = mixing.mixed(docs, point=point)
        assert out.columns == docs.columns
        return [(r["source"], r["doc_id"], r["text"]) for r in out.coalesce(1).collect()]

    spread, ordered = rows("corput"), rows("ordered")
    assert all(t in texts for *_, t in spread) and Counter(spread).most_common(1)[0][1] <= 4
    assert [s for s, *_ in spread] != [s for s, *_ in ordered]
    assert len({s for s, *_ in spread[:40]}) > len({s for s, *_ in ordered[:40]})
    by_doc = {p: {(r["source"], str(r["doc_id"]), r["key"]): (r["first_slot"], r["off_place"]) for r in mixing.Mix(docs, point=p).taken().collect() if r["taken"]} for p in ("corput", "ordered")}
    assert by_doc["corput"] != by_doc["ordered"]  # the schedule shows in the result
    assert max(o for _, o in by_doc["corput"].values()) < max(o for _, o in by_doc["ordered"].values()) / 4
    mix, words, most = mixing.Mix(docs), Counter(), Counter()
    for s, _, t in spread:
        words[s] += len(words_of(t))
    took = Counter()
    for r in mix.taken().collect():
        took[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert all(abs(words[s] - took[s]) <= most[s] / 2 + 1 for s in took)  # a source's last turn is whole or left out


def test_schedule_stays_near_the_weights(spark):
    df = spark.createDataFrame([(0, 500.0), (1, 200.0), (2, 100.0)], "s long, target double")
    slots = [(r["s"], r["rank"]) for r in mixing.schedule(df, 10, chunk=8).orderBy("slot").collect()]
    assert Counter(s for s, _ in slots) == {0: 640, 1: 256, 2: 128}
    for s in range(3):
        assert [r for x, r in slots if x == s] == list(range(Counter(x for x, _ in slots)[s]))
    for n in (8, 80, 400, 1000):
        assert all(abs(sum(x == s for x, _ in slots[:n]) - n * w / 8) <= 4 for s, w in enumerate((5, 2, 1)))


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, nasty, nothing, enc, tmp_path, encoding):
    path = f"file://{tmp_path}/ids"
    token_files.write_tokens(nasty, path, encoding=encoding)
    rows = sorted(NASTY, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want, at = [], 0
    for d, t, *_ in rows:
        b = enc.whole(t or "") + b"\2\0\0\0"
        want.append((d, at, len(b) // 4, zlib.crc32(b)))
        at += len(b) // 4
    got = token_files.digests(spark, path).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert sorted(r["start"] for r in token_files.read_metadata(spark, path).collect()) == [w[1] for w in want]
    assert [r["ids"] for r in token_files.read_tokens(spark, path, [4]).collect()] == [[*np.frombuffer(enc.whole("One two three"), "<u4").tolist(), 2]]
    token_files.write_tokens(nothing, f"{path}0")
    assert token_files.digests(spark, f"{path}0").count() == 0


def test_packing(spark, nasty, nothing, enc):
    docs = nasty.union(frame(spark, [(1000 + i, prose(i, 20 + i % 90), "en", f"s{i % 4}") for i in range(60)]))
    texts = {}  # several rows may share a doc_id and a size: each piece is of one of them
    for r in docs.collect():
        b = enc.whole(r["text"] or "") + b"\0\0\0\0"
        texts.setdefault((r["doc_id"], len(b) // 4), []).append(b)
    rows = packing.packed(docs, window=64, block_windows=32, least=8).collect()
    by = {}
    for r in rows:
        held = texts[r["doc_id"], r["doc_tokens"]]
        assert r["length"] > 0 and any(r["ids_crc32"] == zlib.crc32(b[4 * r["start"] : 4 * (r["start"] + r["length"])]) for b in held)
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(enc.whole(r["text"] or "")) // 4 + 1 for r in docs.collect())
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 64 and not at & (at - 1)
    assert packing.packed(nothing).count() == 0


def test_round_robin_keeps_the_mixture():
    queues = [[50] * 80, [200] * 10, [10] * 100]
    total = sum(map(sum, queues))
    shares = [sum(q) / total for q in queues]
    got = packing.round_robin(queues, shares, [0.0] * 3, 100, 8).tolist()
    for k, q in enumerate(queues):
        mine = sorted((i, a, n) for _, s, i, a, n in got if s == k)
        assert [(i, a) for i, a, _ in mine] == [(i, sum(n for j, _, n in mine[:m] if j == i)) for m, (i, _, _) in enumerate(mine)]
        assert Counter({i: sum(n for j, _, n in mine if j == i) for i in range(len(q))}) == Counter(dict(enumerate(q)))
    for w in range(60):
        mine = [sum(n for v, s, *_, n in got if v == w and s == k) for k in range(3)]
        assert sum(mine) == 100 and all(abs(m - 100 * x) <= 16 for m, x in zip(mine, shares, strict=True))


def test_small_sources_are_in_every_window_by_default():
    """A source of 4 per cent is owed 40 ids a window, more than the least piece."""
    got = packing.round_robin([[1000] * 96, [100] * 40], [0.96, 0.04], [0.0, 0.0], 1000).tolist()
    assert {v for v, s, *_ in got if s == 1} == set(range(100))


def test_crf_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    counts = np.array([3, 1, 4])
    emit, trans = r.normal(size=8), r.normal(size=(2, 2))
    got, _ = quality_crf.marginals(emit, trans, counts)
    at = 0
    for n in counts:
        p = np.zeros(n)
        z = 0.0
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            s = math.exp(sum(e * v for e, v in zip(emit[at : at + n], y, strict=True)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            z += s
            p += s * np.array(y)
        assert got[at : at + n] == pytest.approx(p / z)
        at += n


def junk(seed):
    return " ".join(w.upper() + "!!" for w in prose(seed, 80).split())


def test_quality(spark, nasty, nothing):
    rows = [(i, "\n".join(prose(i * 7 + k, 30) for k in range(4)) if i % 2 else junk(i)) for i in range(120)]
    docs = nasty.union(frame(spark, [(d + 2000, t) for d, t in rows]))
    labels = spark.createDataFrame([(d + 2000, d % 2, 0) for d, _ in rows], "doc_id long, quality int, toxic int")
    got = quality_crf.scored(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and (r["doc_id"] or 0) >= 2000]
    assert held and all(r["predicted"] == r["doc_id"] % 2 for r in held)
    kept = quality_crf.quality_filter(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    assert quality_crf.scored(nothing, labels).count() == 0
    assert {r["score"] for r in quality_crf.scored(nasty, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("tasks,rows", [(1, 256), (7, 1), (50, 5)])
def test_equal_texts_have_equal_scores(spark, tasks, rows):
    """A score depends on its text alone, to the last bit: not on the batch, the task or the document before."""
    r = random.Random(11)
    texts = ["", None, "one", "dog god dog", "same line here\n" * 3, junk(3), *("\n".join(prose(s * 5 + k, r.randrange(1, 40)) for k in range(r.randrange(1, 9))) for s in range(40))]
    rows_ = [(i, texts[i % len(texts)]) for i in range(3 * len(texts))]
    labels = spark.createDataFrame([(i, int(t != texts[5]), 0) for i, t in rows_], "doc_id long, quality int, toxic int")
    one = {x["doc_id"]: x["score"] for x in quality_crf.scored(frame(spark, rows_), labels).collect()}
    got = {x["doc_id"]: x["score"] for x in quality_crf.scored(frame(spark, r.sample(rows_, len(rows_))).repartition(tasks), labels, rows=rows).collect()}
    assert got == one and len(set(one.values())) > 5
    assert all(one[i] == one[i + len(texts)] == one[i + 2 * len(texts)] for i in range(len(texts)))


def test_pieces_of_long_documents_have_the_same_features(monkeypatch):
    text = "\n".join([*(prose(s, 30) for s in range(60)), "", "again and again and again", "again and again and again", "x" * 700])
    whole = quality_crf.lines([text, "tail tail", text])
    monkeypatch.setattr(quality_crf, "BULK", 400)
    for a, b in zip(whole, quality_crf.lines([text, "tail tail", text]), strict=True):
        assert np.array_equal(a, b)
    assert whole[0][62, 16] == 1.0 and whole[0][0, 16] == 0.0
    x = quality_crf.lines(["dog god cab bac", "dog dog cab cab"])[0]
    assert x[0, 8] == 0 and x[1, 8] == 0.5  # anagrams are other words
    monkeypatch.setattr(quality_crf, "LONGEST", 100)
    assert quality_crf.lines(["y" * 250 + "\nz"])[2].tolist() == [4]


def test_pipeline(spark, tmp_path, enc):
    import corpus_pipeline

    good = [(i, prose(i, 120), "en", f"s{i % 3}") for i in range(60)]
    rows = [*good, (100, prose(5, 120), "en", "s0"), (101, "  ".join(prose(6, 120).split(" ")), "en", "s1"), *[(200 + i, junk(i), "en", "s2") for i in range(40)]]
    frame(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 200), 0) for d, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}")
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name == "quality_crf":
            assert sorted(ids) == sorted(d for d, *_ in rows if d < 200)
        elif name != "mixing":
            assert sorted(ids) == list(range(60))
    assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    mix = docs.collect()  # by the plain arithmetic: what each source gives, and that every text is whole
    words, want = Counter(), Counter()
    for r in mix:
        assert r["text"] == prose(r["doc_id"], 120)
        words[r["source"]] += len(words_of(r["text"]))
    sizes = [sum(len(words_of(t)) for _, t, _, s in good if s == x) for x in ("s0", "s1", "s2")]
    for x, target in zip(("s0", "s1", "s2"), filled(sizes, [5.0, 2.0, 1.0], 1.5 * sum(sizes), 2), strict=True):
        assert abs(words[x] - target) <= 120 + 1
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    for r in mix:
        want[r["doc_id"]] += len(enc.whole(r["text"])) // 4 + 1
    got, seen = Counter(), Counter()
    for r in out:
        b = enc.whole(prose(r["doc_id"], 120)) + b"\0\0\0\0"
        assert r["ids_crc32"] == zlib.crc32(b[4 * r["start"] : 4 * (r["start"] + r["length"])]) and r["doc_tokens"] == len(b) // 4
        got[r["doc_id"]] += r["length"]
        seen.update((r["sequence_id"], r["offset"] + k) for k in range(r["length"]))
    assert got == want and set(seen.values()) == {1}
    for s in {s for s, _ in seen}:
        n = sum(x == s for x, _ in seen)
        assert all((s, k) in seen for k in range(n)) and n <= 1024


def test_other_vocabularies_are_encoded_by_the_library():
    """A vocabulary with another pre-tokenizer or normalizer doesn't go through the quick cut."""
    other = Encoder(vocabulary_path("word_bpe_49k.json"))
    texts = ["Hello, world. It's  fine", " a b\nc", "", "Zürich 123"]
    assert not other.known and Encoder(vocabulary_path()).known
    assert [np.frombuffer(x, "<u4").tolist() for x in other.encode(texts)] == [other.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_queue_of_many_sources_takes_little_room():
    """Thousands of tiny sources beside a hot one: every id once, in its queue's order."""
    queues = [[3]] * 5000 + [[20_000]]
    total = sum(map(sum, queues))
    got = packing.round_robin(queues, [sum(q) / total for q in queues], [0.0] * len(queues), 1024)
    assert got[:, 4].sum() == total and {(int(s), int(i)) for _, s, i, *_ in got} == {(s, 0) for s in range(5001)}
    hot = got[got[:, 1] == 5000]
    assert np.array_equal(hot[:, 3], np.cumsum(hot[:, 4]) - hot[:, 4]) and max(hot[:, 4]) <= 1024


def test_ids_equal_encode_on_random_marks_and_blanks_with_a_small_cache():
    r = random.Random(1)
    bits = ["a", "Zz", " ", "  ", "\n", "\n\n", ".", ",", "'s", "'", "%%", "\t", "9", "12", "é", "ß", "_", "x1", "<|endoftext|>", "\xa0", "你好", "\0", "!", "?.", "\r\n", "é", "don't", "²", "~"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(4000)]
    enc = Encoder(vocabulary_path(), cache=300)
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
    assert got == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(enc.cache) + len(enc.old) < 500 and enc.old
