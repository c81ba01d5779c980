"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares of its characters and words (case, symbols, digits, repeats, short
words, ...), together with those of the line before and the line after; a 2 x 2 transition matrix joins neighbouring lines.
Forward-backward marginals, weighted by the lines' lengths, give a document's share of good text, and a logistic curve
fitted on the training documents turns its log-odds into a score.

Training sees a bounded sample: sample_docs labelled documents at most, the first by a hash, of at most sample_lines lines
each and sample_all together. Labels name documents, not lines, so lines start with their document's label and, once, are
labelled anew by the model inside bad documents. Everything else runs over all documents and whole texts.

A score is a function of the text alone, bit for bit: equal texts have equal scores however rows are dealt to tasks and
batches. Null or empty texts are one empty line. A line of more than 2^20 characters counts as several; very long texts are
read in pieces of whole lines. Rows that repeat a doc_id are scored each, an empty table gives none, and only doc_id and text
of a document and doc_id and quality of a label are read, so other columns may have any name. A document with several
labels trains with each. Without both labels all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, documents, held_out_modulus, slim, stored

BASE = 18
FEATURES = 3 * BASE + 1
THRESHOLD = 0.3
BASE_HASH = 0x9E3779B97F4A7C15
#: Characters that are worked on at once, and of a line before it counts as several.
BULK = 1 << 20
LONGEST = 1 << 20


def _classes() -> np.ndarray:
    """Per code point below 0x3000: 0 other, 1 lower case, 2 upper case, 3 digit, 4 symbol, 5 white space."""
    out = np.zeros(0x3000, np.uint8)
    for c in range(0x3000):
        x = chr(c)
        out[c] = 5 if x.isspace() else 2 if x.isupper() else 1 if x.isalpha() else 3 if x.isdigit() else 4
    return out


_CLASS = _classes()


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE_HASH^i and its inverse, modulo 2^64, for i below n."""
    up, down = np.full(n, BASE_HASH, np.uint64), np.full(n, pow(BASE_HASH, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _line_count(text: str | None) -> int:
    return sum(max(1, -(-len(x) // LONGEST)) for x in text.split("\n")) if text and len(text) > LONGEST else text.count("\n") + 1 if text else 1


def _wrapped(text: str | None) -> str:
    """The text with lines above LONGEST characters cut."""
    if text and len(text) > LONGEST:
        return "\n".join(x[i : i + LONGEST] for x in text.split("\n") for i in range(0, max(1, len(x)), LONGEST))
    return text or ""


def lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base features (lines x BASE), line lengths in characters, and the number of lines of each text.

    A line's row depends on its document up to that line alone, bit for bit, however texts are put together: sums are of
    integers, and words and lines are compared by polynomial hashes that don't know their place."""
    counts = np.array([_line_count(t) for t in texts])
    parts, size, held = [], 0, []
    for t in map(_wrapped, texts):  # about BULK characters at a time; a longer text in pieces of whole lines
        while held and size + len(t) > BULK or size > BULK:
            parts.append(_piece(held))
            held, size = [], 0
        lead = ""
        while len(t) > BULK and (at := t.find("\n", BULK)) >= 0:
            parts.append(_piece([t[:at]], lead))
            lead = t[t.rfind("\n", 0, at) + 1 : at]
            t = t[at + 1 :]
        if lead:
            parts.append(_piece([t], lead))
        else:
            held.append(t)
            size += len(t)
    if held:
        parts.append(_piece(held))
    return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts]), counts


def _piece(texts: list[str], lead: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths of the lines of some texts. lead: the line before the first text's first, not told itself."""
    joined = (lead + "\n" if lead else "") + "\n".join(texts) + "\n"
    ch = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CLASS[np.minimum(ch, 0x2FFF)]
    ends = np.flatnonzero(ch == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = (ends - starts).astype(np.float64)

    def per_line(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return (c[ends] - c[starts]).astype(np.float64)

    space = kind == 5
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    stop = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    line_of = np.searchsorted(ends, begin)
    length = stop - begin
    up, down = _powers(1 << max(20, len(ch).bit_length()))
    sums = np.zeros(len(ch) + 1, np.uint64)
    np.cumsum((ch + np.uint64(1)) * up[: len(ch)], dtype=np.uint64, out=sums[1:])
    word = (sums[stop] - sums[begin]) * down[begin]
    whole = (sums[ends] - sums[starts]) * down[starts]
    k = len(ends)

    def words(flag: np.ndarray) -> np.ndarray:
        return np.bincount(line_of, weights=flag, minlength=k)

    def again(lag: int) -> np.ndarray:
        same = np.zeros(len(word))
        same[lag:] = (word[lag:] == word[:-lag]) & (line_of[lag:] == line_of[:-lag])
        return same

    w = words(np.ones(len(word)))
    letters = per_line(kind == 1) + per_line(kind == 2)
    some, any_w, any_l = np.maximum(n, 1), np.maximum(w, 1), np.maximum(letters, 1)
    near = np.maximum.reduce([again(1), again(2), again(3)])
    same_line = np.zeros(k)
    same_line[1:] = (whole[1:] == whole[:-1]) & (n[1:] == n[:-1]) & (w[1:] > 2)
    opened = np.cumsum([(1 if lead else 0), *(t.count("\n") + 1 for t in texts[:-1])])
    same_line[opened[1 if lead else 0 :]] = 0  # a document's first line follows none
    last, first = kind[stop - 1], kind[begin]
    x = np.column_stack([
        np.minimum(np.log1p(n), 8) / 8, np.minimum(np.log1p(w), 6) / 6, per_line(kind == 2) / any_l, per_line(kind == 3) / some, per_line(kind == 4) / some,
        per_line(ch == 33) / any_w, per_line(ch == 124) / any_w, per_line(space) / some, words(again(1)) / any_w, words(near) / any_w,
        words(length <= 3) / any_w, words(length >= 14) / any_w, np.minimum(words(length) / any_w, 30) / 10, words(last == 4) / any_w, words(first == 4) / any_w,
        np.minimum(per_line((kind == 4) & np.concatenate([[False], (kind == 4)[:-1]])) / any_w, 3), same_line, (n == 0).astype(np.float64),
    ])
    return (x[1:], n[1:]) if lead else (x, n)


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after in its document, and a constant."""
    stop = np.cumsum(counts)
    before, after = np.vstack([np.zeros((1, x.shape[1])), x[:-1]]), np.vstack([x[1:], np.zeros((1, x.shape[1]))])
    before[stop - counts] = 0
    after[stop - 1] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1))])


def marginals(emit: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected transitions (2 x 2); emit: log-odds of good, all documents side by side.

    Both passes carry the share of good alone and are written out by element: a matrix product's last bit would depend on
    the other documents."""
    order = np.argsort(-counts, kind="stable")
    at, length = (np.cumsum(counts) - counts)[order], counts[order]
    longest = int(length[0])
    e = np.clip(emit, -30, 30)
    good, bad = 1 / (1 + np.exp(-e)), 1 / (1 + np.exp(e))
    (m00, m01), (m10, m11) = np.exp(trans)
    alive = np.searchsorted(-length, -np.arange(1, longest + 1), side="right").tolist()
    fwd, back = np.empty(len(emit)), np.full(len(emit), 0.5)
    fwd[at] = f = good[at]
    for t in range(1, longest):
        i, f = at[: alive[t]] + t, f[: alive[t]]
        g, b = ((1 - f) * m01 + f * m11) * good[i], ((1 - f) * m00 + f * m10) * bad[i]
        fwd[i] = f = g / (g + b)
    for t in range(longest - 1, 0, -1):
        i = at[: alive[t]] + t
        h = back[i]
        g, b = good[i] * h, bad[i] * (1 - h)
        x, y = b * m10 + g * m11, b * m00 + g * m01
        back[i - 1] = x / (x + y)
    p, q = fwd * back, (1 - fwd) * (1 - back)
    inner = np.ones(len(emit), bool)
    inner[at] = False
    i = np.flatnonzero(inner)
    g, b, f = good[i] * back[i], bad[i] * (1 - back[i]), fwd[i - 1]
    joint = np.array([(1 - f) * m00 * b, (1 - f) * m01 * g, f * m10 * b, f * m11 * g])
    return p / (p + q), (joint / joint.sum(0)).sum(1).reshape(2, 2)


def fit(x: np.ndarray, counts: np.ndarray, n: np.ndarray, label: np.ndarray, steps: int = 120) -> dict[str, np.ndarray | float]:
    """Weights and transitions by Adam on the conditional likelihood, then the logistic curve of the documents' score."""
    full = with_neighbours(x, counts)
    mean, dev = full.mean(0), full.std(0) + 1e-3
    mean[-1], dev[-1] = 0, 1
    z = (full - mean) / dev
    doc = np.repeat(np.arange(len(counts)), counts)
    y = label[doc].astype(np.float64)
    theta, inner = np.zeros(FEATURES + 4), np.ones(len(doc), bool)
    inner[np.cumsum(counts)[:-1]] = inner[0] = False
    for turn in range(2):
        m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
        seen = np.zeros((2, 2))
        i = np.flatnonzero(inner)
        np.add.at(seen, (y[i - 1].astype(int), y[i].astype(int)), 1)
        for t in range(1, steps + 1):
            p, pair = marginals(z @ theta[:FEATURES], theta[FEATURES:].reshape(2, 2), counts)
            g = np.concatenate([z.T @ (y - p), (seen - pair).ravel()]) / len(y) - 1e-3 * theta
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            theta += 0.08 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        if not turn:  # inside bad documents, good-looking lines become good, but never the worst one
            p, _ = marginals(z @ theta[:FEATURES], theta[FEATURES:].reshape(2, 2), counts)
            least = np.minimum.reduceat(p, np.cumsum(counts) - counts)[doc]
            y = np.where(label[doc] == 1, 1.0, ((p > 0.5) & (p > least)).astype(np.float64))
    model = {"theta": theta, "mean": mean, "dev": dev, "a": 1.0, "b": 0.0}
    odds = log_odds(model, x, counts, n)
    a, b = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))
        r = label - q
        h = q * (1 - q) + 1e-6
        hess = np.array([[(h * odds * odds).sum() + 1, (h * odds).sum()], [(h * odds).sum(), h.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, [(r * odds).sum() - a, r.sum()])
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
        if abs(da) + abs(db) < 1e-9:
            break
    return model | {"a": float(a), "b": float(b)}


def emissions(model: dict, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The log-odds of good of each line, feature by feature, so that equal lines among equal ones get equal bits."""
    weight = model["theta"][:FEATURES] / model["dev"]
    sides = np.zeros((3, len(x)))
    for k in range(3):
        for j in range(BASE):
            sides[k] += x[:, j] * weight[k * BASE + j]
    stop = np.cumsum(counts)
    before, after = np.roll(sides[1], 1), np.roll(sides[2], -1)
    before[stop - counts] = 0
    after[stop - 1] = 0
    return sides[0] + before + after + (weight[-1] - float((model["mean"] * weight).sum()))


def log_odds(model: dict, x: np.ndarray, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    p, _ = marginals(emissions(model, x, counts), model["theta"][FEATURES:].reshape(2, 2), counts)
    starts = np.cumsum(counts) - counts
    share = np.add.reduceat(p * (n + 1), starts) / np.add.reduceat(n + 1, starts)
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("score", T.DoubleType())])
SAMPLE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("n", T.BinaryType()), T.StructField("x", T.BinaryType())])


def _scores(model: dict | None, texts: list[str | None]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    x, n, counts = lines(texts)
    return 1 / (1 + np.exp(-np.clip(model["a"] * log_odds(model, x, counts, n) + model["b"], -30, 30)))


def _score(model: dict | None, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole, 2, rows):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_scores(model, batch.column(2).to_pylist()))], SCORES.names)

    return run


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            x, n, _ = lines([r["text"]])
            rows.append({"doc_id": r["doc_id"], "quality": r["quality"], "n": n.tobytes(), "x": x.tobytes()})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("n", pa.binary()), ("x", pa.binary())]))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 3000, sample_lines: int = 1000, sample_all: int = 200_000) -> dict | None:
    """Fits on labelled rows whose crc32(doc_id) mod 5 is not 0: the first sample_docs by a hash of doc_id and text among those
    of at most sample_lines lines and a character more than 2^20 at most, as far as they have sample_all lines together.
    None if they don't hold both labels."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter((held_out_modulus() != 0) & F.col("quality").isin(0, 1))
    chosen = chosen.groupBy("doc_id", "quality").agg(F.lit(1).alias("one")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_docs)
    d = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = d.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text", F.xxhash64("text").alias("key"), (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).alias("lines"))
    rows = rows.filter((F.col("lines") <= sample_lines) & (F.length("text") <= LONGEST))
    first = rows.select("doc_id", "quality", "key", "lines").distinct().orderBy(F.xxhash64("doc_id", "key"), "doc_id", "key", "quality").limit(sample_docs).collect()
    ends = np.cumsum([r["lines"] for r in first])
    told = [(r["doc_id"], r["key"]) for r, end in zip(first, ends, strict=True) if end <= sample_all]
    if not told:
        return None
    keys = F.broadcast(docs.sparkSession.createDataFrame(sorted(set(told)), "doc_id long, key long"))
    some = rows.join(keys, ["doc_id", "key"]).dropDuplicates(["doc_id", "key", "quality"]).select("doc_id", "quality", "text").mapInArrow(_features, SAMPLE)
    got = sorted(some.collect(), key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    if len({r["quality"] for r in got}) < 2:
        return None
    x = np.concatenate([np.frombuffer(r["x"]).reshape(-1, BASE) for r in got])
    n = [np.frombuffer(r["n"]) for r in got]
    return fit(x, np.array([len(v) for v in n]), np.concatenate(n), np.array([r["quality"] for r in got], np.float64))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = 256) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, key (a hash of its text). rows: texts worked on at once."""
    model = train(docs, labels)
    d = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scores = stored(d.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_score(model, rows), SCORES), "quality")
    return scores.select("doc_id", (held_out_modulus() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "key")


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with all their columns, without a shuffle."""
    model = train(docs, labels)
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole, at, 256):
                yield batch.filter(pa.array(_scores(model, batch.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("key")
