"""Retrieval over passages: terms, coverage, rank, fusion, metrics, citations, and the question gate."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.stem import stemmed

from .storage import materialised

LIVE = r"(^|[^a-z])(latest|newest|most recent|current|right now|how many|count of|timestamp)([^a-z]|$)"


def needs_live_answer(question: Column) -> Column:
    """Questions that an index can't answer: they are gated before any retrieval."""
    return F.lower(question).rlike(LIVE)


def coverage(passages: DataFrame, terms: list[str], body: str = "line") -> DataFrame:
    """hits: how many of the terms stand in the body; coverage: their share."""
    hits = F.size(F.array_intersect(tx.body_words(F.col(body)), F.array(*map(F.lit, terms)).cast("array<string>")))
    return passages.withColumn("hits", hits).withColumn("coverage", F.col("hits") / F.lit(float(max(1, len(terms)))))


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rank from 1 on; for rows that a limit has bounded."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def lexical(passages: DataFrame, terms: list[str], k: int, body: str = "line") -> DataFrame:
    """The k passages with the best coverage. Only they are ranked, after a distributed top-k."""
    order = F.desc("hits"), F.asc("doc_id"), F.asc("ordinal")
    found = coverage(passages, terms, body).filter("hits > 0").select("doc_id", "ordinal", "hits", "coverage")
    return ranked(found.orderBy(*order).limit(k), *order)


def postings(passages: DataFrame, keys: list[str], body: str, *, stem: bool = False, weight: float = 1.0) -> DataFrame:
    """An inverted index: keys, term, position, weight."""
    words = F.regexp_extract_all(F.lower(body), F.lit(tx.WORD))
    rows = passages.select(*keys, F.posexplode(words).alias("position", "term"))
    if stem:
        rows = rows.withColumn("term", stemmed("term"))
    return rows.withColumn("weight", F.lit(weight))


def density_rank(index: DataFrame, terms: list[str], keys: list[str]) -> DataFrame:
    """For a disjunction every cover is one matching position: raw sums their weights, score = raw / (raw + 1)."""
    hits = index.filter(F.col("term").isin(terms)).groupBy(*keys).agg(F.sum("weight").alias("raw"))
    return hits.withColumn("score", F.col("raw") / (F.col("raw") + 1))


def fuse(*lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (doc_id, rank) lists: doc_id, score, lists."""
    every = reduce(DataFrame.unionByName, [x.select("doc_id", "rank").groupBy("doc_id").agg(F.min("rank").alias("rank")) for x in lists])
    return every.groupBy("doc_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.count("*").alias("lists"))


def fuse_each(*lists: DataFrame, k: int = 60) -> DataFrame:
    """fuse() for many questions at once: (q, doc_id, rank) lists to q, doc_id, score, lists."""
    every = reduce(DataFrame.unionByName, [x.groupBy("q", "doc_id").agg(F.min("rank").alias("rank")) for x in lists])
    return every.groupBy("q", "doc_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.count("*").alias("lists"))


def metrics(found: DataFrame, k: int) -> DataFrame:
    """Recall@k (any hit), MRR@k and DCG@k of (q, hit, rk)."""
    hit = F.col("hit")
    per = found.filter(F.col("rk") <= k).groupBy("q").agg(
        F.max(F.when(hit, 1.0).otherwise(0.0)).alias("recall"), F.max(F.when(hit, 1 / F.col("rk")).otherwise(0.0)).alias("rr"), F.sum(F.when(hit, 1 / F.log2(F.col("rk") + 1.0)).otherwise(0.0)).alias("dcg")
    )
    return per.agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("dcg"), 6).alias("dcg"))


#: Words of a gram, and the least of them that a quote needs for one: its first and its last word may be parts of a document's.
GRAM = 3


def _grams(text: Column) -> Column:
    """The hashes of a text's runs of GRAM parts between blanks. The text is split and its parts are hashed once; a lambda would do both
    again for each gram, and a gram's hash comes from its parts' hashes, without strings of its own."""

    def hashes(parts: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(parts) - GRAM)
        runs = F.transform(at, lambda i: F.xxhash64(*[F.get(parts, i + k) for k in range(GRAM)]))
        return F.when(F.size(parts) >= GRAM, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(F.transform(F.split(text, " "), lambda part: F.xxhash64(part))), hashes), 1)


def quotes(docs: DataFrame, items: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """(item_id, doc_id) where a document (doc_id, text) contains a quote (item_id, text), byte for byte.

    Of each quote the gram that the fewest documents hold picks the candidates, which are then searched for the whole quote; a gram
    is a run of words between blanks, so whoever holds the quote holds its grams. Quotes too short for a gram go through automata
    in blocks of bounded size that meet the documents part by part. No quote passes the driver. Null texts contain and are contained in nothing."""
    d = docs.select(F.col("doc_id"), "text").filter("text IS NOT NULL")
    q = items.select("item_id", F.col("text").alias("quote")).filter("quote IS NOT NULL")
    inner = F.regexp_replace("quote", r"^[^ ]*(?: |$)|(?: |^)[^ ]*$", "")
    keyed = q.withColumn("grams", _grams(inner))
    long_, short = keyed.filter(F.size("grams") > 0).drop("grams"), keyed.filter(F.size("grams") == 0).drop("grams")
    asked = keyed.select("item_id", F.explode("grams").alias("gram"))
    held = d.select("doc_id", F.explode(_grams(F.col("text"))).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi")
    held = materialised(held, "quote-grams")
    spread = held.groupBy("gram").agg(F.count("*").alias("n"))
    rare = asked.join(spread, "gram").groupBy("item_id").agg(F.count("*").alias("grams"), F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    whole = asked.groupBy("item_id").agg(F.count("*").alias("asked"))
    rare = rare.join(whole, "item_id").filter("grams = asked").select("item_id", "gram")  # a gram that no document holds ends the search
    pairs = rare.join(held, "gram").select("item_id", "doc_id")
    found = pairs.join(long_, "item_id").join(d, "doc_id").filter(F.contains("text", "quote")).select("item_id", "doc_id")
    return found.unionByName(_by_automata(d, short, block_bytes)).distinct()


def _by_automata(docs: DataFrame, short: DataFrame, block_bytes: int) -> DataFrame:
    size = short.agg(F.coalesce(F.sum(F.octet_length("quote")), F.lit(0)).alias("b")).first()["b"]
    blocks = int(size // block_bytes) + 1
    parts = max(1, int(docs.count() // 2000))
    q = short.select("item_id", "quote", F.pmod(F.xxhash64("quote"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    d = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def run(quotes_: pa.Table, texts: pa.Table) -> pa.Table:
        import ahocorasick

        names: dict[str, list] = {}
        for i, quote in zip(quotes_["item_id"].to_pylist(), quotes_["quote"].to_pylist(), strict=True):
            names.setdefault(quote, []).append(i)
        always = names.pop("", [])
        find = ahocorasick.Automaton()
        for quote in names:
            find.add_word(quote, quote)
        find.make_automaton()
        out: list[tuple] = []
        for doc, text in zip(texts["doc_id"].to_pylist(), texts["text"].to_pylist(), strict=True):
            found = {quote for _, quote in find.iter(text)} if names else set()
            out += [(i, doc) for quote in found for i in names[quote]] + [(i, doc) for i in always]
        return pa.table({n: pa.array([x[j] for x in out], pa.int64()) for j, n in enumerate(("item_id", "doc_id"))})

    return q.groupBy("block", "part").cogroup(d.groupBy("block", "part")).applyInArrow(run, "item_id long, doc_id long")


def log_records(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, ordinal, record, stamp, request, lines: a record begins at a date at a line's start; further lines stay with it."""
    parts = F.filter(F.split(text, r"(?m)(?=^\d{4}-\d\d-\d\d[T ])"), lambda x: F.trim(x) != "")
    rows = df.select(*keys, F.posexplode(parts).alias("ordinal", "record"))
    return rows.select(*keys, "ordinal", "record", F.regexp_extract("record", r"^(\S+(?: \d\d:\d\d:\d\d)?)", 1).alias("stamp"), F.regexp_extract("record", r"(?:request|trace)_id=(\w+)", 1).alias("request"), F.size(F.filter(F.split("record", "\n"), lambda x: x != "")).alias("lines"))


def cues(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Transcript cues with the keys of their rows: times in seconds, the speaker tag, what was said."""
    blocks = F.filter(F.split(text, r"\r?\n\s*\r?\n"), lambda b: b.contains("-->"))
    rows = df.select(*keys, F.posexplode(blocks).alias("ordinal", "cue"))
    times = r"(\S+)\s+-->\s+(\S+)"
    said = F.regexp_replace(F.regexp_replace("cue", r"(?s)^.*?-->[^\n]*\n", ""), r"<[^>]*>", "")
    return rows.select(*keys, "ordinal", tx.cue_seconds(F.regexp_extract("cue", times, 1)).alias("starts"), tx.cue_seconds(F.regexp_extract("cue", times, 2)).alias("ends"), F.regexp_extract("cue", r"<v ([^>]+)>", 1).alias("speaker"), F.trim(F.translate(said, "\n", " ")).alias("said"))


def reauthorised(hits: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """The hits if all of them are still allowed, otherwise none."""
    lost = hits.join(allowed.select(key), key, "left_anti").agg(F.count("*").alias("lost"))
    return hits.join(F.broadcast(lost.filter("lost = 0")))
