"""SpotSigs document fingerprints, in DataFrame functions alone.

A run of common words is an anchor; its signature is the run's first word with the CHAIN content words that follow it,
further common words left out. A text's fingerprint is the set of its signatures' 32-bit hashes, ascending, as hex; a text
with few has its word pairs, too, and a text without any of these its whole word sequence. Likeness is the Jaccard similarity of two sets. near_pairs finds
similar documents: sets are partitioned by length so that only neighbouring partitions can reach the threshold, each set is
looked up by its rarest signatures alone, and a candidate is dropped where its lengths bound the similarity below it.

A null text is empty; two empty texts are alike (1.0), and an empty table gives no row. Texts of any length are read whole; only
doc_id and text are read, so other columns may have any name. Documents stand in ascending doc_id order, nulls first, those that
share a doc_id by their texts; the last one's next is the first. Of a single document the next is itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, slim, stored

CHAIN = 2
#: Texts with fewer signatures than this have their word pairs as signatures, too.
FEW = 8
#: Common words of English, French, Spanish and German that serve as anchors. Fixed values.
ANCHORS = (
    "the of and to in a is that for on with was it as are this be by from at or an which he his "
    "de la le et en un une des les du que est pour sur dans au par il qui ne se pas "
    "el y los las por para con lo su es del al como "
    "der die das und ein eine zu den im von mit für ist auf dem nicht sich des"
).split()


def words(text: Column) -> Column:
    """Lower-case letters and digits, one blank between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def one_of(words_: list[str]) -> str:
    """A pattern for any of the words, branching letter by letter; a longer word before its prefixes."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words_)):
        heads.setdefault(w[:1], []).append(w[1:])
    branches = [c + (one_of(rest) if any(rest) else "") for c, rest in heads.items() if c]
    return "(?:" + "|".join(branches) + ")" + ("?" if "" in heads and branches else "")


def _chains(words_: Column, anchors: list[str], chain: int) -> Column:
    """The signatures' hashes, in order of appearance."""
    any_ = one_of(anchors)
    # common words go, but the first of a run stays as a mark on the content word after it
    ended = F.regexp_replace(words_, rf"(?<![^ ]){any_}(?: {any_}(?![^ ]))*+$", "")  # nothing follows the last run
    marked = F.regexp_replace(ended, rf"(?<![^ ])({any_})(?: {any_}(?![^ ]))*+ (?!{any_}(?![^ ]))(?=[^ ])", "$1>")
    found = F.regexp_extract_all(marked, F.lit(rf"(?<![^ ])(?=([^ >]++>[^ ]++(?: [^ ]++){{{chain - 1}}}))"))
    return F.transform(found, lambda s: F.hash(F.regexp_replace(s, " [^ >]+>", " ")))


def with_spots(df: DataFrame, texts: dict[str, Column], anchors: list[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """df with, for each name, the set of its text's signature hashes: an ascending array<int>, never empty; null where the
    text is null. In three projections, so that nothing that is used twice is computed twice."""
    df = df.withColumns({f"{k}_words": F.when(t.isNotNull(), words(t)) for k, t in texts.items()})
    df = df.withColumns({f"{k}_chains": _chains(F.col(f"{k}_words"), anchors, chain) for k in texts})
    out = {}
    for k in texts:
        plain, all_ = F.col(f"{k}_chains"), F.col(f"{k}_words")
        pairs = F.transform(F.regexp_extract_all(all_, F.lit("(?<![^ ])(?=([^ ]++ [^ ]++))")), lambda s: F.hash(s))
        one = F.when(F.size(plain) > 0, F.array().cast("array<int>")).otherwise(F.array(F.hash(all_)))
        rest = F.when(F.size(plain) >= FEW, F.array().cast("array<int>")).when(all_.contains(" "), pairs).otherwise(one)
        out[k] = F.when(all_.isNotNull(), F.array_sort(F.array_distinct(F.concat(plain, rest))))
    return df.withColumns(out).drop(*[f"{k}_{x}" for k in texts for x in ("words", "chains")])


def fingerprint(spots: Column) -> Column:
    return F.array_join(F.transform(spots, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def length_partition(size: Column, threshold: float) -> Column:
    """Sets whose partitions differ by more than one can't reach the threshold."""
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")


def near_pairs(spotted: DataFrame, threshold: float = 0.8, hot: int = 1000) -> DataFrame:
    """(a, b, likeness) for a < b whose likeness reaches the threshold, between representatives of equal sets: (id, spots) rows with equal spots
    count as the one with the smallest id.

    A pair at the threshold shares one of the rarest |A| - ceil(t |A|) + 1 signatures of each; those key the join, with the length partition.
    Distinct sets at the threshold share t / (1 - t) signatures or more, and as many as k of the rarest |A| - ceil(t |A|) + k. So a key
    that more than `hot` sets have is split by a further signature of the longer prefix, again and again while that holds."""
    one = spotted.groupBy("spots").agg(F.min("id").alias("id"))
    seen = one.select("id", F.explode("spots").alias("x"))
    rarity = seen.groupBy("x").agg(F.count("*").alias("n"))
    ordered = seen.join(rarity, "x").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("o"))
    deepest = max(1, math.ceil(threshold / (1 - threshold) - 1e-9)) if threshold < 1 else 1
    n = F.size("o")
    spare = (n - F.ceil(n * threshold - 1e-9)).cast("int")
    ordered = stored(ordered.select("id", n.alias("n"), length_partition(n, threshold).alias("p"), spare.alias("spare"), F.slice("o.x", F.lit(1), spare + deepest).alias("x")), "spot-prefixes")
    rows = ordered.select("id", "n", "p", "spare", "x", F.explode(F.transform(F.slice("x", F.lit(1), F.col("spare") + 1), lambda y: F.array(y))).alias("key"))
    met = None
    for level in range(1, deepest + 1):
        rows = stored(rows.distinct(), "spot-keys") if level > 1 else rows
        many = rows.groupBy("key").agg((F.count("*") > hot).alias("hot"))
        told = rows.join(many, "key")
        mine = told if level == deepest else told.filter("NOT hot")
        left = mine.select(F.col("id").alias("a"), F.col("n").alias("na"), "key", "p")
        right = mine.select(F.col("id").alias("b"), F.col("n").alias("nb"), "key", F.explode(F.array(F.col("p") - 1, F.col("p"), F.col("p") + 1)).alias("p"))
        pruned = left.join(right, ["key", "p"]).filter("a < b").filter(F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9).select("a", "b")
        met = pruned if met is None else met.unionByName(pruned)
        if level == deepest or not told.filter("hot").limit(1).count():
            break
        longer = F.filter(F.slice("x", F.lit(1), F.col("spare") + level + 1), lambda y: ~F.array_contains("key", y))
        rows = told.filter("hot").select("id", "n", "p", "spare", "x", F.explode(F.transform(longer, lambda y: F.array_sort(F.array_append("key", y)))).alias("key"))
    sets = one.select("id", "spots")
    both = met.distinct().join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return both.filter(F.col("likeness") >= threshold - 1e-12)


def _bucket(doc_id: Column, bounds: Column, step: int) -> Column:
    """How many of the ascending bounds, in rows of `step`, are at or below doc_id; looked up in two levels, so that many
    bounds cost their root."""

    def below(a: Column) -> Column:
        return F.size(F.filter(a, lambda x: x <= doc_id))

    row = below(F.transform(bounds, lambda r: r[0]))
    inner = below(F.get(bounds, row - 1))
    return F.when(doc_id.isNull() | (row == 0), 0).otherwise((row - 1) * step + inner)


def with_next(docs: DataFrame, bucket_docs: int = 4000, most_buckets: int = 50_000) -> tuple[DataFrame, Window]:
    """doc_id, text, next_text, last, bucket: each document and the text after it. Ranges of doc_id, cut at quantiles, are
    the partitions; each gets the first text of the range after it. The bounds, at most most_buckets numbers, travel as one
    broadcast row, and only (bucket, next bucket) is put in one order. Returns the window that later columns can use, too."""
    d = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    k = min(max(1, -(-n // bucket_docs)), most_buckets)  # beyond that, ranges grow and their windows spill
    found = d.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], min(20 * k, 1_000_000))).first()[0] if k > 1 else []
    bounds = sorted(set(found or []))
    step = max(1, math.isqrt(len(bounds)))
    if bounds:
        row = docs.sparkSession.createDataFrame([([bounds[i : i + step] for i in range(0, len(bounds), step)],)], "bounds array<array<bigint>>")
        d = d.crossJoin(F.broadcast(row)).select("doc_id", "text", _bucket(F.col("doc_id"), F.col("bounds"), step).alias("bucket"))
    else:
        d = d.withColumn("bucket", F.lit(0))
    least = d.groupBy("bucket").agg(F.min_by(F.struct("doc_id"), F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("m")).select(F.col("bucket").alias("k"), F.col("m.doc_id").alias("m"))
    firsts = d.join(F.broadcast(least), (F.col("bucket") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("m"))).groupBy("bucket").agg(F.min("text").alias("first"))
    firsts = stored(firsts, "firsts")
    over = Window.orderBy("bucket")  # two numbers a bucket
    after = firsts.select("bucket", F.coalesce(F.lead("bucket").over(over), F.first("bucket").over(over)).alias("then"))
    after = after.join(firsts.select(F.col("bucket").alias("then"), F.col("first").alias("first_after")), "then").select("bucket", "first_after")
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    led = d.withColumn("led", F.lead("text").over(w)).join(after, "bucket")
    return led.select("bucket", "doc_id", "text", F.coalesce("led", "first_after").alias("next_text"), F.col("led").isNull().alias("last")), w


def fingerprints(docs: DataFrame, **options: int) -> DataFrame:
    rows, w = with_next(docs, **options)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)))
    found = edited.select("bucket", "doc_id", "text", "edited", "last", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.when(F.col("last"), F.col("next_text")).alias("after_text"))
    found = with_spots(found, {"own": F.col("text"), "changed": F.col("edited"), "after": F.col("after_text")}).drop("edited", "after_text")
    both = found.withColumn("next", F.coalesce("after", F.lead("own").over(w)))
    return both.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"), length_partition(F.size("own"), 0.8).alias("length_partition"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
