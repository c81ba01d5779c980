"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of 2^k slots of equal word counts, real numbers that differ by less than a word once cut. Slot i maps
the van der Corput point of i (its k bits reversed) through the cumulative targets to a source; a slot's rank among its
source's slots names the block that fills it. A source's documents stand in the order of a seeded hash, are cut into blocks,
and the stream is walked at most max_epochs times. What is taken of a source is what its slots ask for: a slot count is the
length of the source's interval in 2^-k, so it misses the target by a block at most, and k grows until a block is a SHARP-th
of the smallest target or LEAST words.

Everything is keyed by source and spread: slots of an interval are made from pieces of it, ranks come from counts per chunk
of slots and prefix sums over chunks, offsets from sums per hash bucket (as many as a source's documents need). Targets and
their cumulative sums come from windows over a slim row per source.

A null text has no words and is never taken. A null source is a source, last in order. Rows that repeat a doc_id are
documents of their own; rows that repeat doc_id and text, too, are taken by turns. A very long text fills many blocks. An
empty table gives an empty mix. Only doc_id, source and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NOT_WS, documents, slim, stored, unused

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS = 1024
SHARP = 128
LEAST = 16
#: Slots that a row of an interval becomes, and that a chunk of the ranking holds.
CHUNK = 1 << 14


def water_fill(sources: DataFrame, share: float, most: float) -> DataFrame:
    """sources (s, weight, size, ...) with target: share times all sizes, by weight, none above most times its size; the excess
    goes to the others by weight.

    In ascending order of cap / weight a source is full if its level, with all sources before it full, asks no more than
    there is; what the full ones leave is the others' level."""
    cap = F.col("size") * float(most)
    by = Window.orderBy(cap / F.col("weight"), "s")  # a slim row a source
    all_ = Window.partitionBy()
    before = F.coalesce(F.sum(cap).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    left = F.least(F.sum("size").over(all_) * float(share), F.sum(cap).over(all_))
    told = sources.withColumn("left_", left).withColumn("full_", before + cap / F.col("weight") * rest <= F.col("left_") * (1 + 1e-15))
    spare = F.col("left_") - F.sum(F.when(F.col("full_"), cap).otherwise(0.0)).over(all_)
    level = spare / F.sum(F.when(F.col("full_"), 0.0).otherwise(F.col("weight"))).over(all_)
    return told.withColumn("target", F.when(F.col("full_"), cap).otherwise(F.col("weight") * level)).drop("left_", "full_")


def bits_for(total: float, smallest: float) -> int:
    """k: blocks of at most BLOCK_WORDS words, smaller ones for small targets."""
    words = min(BLOCK_WORDS, max(LEAST, smallest / SHARP))
    return max(0, math.ceil(math.log2(max(1.0, total / words))))


def corput(i: Column, k: int) -> Column:
    """The k bits of i in reverse: its van der Corput point in units of 2^-k."""
    return F.conv(F.reverse(F.lpad(F.bin(i), k, "0")), 2, 10).cast("long") if k else F.lit(0).cast("long")


def schedule(targets: DataFrame, k: int, chunk: int = CHUNK, point: str = "corput") -> DataFrame:
    """(slot, s, rank, ideal): which block of which source fills each of the 2^k slots, and the place where the block would stand if its
    source's blocks were spread evenly. targets: (s, target), in the order of s.

    point: "corput", or "ordered" for one source after another, which is what a schedule without spreading would do."""
    order = Window.orderBy("s")  # a slim row a source
    ends = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0))
    of = targets.select("s", ends.alias("end"), F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    cut = of.select("s", F.round(F.col("end") / F.col("all") * float(1 << k)).cast("long").alias("to"))
    cut = cut.withColumn("from", F.coalesce(F.lag("to").over(order), F.lit(0).cast("long"))).filter("from < to")
    cut = cut.withColumn("every", F.lit(float(1 << k)) / (F.col("to") - F.col("from")))  # slots from one block of the source to its next
    pieces = cut.select("s", "every", "to", F.explode(F.sequence("from", F.col("to") - 1, F.lit(chunk).cast("long"))).alias("from")).select("s", "every", "from", F.least(F.col("from") + chunk, "to").alias("to"))
    points = pieces.repartition("s", "from").select("s", "every", F.explode(F.sequence("from", F.col("to") - 1)).alias("point"))
    slots = points.select("s", "every", (corput(F.col("point"), k) if point == "corput" else F.col("point")).alias("slot"))
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / (chunk << 4)))
    counts = slots.groupBy("s", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("s", "chunk", (F.sum("n").over(Window.partitionBy("s").orderBy("chunk")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1
    rank = F.col("before") + F.col("local")
    return slots.withColumn("local", local).join(before.hint("merge"), ["s", "chunk"]).select("slot", "s", rank.alias("rank"), ((rank + 0.5) * F.col("every") - 0.5).alias("ideal"))


class Mix:
    """plan: (slot, s, ideal, doc_id, source, key, at, epoch, first_word, words), the mix's pieces by slot; docs: a row per document with
    its source's target. block_words is the real number of words that each slot holds."""

    def __init__(self, docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: int = 2, bucket_docs: int = 4096, seed: int = 0, point: str = "corput") -> None:
        d = slim(docs, "doc_id", "source", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
        d = d.select("doc_id", "source", F.regexp_count("text", F.lit(NOT_WS + "+")).cast("long").alias("size"), F.xxhash64("text").alias("key"))
        sized = stored(d.withColumn("h", F.xxhash64("doc_id", "key", F.lit(seed))), "sizes")
        sums = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        named = sums.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)  # a slim row a source
        weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights)).cast("int"))
        bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / bucket_docs))).cast("int")
        sources = named.select("s", F.col("source").alias("name"), "size", weight.alias("weight"), bits.alias("bits"))
        told = stored(water_fill(sources, share, max_epochs), "targets")
        ask = told.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("all"), F.coalesce(F.min(F.when(F.col("target") > 0, F.col("target"))), F.lit(0.0)).alias("least")).first()
        self.bits = bits_for(ask["all"], ask["least"])
        self.block_words = w = ask["all"] / (1 << self.bits) or 1.0
        mine = sized.join(told.withColumnRenamed("size", "source_size"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
        mine = mine.withColumn("bucket", F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(h, 64 - bits)")).otherwise(F.lit(0).cast("long")))
        buckets = mine.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
        before = buckets.select("s", "bucket", (F.sum("n").over(Window.partitionBy("s").orderBy("bucket")) - F.col("n")).alias("before"))
        running = F.sum("size").over(Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "key").rowsBetween(Window.unboundedPreceding, 0))
        placed = mine.withColumn("running", running).join(before.hint("merge"), ["s", "bucket"]).withColumn("at", F.col("before") + F.col("running") - F.col("size"))
        self.docs = stored(placed.select("doc_id", "source", "size", "key", "s", "source_size", "target", "at"), "placed")
        walks = self.docs.filter("size > 0 AND target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn("from", F.col("at") + F.col("epoch") * F.col("source_size"))
        # block r holds the words from floor(r w) on; a word past the last slot's end meets no slot
        walks = walks.withColumn("to", F.col("from") + F.col("size")).filter(F.col("from") <= F.col("target") + 2 * w)
        first = F.greatest(F.lit(0), F.floor(F.col("from") / w) - 1)
        cut = walks.withColumn("rank", F.explode(F.sequence(first, F.floor(F.col("to") / w) + 1)))
        start, stop = F.greatest(F.floor(F.col("rank") * w), "from"), F.least(F.floor((F.col("rank") + 1) * w), "to")
        blocks = cut.withColumn("start", start).withColumn("stop", stop).filter("start < stop")
        blocks = blocks.select("s", "rank", "doc_id", "source", "key", "at", "epoch", (F.col("start") - F.col("from")).alias("first_word"), (F.col("stop") - F.col("start")).alias("words"))
        self.slots = schedule(told.select("s", "target"), self.bits, point=point)
        self.plan = self.slots.join(blocks.hint("merge"), ["s", "rank"]).drop("rank")  # both sides grow: never broadcast

    def taken(self) -> DataFrame:
        """Per document: doc_id, source, size, source_size, target, taken, key; of the slots that hold its words: first_slot, slots (how many),
        off_place (the farthest that one stands from where an even spread of its source would put it)."""
        off = F.max(F.abs(F.col("slot") - F.col("ideal")))
        words = self.plan.groupBy(F.col("s").alias("s_"), F.col("at").alias("at_")).agg(F.sum("words").alias("words"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("slots"), off.alias("off_place"))
        on = (F.col("s") == F.col("s_")) & (F.col("at") == F.col("at_")) & (F.col("size") > 0)
        return self.docs.join(words.hint("merge"), on, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).alias("taken"), "key", "first_slot", F.coalesce("slots", F.lit(0)).alias("slots"), "off_place")

    def turns(self) -> DataFrame:
        """(doc_id, key, copies, slot): each turn of a document that the mix takes, at the slot of its first word there. A turn
        that ends with its source's last slot counts as a whole one if half of its words or more are in the mix."""
        went = self.plan.groupBy("s", "at", "epoch").agg(F.min("slot").alias("slot"), F.sum("words").alias("words"), F.any_value("doc_id").alias("doc_id"), F.any_value("key").alias("key"))
        whole = went.join(self.docs.filter("size > 0").select("s", "at", "size").hint("merge"), ["s", "at"]).filter("2 * words >= size")
        return whole.groupBy("doc_id", "key", "epoch").agg(F.min("slot").alias("slot"), F.count("*").alias("copies"))


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The mixed corpus with the columns of docs, in the order of the schedule: a whole document comes once for each turn that
    the mix takes of it, at the slot that its first word fills. Written files follow that order."""
    key, id_, of, slot, copies, turn = unused(docs, "m_key", "m_id", "m_of", "m_slot", "m_copies", "m_turn")
    turns = Mix(docs, **options).turns().select(F.col("doc_id").alias(id_), F.col("key").alias(of), F.col("slot").alias(slot), F.col("copies").alias(copies))
    mine = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():  # repeated rows share their turns
        mine = mine.dropDuplicates(["doc_id", key])
    out = mine.join(turns.hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(of)))
    out = out.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return out.repartitionByRange(slot).sortWithinPartitions(slot, "doc_id", turn).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(documents(spark, sf_dir)).taken().drop("key", "source")
