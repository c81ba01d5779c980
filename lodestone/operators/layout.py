"""Layout geometry over words with places: columns by the widest gap, and lines that were wrapped.

Pages are rows of (key, line number, line); a word's place is where its characters stand. Everything is keyed by page, and a page's
places are summed before they are put in order, so a page costs no more rows than it is wide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import islands


def words(lines: DataFrame, key: str, number: str = "ordinal", line: str = "line") -> DataFrame:
    """key, number, x0, x1 for each word: the columns that its characters take, from 0 on, the last one excluded. Words are what blanks part."""
    parts = lines.select(key, number, F.posexplode(F.split(line, " ")).alias("i", "word"))
    ends = F.sum(F.length("word") + 1).over(Window.partitionBy(key, number).orderBy("i"))
    placed = parts.withColumn("x1", (ends - 1).cast("long")).withColumn("x0", F.col("x1") - F.length("word"))
    return placed.filter("x1 > x0").select(key, number, "x0", "x1")


def gaps(placed: DataFrame, key: str) -> DataFrame:
    """key, x0, x1: the stretches of columns, between a page's first and its last word, that no word of any line touches. A sweep over
    the columns where words begin and end counts how many are open."""
    edges = placed.select(key, F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))).alias("e"))
    at = edges.groupBy(key, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(key).orderBy("x")
    swept = at.select(key, F.col("x").alias("x0"), F.lead("x").over(w).alias("x1"), F.sum("d").over(w).alias("open"))
    return swept.filter("open = 0 AND x1 IS NOT NULL").select(key, "x0", "x1")


def column_split(placed: DataFrame, key: str, least: int = 2) -> DataFrame:
    """key, x0, x1, left, right: the widest gap of at least so many columns, the leftmost of equal ones, and the words on either side."""
    best = gaps(placed, key).filter(F.col("x1") - F.col("x0") >= least).groupBy(key).agg(F.min_by(F.struct("x0", "x1"), F.struct(F.col("x0") - F.col("x1"), "x0")).alias("g")).select(key, "g.*")
    sides = placed.select(key, F.col("x0").alias("a")).join(best, key).groupBy(key, "x0", "x1")
    return sides.agg(F.count_if(F.col("a") < F.col("x0")).alias("left"), F.count_if(F.col("a") >= F.col("x1")).alias("right"))


def wrapped(lines: DataFrame, key: str, number: str = "ordinal", line: str = "line", width: int = 60) -> DataFrame:
    """lines with island: lines that go on from the one before, because that one is at least `width` long, ends neither a sentence nor a
    heading, and this one begins with a small letter."""
    before = F.lag(line).over(Window.partitionBy(key).orderBy(number))
    goes_on = (F.length(before) >= width) & ~before.rlike(r"[.!?:;]\s*$") & F.col(line).rlike(r"^\p{Ll}")
    return islands(lines, [key], [number], ~F.coalesce(goes_on, F.lit(False)))
