"""Selection of passages: budgets, threads, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def thread(turns: DataFrame, of: Column, most: int) -> DataFrame:
    """The first other turns of each chosen turn's conversation: conv_id, turn, other."""
    mine = turns.filter(of).select("conv_id", "turn")
    # a rank of most + 1 suffices: at most one of them is the turn itself
    first = turns.select("conv_id", F.col("turn").alias("other"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("r")).filter(F.col("r") <= most + 1)
    both = mine.join(first, "conv_id").filter("turn <> other")
    return both.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("other"))).filter(F.col("place") <= most).drop("place", "r")


def prefix_budget(rows: DataFrame, keys: list[str], order: str, budget: int, most: int) -> DataFrame:
    """keys, chosen, used: the longest run of first rows within the budget."""
    w = Window.partitionBy(*keys).orderBy(order)
    used = rows.withColumn("used", F.sum("cost").over(w)).withColumn("k", F.row_number().over(w))
    return used.filter((F.col("used") <= budget) & (F.col("k") <= most)).groupBy(*keys).agg(F.count("*").alias("chosen"), F.max("used").alias("used"))


def greedy_budget(rows: DataFrame, key: str, order: str, budget: int, most: int) -> DataFrame:
    """key, chosen (orders), used: rows in order, skipping those that don't fit."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("cost").cast("long").alias("c")))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("chosen"))

    def step(s: Column, r: Column) -> Column:
        fits = (s["used"] + r["c"] <= budget) & (F.size(s["chosen"]) < most)
        return F.when(fits, F.struct((s["used"] + r["c"]).alias("used"), F.concat(s["chosen"], F.array(r["o"])).alias("chosen"))).otherwise(s)

    return lists.withColumn("s", F.aggregate("rows", start, step)).select(key, "s.chosen", "s.used")


def page(rows: DataFrame, keys: list[str], order: str, chars: int, pieces: int) -> DataFrame:
    """keys, next_ordinal, pieces: a bounded page and where the next one begins."""
    w = Window.partitionBy(*keys).orderBy(order)
    fits = (F.sum("cost").over(w) <= chars) & (F.row_number().over(w) <= pieces)
    return rows.withColumn("fits", fits).groupBy(*keys).agg((F.max(F.when(F.col("fits"), F.col(order))) + 1).cast("bigint").alias("next_ordinal"), F.count_if(F.col("fits")).alias("pieces"))


def redundant(hits: DataFrame, share: float = 0.8) -> DataFrame:
    """Hits (source, start, end, rank) of which an earlier-ranked hit of the same source covers the share, or more, of the
    shorter one. For the bounded rows of one answer."""
    a, b = hits.alias("a"), hits.alias("b")
    overlap = F.least("a.end", "b.end") - F.greatest("a.start", "b.start")
    shorter = F.least(F.col("a.end") - F.col("a.start"), F.col("b.end") - F.col("b.start"))
    return a.join(b, (F.col("a.source") == F.col("b.source")) & (F.col("b.rank") < F.col("a.rank")) & (overlap >= shorter * share), "left_semi").select("a.*")


_TESTS = {"=": lambda c, v: c == v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "in": lambda c, v: c.isin(*v) if v else F.lit(False), "contains": lambda c, v: c.contains(v)}


def structured(rows: DataFrame, tests: list[tuple[str, str, object]], order: list[str], limit: int, *, after: list[object] | None = None, count: bool = False) -> DataFrame:
    """The first rows that pass every (column, test, value), in an order ("-" descends), with `truncated`: whether more would. The tests
    reach the scan; one row more than the limit is taken, never the whole answer.

    after: a cursor, the order's values of the last row of the page before; the order has to tell all rows apart. count: also `total`, of all
    pages' rows, which is a pass of its own."""
    for column, test, value in tests:
        rows = rows.filter(_TESTS[test](F.col(column), value))
    names = [o.removeprefix("-") for o in order]
    by = [F.desc(n) if o.startswith("-") else F.asc(n) for o, n in zip(order, names, strict=True)]
    page_ = rows
    if after is not None:
        beyond, same = F.lit(False), F.lit(True)
        for o, n, v in zip(order, names, after, strict=True):
            beyond = beyond | (same & (F.col(n) < F.lit(v) if o.startswith("-") else F.col(n) > F.lit(v)))
            same = same & (F.col(n) == F.lit(v))
        page_ = rows.filter(beyond)
    taken = page_.orderBy(*by).limit(limit + 1)
    told = taken.withColumn("place_", F.row_number().over(Window.orderBy(*by))).withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit)  # limit + 1 rows
    out = told.filter(F.col("place_") <= limit).drop("place_")
    return out.withColumn("total", F.lit(rows.count())) if count else out
