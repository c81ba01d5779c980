"""Relational operators beyond the built-in ones: access, closure, ranks, islands, as-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialised


def accessible(sources: DataFrame, accounts: DataFrame, as_of: str, keys: list[str]) -> DataFrame:
    """Sources that are active, whose lease (access_expires_at) hasn't run out at as_of, and that have a healthy account or
    none. The predicates stand before anything that parses a payload."""
    alive = sources.filter(F.col("is_active") & (F.col("access_expires_at").isNull() | (F.col("access_expires_at") > F.lit(as_of).cast("timestamp_ntz"))))
    healthy = accounts.select(*keys).distinct().withColumn("healthy", F.lit(True))
    joined = alive.join(healthy, keys, "left")
    return joined.filter(F.col("healthy") | F.col(keys[0]).isNull()).drop("healthy")


def descendants(edges: DataFrame, roots: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, depth) of all nodes that reach a root by edges (child, parent). Pointer doubling: each round doubles the
    distance that a node has looked up, so a chain of n links takes log2(n) rounds; cycles end at the round limit."""
    at = roots.select(F.col("node"), F.col("node").alias("up"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("done"))
    walk = edges.join(roots.select(F.col("node").alias("child")), "child", "left_anti").select(F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("done"))
    now = materialised(at.union(walk), "closure")
    for _ in range(most_rounds):
        if not now.filter("NOT done").limit(1).count():
            break
        target = now.select(F.col("node").alias("n"), F.col("up").alias("u"), F.col("depth").alias("d"), F.col("done").alias("f"))
        open_ = now.filter("NOT done").join(target, F.col("up") == F.col("n"))  # a missing parent ends a walk
        now = materialised(now.filter("done").union(open_.select("node", F.col("u").alias("up"), (F.col("depth") + F.col("d")).alias("depth"), F.col("f").alias("done"))), "closure")
    return now.filter("done").select("node", "depth")


def first_n(rows: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "place") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)


def after_key(rows: DataFrame, key: Column, last: Column, n: int) -> DataFrame:
    """A page of a descending order, after the last key seen."""
    return rows.filter(key < last).orderBy(key.desc()).limit(n)


def nearest_rank(rows: DataFrame, key: str, value: str, wanted: dict[str, float], near: float = 0.0005) -> DataFrame:
    """Exact percentiles by nearest rank: the value at place ceil(q * n) of a key's values that aren't null.

    A sketch gives two values of which the place is certain to lie between (its error is a fifth of `near`); what is below is
    counted, and only the distinct values between are put in order, about a thousandth of a key's rows."""
    bounds = F.array(*[F.lit(x) for q in wanted.values() for x in (max(0.0, q - near), min(1.0, q + near))])
    told = rows.filter(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.percentile_approx(value, bounds, int(5 / near)).alias("b"))
    ask = F.array(*[F.struct(F.lit(name).alias("name"), F.ceil(q * F.col("n")).alias("place"), F.col("b")[2 * i].alias("lo"), F.col("b")[2 * i + 1].alias("hi")) for i, (name, q) in enumerate(wanted.items())])
    asked = rows.select(key, value).join(told.select(key, F.explode(ask).alias("ask")), key).select(key, value, "ask.*").filter(F.col(value) <= F.col("hi"))
    counts = asked.groupBy(key, "name", "place", F.when(F.col(value) >= F.col("lo"), F.col(value)).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key, "name").orderBy(F.col("v").asc_nulls_first()))
    found = counts.withColumn("upto", upto).filter(F.col("v").isNotNull() & (F.col("upto") >= F.greatest("place", F.lit(1))))
    return found.groupBy(key).agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in wanted])


def islands(rows: DataFrame, keys: list[str], order: list[str], is_break: Column) -> DataFrame:
    """rows with island: a number that rises where is_break holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("b", F.coalesce(is_break, F.lit(True)).cast("int")).withColumn("island", F.sum("b").over(w)).drop("b")


def section_parents(heads: DataFrame, keys: list[str], order: str, level: str) -> DataFrame:
    """parent: the nearest heading before of a lower level."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    above = [F.when(F.col(level) > k, F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(w)) for k in range(1, 6)]
    return heads.withColumn("parent", F.greatest(*above))


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, id_: str) -> DataFrame:
    """left with before: the id of the latest right row of the same keys before it. One shuffle, no range join."""
    mine = left.withColumn("side", F.lit(0))
    both = mine.unionByName(right.withColumn("side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(time, "side", id_).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("before", F.last(F.when(F.col("side") == 1, F.col(id_)), ignorenulls=True).over(w)).filter("side = 0").drop("side")


def not_in(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """SQL's NOT IN without a broadcast of the list: one look tells whether it holds a null (nothing passes) or nothing (all
    pass); otherwise an anti join, which a null key doesn't pass."""
    seen = listed.agg(F.count("*").alias("n"), F.count(key).alias("known")).first()
    if not seen["n"]:
        return rows
    if seen["known"] < seen["n"]:
        return rows.filter(F.lit(False))
    return rows.filter(F.col(key).isNotNull()).join(listed.select(key), key, "left_anti").select(*rows.columns)
