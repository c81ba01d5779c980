"""Incremental maintenance: snapshots in, snapshots out. Every function is a pure old + delta -> new DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """keys, state: added, removed, changed or unchanged."""
    o = old.select(*keys, F.col(fingerprint).alias("before"), F.lit(True).alias("was"))
    n = new.select(*keys, F.col(fingerprint).alias("after"), F.lit(True).alias("now"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("changed")
    return o.join(n, keys, "full").select(*keys, state.alias("state"))


def newer_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert, or do nothing on conflict; of rows new to each other with one key, any one is inserted."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def swept(old: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a complete scan didn't see: the tombstones."""
    return old.join(seen.select(*keys), keys, "left_anti")


def tombstoned(old: DataFrame, gone: DataFrame, keys: list[str], at: str) -> DataFrame:
    flag = gone.select(*keys).distinct().withColumn("gone", F.lit(True))
    marked = old.join(flag, keys, "left")
    return marked.withColumn("removed_at", F.when(F.col("gone"), F.coalesce("removed_at", F.lit(at).cast("timestamp"))).otherwise(F.col("removed_at"))).drop("gone").select(*old.columns)


def delete_cascade(parents: DataFrame, gone: DataFrame, keys: list[str], *children: DataFrame) -> tuple[DataFrame, ...]:
    """Parents and children without the rows that go."""
    g = gone.select(*keys)
    return tuple(t.join(g, keys, "left_anti") for t in (parents, *children))


def replace_group(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete and insert by group: the groups of new take the place of their old rows."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def update_where(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()}).select(*table.columns)


def fenced_update(table: DataFrame, updates: DataFrame, key: str, token: str) -> DataFrame:
    """Updates that carry the row's current run token take effect; stale workers' don't."""
    good = updates.join(table.select(key, token), [key, token], "left_semi")
    return newer_wins(table, good.select(*table.columns), [key])


def reassign_preview(table: DataFrame, owner: str, of: str, to: str, fingerprint: str) -> DataFrame:
    """rows_to_move, conflicts: a reassignment is refused while a fingerprint collides."""
    taken = table.filter(F.col(owner) == to).select(fingerprint).distinct().withColumn("taken", F.lit(1))
    return table.filter(F.col(owner) == of).join(taken, fingerprint, "left").agg(F.count("*").alias("rows_to_move"), F.count("taken").alias("conflicts"))


def reassign(table: DataFrame, owner: str, of: str, to: str, fingerprint: str) -> DataFrame:
    if n := reassign_preview(table, owner, of, to, fingerprint).first()["conflicts"]:
        raise ValueError(f"{n} rows collide with {to}'s")
    return update_where(table, F.col(owner) == of, **{owner: F.lit(to)})


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*")


def coalesce_jobs(requests: DataFrame, key: str, full: Column) -> DataFrame:
    """One pending job per key; a full request upgrades it."""
    return requests.groupBy(key).agg(F.count("*").alias("n"), F.bool_or(full).alias("full"))


def renewed(table: DataFrame, scanned: DataFrame, keys: list[str], until: str) -> DataFrame:
    """Leases are renewed for what a clean scan saw, and for nothing else."""
    seen = scanned.select(*keys).distinct().withColumn("seen", F.lit(True))
    out = table.join(seen, keys, "left")
    return out.withColumn("access_expires_at", F.when(F.col("seen"), F.lit(until).cast("timestamp")).otherwise(F.col("access_expires_at"))).select(*table.columns)


def expired(table: DataFrame, as_of: str, column: str = "valid_until") -> DataFrame:
    return table.filter(F.col(column) <= F.lit(as_of).cast("timestamp"))


def appended(trail: DataFrame | None, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """An append-only trail with seq from 1 on within keys: new rows go on from the last number; old ones never change."""
    numbered = new.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    if trail is None:
        return numbered
    last = trail.groupBy(*keys).agg(F.max("seq").alias("last_"))
    later = numbered.join(last, keys, "left").withColumn("seq", F.col("seq") + F.coalesce("last_", F.lit(0))).drop("last_")
    return trail.unionByName(later)
