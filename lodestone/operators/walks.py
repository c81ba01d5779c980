"""Walks over trees and graphs by recursive SQL: paths are carried along, so cycles are seen where they close.

For chains of unknown length there is relational.descendants, which doubles its steps; these walks are bounded in depth, and
tell how each of them ended. Results are stored tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialised


@contextmanager
def _views(spark: SparkSession, *frames: DataFrame) -> Iterator[list[str]]:
    """Temporary views, and recursion without a limit of rows (depth bounds it), for what runs inside."""
    names, key = [f"walk_{uuid.uuid4().hex}" for _ in frames], "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    for name, df in zip(names, frames, strict=True):
        df.createOrReplaceTempView(name)
    spark.conf.set(key, "-1")
    try:
        yield names
    finally:
        spark.conf.set(key, before)
        for name in names:
            spark.catalog.dropTempView(name)


def _walk(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """start, node, depth, path, cycle: every place that the walks from starts (node) upwards along edges (child, parent) come to. A node that is
    on its walk's path already ends it."""
    spark = edges.sparkSession
    with _views(spark, edges.select("child", "parent").filter("child IS NOT NULL AND parent IS NOT NULL").distinct(), starts.select("node").filter("node IS NOT NULL").distinct()) as (e, s):
        return materialised(
            spark.sql(f"""WITH RECURSIVE walk(start, node, depth, path, cycle) MAX RECURSION LEVEL {most + 2} AS (
              SELECT node, node, 0, array(node), false FROM {s}
              UNION ALL
              SELECT w.start, e.parent, w.depth + 1, array_append(w.path, e.parent), array_contains(w.path, e.parent)
              FROM walk w JOIN {e} e ON e.child = w.node WHERE NOT w.cycle AND w.depth < {most})
              SELECT * FROM walk"""),
            "walk",
        )


def ancestors(edges: DataFrame, starts: DataFrame, roots: DataFrame, most: int = 8) -> DataFrame:
    """start, node (the last one reached), depth, path, ended for a tree's walks: at a `root`; at an `orphan`, which has no parent but isn't
    among roots (node); at a `cycle`, whose node stands twice on the path; or at the `bound` of most steps.

    A start that is nobody's parent is on no path but its own, so its walk is its parent's, one step longer: only parents walk, each once
    however many children it has."""
    up = edges.select("child", "parent").filter("child IS NOT NULL AND parent IS NOT NULL").distinct()
    inner = up.select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    told = materialised(starts.select("node").filter("node IS NOT NULL").distinct().join(inner, "node", "left").select("node", F.coalesce("inner", F.lit(False)).alias("inner")), "walk-starts")
    leaves = told.filter(~F.col("inner")).select(F.col("node").alias("start"))
    stepped = leaves.join(up, leaves["start"] == up["child"], "left").select("start", F.col("parent").alias("over"))
    own = told.filter("inner").select("node")
    rows = _walk(up, stepped.select(F.col("over").alias("node")).union(own), most)
    order = F.struct("depth", "node")
    last = rows.groupBy("start").agg(F.max_by(F.struct("node", "depth", "path", "cycle"), order).alias("whole"), F.max_by(F.struct("node", "depth", "path", "cycle"), F.when(F.col("depth") < most, order)).alias("short"))
    over = stepped.join(last.select(F.col("start").alias("over"), "short.*"), "over", "left")
    alone = F.array("start")
    risen = over.select("start", F.coalesce("node", "start").alias("node"), F.coalesce(F.col("depth") + 1, F.lit(0)).alias("depth"), F.coalesce(F.concat(alone, "path"), alone).alias("path"), F.coalesce("cycle", F.lit(False)).alias("cycle"))
    risen = risen.groupBy("start").agg(F.max_by(F.struct("node", "depth", "path", "cycle"), order).alias("l")).select("start", "l.*")
    final = risen.union(last.join(own.select(F.col("node").alias("start")), "start", "left_semi").select("start", "whole.*"))
    more = up.select(F.col("child").alias("node")).distinct().withColumn("more", F.lit(True))
    root = roots.select("node").distinct().withColumn("root", F.lit(True))
    seen = final.join(more, "node", "left").join(root, "node", "left")
    ended = F.when(F.col("cycle"), "cycle").when(F.col("more"), "bound").when(F.col("root"), "root").otherwise("orphan")
    return seen.select("start", "node", "depth", "path", ended.alias("ended"))


def search_upwards(edges: DataFrame, starts: DataFrame, wanted: DataFrame, most_nodes: int = 64, most_depth: int = 8) -> DataFrame:
    """start, visited, found: breadth-first along all parents, nearest nodes first and of equal depth by name, until most_nodes were
    visited; found: whether one of wanted (node) was among them. A node counts once, where it is nearest.

    Each level is stored, its nodes once per start, without paths: what is nearer isn't entered again, and a start that has its most_nodes goes
    no farther, since what comes later stands behind them."""
    up = materialised(edges.select("child", "parent").filter("child IS NOT NULL AND parent IS NOT NULL").distinct(), "search-edges")
    seen = level = materialised(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).filter("node IS NOT NULL").distinct(), "search")
    for depth in range(1, most_depth + 1):
        full = seen.groupBy("start").agg(F.count("*").alias("n")).filter(F.col("n") >= most_nodes)
        on = level.join(full, "start", "left_anti") if depth > 1 else level
        next_ = on.join(up, on["node"] == up["child"]).select("start", F.col("parent").alias("node")).distinct()
        level = materialised(next_.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "search")
        if level.isEmpty():
            break
        seen = seen.union(level)
    order = Window.partitionBy("start").orderBy("depth", "node")
    near = seen.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most_nodes)
    hit = wanted.select("node").distinct().withColumn("hit", F.lit(True))
    return near.join(hit, "node", "left").groupBy("start").agg(F.count("*").alias("visited"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("found"))


def json_nodes(rows: DataFrame, key: str, text: str, deepest: int = 30) -> DataFrame:
    """key, path (a JSON pointer), depth, kind, leaf (its JSON text; null for what holds others) of every node of JSON texts, in the JVM: texts become
    variants, and each step of the recursion opens all objects and arrays of one depth. Texts that aren't JSON, or repeat a key, have no nodes; what
    lies deeper than `deepest` isn't opened, and stands as a leaf."""
    spark = rows.sparkSession
    step = "coalesce(replace(replace(x.key, '~', '~0'), '/', '~1'), cast(x.pos AS string))"
    with _views(spark, rows.select(F.col(key).alias("k"), F.try_parse_json(text).alias("v")).filter("v IS NOT NULL")) as (r,):
        return materialised(
            spark.sql(f"""WITH RECURSIVE t(k, path, v, depth) MAX RECURSION LEVEL {deepest + 2} AS (
              SELECT k, '', v, 0 FROM {r}
              UNION ALL
              SELECT t.k, t.path || '/' || {step}, x.value, t.depth + 1 FROM t, LATERAL variant_explode(t.v) x WHERE t.depth < {deepest})
              SELECT k AS `{key}`, path, depth, regexp_extract(schema_of_variant(v), '^([A-Z]+)', 1) AS kind,
                CASE WHEN depth >= {deepest} OR NOT (to_json(v) LIKE '{{_%}}' OR to_json(v) LIKE '[_%]') THEN to_json(v) END AS leaf FROM t"""),
            "json-nodes",
        )


#: A JSON text's strings.
_STRINGS = r'"(?:[^"\\]|\\.)*"'


def json_state(text: str | F.Column) -> F.Column:
    """Whether a JSON text may be read as variants: `missing`, `malformed` (or a key repeats), `inexact` (a number of more than 38 digits or with an
    exponent would change), otherwise `exact`. Numbers are looked at as they are written."""
    t = F.col(text) if isinstance(text, str) else text
    numerals = F.regexp_extract_all(F.regexp_replace(t, _STRINGS, '""'), F.lit(r"(-?[0-9][0-9.eE+-]*)"))
    lossy = F.exists(numerals, lambda x: x.rlike("[eE]") | (F.length(F.regexp_replace(x, "[^0-9]", "")) > 38))
    return F.when(t.isNull(), "missing").when(F.try_parse_json(t).isNull(), "malformed").when(lossy, "inexact").otherwise("exact")
