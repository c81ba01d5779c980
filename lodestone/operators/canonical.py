"""The canonical document: sections, relations, quality metrics and integrity rules, as DataFrames over blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import hashing
from lodestone.functions import text as tx


def sections(blocks: DataFrame) -> DataFrame:
    """id, path, parent, depth: every prefix of every section path once."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("section_path")), lambda n: F.slice("section_path", F.lit(1), n))
    rows = blocks.filter("error IS NULL AND size(section_path) > 0").select("id", F.explode(prefixes).alias("path")).distinct()
    n = F.size("path")
    return rows.select("id", "path", F.when(n > 1, F.slice("path", F.lit(1), n - 1)).alias("parent"), n.alias("depth"))


def relations(blocks: DataFrame) -> DataFrame:
    """id, source, target, relation: consecutive blocks, and captions (a paragraph right after a figure)."""
    w = Window.partitionBy("id").orderBy("ordinal")
    pairs = blocks.filter("error IS NULL").select("id", F.col("block_id").alias("source"), "type", F.lead("block_id").over(w).alias("target"), F.lead("type").over(w).alias("next")).filter("target IS NOT NULL")
    follows = pairs.select("id", "source", "target", F.lit("next").alias("relation"))
    return follows.union(pairs.filter("type = 'figure' AND next = 'paragraph'").select("id", F.col("target").alias("source"), F.col("source").alias("target"), F.lit("caption_of").alias("relation")))


def quality(blocks: DataFrame, most_garbled: float = 0.02, most_duplicates: float = 0.5) -> DataFrame:
    """id, metrics and the gates that failed."""
    body = ~F.col("type").isin("heading", "figure")
    text = F.col("content")
    found = blocks.groupBy("id").agg(
        F.count_if(F.col("error").isNotNull()).alias("errors"), (F.sum(tx.garbled_count(text)) / F.greatest(F.sum(F.length(text)), F.lit(1))).alias("garbled_ratio"),
        (1 - F.count_distinct(F.when(body, F.col("content_hash"))) / F.greatest(F.count(F.when(body, F.col("content_hash"))), F.lit(1))).alias("duplicate_rate"), F.sum(F.length(F.trim(text))).alias("chars"),
    )
    gates = F.array(F.when(F.coalesce("chars", F.lit(0)) == 0, "no_extractable_text"), F.when(F.col("garbled_ratio") > most_garbled, "garbled_text"), F.when(F.col("duplicate_rate") > most_duplicates, "excessive_repeated_content"), F.when(F.col("errors") > 0, "parse_error"))
    return found.withColumn("failures", F.filter(gates, lambda x: x.isNotNull())).withColumn("passed", F.size("failures") == 0)


def best_parse(parses: DataFrame) -> DataFrame:
    """Of several parsers' results (id, tier, priority, passed, ...) the first that passed, by tier and priority."""
    w = Window.partitionBy("id").orderBy(F.desc("passed"), "tier", "priority")
    return parses.withColumn("k", F.row_number().over(w)).filter("k = 1 AND passed").drop("k")


def _structured(name: str, kind: str) -> Column:
    return F.from_json(F.get_json_object("structured", f"$.{name}"), kind)


def _row_rules() -> dict[str, Column]:
    """Rules that a block keeps or breaks by itself; null counts as broken."""
    pair = F.to_json(F.array("type", "content"))
    digest = hashing.json_digest(F.concat(F.lit("["), pair.substr(F.lit(2), F.length(pair) - 2), F.lit(","), F.col("structured"), F.lit("]")))
    rows, headers = _structured("rows", "array<array<string>>"), _structured("headers", "array<string>")
    return {
        "content_is_text": (F.trim("content") != "") & ~F.contains("content", F.lit("\0")),
        "content_hash": digest == F.col("content_hash"),
        "rectangular_table": (F.col("type") != "table") | ((F.size(headers) > 0) & (F.size(rows) > 0) & ~F.exists(rows, lambda r: F.size(r) != F.size(headers))),
        "code_has_language": (F.col("type") != "code") | (F.get_json_object("structured", "$.language") != ""),
        "figure_has_asset": (F.col("type") != "figure") | (F.length(F.get_json_object("structured", "$.asset_id")) > 0) | (F.length(F.get_json_object("structured", "$.reference")) > 0),
    }


def broken(rows: DataFrame, rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, all in one pass; a rule that can't be decided is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(keeps, F.lit(False)), F.lit(name)) for name, keeps in rules.items()]))


def violations(blocks: DataFrame, relations_: DataFrame) -> DataFrame:
    """rule, id: what breaks the canonical contract. Rules of single blocks are checked in one pass, those of a document's blocks by one grouping."""
    good = blocks.filter("error IS NULL")
    single = good.select("id", F.explode(broken(good, _row_rules())).alias("rule"))
    per = good.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("block_id").alias("ids"), F.count_distinct("ordinal").alias("places"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    group = {"unique_block_id": F.col("n") == F.col("ids"), "ordinals_without_gaps": (F.col("places") == F.col("n")) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1)}
    grouped = per.select("id", F.explode(broken(per, group)).alias("rule"))
    ends = relations_.select("id", F.explode(F.array("source", "target")).alias("block_id"))
    loose = ends.join(good.select("id", "block_id"), ["id", "block_id"], "left_anti").select("id", F.lit("relation_resolves").alias("rule"))
    return single.unionByName(grouped).unionByName(loose).select("rule", "id").distinct()


def served(rows: DataFrame, key: str, rules: dict[str, Column], fingerprints: DataFrame | None = None, fingerprint: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """(what may be served, what is quarantined with `broken`: its rules' names). A key is served if none of its rows breaks a rule and, where
    fingerprints (key, fingerprint) are given, the rows were made from the stored one: a stale or unknown fingerprint fails closed."""
    told = rows.withColumn("__broken", broken(rows, rules))
    if fingerprints is not None:
        now = fingerprints.select(key, F.col(fingerprint).alias("__now"))
        told = told.join(now, key, "left")
        stale = F.when(F.coalesce(F.col(fingerprint) == F.col("__now"), F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("stale_fingerprint")))
        told = told.withColumn("__broken", F.concat("__broken", stale)).drop("__now")
    bad = told.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("__broken")))).alias("broken")).filter(F.size("broken") > 0)
    return rows.join(bad.select(key), key, "left_anti"), rows.join(bad, key)
