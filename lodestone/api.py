"""The library's calls: register, parse, index, search and answer, over tables in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import answers, incremental, passages, storage
from lodestone.operators.answers import Answer, Request, Viewer
from lodestone.operators.index import Index
from lodestone.sources import blocks


class Workspace:
    """Tables (sources, blocks, passages) as immutable snapshots: every change writes a new one and returns it."""

    def __init__(self, spark: SparkSession, accounts: DataFrame | None = None) -> None:
        """accounts: account, owner, status, authentication of the connected services that sources may come from."""
        self.spark, self.accounts = spark, accounts
        self.sources: DataFrame | None = None
        self.blocks: DataFrame | None = None
        self.passages: DataFrame | None = None
        self.lexical: Index | None = None

    def register(self, new: DataFrame) -> DataFrame:
        """Sources (id, project, modality, text, is_active; if there is one, owner). Of an owner's sources of one project with equal content the one with the smallest
        id is kept, and none where one is known already; others' sources with the same content are theirs. A null text is like no other."""
        rows = new if "owner" in new.columns else new.withColumn("owner", F.lit("local"))
        rows = rows.withColumn("file_hash", F.coalesce(F.sha2("text", 256), F.sha2(F.concat(F.lit("null:"), F.col("id")), 256)))
        key = ["owner", "project", "file_hash"]
        rest = [c for c in rows.columns if c not in (*key, "id")]
        first = rows.groupBy(*key).agg(F.min_by(F.struct("id", *rest), "id").alias("r")).select(*key, "r.*").select(*rows.columns)
        self.sources = first if self.sources is None else self.sources.unionByName(first.join(self.sources.select(*key), (first["owner"].eqNullSafe(self.sources["owner"])) & (first["project"].eqNullSafe(self.sources["project"])) & (first["file_hash"] == self.sources["file_hash"]), "left_anti"))
        return self.sources

    def index(self, path: str | None = None) -> DataFrame:
        """Parses and packs sources whose content isn't indexed yet, drops passages of sources that went, and brings the stored index up to
        date: built the first time, in a folder of the session if no path is given, by a delta segment later."""
        if self.sources is None:
            raise ValueError("nothing is registered")
        todo = self.sources.filter("is_active")
        kept = gone = None
        if self.passages is not None:
            kept = self.passages.join(todo.select("id", "file_hash"), ["id", "file_hash"], "left_semi")
            gone = self.passages.join(todo.select("id", "file_hash"), ["id", "file_hash"], "left_anti").select(answers.document_number().alias("doc_id")).distinct()
            todo = todo.join(self.passages.select("id", "file_hash").distinct(), ["id", "file_hash"], "left_anti")
        made = storage.materialised(blocks.parsed(todo), "blocks")
        self.blocks = made if self.blocks is None else incremental.replace_group(self.blocks, made, "id")
        new = storage.materialised(passages.packed(made).filter("error IS NULL").join(todo.select("id", "project", "file_hash"), "id"), "passages")
        self.passages = new if kept is None else kept.unionByName(new)
        if self.lexical is None:
            self.lexical = answers.indexed(self.passages, path or storage.fresh_path(self.spark, "passage-index"))
        else:
            self.lexical = self.lexical.update(answers.for_index(new), gone)
        return self.passages

    def set_active(self, source: str, active: bool) -> DataFrame:
        self.sources = incremental.update_where(self.sources, F.col("id") == source, is_active=F.lit(active))
        return self.sources

    def remove_index(self, source: str) -> DataFrame:
        self.passages = self.passages.filter(F.col("id") != source)
        if self.lexical is not None:
            gone = self.spark.createDataFrame([(source,)], "id string").select(answers.document_number().alias("doc_id"))
            self.lexical = self.lexical.update(answers.for_index(self.passages.limit(0)), gone)
        return self.passages

    def _open(self, viewer: Viewer) -> DataFrame:
        """The passages of what the viewer may read, made from its present content. A source without columns for status, lease or account is
        parsed, never ends and was uploaded."""
        missing = {"status": F.lit("parsed"), "access_expires_at": F.lit(None).cast("timestamp"), "account": F.lit(None).cast("string")}
        sources = self.sources.withColumns({c: v for c, v in missing.items() if c not in self.sources.columns})
        accounts = self.spark.createDataFrame([], "account string, owner string, status string, authentication string") if self.accounts is None else self.accounts
        return self.passages.join(answers.readable(sources, accounts, viewer).select("id", "file_hash"), ["id", "file_hash"], "left_semi")

    def search(self, request: Request, viewer: Viewer = Viewer("local")) -> list[dict]:
        return answers.chosen(answers.retrieve(self._open(viewer), request, index=self.lexical)[0], request)

    def answer(self, request: Request, claims: list[dict] | None = None, viewer: Viewer = Viewer("local"), **vectors: object) -> Answer:
        """vectors: embeddings (passage_id, embedding) and query_vector, for hybrid retrieval. What may be read is decided before
        retrieval and once more before the answer."""
        return answers.answer(self._open(viewer), request, claims, lambda: self._open(viewer), index=self.lexical, **vectors)
