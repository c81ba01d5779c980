"""Files and texts to blocks as DataFrames; what fails comes back as rows of its own, never as an exception."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row, StructType

from . import modality as md
from . import parsers

SCHEMA = "id string, ordinal int, block_id string, type string, content string, structured string, section_path array<string>, content_hash string, location string, error string"
_ARROW = pa.schema([("id", pa.string()), ("ordinal", pa.int32()), *[(c, pa.string()) for c in ("block_id", "type", "content", "structured")], ("section_path", pa.list_(pa.string())), *[(c, pa.string()) for c in ("content_hash", "location", "error")]])


def _parse_schema(text: str) -> StructType:
    return StructType.fromDDL(text)


def _rows(source: str, kind: str | None, text: str | None, language: str = "") -> list[dict]:
    try:
        found = parsers.parse(source, kind or "text", text or "", language)
        return [{"id": source, **b} for b in found] or [{"id": source, "error": "no_extractable_text"}]
    except (ValueError, RecursionError) as e:
        return [{"id": source, "error": f"{type(e).__name__}: {e}"}]


def _yield(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in _ARROW.names} for r in rows], _ARROW)


def parsed(texts: DataFrame) -> DataFrame:
    """(id, modality, text[, language]) to blocks."""
    d = texts if "language" in texts.columns else texts.withColumn("language", F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100).to_pydict()
                yield _yield([r for x in zip(part["id"], part["modality"], part["text"], part["language"], strict=True) for r in _rows(*x)])

    return d.select("id", "modality", "text", "language").mapInArrow(run, SCHEMA)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file under a path to blocks: bounded reads, sniffed by content, Office files included. A too large file
    isn't read; it gives a row with its error. Spark's reader doesn't list empty ones."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fits = F.col("length").between(1, md.MOST_BYTES)
    files = every.filter(fits)
    reason = F.when(F.col("length") < 1, "Unreadable: the file is empty").otherwise(f"Unreadable: the file has more than {md.MOST_BYTES} bytes")
    refused = every.filter(~fits).select(*[(F.col("path") if f.name == "id" else reason if f.name == "error" else F.lit(None)).cast(f.dataType).alias(f.name) for f in _parse_schema(SCHEMA)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .office import OFFICE

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    kind, text = md.inspect(name, raw := data.as_py())
                    if kind in OFFICE:
                        b = parsers.Builder(name)
                        for event in OFFICE[kind](raw):
                            b.add(*event)
                        rows = [{"id": name, **x} for x in b.blocks]
                    else:
                        rows = _rows(name, kind, text, md.LANGUAGES.get(name.rpartition(".")[2].lower(), ""))
                except (ValueError, KeyError) as e:
                    rows = [{"id": name, "error": f"{type(e).__name__}: {e}"}]
                yield _yield(rows)

    return files.select("path", "content").mapInArrow(run, SCHEMA).unionByName(refused)


class ParseBlocks:
    """The SQL table function parse_blocks(source, modality, text)."""

    def eval(self, source: str, kind: str, text: str) -> Iterator[Row]:
        for r in _rows(source, kind, text):
            yield tuple(r.get(n) for n in _ARROW.names)


def register(spark: SparkSession) -> None:
    spark.udtf.register("parse_blocks", F.udtf(ParseBlocks, returnType=SCHEMA))
