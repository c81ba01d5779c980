"""Recorded change feeds as data sources: pages of JSON, read in one go or as a stream whose offset is the page's number.

A page is a file NNNNNN.json with {"items": [{"id", "parent", "version", "hash", "removed", "at"}], "cursor": ...}. The
folder must be reachable from the driver and the executors under the same path; read_pages and stream_pages read any store.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "id string, parent string, version string, hash string, removed boolean, at timestamp, page int"


class Page(InputPartition):
    def __init__(self, path: str, number: int) -> None:
        self.path, self.number = path, number


def _pages(folder: str) -> list[Page]:
    found = sorted(glob.glob(os.path.join(folder, "[0-9]*.json")))
    return [Page(p, int(os.path.basename(p)[:-5])) for p in found]


def _rows(page: Page) -> Iterator[tuple]:
    from datetime import datetime

    with open(page.path, encoding="utf-8") as f:
        for x in json.load(f)["items"]:
            at = datetime.fromisoformat(x["at"])
            if at.tzinfo is None:
                raise ValueError("a time needs an offset")
            yield (x["id"], x.get("parent"), x.get("version"), x.get("hash"), bool(x.get("removed")), at, page.number)


class _Reader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[Page]:
        return _pages(self.folder)

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from _rows(partition) if partition is not None else ()


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"page": -1}

    def latestOffset(self) -> dict:
        return {"page": max([-1, *(p.number for p in _pages(self.folder))])}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [p for p in _pages(self.folder) if start["page"] < p.number <= end["page"]]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from _rows(partition)

    def commit(self, end: dict) -> None:
        """The checkpoint keeps the offset; pages stay where they are."""


class ChangeFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options["path"])

    def streamReader(self, schema: object) -> _Stream:
        return _Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangeFeed)


PAGE = "items array<struct<id:string,parent:string,version:string,hash:string,removed:boolean,at:string>>"


def _opened(pages: DataFrame) -> DataFrame:
    """A row for each item. A time without an offset is an error, as is a file that isn't a page."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("int")
    rows = pages.select(F.explode("items").alias("x"), number.alias("page")).select("x.*", "page")
    timed = F.when(F.col("at").rlike(r"(?:[+-]\d\d:?\d\d|Z)$"), F.to_timestamp("at")).otherwise(F.raise_error(F.lit("a time needs an offset")).cast("timestamp"))
    return rows.select("id", "parent", "version", "hash", F.coalesce("removed", F.lit(False)).alias("removed"), timed.alias("at"), "page")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows as the data source, through Spark's own file readers: the folder may be in any store that Spark reaches."""
    return _opened(spark.read.schema(PAGE).options(multiLine=True, mode="FAILFAST", pathGlobFilter="[0-9]*.json").json(folder))


def stream_pages(spark: SparkSession, folder: str, pages_a_batch: int = 16) -> DataFrame:
    """read_pages as a stream: its offsets are the files that were read, and a page is read once."""
    return _opened(spark.readStream.schema(PAGE).options(multiLine=True, mode="FAILFAST", pathGlobFilter="[0-9]*.json", maxFilesPerTrigger=pages_a_batch).json(folder))
