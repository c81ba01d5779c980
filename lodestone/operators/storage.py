"""Materialised intermediate tables, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = f"file:///tmp/lodestone-{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    """Deletes what this session wrote, through Hadoop's file system API, which also reaches remote stores."""
    for spark, path in _written:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder, deleted when the session's Python ends."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from Parquet: the lineage ends here."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: dict[tuple, object] = {}


def once(spark: SparkSession, path: str, name: str, make: Callable[[], Any]) -> Any:
    """make(), or what it gave before in this session for the same name and the same files, by their lengths and times, at path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files = tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)))
    key = (spark.sparkContext.applicationId, name, files)
    if key not in _made:
        _made[key] = make()
    return _made[key]
