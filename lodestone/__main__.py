"""python -m lodestone parse PATH OUT: parses every file under PATH and writes the blocks as JSON."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from lodestone.sources import blocks


def main(args: list[str]) -> int:
    if len(args) != 3 or args[0] != "parse":
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    blocks.read_files(spark, args[1]).write.mode("overwrite").json(args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
