"""Digests of files of any size, read as byte ranges by many tasks."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes in one range, in one read, and digests that one digest combines.
RANGE, PIECE, FAN_IN = 64 << 20, 1 << 20, 4096


class FileRange(InputPartition):
    def __init__(self, path: str, size: int, number: int, start: int, length: int):
        self.path, self.size, self.number, self.start, self.length = path, size, number, start, length


class RangeReader(DataSourceReader):
    """Each partition is one range of one file of a folder (or pattern) that all executors see."""

    def __init__(self, options: dict):
        self.path, self.width = options["path"].removeprefix("file:"), int(options.get("range", RANGE))

    def partitions(self) -> list[FileRange]:
        # Names and sizes only: the contents are read by the tasks.
        found = sorted(glob.glob(os.path.join(self.path, "*") if os.path.isdir(self.path) else self.path))
        out = []
        for name in found:
            if os.path.isfile(name):
                size = os.path.getsize(name)
                starts = range(0, max(size, 1), self.width)
                out += [FileRange(name, size, i, s, min(self.width, size - s)) for i, s in enumerate(starts)]
        return out

    def read(self, partition: FileRange) -> Iterator[tuple]:
        digest, left = sha256(), partition.length
        with open(partition.path, "rb") as held:
            held.seek(partition.start)
            while left > 0:
                piece = held.read(min(PIECE, left))
                if not piece:
                    raise OSError(f"{partition.path} ends before byte {partition.start + partition.length}")
                digest.update(piece)
                left -= len(piece)
        yield os.path.basename(partition.path), partition.size, partition.number, digest.hexdigest()


class FileRanges(DataSource):
    """``spark.read.format("file_ranges").option("path", ...).option("range", bytes)``."""

    @classmethod
    def name(cls) -> str:
        return "file_ranges"

    def schema(self) -> str:
        return "file string, bytes bigint, number bigint, sha256 string"

    def reader(self, schema: object) -> DataSourceReader:
        return RangeReader(self.options)


def range_fingerprint(spark: SparkSession, path: str, width: int = RANGE) -> DataFrame:
    """``file, sha256, bytes, ranges`` of every file at ``path``, whatever its size.

    A file of one range has the digest of its bytes. One of more has the digest of the joined
    digests of its ranges in order, ``FAN_IN`` of them at a time and level upon level, so it depends
    on ``width`` but not on tasks, and no task reads more than a range or joins more than ``FAN_IN``.
    """
    spark.dataSource.register(FileRanges)
    node = spark.read.format("file_ranges").option("path", path).option("range", width).load()
    node = node.withColumn("ranges", F.lit(1).cast("long")).withColumn("alone", F.col("bytes") <= width)
    most = max((p.number for p in RangeReader({"path": path, "range": width}).partitions()), default=0) + 1
    while most > 1:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "sha256"))), lambda x: x["sha256"]), ",")
        node = node.groupBy("file", "bytes", "alone", F.expr(f"number div {FAN_IN}").alias("number")).agg(
            F.when(F.first("alone"), F.first("sha256")).otherwise(F.sha2(joined, 256)).alias("sha256"), F.sum("ranges").alias("ranges")
        )
        most = -(-most // FAN_IN)
    return node.select("file", "sha256", "bytes", "ranges")
