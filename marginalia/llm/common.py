"""Helpers the corpus operators share: saved tables, bounded samples, union-find."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators.ranking import ready_checkpoints

#: ASCII white space; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables written to the shared checkpoint folder, so that a lost executor loses no rows.

    ``save`` writes and rereads a table; ``drop`` removes those that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ready_checkpoints(spark)}/llm-{uuid.uuid4().hex}"
        self.made: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.made.pop(id(df), None)
        if path is None:
            return
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def crc_of_id(id_column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")))


def drawn(share: float | Column, *by: str | Column, seed: int = 7) -> Column:
    """True for about ``share`` of the rows, by a hash of ``by``: the same rows for any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 40)) < F.lit(float(1 << 40)) * share


def sampled(df: DataFrame, rows: int, bound: int, *by: str | Column, seed: int = 7) -> DataFrame:
    """About ``bound`` of the ``rows`` rows of ``df``, drawn row by row by a hash of ``by``."""
    return df if rows <= bound else df.where(drawn(bound / rows, *by, seed=seed))


def with_field(schema: T.StructType, *more: tuple[str, T.DataType], leave: str = "_text") -> T.StructType:
    """``schema`` without the column ``leave`` and with some more, whatever its columns are called."""
    kept = [f for f in schema if f.name != leave]
    return T.StructType([*kept, *[T.StructField(n, k) for n, k in more]])


def tidy(task: Callable) -> Callable:
    """An Arrow task that gives its free memory back when it ends, as workers serve many tasks."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()

    return run


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


class Forest:
    """Union-find over 0..n-1 that keeps only the links that join two groups."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def _root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def _flatten(self) -> None:
        while True:
            above = self.parent[self.parent]
            if np.array_equal(above, self.parent):
                return
            self.parent = above

    def link(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Join the pairs; returns those that were needed."""
        kept: list[tuple[int, int]] = []
        while len(a):
            self._flatten()
            a, b = self._apart(a, b)
            if not len(a):
                break
            # One pair for each group at a time: most of the others are inside by then.
            _, first = np.unique(self.parent[a], return_index=True)
            for i, j in zip(a[first].tolist(), b[first].tolist()):
                ri, rj = self._root(i), self._root(j)
                if ri != rj:
                    self.parent[max(ri, rj)] = min(ri, rj)
                    kept.append((i, j))
        return kept

    def _apart(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = self.parent[a] != self.parent[b]
        return a[apart], b[apart]
