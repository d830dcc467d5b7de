"""Helpers that the corpus operators share: working tables and word hashing."""

from __future__ import annotations

import functools
import math
import tempfile
import uuid
import weakref

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Tables that were written by the functions that are under way and tidy up, the innermost last
_open: list[list[DataFrame]] = []


def work_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one where that is unset and all runs on one machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="quern-")
    return _own_dir[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder, in a folder a value of `by`, and read again: cuts lineage, survives
    lost executors."""
    path = new_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return kept(df.sparkSession.read.schema(df.schema).parquet(path), path)


def kept(table: DataFrame, path: str) -> DataFrame:
    """table, known to lie under path, so that discard() and tidy() find its files."""
    _paths[table] = path
    if _open:
        _open[-1].append(table)
    return table


def discard(df: DataFrame) -> None:
    """Delete the files of a table as written() returned it, once nothing reads it any more."""
    spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(name: str):
    """Of a function that returns a DataFrame: its result is written, and the working tables that it wrote go."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **kwargs) -> DataFrame:
            _open.append([])
            try:
                made = f(*args, **kwargs)
                tables = _open[-1].copy()
                path = new_path(made.sparkSession, name)
                made.write.parquet(path)
            finally:
                _open.pop()
            result = kept(made.sparkSession.read.schema(made.schema).parquet(path), path)
            for table in tables:
                if table in _paths:
                    discard(table)
            return result

        return run

    return wrap


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered for up to `limit` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (two xor-shift and multiply rounds)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def whole(x: float, scale: int) -> int:
    """floor(scale * x) of a finite double, exact for a scale that is a power of two."""
    return math.floor(x * scale) if abs(x) < 1e290 else int(x) * scale


def order_key(n: int) -> bytes:
    """A whole number of any size as bytes that have its order: how many bytes its magnitude has, above or below a middle,
    then these, complemented below 0."""
    size = (abs(n).bit_length() + 7) // 8
    if n < 0:
        return (0x8000 - size).to_bytes(2, "big") + ((1 << 8 * size) - 1 + n).to_bytes(size, "big")
    return (0x8000 + size).to_bytes(2, "big") + n.to_bytes(size, "big")


def key_number(key: bytes) -> int:
    """The number whose order_key() it is."""
    size, n = int.from_bytes(key[:2], "big") - 0x8000, int.from_bytes(key[2:], "big")
    return n if size >= 0 else n + 1 - (1 << -8 * size)


def as_long(n: int) -> int:
    """n, or the nearest 64-bit number."""
    return max(-(1 << 63), min(n, (1 << 63) - 1))
