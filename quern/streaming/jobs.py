"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A stream of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _timed(df: DataFrame, late: str) -> DataFrame:
    """With a watermark on ts, which may lack a time zone in the files."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def debounce(changes: DataFrame, key: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of changes of a key, each emitted once it has been quiet for the gap (append mode)."""
    windows = _timed(changes, late).groupBy(key, F.session_window("ts", gap).alias("w"))
    return windows.agg(F.count("*").alias("changes")).select(key, F.col("w.start").alias("first_ts"), F.col("w.end").alias("closes"), "changes")


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return _timed(events, late).groupBy(F.window("ts", "1 hour").alias("w"), "tier").agg(F.count("*").alias("n"), F.avg("ms").alias("avg_ms")).select(F.col("w.start").alias("hour"), "tier", "n", "avg_ms")


def sliding(events: DataFrame, length: str = "1 hour", step: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Figures of the last hour, anew every five minutes."""
    windows = _timed(events, late).groupBy(F.window("ts", length, step).alias("w"), "tier")
    return windows.agg(F.count("*").alias("n"), F.avg("ms").alias("avg_ms")).select(F.col("w.end").alias("until"), "tier", "n", "avg_ms")


def _changed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    for pdf in batches:
        pdf = pdf.sort_values(["ts", "ord"], kind="stable")
        was = pdf["hash"].shift().astype(object)
        was.iloc[0] = last
        last = pdf["hash"].iloc[-1]
        yield pdf[pdf["hash"] != was][["ord", "uri", "hash"]]
    state.update((last,))


def changed_only(versions: DataFrame) -> DataFrame:
    """Versions of a uri whose hash differs from the one before; the last hash of a uri is the state.

    Batches must bring a uri's versions in order of time."""
    return versions.select("ord", "uri", "hash", "ts").groupBy("uri").applyInPandasWithState(_changed, "ord long, uri string, hash string", "hash string", "append", GroupStateTimeout.NoTimeout)


def profiles(feedback: DataFrame) -> DataFrame:
    """Running verdict counts by team and rule (update or complete mode)."""
    return feedback.groupBy("team", "rule_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("useful", "noise", "wrong")])


def ingest(events: DataFrame, out: str, checkpoint: str, valid: Callable[[DataFrame], DataFrame] = lambda d: d):
    """Append valid events to a folder, each input file once."""
    return valid(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
