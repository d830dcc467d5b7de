"""Bursts of changes, all paths together: a burst ends when nothing has changed for a while."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def with_burst(changes: DataFrame, gap: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """changes (ts, path, ...) with burst, the time at which their burst began. A change belongs to the burst before it if that
    is at most the gap old; changes without a time are in none.

    Moments are first told apart within spans of time, side by side; then only the first and the last burst of each
    span are compared with those of the spans before and behind, a row a span in which anything happened. So one burst that
    goes on for ever isn't one task. A span is made longer than the gap if it isn't."""
    quiet, width = (F.unix_micros(F.lit("1970-01-01 00:00:00+00:00").cast("timestamp") + F.expr(f"interval {x}")) for x in (gap, span))
    width = F.greatest(width, quiet)
    at = changes.select(_micros(F.col("ts")).alias("at")).where("at is not null").distinct().withColumn("span", F.floor(F.col("at") / width))
    within = Window.partitionBy("span").orderBy("at")
    fresh = F.coalesce(F.col("at") - F.lag("at").over(within) > quiet, F.lit(True)).cast("int")
    marked = at.withColumn("fresh", fresh).withColumn("no", F.sum("fresh").over(within))
    pieces = marked.groupBy("span", "no").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    spans = pieces.groupBy("span").agg(F.max("no").alias("n"), F.min("first").alias("s_first"), F.max("last").alias("s_last"), F.max_by("first", "no").alias("last_begins"))
    # a row a span; the pieces of a span are told apart by now
    order = Window.orderBy("span")
    goes_on = F.coalesce(F.col("s_first") - F.lag("s_last").over(order) <= quiet, F.lit(False))
    begins = F.when((F.col("n") > 1) | ~F.col("goes_on"), F.col("last_begins"))
    spans = spans.withColumn("goes_on", goes_on).withColumn("end_began", F.last(begins, ignorenulls=True).over(order))
    spans = spans.withColumn("start_began", F.when(F.col("goes_on"), F.lag("end_began").over(order)))
    named = pieces.join(spans.select("span", "start_began"), "span").select("span", "no", F.when(F.col("no") == 1, F.coalesce("start_began", "first")).otherwise(F.col("first")).alias("began"))
    moments = marked.join(named, ["span", "no"]).select("at", F.timestamp_micros("began").alias("burst"))
    return changes.join(moments, _micros(F.col("ts")) == F.col("at"), "left").drop("at")


def bursts(changes: DataFrame, gap: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """Each burst's paths: (burst, path, changes, first_ts, last_ts), a row a burst and path. A burst of any size is as many rows as
    it has paths."""
    return with_burst(changes, gap, span).where("burst is not null").groupBy("burst", "path").agg(F.count("*").alias("changes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
