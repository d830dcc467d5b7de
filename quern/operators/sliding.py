"""Figures of the last hour from partial ones by minute, and all figures of a service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .measures import safe

SUMS = ("n", "errors", "findings", "ms", "queue_ms", "total_ms", "tokens_in", "tokens_out", "hits", "misses", "stale")
PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _sums() -> dict[str, Column]:
    said = {"n": F.count("*"), "errors": F.count_if(F.col("error") != ""), "findings": F.sum("finding_count")}
    said |= {c: F.sum(c) for c in ("ms", "queue_ms", "total_ms", "tokens_in", "tokens_out")}
    return said | {c: F.count_if(F.col("cache_result") == v) for c, v in (("hits", "hit"), ("misses", "miss"), ("stale", "stale"))}


def minute_sums(events: DataFrame) -> DataFrame:
    """(minute, tier, sums, max_ms): what events (ts, tier, error, finding_count, ms, queue_ms, total_ms, tokens_in, tokens_out,
    cache_result) of a minute and tier add up to. Rows of other batches may be added to them."""
    return events.groupBy(F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("minute"), "tier").agg(*[f.alias(c) for c, f in _sums().items()], F.max("ms").alias("max_ms"))


def minute_counts(events: DataFrame) -> DataFrame:
    """(minute, ms, n): how often each duration came up in a minute. Counts add up, and percentiles of any span follow exactly."""
    return events.where("ms is not null").groupBy(F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("minute"), "ms").agg(F.count("*").alias("n"))


def _steps(minute: Column, length: int, step: int) -> Column:
    """The ends of the windows that a minute falls into: every `step` minutes, over the `length` minutes before."""
    first = F.floor(F.unix_seconds(minute) / (60 * step)) + 1
    # windows end behind the minute, and begin before it or with it
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(length // step - 1)), lambda i: F.timestamp_seconds((first + i) * (60 * step))))


def ranked(counts: DataFrame, key: str, ps: dict[str, float]) -> DataFrame:
    """Lower nearest ranks of values by key from (key, ms, n): the value at (total - 1) * p, cut to a whole number."""
    up_to, whole = Window.partitionBy(key).orderBy("ms").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key)
    rows = counts.groupBy(key, "ms").agg(F.sum("n").alias("n")).select(key, "ms", "n", F.sum("n").over(up_to).alias("top"), F.sum("n").over(whole).alias("total"))
    at = lambda p: F.floor((F.col("total") - 1) * F.lit(p))
    return rows.groupBy(key).agg(*[F.max(F.when((at(p) < F.col("top")) & (at(p) >= F.col("top") - F.col("n")), F.col("ms"))).alias(c) for c, p in ps.items()])


def last_hours(sums: DataFrame, counts: DataFrame, length: int = 60, step: int = 5) -> DataFrame:
    """Every `step` minutes the figures of the `length` minutes before, from minute_sums() and minute_counts(), of which there may
    be several rows a minute: until, the sums, means, percentiles, max_ms, hit_rate, and rates a minute. Windows without any
    event are left out. Each minute goes into length / step windows, whatever its number of events."""
    if length % step:
        raise ValueError("the step must divide the length")
    whole = sums.withColumn("until", _steps(F.col("minute"), length, step)).groupBy("until").agg(*[F.sum(c).alias(c) for c in SUMS], F.max("max_ms").alias("max_ms"))
    places = ranked(counts.select(_steps(F.col("minute"), length, step).alias("until"), "ms", "n"), "until", PERCENTILES).withColumnRenamed("until", "p_until")
    out = whole.join(places, F.col("until") == F.col("p_until"), "left").drop("p_until")
    return _rates(out, F.lit(float(length)))


def _rates(out: DataFrame, minutes: Column) -> DataFrame:
    n = F.col("n")
    mean = {f"avg_{c}": safe(F.col(c), n) for c in ("ms", "queue_ms", "total_ms", "tokens_in", "tokens_out")}
    return out.withColumns(mean | {"hit_rate": safe(F.col("hits"), F.col("hits") + F.col("misses") + F.col("stale")), "findings_per_analysis": safe(F.col("findings"), n), "per_minute": safe(n, minutes)})


def service_stats(events: DataFrame, length: int = 60) -> tuple[DataFrame, DataFrame]:
    """All figures of a service as of its last event: (one row, a row a tier). The row has lifetime sums, averages and rates a minute
    (since the first event), and w_ figures of the last `length` minutes: n, means, percentiles, max. Tiers are those
    of that window. Without events the row has zeros and there are no tiers. Durations are gathered by value, not by event."""
    ts = F.col("ts").cast("timestamp")
    life = events.agg(*[F.coalesce(f, F.lit(0)).alias(c) for c, f in _sums().items()], F.min(ts).alias("since"), F.max(ts).alias("until"))
    minutes = (F.unix_micros("until") - F.unix_micros("since")) / 60e6
    life = _rates(life, F.coalesce(minutes, F.lit(0.0))).drop("avg_ms", "avg_queue_ms", "avg_total_ms", "ms", "queue_ms", "total_ms")
    # one row
    recent = events.join(F.broadcast(life.select(F.col("until").alias("now"))), ts > F.col("now") - F.expr(f"interval {int(length)} minutes"))
    sums = recent.agg(F.count("*").alias("w_n"), *[F.avg(c).alias(f"w_avg_{c}") for c in ("ms", "queue_ms", "total_ms")], F.max("ms").alias("w_max_ms"))
    counts = recent.where("ms is not null").groupBy(F.lit(0).alias("all"), "ms").agg(F.count("*").alias("n"))
    places = ranked(counts, "all", {f"w_{c}": p for c, p in PERCENTILES.items()})
    row = life.join(F.broadcast(sums), F.lit(True)).join(F.broadcast(places), F.lit(True), "left").drop("all")
    tiers = recent.groupBy("tier").agg(F.count("*").alias("n"), F.avg("ms").alias("avg_ms"), safe(F.count_if(F.col("error") != ""), F.count("*")).alias("error_rate"))
    return row, tiers


def report(row: DataFrame, tiers: DataFrame) -> DataFrame:
    """service_stats() as a plain report: (place, text), a line a row, tiers last and by name."""
    number = lambda label, c, form="%d": F.format_string(f"%-20s{form}", F.lit(label), c)
    col, pct = F.col, lambda a, b: safe(100.0 * a, b)
    millis = lambda c: F.coalesce(col(c).cast("double"), F.lit(0.0))
    lines = [
        F.lit("=== Summary ==="), number("Total Analyses:", col("n")), F.format_string("%-20s%d (%.1f%%)", F.lit("Total Errors:"), col("errors"), pct(col("errors"), col("n"))), number("Total Findings:", col("findings")), number("Findings/Analysis:", col("findings_per_analysis"), "%.2f"),
        F.lit("=== Latency ==="), *[number(a, millis(c), "%.0fms") for a, c in (("Average:", "w_avg_ms"), ("P50:", "w_p50"), ("P95:", "w_p95"), ("P99:", "w_p99"), ("Max:", "w_max_ms"), ("Avg Queue:", "w_avg_queue_ms"), ("Avg Total:", "w_avg_total_ms"))],
        F.lit("=== Cache ==="), number("Hits:", col("hits")), number("Misses:", col("misses")), number("Stale:", col("stale")), number("Hit Rate:", 100 * col("hit_rate"), "%.1f%%"),
        F.lit("=== Throughput ==="), number("Analyses/min:", col("per_minute"), "%.2f"),
        F.lit("=== Tokens ==="), number("Total In:", col("tokens_in")), number("Total Out:", col("tokens_out")), number("Avg In:", col("avg_tokens_in"), "%.0f"), number("Avg Out:", col("avg_tokens_out"), "%.0f"),
    ]
    head = row.select(F.posexplode(F.array(*lines)).alias("place", "text"))
    own = F.format_string("%s: Count: %d, Avg Latency: %.0fms, Error Rate: %.1f%%", F.coalesce("tier", F.lit("")), "n", millis("avg_ms"), 100 * F.col("error_rate"))
    return head.unionByName(tiers.select((F.lit(100) + F.row_number().over(Window.orderBy("tier"))).alias("place"), own.alias("text")))


def stats_json(row: DataFrame, tiers: DataFrame) -> DataFrame:
    """service_stats() as one JSON text; tiers are few."""
    by_tier = tiers.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("tier", F.lit("")).alias("tier"), F.struct("n", "avg_ms", "error_rate"))))).alias("by_tier"))
    return row.join(F.broadcast(by_tier), F.lit(True)).select(F.to_json(F.struct(*row.columns, "by_tier")).alias("json"))
