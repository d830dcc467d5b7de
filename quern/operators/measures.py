"""Aggregates: service metrics, detection quality, experiment summaries, feedback and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename


def percentile(values: Column, p: float) -> Column:
    """Lower nearest rank: the element at (n - 1) * p, cut to a whole number, of the sorted values. Gathers all
    values of a group; percentiles() doesn't."""
    a = F.array_sort(F.collect_list(values))
    return F.get(a, F.floor((F.size(a) - 1) * F.lit(p)).cast("int"))


def percentiles(df: DataFrame, key: str, value: str, ps: dict[str, float]) -> DataFrame:
    """percentile() of a numeric column by key for groups of any size: column name -> p. Null values don't count.

    Values are counted before they are gathered, first by bin, which rises with the value. A running sum over a
    key's bins tells the one that holds a rank, and only that bin's distinct values are summed up in turn."""
    v = F.col("value").cast("double")
    # NaN is sorted last, like in array_sort
    place = F.when(F.isnan(v), F.lit(1 << 40)).otherwise(F.floor(F.signum(v) * F.log1p(F.abs(v)) * 1024)).cast("long")
    place = F.when(F.abs(v) == float("inf"), F.when(v > 0, 1 << 39).otherwise(-1 << 39)).otherwise(place)
    counts = df.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count(value).alias("n")).withColumn("bin", place)
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(p).alias("p")) for i, p in enumerate(ps.values())])).alias("x")
    bins = counts.groupBy("key", "bin").agg(F.sum("n").alias("n"))
    whole, so_far = Window.partitionBy("key"), Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.where("bin is not null").select("key", "bin", "n", F.sum("n").over(so_far).alias("top"), F.sum("n").over(whole).alias("total"))
    rank = F.floor((F.col("total") - 1) * F.col("x.p"))
    picks = ranked.select("*", wanted).withColumn("rank", rank).where("rank < top and rank >= top - n").select(F.col("key").alias("p_key"), F.col("bin").alias("p_bin"), "x.no", (F.col("rank") - F.col("top") + F.col("n")).alias("rank"))
    # a key has one row a percentile
    inside = counts.join(picks, F.col("key").eqNullSafe(F.col("p_key")) & (F.col("bin") == F.col("p_bin")))
    upto = Window.partitionBy("key", "no").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    found = inside.withColumn("top", F.sum("n").over(upto)).where("rank < top and rank >= top - n")
    # keys without any value have a row of nulls
    rows = found.select("key", "no", "value").unionByName(bins.select("key").distinct(), allowMissingColumns=True)
    return rows.groupBy("key").agg(*[F.max(F.when(F.col("no") == i, F.col("value"))).alias(c) for i, c in enumerate(ps)]).withColumnRenamed("key", key)


def safe(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def metrics_summary(events: DataFrame) -> DataFrame:
    """Lifetime counters of analysis events."""
    hit, miss, stale = (F.count_if(F.col("cache_result") == x) for x in ("hit", "miss", "stale"))
    total = F.count("*")
    return events.agg(total.alias("analyses"), F.count_if(F.col("error") != "").alias("errors"), F.sum("finding_count").alias("findings"), hit.alias("hits"), miss.alias("misses"), safe(hit, hit + miss + stale).alias("hit_rate"), safe(F.sum("finding_count"), total).alias("avg_findings"))


def windowed(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Events less than that long before the last one."""
    last = events.agg(F.max("ts").alias("last"))
    return events.join(F.broadcast(last), F.col("ts") > F.col("last") - F.expr(f"interval {int(seconds)} seconds")).drop("last")


def match_case(tolerance: int = 5) -> Column:
    """Greedy matching of expected findings, in order, with the first actual one that fits and is free: of the columns
    expected and actual (arrays of structs) a struct of the actuals' numbers that are used, and of how many expected
    ones that must be found were missed. An empty level, the rule any, and the lines 0 to 0 fit everything; so does an
    actual without a line, as to lines."""

    def step(s: Column, e: Column) -> Column:
        fits = lambda a: ((e.level == "") | (e.level == a.level)) & ((e.rule_id == "any") | (e.rule_id == a.rule_id)) & (((e.lo == 0) & (e.hi == 0)) | a.line.isNull() | a.line.between(e.lo - tolerance, e.hi + tolerance)) & ~F.array_contains(s.used, a.no)
        first = F.try_element_at(F.filter("actual", fits), F.lit(1))
        used = F.when(first.isNotNull(), F.array_append(s.used, first.no)).otherwise(s.used)
        return F.struct(used.alias("used"), (s.missed + F.when(first.isNull() & e.must_find, 1).otherwise(0)).alias("missed"))

    return F.aggregate("expected", F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).alias("missed")), step)


def score_cases(cases: DataFrame, tolerance: int = 5) -> DataFrame:
    """cases: case_id, source (path of the file), expected (level, rule_id, lo, hi, must_find) and actual (no, level,
    rule_id, line, uri, confidence). Of each: tp, fp, fn (missed ones that must be found), hallucinations (unmatched
    ones in another file), precision, recall, f1, and mean confidence of matched and of unmatched ones (0 for none)."""
    c = cases.withColumn("m", match_case(tolerance))
    used = F.col("m.used")
    right, wrong = F.filter("actual", lambda a: F.array_contains(used, a.no)), F.filter("actual", lambda a: ~F.array_contains(used, a.no))
    name = basename(F.coalesce("source", F.lit("")))
    lost = F.filter(wrong, lambda a: (F.coalesce(a.uri, F.lit("")) != "") & (name != "") & ~a.uri.endswith(name))

    def sure(rows: Column) -> Column:
        given = F.filter(F.transform(rows, lambda a: a.confidence), lambda x: x.isNotNull())
        return safe(F.aggregate(given, F.lit(0.0), lambda s, x: s + x), F.size(given))

    tp = F.size(used)
    c = c.select("case_id", tp.alias("tp"), (F.size("actual") - tp).alias("fp"), F.col("m.missed").alias("fn"), F.size(lost).alias("hallucinations"), sure(right).alias("tp_conf"), sure(wrong).alias("fp_conf"))
    p, r = safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": p, "recall": r}).withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def score_total(scores: DataFrame, *keys: str) -> DataFrame:
    """Micro figures from totals, macro ones as means of cases, hallucinations by findings, and the mean confidence of
    cases' right findings less that of their wrong ones (cases with 0 don't count)."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    p, r = safe(tp, tp + fp), safe(tp, tp + fn)
    sure = lambda c: F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))
    return scores.groupBy(*keys).agg(p.alias("micro_precision"), r.alias("micro_recall"), safe(2 * p * r, p + r).alias("micro_f1"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), safe(F.sum("hallucinations"), tp + fp).alias("hallucination_rate"), (sure("tp_conf") - sure("fp_conf")).alias("calibration"))


def score_runs(scores: DataFrame, key: str) -> DataFrame:
    """Over repeated runs of a case: means of counts, rounded half away from zero, and mean and sample deviation (0 for
    one run) of precision, recall and f1."""
    rates = [f for c in ("precision", "recall", "f1") for f in (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))]
    return scores.groupBy(key).agg(F.count("*").alias("runs"), *[F.round(F.avg(c)).cast("long").alias(c) for c in ("tp", "fp", "fn", "hallucinations")], *rates)


def run_measures(findings: DataFrame, key: str = "run_id") -> DataFrame:
    """A row a run: findings by tier (none is comprehensive) and level, sure errors, mean confidence (none is 0)."""
    tier, n = F.coalesce("tier", F.lit("comprehensive")), F.count("*")
    levels = [F.count_if(F.col("level") == x).alias(f"{x}s") for x in ("error", "warning", "note")]
    return findings.groupBy(key).agg(n.alias("total"), F.count_if(tier == "comprehensive").alias("llm"), F.count_if(tier == "instant").alias("instant"), *levels, F.count_if((F.col("level") == "error") & (F.col("confidence") > 0.8)).alias("sure_errors"), safe(F.sum(F.coalesce("confidence", F.lit(0.0))), n).alias("avg_conf"))


def summarize(runs: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Mean and sample standard deviation (0 for one run) of each measure by key."""
    return runs.groupBy(key).agg(F.count("*").alias("runs"), *[f(m).alias(f"{m}_{n}") for m in measures for n, f in (("mean", F.avg), ("std", lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))))])


def deltas(summary: DataFrame, key: str, baseline: str, measures: list[str], absolute: tuple[str, ...] = ("avg_conf",)) -> DataFrame:
    """Change of each mean against the baseline's row in percent, 0 where that is 0; of the absolute ones the difference itself.
    The baseline goes."""
    base = summary.where(F.col(key) == baseline).select(*[F.col(f"{m}_mean").alias(f"b_{m}") for m in measures])
    pct = lambda m: F.col(f"{m}_mean") - F.col(f"b_{m}") if m in absolute else F.when(F.col(f"b_{m}") != 0, (F.col(f"{m}_mean") - F.col(f"b_{m}")) / F.col(f"b_{m}") * 100).otherwise(0.0)
    # one row at most
    return summary.where(F.col(key) != baseline).join(F.broadcast(base), F.lit(True)).select(key, *[pct(m).alias(f"{m}_diff" if m in absolute else f"{m}_pct") for m in measures])


def profiles(feedback: DataFrame) -> DataFrame:
    """Per team and rule: verdict counts, noise rate, mean confidences, and the threshold learnt from them."""
    n = feedback.groupBy("team", "rule_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("useful", "noise", "wrong")], F.avg(F.when(F.col("verdict") == "useful", F.col("confidence"))).alias("useful_conf"), F.avg(F.when(F.col("verdict") == "noise", F.col("confidence"))).alias("noise_conf"))
    return profile_measures(n)


def profile_measures(counts: DataFrame) -> DataFrame:
    """Counts of profiles with noise_rate, conf_calibration (mean confidence of useful findings less that of noise; 0 where either
    is 0 or missing) and suppress_below (mean confidence of noise where at least 70 % are noise; else 0)."""
    rate = safe(F.col("noise"), F.col("total"))
    useful, noise = (F.coalesce(c, F.lit(0.0)) for c in ("useful_conf", "noise_conf"))
    n = counts.withColumns({"noise_rate": rate, "conf_calibration": F.when((useful != 0) & (noise != 0), useful - noise).otherwise(0.0)})
    return n.withColumn("suppress_below", F.when((F.col("noise_rate") >= 0.7) & (noise > 0), noise).otherwise(0.0))


def cross_team(profile: DataFrame) -> DataFrame:
    return profile.groupBy("rule_id").agg(F.avg("noise_rate").alias("noise_rate"), F.count("*").alias("teams"), F.sum("total").alias("feedback"))


def changed_only(versions: DataFrame) -> DataFrame:
    """Versions of a uri whose content hash isn't the one before it."""
    w = Window.partitionBy("uri").orderBy("ts", "ord")
    return versions.withColumn("was", F.lag("hash").over(w)).where("was is null or was <> hash").drop("was")


def sessions(changes: DataFrame, key: str, gap: str) -> DataFrame:
    """Bursts of changes that end when nothing changes for the gap."""
    return changes.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("changes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("w")
