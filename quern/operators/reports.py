"""Overlays, caches, diffs and reports around the findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL_PRIORITY = {"error": 0, "warning": 1, "note": 2}


def priority(level: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LEVEL_PRIORITY.items() for x in kv])
    return F.coalesce(F.try_element_at(known, level), F.lit(3))


def overlay(layers: DataFrame, key: str, layer: str) -> DataFrame:
    """Of the rows with the same key the one of the highest layer, whole; of equal layers the one whose JSON is last."""
    last = Window.partitionBy(key).orderBy(F.desc(layer), F.to_json(F.struct(*layers.columns)).desc())
    return layers.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


def policy_overlay(layers: DataFrame, texts: list[str]) -> DataFrame:
    """Policies (name, layer, texts, enabled) laid over each other field by field: the highest layer whose text
    isn't empty gives it. A true `enabled` switches on; a false one counts only in a row without any text."""
    bare = F.lit(True)
    for c in texts:
        bare = bare & (F.coalesce(c, F.lit("")) == "")
    says = F.when(F.col("enabled") | bare, F.struct("layer", "enabled"))
    merged = [F.max(F.when(F.coalesce(c, F.lit("")) != "", F.struct("layer", F.col(c).alias("v"))))["v"].alias(c) for c in texts]
    out = layers.groupBy("name").agg(*merged, F.coalesce(F.max(says)["enabled"], F.lit(False)).alias("enabled"))
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})


def policy_text(policies: DataFrame, key: str) -> DataFrame:
    """A line for each enabled policy (name, severity, instruction), by name."""
    line = F.concat(F.lit("- "), "name", F.lit(" ["), "severity", F.lit("]: "), "instruction", F.lit("\n"))
    return policies.where("enabled").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))).alias("x")).select(key, F.array_join("x.line", "").alias("text"))


def diff_stats(diffs: DataFrame) -> DataFrame:
    """Per diff file (diff_id, path, content): lines added and removed inside hunks, the kind of change, and
    whether its diff may move code: two files or more, one that only removes and one that adds."""
    lines = F.split("content", "\n")
    first = F.array_position(F.transform(lines, lambda x: x.startswith("@@")), True)
    inside = F.when(first > 0, F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    count = lambda sign: F.size(F.filter(inside, lambda x: x.startswith(sign)))
    n = diffs.select("diff_id", "path", count("+").alias("added"), count("-").alias("removed"))
    kind = F.when((F.col("added") > 0) & (F.col("removed") > 0), "mixed").when(F.col("added") > 0, "add-only").when(F.col("removed") > 0, "remove-only").otherwise("none")
    n = n.withColumn("kind", kind)
    of_diff = n.groupBy("diff_id").agg(((F.count("*") >= 2) & F.bool_or(F.col("kind") == "remove-only") & F.bool_or(F.col("kind").isin("add-only", "mixed"))).alias("movement"))
    return n.join(of_diff, "diff_id")


def context_budget(files: DataFrame, key: str, order: str, file_bytes: int = 64 << 10, total_bytes: int = 256 << 10) -> DataFrame:
    """Files (content, ...) of a key in order, each counted up to file_bytes, until the first that would bring
    the sum over total_bytes; that one and all after it stay out. Orders that are equal count together.

    A key's budget ends within its first total_bytes + 1 files that hold anything, so only these are put in order; the rest
    is compared with where it ends."""
    size = F.least(F.octet_length("content"), F.lit(file_bytes)).cast("long")
    sized = files.withColumn("taken", size)
    by = Window.partitionBy("b_key").orderBy("b_order")
    first = sized.where("taken > 0").select(F.col(key).alias("b_key"), F.col(order).alias("b_order"), "taken").withColumn("place", F.rank().over(by)).where(F.col("place") <= total_bytes + 1)
    # sums only rise, so all that follows the first file over the budget is over it too
    ends = first.withColumn("total", F.sum("taken").over(by)).where(F.col("total") > total_bytes).groupBy("b_key").agg(F.min("b_order").alias("end"))
    kept = sized.join(ends, F.col(key).eqNullSafe(F.col("b_key")), "left").where(F.col("end").isNull() | (F.col(order) < F.col("end")))
    return kept.drop("b_key", "end").withColumn("cut", F.octet_length("content") > file_bytes)


def cache_lookup(wanted: DataFrame, local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """wanted with the value of the local cache, else of the remote one, and where it was found; `warm` marks
    what the local cache should take over. Caches hold (key, value), a row a key."""
    near = local.select(F.col(key).alias("n_key"), F.col("value").alias("n_value"))
    far = remote.select(F.col(key).alias("f_key"), F.col("value").alias("f_value"))
    both = wanted.join(near, F.col(key) == F.col("n_key"), "left").join(far, F.col(key) == F.col("f_key"), "left")
    found = F.when(F.col("n_key").isNotNull(), "local").when(F.col("f_key").isNotNull(), "remote").otherwise("miss")
    value = F.when(F.col("n_key").isNotNull(), F.col("n_value")).otherwise(F.col("f_value"))
    return both.withColumns({"value": value, "found": found, "warm": found == "remote"}).drop("n_key", "n_value", "f_key", "f_value")


def tier_rollup(messages: DataFrame, key: str) -> DataFrame:
    """Messages (ord, tier, finding_count) of a key in order: those in a row with the same tier make one."""
    w = Window.partitionBy(key).orderBy("ord")
    fresh = F.coalesce(F.lag("tier").over(w) != F.col("tier"), F.lit(True)).cast("int")
    flush = messages.withColumn("fresh", fresh).withColumn("flush", F.sum("fresh").over(w))
    return flush.groupBy(key, "flush", "tier").agg(F.count("*").alias("messages"), F.sum("finding_count").alias("findings"), F.min("ord").alias("first_ord"))


def calibration_events(findings: DataFrame, key: str = "run_id") -> DataFrame:
    """One event a run with its distinct rules and file name endings, and one a finding."""
    ending = F.nullif(F.regexp_extract(F.coalesce("uri", F.lit("")), r"\.[^./]*$", 0), F.lit(""))
    run = findings.groupBy(key).agg(F.lit("analysis").alias("type"), F.lit(None).cast("long").alias("ord"), F.countDistinct("rule_id").alias("rules"), F.array_join(F.sort_array(F.collect_set(ending)), ",").alias("endings"), F.count("*").alias("findings"))
    each = findings.select(key, F.lit("finding").alias("type"), "ord", F.lit(1).cast("long").alias("rules"), F.coalesce(ending, F.lit("")).alias("endings"), F.lit(1).cast("long").alias("findings"))
    return run.unionByName(each)


def judge_stats(answers: DataFrame, key: str) -> DataFrame:
    """Means over judges' answers (JSON with score and verdict); one that can't be read is 1 and noise."""
    parsed = F.from_json("answer", "score double, verdict string")
    score, verdict = F.coalesce(parsed["score"], F.lit(1.0)), F.when(parsed["score"].isNull(), "noise").otherwise(F.coalesce(parsed["verdict"], F.lit("noise")))
    return answers.groupBy(key).agg(F.avg(score).alias("score"), F.avg((verdict == "valid").cast("double")).alias("valid_rate"), F.avg((verdict == "noise").cast("double")).alias("noise_rate"))


def compare(runs: DataFrame, keys: list[str], side: str, current, baseline, measures: list[str]) -> DataFrame:
    """Measures of the current side less those of the baseline, a row a key; one pass, no join."""
    pick = lambda m, s: F.max(F.when(F.col(side) == s, F.col(m)))
    return runs.groupBy(*keys).agg(*[(pick(m, current) - pick(m, baseline)).alias(m) for m in measures])


def two_level(runs: DataFrame, condition: str, run: str, measures: list[str], weighted: str | None = None, weight: str = "total") -> DataFrame:
    """Sums per condition and run over packages, then mean and sample deviation (0 for one run) over runs. The weighted
    measure is a mean over packages by weight instead of a sum, 0 where the weights are."""
    mean = [F.coalesce(F.sum(F.col(weighted) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0)), F.lit(0.0)).alias(weighted)] if weighted else []
    sums = runs.groupBy(condition, run).agg(*[F.sum(m).alias(m) for m in measures], *mean)
    measures = [*measures, weighted] if weighted else measures
    return sums.groupBy(condition).agg(F.count("*").alias("runs"), *[f for m in measures for f in (F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"))])


def summary_text(summary: DataFrame, key: str, measures: dict[str, str]) -> DataFrame:
    """A line a measure (label -> name) of a summary with mean and deviation: (key, place, text)."""
    line = lambda i, label, m: F.struct(F.lit(i).alias("place"), F.format_string(f"  %-22s %8.1f ±%-5.1f", F.lit(label), f"{m}_mean", f"{m}_std").alias("text"))
    return summary.select(key, F.inline(F.array(*[line(i, label, m) for i, (label, m) in enumerate(measures.items())])))


def timing(events: DataFrame) -> DataFrame:
    """Milliseconds in the queue, under analysis and in all, of events (queued, started, completed); 0 where a time is unset."""
    ms = lambda a, b: F.coalesce(F.unix_millis(F.col(b).cast("timestamp")) - F.unix_millis(F.col(a).cast("timestamp")), F.lit(0))
    return events.withColumns({"queue_ms": ms("queued", "started"), "analysis_ms": ms("started", "completed"), "total_ms": ms("queued", "completed")})
