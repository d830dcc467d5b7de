"""The algebra of findings: deduplication, baselines, thresholds, suppressions and the gate."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_path

TIER_RANK = {"instant": 1, "fast": 2, "comprehensive": 3}
#: Sizes of blocks of lines: by a width of 64 the largest hold 2**30 lines.
LEVELS = 6


def tier_dedup(findings: DataFrame, key: str = "run_id") -> DataFrame:
    """Of findings of a run with the same rule, uri and line the one of the highest tier, then the first; those
    without a location go. A missing tier is instant."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TIER_RANK.items() for x in kv]), F.coalesce("tier", F.lit("instant"))), F.lit(0))
    best = Window.partitionBy(*[key] * (key in findings.columns), "rule_id", "uri", "start_line").orderBy(rank.desc(), "ord")
    return findings.where("uri is not null").withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def _keep_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """run and ord of the findings to keep of sorted ones; only the best so far of one run, rule and uri is held."""
    group = best = None
    for batch in batches:
        kept = []
        for run, rule, uri, no, start, end, confidence in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sure = (confidence != confidence, confidence)  # noqa: PLR0124 (NaN is above all)
            if best is None or group != (run, rule, uri):
                if best is not None:
                    kept.append((group[0], best[0]))
                group, best = (run, rule, uri), (no, start, end, sure)
            elif None not in (start, end, best[1], best[2]) and start <= best[2] and best[1] <= end:
                if sure > best[3]:
                    best = (no, start, end, sure)
            else:
                kept.append((run, no))
        yield _kept(kept, batch.column(0).type)
    if best is not None:
        yield _kept([(group[0], best[0])], batch.column(0).type)


def _kept(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64())], ["k_run", "k_ord"])


def overlap_dedup(findings: DataFrame, key: str = "run_id") -> DataFrame:
    """Per run, rule and uri, in order: a finding whose lines overlap the best so far replaces it if its
    confidence is higher and goes otherwise; one that doesn't overlap stays and is not compared again.
    Findings without a location all stay. ord is a finding's place within its run; findings without the key are one run.
    The sorted rows of a run, rule and uri are streamed, not gathered."""
    run = F.col(key) if key in findings.columns else F.lit("")
    order = ["run", "rule_id", "uri", "ord", "start_line", "end_line", "confidence"]
    placed = findings.where("uri is not null").select(run.alias("run"), "rule_id", "uri", F.col("ord").cast("long").alias("ord"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"))
    kept = placed.repartition("run", "rule_id", "uri").sortWithinPartitions(*order).mapInArrow(_keep_best, f"k_run {placed.schema['run'].dataType.simpleString()}, k_ord long")
    return findings.where("uri is not null").join(kept, run.eqNullSafe(F.col("k_run")) & (F.col("ord") == F.col("k_ord")), "left_semi").unionByName(findings.where("uri is null"))


def baseline_diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """current with baseline_state new or unchanged by fingerprint fp, and the baseline's rows whose
    fingerprint is gone as absent. Rows without a fingerprint keep a null state."""
    known = baseline.where("fp is not null").select(F.col("fp").alias("known")).distinct()
    seen = current.where("fp is not null").select("fp").distinct()
    marked = current.join(known, current.fp == known.known, "left")
    state = F.when(F.col("fp").isNull(), F.lit(None)).when(F.col("known").isNull(), "new").otherwise("unchanged")
    gone = baseline.where("fp is not null").join(seen, "fp", "left_anti").withColumn("baseline_state", F.lit("absent"))
    return marked.withColumn("baseline_state", state).drop("known").unionByName(gone.select(*current.columns, "baseline_state"))


def with_threshold(findings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """findings with `dropped`: below the rule's suppress_below, if that isn't 0; no confidence counts as 0."""
    t = thresholds.select(F.col("rule_id").alias("t_rule"), "suppress_below")
    low = (F.col("suppress_below") != 0) & (F.coalesce("confidence", F.lit(0.0)) < F.col("suppress_below"))
    return findings.join(t, findings.rule_id == t.t_rule, "left").withColumn("dropped", F.coalesce(low, F.lit(False))).drop("t_rule", "suppress_below")


def apply_suppressions(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """findings with the reason of the first suppression (by s_ord) of the rule, for all files or this one.

    Two equi-joins instead of one with an OR: by rule for global ones, by rule and path for the others."""
    s = suppressions.select(F.col("rule_id").alias("s_rule"), F.when(F.coalesce("file", F.lit("")) != "", normalize_path(F.col("file"))).alias("s_file"), F.struct("s_ord", "reason").alias("hit"))
    everywhere = s.where("s_file is null").groupBy("s_rule").agg(F.min("hit").alias("all_hit"))
    here = s.where("s_file is not null").groupBy("s_rule", "s_file").agg(F.min("hit").alias("file_hit")).withColumnRenamed("s_rule", "f_rule")
    path = normalize_path(F.coalesce("uri", F.lit("")))
    out = findings.withColumn("n_path", path).join(everywhere, F.col("rule_id") == F.col("s_rule"), "left")
    out = out.join(here, (F.col("rule_id") == F.col("f_rule")) & (F.col("n_path") == F.col("s_file")), "left")
    return out.withColumn("suppressed_by", F.least("all_hit", "file_hit")["reason"]).drop("s_rule", "f_rule", "s_file", "n_path", "all_hit", "file_hit")


def suppression_upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row a rule and normalised file: its first place, its last reason."""
    key = ["rule_id", "file"]
    all_rows = existing.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1))).withColumn("file", F.when(F.coalesce("file", F.lit("")) == "", "").otherwise(normalize_path(F.col("file"))))
    return all_rows.groupBy(*key).agg(F.min(F.struct("side", "s_ord"))["s_ord"].alias("s_ord"), F.max(F.struct("side", "s_ord", "reason"))["reason"].alias("reason"))


def actionable() -> Column:
    return F.col("suppressed_by").isNull() & ~F.coalesce("baseline_state", F.lit("")).isin("unchanged", "absent")


def gate(findings: DataFrame, key: str = "run_id", reject_above: float = 0.85) -> DataFrame:
    """A decision a run: reject for an actionable error above that confidence, merge if nothing is
    actionable, else review."""
    n = findings.groupBy(key).agg(F.count_if(actionable()).alias("n_actionable"), F.count_if(actionable() & (F.col("level") == "error") & (F.coalesce("confidence", F.lit(0.0)) > reject_above)).alias("n_rejecting"))
    return n.select(key, F.when(F.col("n_rejecting") > 0, "reject").when(F.col("n_actionable") == 0, "merge").otherwise("review").alias("decision"), "n_actionable", "n_rejecting")


def relevant(findings: DataFrame, verdicts: DataFrame, key: str = "run_id") -> DataFrame:
    """What a verdict rests on: errors for reject, errors and warnings for review; suppressed ones never.
    The baseline state doesn't matter here."""
    levels = F.col("level").isin("error", "warning")
    shown = (F.col("decision") == "reject") & (F.col("level") == "error") | (F.col("decision") == "review") & levels
    return findings.where("suppressed_by is null").join(verdicts.select(key, "decision"), key).where(shown)


def _blocks(start: Column, end: Column, width: int) -> Column:
    """The largest blocks that make up the lines from start to end, each a level and a number: blocks of level k hold width**k
    lines, so a level takes part with at most two runs shorter than width (the last one, with any number)."""
    inside = [(F.ceil(start / width**k), F.floor((end + 1) / width**k) - 1) for k in range(LEVELS)]
    run = lambda k, a, b: F.when(a <= b, F.transform(F.sequence(a, b), lambda n: F.struct(F.lit(k).alias("level"), n.alias("block")))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))
    runs = [run(LEVELS - 1, *inside[-1])]
    for k, ((a, b), (c, d)) in enumerate(zip(inside, inside[1:])):
        larger = c <= d
        runs += [run(k, a, F.when(larger, c * width - 1).otherwise(b)), run(k, F.when(larger, (d + 1) * width).otherwise(b + 1), b)]
    return F.concat(*runs)


def enclosing(findings: DataFrame, functions: DataFrame, width: int = 64, key: str = "run_id") -> DataFrame:
    """findings with the name of the innermost function around their line, and its class if functions have one: the
    narrowest span, then the first. Functions that carry the key are those of that run only.

    A function is dealt to the few blocks that make up its lines, and of a block's functions the innermost one is kept. A line
    is in one block of each level, so the functions around it are never paired with it: it meets LEVELS rows at most."""
    per_run, named = {key} <= {*functions.columns} & {*findings.columns}, [c for c in ("class",) if c in functions.columns]
    run = lambda name, c=key: [F.col(c).alias(name)] * per_run
    same = lambda a, b: [F.col(a).eqNullSafe(F.col(b))] * per_run
    start, end = F.col("start_line").cast("long"), F.col("end_line").cast("long")
    f = functions.select(*run("f_run"), F.col("uri").alias("f_uri"), start.alias("f_start"), end.alias("f_end"), F.struct((end - start).alias("span"), "fn_ord", "name", *named).alias("b")).where("f_uri is not null and f_start <= f_end")
    f = f.groupBy(*run("f_run", "f_run"), "f_uri", "f_start", "f_end").agg(F.min("b").alias("b"))
    f = f.select(*run("f_run", "f_run"), "f_uri", "b", F.inline(_blocks(F.col("f_start"), F.col("f_end"), width)))
    f = f.groupBy(*run("f_run", "f_run"), "f_uri", "level", "block").agg(F.min("b").alias("b"))
    lines = findings.where("uri is not null and start_line is not null").select(*run("l_run"), F.col("uri").alias("l_uri"), F.col("start_line").cast("long").alias("l_line")).distinct()
    levels = F.inline(F.array(*[F.struct(F.lit(k).alias("l_level"), F.floor(F.col("l_line") / width**k).alias("l_block")) for k in range(LEVELS)]))
    met = [F.col("l_uri") == F.col("f_uri"), F.col("l_level") == F.col("level"), F.col("l_block") == F.col("block"), *same("l_run", "f_run")]
    best = lines.select("*", levels).join(f, met).groupBy(*run("l_run", "l_run"), "l_uri", "l_line").agg(F.min("b").alias("b"))
    out = findings.join(best, [F.col("uri") == F.col("l_uri"), F.col("start_line") == F.col("l_line"), *same(key, "l_run")], "left")
    return out.withColumns({"function": F.col("b.name")} | {c: F.col(f"b.{c}") for c in named}).drop("b", "l_run", "l_uri", "l_line")
