"""Findings, events and feedback as editors, reports and dashboards show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet
from .reports import priority


def within_lines(findings: DataFrame, first: int, last: int, shift: int = 0) -> DataFrame:
    """Findings that start between two lines, their lines moved by shift: from a part of a file to the whole."""
    kept = findings.where(F.col("start_line").between(first, last))
    return kept.withColumns({c: F.col(c) + shift for c in ("start_line", "end_line")})


def overlapping(findings: DataFrame, first: int, last: int) -> DataFrame:
    """Findings of which a line lies between two."""
    return findings.where((F.col("start_line") <= last) & (F.col("end_line") >= first))


def analysis_window(findings: DataFrame, around: int = 10) -> DataFrame:
    """findings with the lines to analyse anew, so many around their own, and their line within these."""
    start = F.greatest(F.col("start_line") - around, F.lit(1))
    return findings.withColumns({"window_start": start, "window_end": F.col("end_line") + around, "line_in_window": F.col("start_line") - start + 1})


def scores(findings: DataFrame) -> DataFrame:
    """findings with the severity and precision that code scanning sorts by."""
    return findings.withColumns({"severity": severity_score(F.col("level")), "precision": precision(F.col("tier"))})


def severity_score(level: Column) -> Column:
    return F.when(level == "error", 8.0).when(level == "warning", 5.0).otherwise(2.0)


def precision(tier: Column) -> Column:
    return F.when(tier == "comprehensive", "high").otherwise("medium")


def diagnostics(findings: DataFrame, tool: str = "quern") -> DataFrame:
    """Placed findings with lines from 0, a severity of 1 to 3 and their source, as editors take them."""
    zero = lambda c: F.greatest(F.col(c) - 1, F.lit(0))
    severity = F.when(F.col("level") == "error", 1).when(F.col("level") == "warning", 2).otherwise(3)
    source = F.concat(F.lit(f"{tool}/"), F.coalesce("tier", F.lit("instant")))
    return findings.where("uri is not null").withColumns({"line": zero("start_line"), "last_line": zero("end_line"), "severity": severity, "source": source})


def code_actions(asked: DataFrame, findings: DataFrame) -> DataFrame:
    """asked (rule_id, start_line, fixed, ...): the first finding of each one's rule and line; an edit if it is fixed, else
    advice. With a run_id, of that run's findings."""
    keys = ["run_id"] * ("run_id" in asked.columns) + ["rule_id", "start_line"]
    first = findings.groupBy(*keys).agg(F.min(F.struct("ord", "end_line")).alias("f"))
    kind = F.when(F.col("fixed"), "edit").otherwise("advice")
    return asked.join(first, keys).select(*asked.columns, "f.ord", kind.alias("kind"), F.col("f.end_line").alias("edit_end"))


def severity_table(findings: DataFrame) -> DataFrame:
    """Findings and files by level, with the level's place in a report."""
    return findings.groupBy("level", priority(F.col("level")).alias("priority")).agg(F.count("*").alias("n"), F.countDistinct("uri").alias("files"))


def cache_table(events: DataFrame) -> DataFrame:
    """Events and mean findings by tier and by what the cache said."""
    return events.groupBy("tier", "cache_result").agg(F.count("*").alias("n"), F.avg("finding_count").alias("findings"))


def verdict_rates(feedback: DataFrame) -> DataFrame:
    """Feedback by verdict: number and share of all."""
    total = feedback.agg(F.count("*").alias("all"))  # one row
    return feedback.groupBy("verdict").agg(F.count("*").alias("n")).join(F.broadcast(total), F.lit(True)).select("verdict", "n", (F.col("n") / F.col("all")).alias("rate"))


def listed(suppressions: DataFrame, reason: str = "") -> DataFrame:
    """Suppressions as a list shows them, of reasons that begin so; one for all files says (all)."""
    file = F.when(F.coalesce("file", F.lit("")) == "", "(all)").otherwise(F.col("file"))
    return suppressions.where(F.coalesce("reason", F.lit("")).startswith(reason)).withColumn("file", file)


def recent(events: DataFrame, n: int = 50) -> DataFrame:
    """The newest n events."""
    return events.orderBy(F.desc("ts"), F.desc("ord")).limit(n)


def surrounding(content: Column, first: int, last: int, around: int = 2) -> Column:
    """Lines first to last with so many around them; null where that is no more than the lines, or where there are none."""
    own = snippet(content, F.lit(first), F.lit(last))
    wide = snippet(content, F.lit(max(1, first - around)), F.lit(last + around))
    return F.when(own.isNotNull() & (wide != own), wide)


def long_functions(functions: DataFrame, most: int = 40) -> DataFrame:
    """Of an index of functions (start_line, end_line, ...) those of more than `most` lines, with their number."""
    return functions.withColumn("n", (F.col("end_line") - F.col("start_line") + 1).cast("long")).where(F.col("n") > most)
