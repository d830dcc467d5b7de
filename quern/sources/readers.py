"""Readers of artifacts, diffs and stored runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, content, kind) of whole files; files that aren't UTF-8 are left out."""
    return _decoded(spark.read.format("binaryFile").load(list(paths)))


def read_directory(spark: SparkSession, top: str) -> DataFrame:
    """All files below a folder but those in folders whose name begins with a dot. Spark's readers also pass over
    files whose own name begins with a dot or an underscore; read_files() takes those by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top)
    below = F.regexp_replace("path", F.lit("^.*?" + top.removeprefix("file://").rstrip("/").replace("\\", "\\\\").replace(".", "\\.")), F.lit(""))
    return _decoded(files.where(~below.rlike(r"/\.[^/]+/")))


def _decoded(files: DataFrame) -> DataFrame:
    return files.where(F.is_valid_utf8("content")).select("path", F.decode("content", "UTF-8").alias("content"), F.lit("file").alias("kind"))


def split_diff(diffs: DataFrame) -> DataFrame:
    """Unified diffs (diff_id, diff) to (diff_id, path, content, kind): one row a `diff --git` header; its path is
    the header's last word without b/. Text before the first header goes."""
    lines = diffs.select("diff_id", F.posexplode(F.split("diff", "\n")).alias("no", "line"))
    head = F.col("line").startswith("diff --git")
    part = lines.withColumn("head", head).withColumn("part", F.sum(head.cast("int")).over(Window.partitionBy("diff_id").orderBy("no"))).where("part > 0")
    path = F.max(F.when(F.col("head"), F.regexp_replace(F.regexp_extract("line", r"(\S+)\s*$", 1), "^b/", "")))
    body = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("no", "line"))))
    return part.groupBy("diff_id", "part").agg(path.alias("path"), body.alias("x")).select("diff_id", "path", F.array_join("x.line", "\n").alias("content"), F.lit("diff").alias("kind"))


def changed_range(content: Column) -> Column:
    """struct(start, end): the span of all hunks' new lines; a hunk without a length has one line."""
    starts = F.regexp_extract_all(content, F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"), F.lit(1))
    sizes = F.regexp_extract_all(content, F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"), F.lit(2))
    hunks = F.filter(F.zip_with(starts, sizes, lambda a, n: F.struct(a.cast("int").alias("start"), F.when(n == "", 1).otherwise(n.cast("int")).alias("n"))), lambda h: h.start > 0)
    return F.struct(F.array_min(F.transform(hunks, lambda h: h.start)).alias("start"), F.array_max(F.transform(hunks, lambda h: F.greatest(h.start, h.start + h.n - 1))).alias("end"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Stored findings, partitioned by run_id."""
    return spark.read.parquet(path)


def write_run(findings: DataFrame, path: str) -> None:
    findings.write.mode("append").partitionBy("run_id").parquet(path)


def alert_verdicts(alerts: DataFrame) -> DataFrame:
    """Alerts (number, state, dismissed_reason) to verdicts; open ones go."""
    verdict = F.when(F.col("state") == "fixed", "useful").when((F.col("state") == "dismissed") & (F.col("dismissed_reason") == "false positive"), "wrong").when(F.col("state") == "dismissed", "noise")
    return alerts.withColumn("verdict", verdict).where("verdict is not null")
