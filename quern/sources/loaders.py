"""Readers of rules, suppressions, benchmark cases, stored runs and queued events, and writers of runs."""

from __future__ import annotations

import os
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.exchange import nested_run
from ..operators.rules import Rule


def _yaml(text: str) -> Any:
    """YAML where a parser is installed; else JSON, which is YAML too."""
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text)
    return yaml.safe_load(text)


def parse_rules(text: str) -> list[Rule]:
    """The rules of a file; a rule without a type has a pattern. Raises ValueError for a rule that lacks a field, has a
    confidence outside (0, 1] or repeats an id, and for a pattern that Java can't read once it is used."""
    rules: list[Rule] = []
    for i, r in enumerate((_yaml(text) or {}).get("rules") or []):
        kind = r.get("type") or "regex"
        said = lambda why, r=r, i=i: ValueError(f"rule {r.get('id', '')!r} (index {i}): {why}")
        if kind not in ("regex", "ast"):
            raise said(f"unknown rule type: {kind}")
        for field in ("id", "pattern" if kind == "regex" else "ast_check", "level", "message"):
            if not r.get(field):
                raise said(f"missing required field: {field}")
        sure = float(r.get("confidence") or 0)
        if not 0 < sure <= 1:
            raise said(f"confidence must be in range (0, 1], got {sure}")
        if any(x.id == r["id"] for x in rules):
            raise ValueError(f"duplicate rule ID {r['id']!r}")
        lists = {c: list(r.get(c) or []) for c in ("languages", "cwe", "owasp", "references")}
        rules.append(Rule(r["id"], r["level"], sure, r["message"], r.get("category") or "", r.get("pattern") or "", remediation=r.get("remediation") or "", ast_check=r.get("ast_check") or "", ast_config=dict(r.get("ast_config") or {}), **lists))
    return rules


def load_rules(folder: str) -> list[Rule]:
    """All rules of a folder's .yaml and .yml files, by file name; a missing folder has none."""
    if not os.path.isdir(folder):
        return []
    files = sorted(p for p in Path(folder).iterdir() if p.is_file() and p.suffix.lower() in (".yaml", ".yml"))
    return [r for p in files for r in parse_rules(p.read_text(encoding="utf-8"))]


def merge_rules(*layers: list[Rule]) -> list[Rule]:
    """Later layers replace rules of the same id; by id."""
    merged = {r.id: r for layer in layers for r in layer}
    return [merged[k] for k in sorted(merged)]


SUPPRESSIONS = "s_ord long, rule_id string, file string, reason string, created string, source string"


def load_suppressions(spark: SparkSession, path: str) -> DataFrame:
    """The suppressions of a file in their order; a missing file has none."""
    found = (_yaml(Path(path).read_text(encoding="utf-8")) or {}).get("suppressions") or [] if os.path.exists(path) else []
    text = lambda x: None if x is None else str(x)
    return spark.createDataFrame([(i, s.get("rule_id"), s.get("file") or "", s.get("reason") or "", text(s.get("created")), s.get("source") or "") for i, s in enumerate(found)], SUPPRESSIONS)


EXPECTED = "case_id string, ord long, rule_id string, level string, lo int, hi int, category string, must_find boolean"


def _expectations(batches):
    """Of (case_id, text) rows the expected findings; the texts are parsed where they are."""
    import pyarrow as pa

    kinds = {"case_id": pa.string(), "ord": pa.int64(), "rule_id": pa.string(), "level": pa.string(), "lo": pa.int32(), "hi": pa.int32(), "category": pa.string(), "must_find": pa.bool_()}
    for batch in batches:
        rows = []
        for case, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for i, e in enumerate((_yaml(text) or {}).get("findings") or []):
                lo, hi = (*(e.get("line_range") or (0, 0)), 0)[:2]
                rows.append((case, i, e.get("rule_id") or "", e.get("severity") or "", lo, hi, e.get("category") or "", bool(e.get("must_find"))))
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def load_corpus(spark: SparkSession, top: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark cases under top/language/case: (case_id, language, path, content) of the sources, and the expected
    findings. A case's source is its first file by name that isn't expected.yaml or metadata.yaml; folders with a dot in
    front are passed over; a case without a source or expectations is an error. Files are listed and read side by side; nothing
    of them comes to the driver but the name of a case that is wrong."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top)
    parts = F.split(F.regexp_replace("path", "^file:", ""), "/")
    at = lambda i: F.element_at(parts, i)
    depth = F.size(F.split(F.lit(os.path.abspath(top) if "://" not in top else top.rstrip("/")), "/"))
    inside = (F.size(parts) - depth == 3) | F.lit("://" in top)
    placed = files.select(F.concat_ws("/", at(-3), at(-2)).alias("case_id"), at(-3).alias("language"), at(-1).alias("name"), F.col("path"), F.col("content")).where(inside & ~at(-3).startswith(".") & ~at(-2).startswith("."))
    own = placed.where(~F.col("name").isin("expected.yaml", "metadata.yaml"))
    # names first: only the chosen file's content is read
    first = own.groupBy(F.col("case_id").alias("first_of")).agg(F.min("name").alias("first"))
    cases = placed.groupBy("case_id").agg(F.count_if(~F.col("name").isin("expected.yaml", "metadata.yaml")).alias("sources"), F.count_if(F.col("name") == "expected.yaml").alias("wanted"))
    if os.path.isdir(top):  # folders without any file are in no listing of files
        seen = lambda p: [x for x in os.scandir(p) if x.is_dir() and not x.name.startswith(".")]
        folders = spark.createDataFrame([(f"{a.name}/{b.name}",) for a in seen(top) for b in seen(a.path)], "case_id string")
        cases = folders.join(cases, "case_id", "left").fillna(0, ["sources", "wanted"])
    wrong = cases.where("sources = 0 or wanted = 0").orderBy("case_id").first()
    if wrong:
        raise ValueError(f"no {'source file' if not wrong.sources else 'expected.yaml'} found in {wrong.case_id}")
    sources = own.join(first, (F.col("case_id") == F.col("first_of")) & (F.col("name") == F.col("first"))).select("case_id", "language", F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "UTF-8").alias("content"))
    expected = placed.where("name = 'expected.yaml'").select("case_id", F.decode("content", "UTF-8").alias("text")).mapInArrow(_expectations, EXPECTED)
    return sources, expected


LOG = "runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int,snippet:struct<text:string>>>>>,properties:struct<confidence:double,tier:string>>>>>"


def read_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """Findings of interchange-format logs, one JSON document a file: run_id is the name of the file's folder; a result
    without a location has a null uri; ord is its place in the first run."""
    logs = spark.read.schema(LOG).json(list(paths), multiLine=True).withColumn("path", F.input_file_name())
    rows = logs.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run_id"), F.posexplode(F.get("runs", F.lit(0))["results"]).alias("ord", "r"))
    at = F.get("r.locations", F.lit(0))["physicalLocation"]
    return rows.select("run_id", F.col("ord").cast("long").alias("ord"), F.col("r.ruleId").alias("rule_id"), "r.level", F.col("r.message.text").alias("message"), at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("start_line"), at["region"]["endLine"].alias("end_line"), at["region"]["snippet"]["text"].alias("snippet"), "r.properties.confidence", "r.properties.tier")


def read_baseline(spark: SparkSession, baseline: str, store: str) -> DataFrame:
    """A baseline's findings: a log file of that path if there is one, else the stored run of that id."""
    if os.path.isfile(baseline):
        return read_logs(spark, baseline)
    return spark.read.parquet(store).where(F.col("run_id") == baseline)


def write_results(findings: DataFrame, path: str) -> None:
    """Findings as lines of JSON results, a folder a run, in order within each file."""
    nested_run(findings).repartitionByRange("run_id", "ord").sortWithinPartitions("run_id", "ord").select("run_id", F.col("result").alias("value")).write.mode("append").partitionBy("run_id").text(path)


def write_verdicts(verdicts: DataFrame, path: str) -> None:
    verdicts.write.mode("append").partitionBy("run_id").parquet(path)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_run_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").json(path)


def read_run_metrics(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Lines of JSON; a line that can't be read is an error."""
    return (spark.read.schema(schema) if schema else spark.read).option("mode", "FAILFAST").json(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Code-scanning alerts, an array of JSON objects a file: number, state, dismissed_reason, rule_id, uri, start_line."""
    schema = "number long, state string, dismissed_reason string, rule struct<id:string>, most_recent_instance struct<location:struct<path:string,start_line:int>>"
    a = spark.read.schema(schema).json(path, multiLine=True)
    return a.select("number", "state", "dismissed_reason", F.col("rule.id").alias("rule_id"), F.col("most_recent_instance.location.path").alias("uri"), F.col("most_recent_instance.location.start_line").alias("start_line"))


def queued_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of JSON batches from a folder; files and lines that can't be read are passed over. A checkpoint of the
    query that reads it takes the place of deleting what was delivered."""
    lines = spark.readStream.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("ignoreCorruptFiles", "true").json(path)
    return lines.where("_corrupt is null").drop("_corrupt")
