"""Whole logs, verdicts and cache entries, written in pieces and read back."""

import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.operators import rules as R
from quern.plans import documents  # noqa: F401
from quern.plans import registry
from quern.sources import documents as D
from quern.sources import loaders

F_SCHEMA = "run_id string, ord long, rule_id string, level string, message string, uri string, start_line int, end_line int, snippet string, confidence double, tier string, baseline_state string, suppressed_by string, function string, class string"
ROWS = [
    ("A", 0, "S1", "error", 'say "x"\n', "a.go", 3, 4, "  x\n y", 0.9, "fast", "new", None, "f", "S"),
    ("A", 1, "S2", "note", "m", None, None, None, None, None, None, None, "why", None, None),
    ("B", 0, "S1", "warning", "m", "b/ü.go", 1, 1, None, 0.25, "comprehensive", "unchanged", None, "g", ""),
]


def texts(parts, key="run_id"):
    out = {}
    for r in sorted(parts.collect(), key=lambda r: (r[key], r.part, r.ord)):
        out[r[key]] = out.get(r[key], "") + r.text
    return {k: json.loads(v) for k, v in out.items()}


def test_logs_of_runs_are_whole_documents(spark, tmp_path):
    f = spark.createDataFrame(ROWS, F_SCHEMA)
    runs = spark.createDataFrame([("A", "ga", None, "diff", "p", "/w"), ("B", "gb", "ga", "diff", None, "/w"), ("C", "gc", None, None, None, None)], "run_id string, guid string, baseline_guid string, scope string, persona string, directory string")
    parts = D.run_logs(f, runs, R.BUILT_IN)
    logs = texts(parts)
    run = logs["A"]["runs"][0]
    assert logs["A"]["version"] == "2.1.0" and [len(logs[k]["runs"][0]["results"]) for k in "ABC"] == [2, 1, 0]
    assert run["automationDetails"] == {"guid": "ga"} and "baselineGuid" not in run and logs["B"]["runs"][0]["baselineGuid"] == "ga"
    assert run["properties"] == {"inputScope": "diff", "persona": "p"} and run["invocations"][0]["workingDirectory"]["uri"] == "/w"
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == [r.id for r in R.BUILT_IN]
    assert {x["name"] for x in run["taxonomies"]} == {"CWE", "OWASP"} and run["tool"]["driver"]["rules"][0]["relationships"][0]["target"] == {"id": "259", "toolComponent": {"name": "CWE"}}
    first = run["results"][0]
    assert first["message"]["text"] == 'say "x"\n' and first["baselineState"] == "new" and first["properties"]["security-severity"] == 8.0
    assert first["locations"][0]["logicalLocations"] == [{"name": "f", "kind": "function", "fullyQualifiedName": "S.f"}]
    assert len(first["fingerprints"]["contentHash/v1"]) == 32 == len(first["partialFingerprints"]["primaryLocationLineHash"])
    assert "locations" not in run["results"][1] and run["results"][1]["suppressions"] == [{"kind": "external", "justification": "why"}]

    D.write_documents(parts, str(tmp_path / "logs"))
    back = D.read_log_pieces(spark, str(tmp_path / "logs"))
    columns = ["run_id", "ord", "rule_id", "level", "message", "uri", "start_line", "end_line", "snippet", "confidence", "tier", "baseline_state"]
    assert sorted(map(repr, (tuple(r) for r in back.select(columns).collect()))) == sorted(map(repr, (tuple(r) for r in f.select(columns).collect())))
    assert {r.function for r in back.collect()} == {"S.f", "g", None}
    D.join_document(spark, str(tmp_path / "logs/run_id=A"), str(tmp_path / "A/log.json"))
    assert json.loads(Path(tmp_path / "A/log.json").read_text())["runs"][0]["results"][0]["ruleId"] == "S1"
    assert sorted((r.ord, r.rule_id) for r in loaders.read_logs(spark, str(tmp_path / "A/log.json")).collect()) == [(0, "S1"), (1, "S2")]


def test_a_run_of_a_million_findings(spark, tmp_path):
    n = 1_000_000
    f = spark.range(n).select(F.lit("big").alias("run_id"), F.col("id").alias("ord"), F.lit("S1").alias("rule_id"), F.lit("error").alias("level"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("message"), F.lit("a.go").alias("uri"), (F.col("id") % 1000).cast("int").alias("start_line"), (F.col("id") % 1000).cast("int").alias("end_line"))
    D.write_documents(D.run_logs(f, spark.createDataFrame([("big",)], "run_id string"), R.BUILT_IN), str(tmp_path))
    back = D.read_log_pieces(spark, str(tmp_path))
    assert back.agg(F.count("*"), F.sum("ord"), F.countDistinct("message"), F.sum("start_line")).first() == (n, n * (n - 1) // 2, n, f.agg(F.sum("start_line")).first()[0])
    pieces = D.manifest(spark, str(tmp_path)).orderBy("place").collect()
    assert len(pieces) > 1 and [r.place for r in pieces] == list(range(len(pieces)))
    D.join_document(spark, str(tmp_path / "run_id=big"), str(tmp_path / "whole.json"))
    text = Path(tmp_path / "whole.json").read_text().replace("\n", "")
    assert Path(tmp_path / "whole.json").stat().st_size == sum(r.bytes for r in pieces)
    assert [r["properties"]["ord"] for r in json.loads(text)["runs"][0]["results"][:: n // 10]] == list(range(0, n, n // 10))


def test_verdicts_hold_all_findings(spark):
    f = spark.createDataFrame(ROWS, F_SCHEMA).where("level <> 'note'")
    many = f.where("run_id = 'A'").crossJoin(spark.range(1500)).drop("ord").withColumnRenamed("id", "ord")
    v = spark.createDataFrame([("A", "reject", 'a "b"'), ("C", "merge", "none")], "run_id string, decision string, reason string")
    found = texts(D.verdict_documents(v, many))
    assert len(found["A"]["relevant_findings"]) == 1500 and found["A"]["reason"] == 'a "b"'
    assert found["C"] == {"decision": "merge", "reason": "none", "relevant_findings": []}


def test_cache_entries_hold_their_findings(spark):
    a = spark.createDataFrame([("a.go", 'password = "secret123"\n// TODO: x'), ("b.go", "")], "path string, content string")
    found = R.regex_scan(a, R.BUILT_IN).withColumns({"ord": F.col("rule_ord") * 1000 + F.col("match_ord"), "end_line": F.col("start_line")})
    entries = texts(D.cache_documents(a, found), "path")
    assert [r["ruleId"] for r in entries["a.go"]["results"]] == ["S2068", "S1135"] and entries["b.go"]["results"] == [] and len(entries["b.go"]["key"]) == 64


def test_documents_of_empty_tables(spark, tmp_path):
    f = spark.createDataFrame([], F_SCHEMA)
    assert D.run_logs(f, spark.createDataFrame([], "run_id string"), []).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        D.read_log_pieces(spark, str(tmp_path / "none")).collect()


def test_logs_written_by_columns_are_those_of_their_parts(spark, tmp_path):
    """Byte for byte, plain and compressed; a run without findings, findings of no known run, an ord that is there twice, a null ord."""
    rows = [*ROWS, ("B", 5, *ROWS[0][2:]), ("B", 0, *ROWS[1][2:]), ("B", None, *ROWS[2][2:]), ("Z", 0, *ROWS[0][2:]), (None, 3, *ROWS[0][2:])]
    rows += [("many", k, *ROWS[k % 3][2:]) for k in range(3000)]
    f = spark.createDataFrame(rows, F_SCHEMA)
    runs = spark.createDataFrame([(k, f"g{k}") for k in ("A", "B", "C", "many")], "run_id string, guid string")
    for name, given in (("all", f), ("few", f.drop("function", "class", "baseline_state", "suppressed_by", "snippet", "tier"))):
        D.write_documents(D.run_logs(given, runs, R.BUILT_IN), str(tmp_path / name / "parts"))
        D.write_logs(given, runs, R.BUILT_IN, str(tmp_path / name / "plain"))
        D.write_logs(given, runs, R.BUILT_IN, str(tmp_path / name / "gzip"), compression="gzip")
        for run in ("A", "B", "C", "many"):
            for kind in ("parts", "plain", "gzip"):
                D.join_document(spark, str(tmp_path / name / kind / f"run_id={run}"), str(tmp_path / name / f"{kind}-{run}.json"))
            text = {kind: sorted((tmp_path / name / f"{kind}-{run}.json").read_text().splitlines()) for kind in ("parts", "plain", "gzip")}
            assert text["parts"] == text["plain"] == text["gzip"]
            if run != "B":  # where no ord is there twice, lines have one order, and B's text has no first item alone
                assert len({(tmp_path / name / f"{kind}-{run}.json").read_bytes() for kind in ("parts", "plain", "gzip")}) == 1
                json.loads((tmp_path / name / f"gzip-{run}.json").read_text())
        found = [sorted(map(repr, map(tuple, D.read_log_pieces(spark, str(tmp_path / name / kind)).collect()))) for kind in ("parts", "plain", "gzip")]
        assert found[0] == found[1] == found[2] and len(found[0]) == 3006


def test_logs_of_the_query_take_less_disk_than_their_text(spark):
    """Its pieces are compressed, and the tables that it works with go."""
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    before = {*shared.glob("*")}
    n = registry.QUERIES["logs_written_and_read"](spark, "/root/testdata/sf0.001").count()
    (logs,) = {*shared.glob("*")} - before
    pieces = [p for p in logs.rglob("part-*")]
    text = [(gzip.decompress(b) if p.suffix == ".gz" else b).decode() for p in pieces for b in [p.read_bytes()]]
    assert n > 0 and sum(t.count('"ruleId":') for t in text) == n
    assert 4 * sum(p.stat().st_size for p in pieces) < sum(map(len, text))
