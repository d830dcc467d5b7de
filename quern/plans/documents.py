"""Registered queries of whole documents as their parts, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import findings as A
from ..operators import rules as R
from ..operators import measures as M
from ..operators import reports as P
from ..sources import documents as D
from ..sources import loaders, readers
from ..sources.scratch import new_folder, working_table
from .registry import ARTIFACTS, FP, GATE, _gated, _scan_sql, artifacts, query


def _json(columns: dict[str, str]) -> str:
    """SQL of a finding's result as JSON; columns: what stands for its fields."""
    c = {"rule_id": "rule_id", "level": "level", "message": "message", "uri": "uri", "snippet": "snippet", "confidence": "confidence", "tier": "tier", "fp": "fp"} | columns
    opt = lambda test, *xs: f"case when {test} is null then '' else concat({', '.join(xs)}) end"
    region = f"'\"region\":{{\"startLine\":', cast(start_line as varchar), ',\"endLine\":', cast(end_line as varchar), {opt(c['snippet'], repr(',\"snippet\":{\"text\":\"'), 'replace(' + c['snippet'] + ', chr(10), chr(92) || chr(110))', repr('\"}'))}, '}}}}'"
    place = opt(c["uri"], "',\"locations\":[{\"physicalLocation\":{\"artifactLocation\":{\"uri\":\"'", c["uri"], "'\"},'", region, "'}]'")
    line = f"substr(sha256(concat_ws('|', {c['rule_id']}, coalesce({c['uri']}, ''), cast(start_line as varchar), {c['message']})), 1, 32)"
    fingerprint = opt(c["fp"], "',\"fingerprints\":{\"contentHash/v1\":\"'", c["fp"], "'\"}'")
    severity = f"case {c['level']} when 'error' then '8.0' when 'warning' then '5.0' else '2.0' end"
    properties = f"'\"properties\":{{', {opt(c['confidence'], repr('\"confidence\":'), 'cast(' + c['confidence'] + ' as varchar)', repr(','))}, {opt(c['tier'], repr('\"tier\":\"'), c['tier'], repr('\",'))}, '\"ord\":', cast(ord as varchar), ',\"security-severity\":', {severity}, ',\"precision\":\"', case when {c['tier']} = 'comprehensive' then 'high' else 'medium' end, '\"}}}}'"
    return f"concat('{{\"ruleId\":\"', {c['rule_id']}, '\",\"level\":\"', {c['level']}, '\",\"message\":{{\"text\":\"', {c['message']}, '\"}}', {place}, {fingerprint}, ',\"partialFingerprints\":{{\"primaryLocationLineHash\":\"', {line}, '\"}},', {properties})"


def _comma(key: str) -> str:
    return f"case when row_number() over (partition by {key} order by ord) = 1 then '' else ',' end"


DRIVER = json.dumps({"name": "quern", "version": "1", "rules": [D._described(r) for r in R.BUILT_IN[:3]]}).replace("'", "''")
TAXA = json.dumps(D._taxonomies(R.BUILT_IN[:3]))


@query(f"""select run_id, 0 as part, 0::bigint as ord, concat('{{"$schema":"{D.SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{DRIVER}}},"taxonomies":{TAXA},"invocations":[{{"workingDirectory":{{"uri":"/src"}},"executionSuccessful":true}}],"automationDetails":{{"guid":"g-', run_id, '"}}', case when run_id = 'run0' then '' else concat(',"baselineGuid":"g-run', cast(cast(substr(run_id, 4) as int) - 1 as varchar), '"') end, ',"properties":{{"inputScope":"directory"}},"results":[') as text from (select distinct run_id from {{findings}})
union all select run_id, 1, ord, concat({_comma('run_id')}, {_json({})}) from (select *, {FP} as fp from {{findings}})
union all select distinct run_id, 2, 0, ']}}]}}' from {{findings}}""")
def run_log(t):
    """The whole log of each run: tool, taxonomies, invocation, identity and all results."""
    f = t("findings")
    before = F.when(F.col("run_id") != "run0", F.concat(F.lit("g-run"), (F.substring("run_id", 4, 9).cast("int") - 1).cast("string")))
    runs = f.select("run_id").distinct().select("run_id", F.concat(F.lit("g-"), "run_id").alias("guid"), before.alias("baseline_guid"), F.lit("directory").alias("scope"), F.lit("/src").alias("directory"))
    return D.run_logs(f, runs, R.BUILT_IN[:3])


@query(f"""select run_id, 0 as part, 0::bigint as ord, concat('{{"decision":"', decision, '","reason":"', cast(n_actionable as varchar), '","relevant_findings":[') as text from {GATE}
union all select run_id, 1, ord, concat({_comma('run_id')}, {_json({})}) from (select *, {FP} as fp from {{findings}} where level = 'error') where run_id in (select run_id from {GATE})
union all select run_id, 2, 0, ']}}' from {GATE}""")
def verdict_json(t):
    """Each run's verdict with all its errors."""
    v = A.gate(_gated(t)).withColumn("reason", F.col("n_actionable").cast("string"))
    return D.verdict_documents(v, t("findings").where("level = 'error'"))


FOUND = " union all ".join(_scan_sql([r]).replace("ms[k] as match", f"ms[k] as match, {i} * 1000000000::bigint + k - 1 as ord, '{r.message}' as message") for i, r in enumerate(R.BUILT_IN))


@query(f"""select path, 0 as part, 0::bigint as ord, concat('{{"key":"', sha256(concat(content, chr(0), path)), '","path":"', path, '","results":[') as text from {ARTIFACTS}
union all select uri, 1, ord, concat({_comma('uri')}, {_json({'snippet': 'null', 'fp': 'null', 'tier': "'instant'"})}) from (select *, start_line as end_line from ({FOUND}))
union all select path, 2, 0, ']}}' from {ARTIFACTS}""")
def cache_export(t):
    """A cache entry an artifact with all its findings."""
    a = artifacts(t)
    found = R.regex_scan(a, R.BUILT_IN).withColumns({"ord": F.col("rule_ord").cast("long") * 1_000_000_000 + F.col("match_ord"), "end_line": F.col("start_line")})
    return D.cache_documents(a, found)


@query(f"select run_id, ord, rule_id, level, message, uri, start_line, end_line, confidence, tier, {FP} as content_fp, substr(sha256(concat_ws('|', rule_id, coalesce(uri, ''), cast(start_line as varchar), message)), 1, 32) as line_fp from {{findings}} where uri is not null")
def logs_written_and_read(t):
    """Findings with a place, through the logs of their runs: written in pieces, read by lines."""
    f = t("findings").where("uri is not null")
    f = f.select("run_id", "ord", *[c for c in D.FIELDS if c in f.columns])
    path = new_folder(f.sparkSession, "logs")
    with working_table(f, "findings") as stored:
        D.write_logs(stored, stored.select("run_id").distinct(), R.BUILT_IN[:3], path, compression="gzip")
    return D.read_log_pieces(f.sparkSession, path).select("run_id", "ord", "rule_id", "level", "message", "uri", "start_line", "end_line", "confidence", "tier", "content_fp", "line_fp")


@query(f"select run_id, decision, n_actionable from {GATE}")
def verdicts_written_and_read(t):
    v = A.gate(_gated(t)).drop("n_rejecting")
    path = new_folder(v.sparkSession, "verdicts")
    loaders.write_verdicts(v, path)
    return loaders.read_verdicts(v.sparkSession, path).select("run_id", "decision", "n_actionable")


@query("select run_id, count(*) as total, count(*) filter (level = 'error') as errors from {findings} group by run_id union all select run_id, count(*), count(*) filter (level = 'error') from {findings} group by run_id")
def metrics_written_and_read(t):
    """Two appends to a log of metrics, line by line."""
    m = M.run_measures(t("findings")).select("run_id", "total", "errors")
    path = new_folder(m.sparkSession, "metrics")
    loaders.append_run_metrics(m, path)
    loaders.append_run_metrics(m, path)
    return loaders.read_run_metrics(m.sparkSession, path, "run_id string, total long, errors long")


@query("select ord, rule_id, uri from {findings} where run_id = 'run3'")
def stored_baseline(t):
    """A baseline by the id of a stored run."""
    f = t("findings")
    path = new_folder(f.sparkSession, "store")
    readers.write_run(f, path)
    return loaders.read_baseline(f.sparkSession, "run3", path).select("ord", "rule_id", "uri")


@query("select variant, 0 as place, printf('  %-22s %8.1f ±%-5.1f', 'Findings', avg(total), coalesce(stddev_samp(total), 0)) as text from {runs} group by variant union all select variant, 1, printf('  %-22s %8.1f ±%-5.1f', 'Errors', avg(errors), coalesce(stddev_samp(errors), 0)) from {runs} group by variant")
def summary_lines(t):
    """A summary's lines of text."""
    return P.summary_text(M.summarize(t("runs"), "variant", ["total", "errors"]), "variant", {"Findings": "total", "Errors": "errors"})
