"""Registered queries of overlays, diffs, caches and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import findings as A
from ..operators import reports as P
from ..operators import rules as R
from ..operators import syntax as S
from ..operators import views as V
from ..sources import readers
from .registry import ARTIFACTS, DIFFED, GATE, SUPPRESSED, _gated, _scan_sql, artifacts, query, r6


def _applies(rule: R.Rule) -> str:
    return " or ".join(f"path like '%{e}'" for lang in rule.languages for e in T.LANGUAGE_ENDINGS[lang]) or "true"


PRIORITY = "case level when 'error' then 0 when 'warning' then 1 when 'note' then 2 else 3 end"


@query("select run_id, count(*) as n from {findings} group by run_id order by run_id desc limit 1")
def latest_run(t):
    return t("findings").groupBy("run_id").agg(F.count("*").alias("n")).orderBy(F.desc("run_id")).limit(1)


@query(f"select ord, {PRIORITY} as priority, uri, message from {{findings}}")
def report_order(t):
    """In the order of a report: by priority, file and first place."""
    f = t("findings").select("ord", P.priority(F.col("level")).alias("priority"), "uri", T.truncate_bytes(F.col("message"), 80).alias("message"))
    return f.orderBy("priority", "uri", "ord")


@query(f"select uri, rule_id, start_line, count(*) as n from ({_scan_sql(R.BUILT_IN)}) group by all")
def regex_scan_lines(t):
    return R.regex_scan(artifacts(t), R.BUILT_IN).groupBy("uri", "rule_id", "start_line").agg(F.count("*").alias("n"))


@query(" union all ".join(f"select path, '{r.id}' as rule_id from {ARTIFACTS} where {_applies(r)}" for r in R.BUILT_IN))
def lang_filter(t):
    """The rules that apply to each artifact."""
    ids = F.array_compact(F.array(*[F.when(T.language_matches(F.col("path"), r.languages), F.lit(r.id)) for r in R.BUILT_IN]))
    return artifacts(t).select("path", F.explode(ids).alias("rule_id"))


@query(f"select case when path like '%.go' then 'go' when path like '%.py' then 'python' when path like '%.ts' then 'typescript' else '' end as lang, count(*) as n from {ARTIFACTS} group by 1")
def lang_detect(t):
    return artifacts(t).groupBy(T.detect_language(F.col("path")).alias("lang")).agg(F.count("*").alias("n"))


@query("select doc_id, cast(strlen(text) // 4 as bigint) as tokens from {documents}")
def token_estimate(t):
    return t("documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


LINES = "string_split(content, chr(10))"


@query(f"select path, array_to_string({LINES}[1:7], chr(10)) || case when len({LINES}) > 7 then chr(10) else '' end as region from {ARTIFACTS} where len({LINES}) >= 3")
def context_region(t):
    """Lines 3 to 5 with two around them; null where that is the region itself."""
    a = artifacts(t).where(T.snippet(F.col("content"), F.lit(3), F.lit(5)).isNotNull())
    return a.select("path", V.surrounding(F.col("content"), 3, 5).alias("region"))


@query("select ord, greatest(start_line - 10, 1) as window_start, end_line + 10 as window_end, start_line - greatest(start_line - 10, 1) + 1 as line_in_window from {findings}")
def scoped_window(t):
    return V.analysis_window(t("findings")).select("ord", "window_start", "window_end", "line_in_window")


@query("select ord from {findings} where start_line <= 20 and end_line >= 15")
def range_overlap(t):
    return V.overlapping(t("findings"), 15, 20).select("ord")


FUNCTION_LINES = "select p_partkey as fn_ord, concat('src/f', cast(p_partkey % 300 as string), '.go') as uri, p_partkey % 40 as start_line, p_partkey % 40 + p_size as end_line"


@query(f"select fn_ord, uri, cast(end_line - start_line + 1 as bigint) as n from ({FUNCTION_LINES} from {{part}}) where end_line - start_line + 1 > 40")
def ast_function_length(t):
    """Functions of an index that are longer than 40 lines."""
    p = t("part").selectExpr("p_partkey as fn_ord", "concat('src/f', p_partkey % 300, '.go') as uri", "p_partkey % 40 as start_line", "p_partkey % 40 + p_size as end_line")
    return V.long_functions(p).select("fn_ord", "uri", "n")


@query("select r.id as rule_id, count(*) as n from (%s) f join (%s) r on r.id = f.rule_id where list_contains(r.cwe, 'CWE-252') or r.category = 'security' group by 1" % (_scan_sql(R.BUILT_IN), " union all ".join("select %r as id, %r as category, cast(%r as varchar[]) as cwe" % (r.id, r.category, r.cwe) for r in R.BUILT_IN)))
def rules_by_cwe(t):
    """Findings of the rules of a category or a CWE number."""
    picked = [r for r in R.BUILT_IN if "CWE-252" in r.cwe or r.category == "security"]
    return R.regex_scan(artifacts(t), picked).groupBy("rule_id").agg(F.count("*").alias("n"))


HELP = {r.id: r.cwe for r in R.BUILT_IN}


@query("select distinct rule_id, case rule_id %s end as uri from (%s)" % (" ".join(f"when '{k}' then " + (f"'https://cwe.mitre.org/data/definitions/{c[0][4:]}.html'" if c else "null") for k, c in HELP.items()), _scan_sql(R.BUILT_IN)))
def help_uri(t):
    """Pages on the rules that found something."""
    cwe = F.create_map(*[x for k, c in HELP.items() for x in (F.lit(k), F.array(*map(F.lit, c)).cast("array<string>"))])
    none = F.array().cast("array<string>")
    return R.regex_scan(artifacts(t), R.BUILT_IN).select("rule_id").distinct().select("rule_id", T.help_uri(none, F.try_element_at(cwe, F.col("rule_id"))).alias("uri"))


ALERTS = "select o_orderkey as number, case o_orderstatus when 'F' then 'fixed' when 'O' then 'dismissed' else 'open' end as state, case when o_orderkey % 3 = 0 then 'false positive' else 'used in tests' end as dismissed_reason"


@query(f"select number, case when state = 'fixed' then 'useful' when dismissed_reason = 'false positive' then 'wrong' else 'noise' end as verdict from ({ALERTS} from {{orders}}) where state <> 'open'")
def alert_verdicts(t):
    a = t("orders").selectExpr(*ALERTS.removeprefix("select ").replace(", case", "\ncase").split("\n"))
    return readers.alert_verdicts(a).select("number", "verdict")


@query("select id, layer, s_ord from (select s_ord, rule_id as id, s_ord % 3 as layer from {suppressions}) qualify row_number() over (partition by id order by layer desc, s_ord desc) = 1")
def rule_overlay(t):
    s = t("suppressions").select("s_ord", F.col("rule_id").alias("id"), (F.col("s_ord") % 3).alias("layer"))
    return P.overlay(s.withColumn("place", F.struct("layer", "s_ord")), "id", "place").select("id", "layer", "s_ord")


POLICIES = "select concat('p', cast(c_custkey % 97 as string)) as name, c_custkey as layer, case when c_custkey % 3 = 0 then '' else c_name end as description, case when c_custkey % 2 = 0 then '' else c_mktsegment end as severity, case when c_custkey % 5 = 0 then '' else c_name end as instruction, c_custkey % 7 > 2 as enabled"
LAST = "arg_max({0}, layer) filter ({0} <> '')"


@query(f"""select name, coalesce({LAST.format('description')}, '') as description, coalesce({LAST.format('severity')}, '') as severity, coalesce({LAST.format('instruction')}, '') as instruction,
coalesce(arg_max(enabled, layer) filter (enabled or description = '' and severity = '' and instruction = ''), false) as enabled from ({POLICIES} from {{customer}}) group by name""")
def policy_overlay(t):
    c = t("customer").withColumns({"name": F.expr("concat('p', c_custkey % 97)"), "layer": F.col("c_custkey"), "description": F.expr("if(c_custkey % 3 = 0, '', c_name)"), "severity": F.expr("if(c_custkey % 2 = 0, '', c_mktsegment)"), "instruction": F.expr("if(c_custkey % 5 = 0, '', c_name)"), "enabled": F.expr("c_custkey % 7 > 2")})
    return P.policy_overlay(c, ["description", "severity", "instruction"])


@query("select c_nationkey as team, string_agg(concat('- ', c_name, ' [', case when c_custkey % 2 = 0 then 'error' else 'note' end, ']: check ', cast(c_custkey as string), chr(10)), '' order by c_name) as text from {customer} where c_custkey % 4 <> 1 group by 1")
def policy_text(t):
    n = t("customer").selectExpr("c_nationkey as team", "c_name as name", "if(c_custkey % 2 = 0, 'error', 'note') as severity", "concat('check ', c_custkey) as instruction", "c_custkey % 4 <> 1 as enabled")
    return P.policy_text(n, "team")


def _diffs(t) -> DataFrame:
    """A diff a user: two files, the first with a hunk that adds or removes, the second with one that does both."""
    u = t("events").groupBy("user_id").agg(F.count("*").alias("n"))
    return u.select(F.col("user_id").alias("diff_id"), F.expr("concat('intro\ndiff --git a/x.go b/x', user_id, '.go\n--- a/x.go\n+++ b/x.go\n@@ -1,2 +', n, ',', user_id % 5, ' @@\n', if(user_id % 3 = 0, '-old', '+new'), '\n same\ndiff --git a/y.py b/y.py\n@@ -5 +', user_id % 50 + 1, ' @@\n-a\n+b')").alias("diff"))


USERS = "(select user_id as diff_id, count(*) as n from {events} group by user_id)"
SECOND = "select diff_id, 'y.py' as path"


@query(f"select diff_id, concat('x', cast(diff_id as string), '.go') as path, concat('--- a/x.go', chr(10), '+++ b/x.go', chr(10), '@@ -1,2 +', cast(n as string), ',', cast(diff_id % 5 as string), ' @@', chr(10), case when diff_id % 3 = 0 then '-old' else '+new' end, chr(10), ' same') as content from {USERS} union all {SECOND}, concat('@@ -5 +', cast(diff_id % 50 + 1 as string), ' @@', chr(10), '-a', chr(10), '+b') from {USERS}")
def diff_split(t):
    return readers.split_diff(_diffs(t)).select("diff_id", "path", "content")


@query(f"select diff_id, concat('x', cast(diff_id as string), '.go') as path, cast(n as integer) as first, cast(greatest(n, n + diff_id % 5 - 1) as integer) as last from {USERS} union all {SECOND}, cast(diff_id % 50 + 1 as integer), cast(diff_id % 50 + 1 as integer) from {USERS}")
def diff_range(t):
    d = readers.split_diff(_diffs(t)).withColumn("r", readers.changed_range(F.col("content")))
    return d.select("diff_id", "path", F.col("r.start").alias("first"), F.col("r.end").alias("last"))


@query(f"select diff_id, concat('x', cast(diff_id as string), '.go') as path, case when diff_id % 3 = 0 then 0 else 1 end as added, case when diff_id % 3 = 0 then 1 else 0 end as removed, case when diff_id % 3 = 0 then 'remove-only' else 'add-only' end as kind, diff_id % 3 = 0 as movement from {USERS} union all {SECOND}, 1, 1, 'mixed', diff_id % 3 = 0 from {USERS}")
def diff_stats(t):
    return P.diff_stats(readers.split_diff(_diffs(t)))


@query("select doc_id, source, least(strlen(coalesce(text, '')), 65536) as taken, strlen(coalesce(text, '')) > 65536 as cut from {documents} qualify sum(least(strlen(coalesce(text, '')), 65536)) over (partition by source order by doc_id) <= 262144")
def context_budget(t):
    return P.context_budget(t("documents").withColumn("content", F.coalesce("text", F.lit(""))), "source", "doc_id").select("doc_id", "source", "taken", "cut")


@query("select e.ord, case when l.ord is not null then 'local' when r.ord is not null then 'remote' else 'miss' end as found, coalesce(l.ms, r.ms + 1) as value, l.ord is null and r.ord is not null as warm from {analysis_events} e left join (select ord, ms from {analysis_events} where cache_result = 'hit') l on l.ord = e.ord left join (select ord, ms from {analysis_events} where ord % 3 = 0) r on r.ord = e.ord")
def cache_lookup(t):
    e = t("analysis_events")
    local, remote = e.where("cache_result = 'hit'").selectExpr("ord", "ms as value"), e.where("ord % 3 = 0").selectExpr("ord", "ms + 1 as value")
    return P.cache_lookup(e.select("ord"), local, remote, "ord")


@query("select uri, tier, count(*) as messages, cast(sum(finding_count) as bigint) as findings, min(ord) as first_ord from (select *, sum(fresh) over (partition by uri order by ord) as flush from (select *, case when lag(tier) over (partition by uri order by ord) = tier then 0 else 1 end as fresh from {analysis_events})) group by uri, flush, tier")
def tier_rollup(t):
    return P.tier_rollup(t("analysis_events"), "uri").select("uri", "tier", "messages", "findings", "first_ord")


ENDING = "regexp_extract(coalesce(uri, ''), '\\.[^./]*$', 0)"


@query(f"select run_id, 'analysis' as type, null::bigint as ord, count(distinct rule_id) as rules, array_to_string(list_sort(list(distinct {ENDING}) filter ({ENDING} <> '')), ',') as endings, count(*) as findings from {{findings}} group by run_id union all select run_id, 'finding', ord, 1, {ENDING}, 1 from {{findings}}")
def calibration_events(t):
    return P.calibration_events(t("findings"))


@query("select event_type, round(avg(case when event_id % 7 = 0 then 1.0 else event_id % 5 end), 6) as score, round(avg(case when event_id % 7 <> 0 and event_id % 2 = 0 then 1.0 else 0 end), 6) as valid_rate, round(avg(case when event_id % 7 = 0 or event_id % 2 = 1 then 1.0 else 0 end), 6) as noise_rate from {events} group by event_type")
def judge_stats(t):
    a = t("events").selectExpr("event_type", "if(event_id % 7 = 0, 'no answer', concat('{\"score\": ', event_id % 5, ', \"verdict\": \"', if(event_id % 2 = 0, 'valid', 'noise'), '\"}')) as answer")
    s = P.judge_stats(a, "event_type")
    return s.select("event_type", *[r6(F.col(c), c) for c in ("score", "valid_rate", "noise_rate")])


@query("select event_id, coalesce(json_extract_string(props, '$.k'), '') as k from {events}")
def parse_last_json(t):
    """A field of the last object in a text that has others and words around it."""
    return t("events").select("event_id", T.last_json_field(F.concat(F.lit('so {"k": "first"} then '), "props", F.lit(" end")), "k").alias("k"))


@query("select variant, round(max(total) filter (run = 1) - max(total) filter (run = 0), 6) as total, round(max(cost) filter (run = 1) - max(cost) filter (run = 0), 6) as cost from {runs} group by variant")
def bench_compare(t):
    c = P.compare(t("runs"), ["variant"], "run", 1, 0, ["total", "cost"])
    return c.select("variant", r6(F.col("total"), "total"), r6(F.col("cost"), "cost"))


PACKAGES = "(select o_orderpriority as condition, o_orderkey % 4 as run, concat('k', cast(o_custkey % 9 as string)) as package, cast(count(*) as double) as total from {orders} group by all)"


def _packages(t) -> DataFrame:
    return t("orders").groupBy(F.col("o_orderpriority").alias("condition"), (F.col("o_orderkey") % 4).alias("run"), F.expr("concat('k', o_custkey % 9)").alias("package")).agg(F.count("*").cast("double").alias("total"))


@query(f"select condition, count(*) as runs, round(avg(total), 6) as total_mean, round(coalesce(stddev_samp(total), 0), 6) as total_std from (select condition, run, sum(total) as total from {PACKAGES} group by all) group by condition")
def condition_summary(t):
    s = P.two_level(_packages(t), "condition", "run", ["total"])
    return s.select("condition", "runs", r6(F.col("total_mean"), "total_mean"), r6(F.col("total_std"), "total_std"))


@query(f"select condition, package, count(*) as runs, round(avg(total), 6) as total from {PACKAGES} group by condition, package")
def package_breakdown(t):
    return _packages(t).groupBy("condition", "package").agg(F.count("*").alias("runs"), r6(F.avg("total"), "total"))


@query("select event_id, cast(case when event_id % 11 = 0 then 0 else event_id % 7 * 1000 end as bigint) as queue_ms, cast(case when event_id % 11 = 0 or event_id % 13 = 0 then 0 else event_id % 5 * 1000 end as bigint) as analysis_ms, cast(case when event_id % 13 = 0 then 0 else (event_id % 7 + event_id % 5) * 1000 end as bigint) as total_ms from {events}")
def timing(t):
    e = t("events").selectExpr("event_id", "ts as queued", "if(event_id % 11 = 0, null, ts + make_dt_interval(0, 0, 0, event_id % 7)) as started", "if(event_id % 13 = 0, null, ts + make_dt_interval(0, 0, 0, event_id % 7 + event_id % 5)) as completed")
    return P.timing(e).select("event_id", "queue_ms", "analysis_ms", "total_ms")


CODE = "(select s_suppkey as edit_ord, concat('r', cast(s_suppkey % 40 as string)) as rule_id, cast(s_suppkey % 50 + 1 as int) as line, case when s_suppkey % 3 = 0 then '' else concat('fix ', cast(s_suppkey as string)) end as replacement from {supplier})"


@query(f"select d.edit_ord, f.ord, case when d.replacement <> '' then 'edit' else 'advice' end as kind, f.end_line as edit_end from {CODE} d join (select rule_id, start_line, min(ord) as ord, arg_min(end_line, ord) as end_line from {{findings}} group by all) f on f.rule_id = d.rule_id and f.start_line = d.line")
def code_actions(t):
    """For each diagnostic the first finding of its rule and line: an edit if there is a fix, else advice."""
    d = t("supplier").selectExpr("s_suppkey as edit_ord", "concat('r', s_suppkey % 40) as rule_id", "cast(s_suppkey % 50 + 1 as int) as start_line", "s_suppkey % 3 <> 0 as fixed")
    return V.code_actions(d, t("findings")).select("edit_ord", "ord", "kind", "edit_end")


@query(f"select g.run_id, concat('Decision: ', g.decision, ' based on ', cast(count(*) filter (suppressed_by is null) as varchar), ' findings', case when count(suppressed_by) > 0 then concat(', ', cast(count(suppressed_by) as varchar), ' suppressed') else '' end) as reason from {GATE} g join {SUPPRESSED % DIFFED} f on f.run_id = g.run_id group by g.run_id, g.decision")
def verdict_reason(t):
    """What a verdict says of itself; absent findings count, suppressed ones apart."""
    f = _gated(t)
    n = f.groupBy("run_id").agg(F.count_if(F.col("suppressed_by").isNull()).alias("open"), F.count("suppressed_by").alias("hidden"))
    more = F.when(F.col("hidden") > 0, F.concat(F.lit(", "), F.col("hidden").cast("string"), F.lit(" suppressed"))).otherwise("")
    return A.gate(f).join(n, "run_id").select("run_id", F.concat(F.lit("Decision: "), "decision", F.lit(" based on "), F.col("open").cast("string"), F.lit(" findings"), more).alias("reason"))


def _sources(t) -> DataFrame:
    """A Python file a user: parameters, nested ifs, a handler and a line an event."""
    u = t("events").groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
    ifs = "transform(sequence(1, cast(user_id % 7 + 1 as int)), i -> concat(repeat(' ', i), 'if x:\\n'))"
    head = "concat('def f(', array_join(transform(sequence(1, cast(user_id % 8 + 1 as int)), i -> concat('a', i)), ', '), '):\\n try:\\n  x = 1\\n except ValueError:\\n  ', if(user_id % 2 = 0, 'pass', 'x = 2'), '\\n')"
    body = f"concat({head}, array_join({ifs}, ''), repeat(' ', cast(user_id % 7 + 2 as int)), 'x = 3\\n', repeat(' y = 1\\n', n), 'z = 2\\n')"
    return u.select(F.expr("concat('src/u', user_id, if(user_id % 10 = 9, '.txt', '.py'))").alias("path"), F.expr(body).alias("content"))


USER_FILES = "(select user_id as u, count(*) as n, 6 + user_id % 7 + 1 + count(*) as last from {events} where user_id % 10 <> 9 group by user_id)"
AST_ROW = "select concat('src/u', cast(u as varchar), '.py') as uri, "


@query(f"{AST_ROW} 'AST001' as rule_id, 1 as start_line, cast(last as integer) as end_line from {USER_FILES} where last > 50 union all {AST_ROW} 'AST004', 1, cast(last as integer) from {USER_FILES} where u % 8 + 1 > 5 union all {AST_ROW} 'AST003', 4, 5 from {USER_FILES} where u % 2 = 0 union all {AST_ROW} 'AST002', 10, cast(6 + u % 7 + 1 as integer) from {USER_FILES} where u % 7 + 1 > 4")
def ast_scan(t):
    return S.syntax_scan(_sources(t)).select("uri", "rule_id", "start_line", "end_line")
