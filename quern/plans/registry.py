"""Registered queries, and the SQL that restates each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import findings as A
from ..operators import measures as M
from ..operators import rules as R
from ..operators import views as V
from .bindings import for_duckdb, view

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register f(t) -> DataFrame, where t(name) gives a table or view."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(lambda n: view(spark, sf_dir, n))
        if sql:
            ORACLES[key] = for_duckdb(sql)
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def one_run(findings: DataFrame) -> DataFrame:
    return findings.drop("run_id")


def artifacts(t) -> DataFrame:
    """One file a user: its lines in the order of their events."""
    ending = F.element_at(F.array(*map(F.lit, (".go", ".py", ".ts", ".txt"))), (F.col("user_id") % 4 + 1).cast("int"))
    lines = t("lines").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("x"))
    return lines.select(F.concat(F.lit("src/u"), F.col("user_id").cast("string"), ending).alias("path"), F.array_join("x.line", "\n").alias("content"))


ARTIFACTS = "(select concat('src/u', cast(user_id as string), case user_id % 4 when 0 then '.go' when 1 then '.py' when 2 then '.ts' else '.txt' end) as path, string_agg(line, chr(10) order by event_id) as content from {lines} group by user_id)"
NL = "(length({0}) - length(replace({0}, chr(10), '')))"
ENDINGS = {"go": "path like '%.go'"}


def _scan_sql(rules) -> str:
    parts = []
    for r in rules:
        p = r.pattern.replace("'", "''")
        where = " or ".join(f"path like '%{e}'" for lang in r.languages for e in T.LANGUAGE_ENDINGS[lang]) or "true"
        parts.append(f"""select path as uri, '{r.id}' as rule_id, '{r.level}' as level, cast({r.confidence} as double) as confidence,
  cast(1 + list_sum([{NL.format('s')} for s in segs[1:k]]) + coalesce(list_sum([{NL.format('m')} for m in ms[1:k - 1]]), 0) as integer) as start_line, ms[k] as match
from (select path, segs, ms, unnest(range(1, len(ms) + 1)) as k from (select path, regexp_split_to_array(content, '{p}') as segs, regexp_extract_all(content, '{p}') as ms from {ARTIFACTS} where {where}))""")
    return "\nunion all\n".join(parts)


@query(_scan_sql(R.BUILT_IN))
def regex_scan(t):
    return R.regex_scan(artifacts(t), R.BUILT_IN).select("uri", "rule_id", "level", "confidence", "start_line", "match")


for _rule in R.BUILT_IN:
    query(_scan_sql([_rule]), f"rule_{_rule.id}")(lambda t, r=_rule: R.regex_scan(artifacts(t), [r]).select("uri", "rule_id", "level", "confidence", "start_line", "match"))


@query(f"select path, cast(length(content) - length(replace(content, chr(10), '')) + 1 as bigint) as lines, strlen(content) // 4 as tokens, case when path like '%.go' then 'go' when path like '%.py' then 'python' when path like '%.ts' then 'typescript' else '' end as lang from {ARTIFACTS}")
def artifact_stats(t):
    return artifacts(t).select("path", T.line_count(F.col("content")).alias("lines"), T.token_estimate(F.col("content")).alias("tokens"), T.detect_language(F.col("path")).alias("lang"))


@query(f"select path, sha256(concat(content, chr(0), path)) as key from {ARTIFACTS}")
def content_key(t):
    return artifacts(t).select("path", T.content_key(F.col("content"), F.col("path")).alias("key"))


@query(f"select path, array_to_string(string_split(content, chr(10))[3:5], chr(10)) || case when len(string_split(content, chr(10))) > 5 then chr(10) else '' end as snippet from {ARTIFACTS} where len(string_split(content, chr(10))) >= 3")
def snippets(t):
    return artifacts(t).select("path", T.snippet(F.col("content"), F.lit(3), F.lit(5)).alias("snippet")).where("snippet is not null")


NORM = "case when {0} is null then null else case when {1} = '' then '.' else {1} end end"


@query("select s_ord, case when file = '' then '.' else replace(replace(replace(file, './src//', 'src/'), 'src/x/../', 'src/'), '//', '/') end as path from {suppressions}")
def normalize_path(t):
    return t("suppressions").select("s_ord", T.normalize_path(F.col("file")).alias("path"))


@query("select ord, uri, rule_id, start_line from {findings} where uri is not null qualify row_number() over (partition by rule_id, uri, start_line order by case coalesce(tier, 'instant') when 'comprehensive' then 3 when 'fast' then 2 when 'instant' then 1 else 0 end desc, ord) = 1")
def tier_dedup(t):
    return A.tier_dedup(one_run(t("findings"))).select("ord", "uri", "rule_id", "start_line")


@query("""
with recursive f as materialized (select *, coalesce(confidence, 0) as c, row_number() over (partition by rule_id, uri order by ord) as rn from {findings} where uri is not null),
fold as (
  select rule_id, uri, rn, ord as b, start_line as s, end_line as e, c, cast(null as bigint) as extra from f where rn = 1
  union all
  select f.rule_id, f.uri, f.rn,
    case when f.start_line <= fold.e and fold.s <= f.end_line and f.c > fold.c then f.ord else fold.b end,
    case when f.start_line <= fold.e and fold.s <= f.end_line and f.c > fold.c then f.start_line else fold.s end,
    case when f.start_line <= fold.e and fold.s <= f.end_line and f.c > fold.c then f.end_line else fold.e end,
    case when f.start_line <= fold.e and fold.s <= f.end_line and f.c > fold.c then f.c else fold.c end,
    case when f.start_line <= fold.e and fold.s <= f.end_line then null else f.ord end
  from fold join f on f.rule_id = fold.rule_id and f.uri = fold.uri and f.rn = fold.rn + 1)
select extra as ord from fold where extra is not null
union all select b from (select *, max(rn) over (partition by rule_id, uri) as top from fold) where rn = top
union all select ord from {findings} where uri is null""")
def overlap_dedup(t):
    return A.overlap_dedup(one_run(t("findings"))).select("ord")


@query("select run_id, ord, uri, rule_id, start_line from (select *, l as run_id from (select * exclude (run_id), concat('run', cast(ord % 3 as varchar)) as l from {findings})) where uri is not null qualify row_number() over (partition by run_id, rule_id, uri, start_line order by case coalesce(tier, 'instant') when 'comprehensive' then 3 when 'fast' then 2 when 'instant' then 1 else 0 end desc, ord) = 1")
def tier_dedup_by_run(t):
    f = t("findings").withColumn("run_id", F.expr("concat('run', ord % 3)"))
    return A.tier_dedup(f).select("run_id", "ord", "uri", "rule_id", "start_line")


@query("""
with recursive g as (select * replace (concat('run', cast(ord % 3 as varchar)) as run_id), row_number() over (partition by ord % 3 order by ord) as place from {findings}),
f as materialized (select *, coalesce(confidence, 0) as c, row_number() over (partition by run_id, rule_id, uri order by place) as rn from g where uri is not null),
fold as (
  select run_id, rule_id, uri, rn, place as b, start_line as s, end_line as e, c, cast(null as bigint) as extra from f where rn = 1
  union all
  select f.run_id, f.rule_id, f.uri, f.rn, case when hit and f.c > fold.c then f.place else fold.b end, case when hit and f.c > fold.c then f.start_line else fold.s end,
    case when hit and f.c > fold.c then f.end_line else fold.e end, case when hit and f.c > fold.c then f.c else fold.c end, case when hit then null else f.place end
  from fold join (select * from f) f on f.run_id = fold.run_id and f.rule_id = fold.rule_id and f.uri = fold.uri and f.rn = fold.rn + 1, lateral (select f.start_line <= fold.e and fold.s <= f.end_line as hit))
select run_id, extra as place from fold where extra is not null
union all select run_id, b from (select *, max(rn) over (partition by run_id, rule_id, uri) as top from fold) where rn = top
union all select run_id, place from g where uri is null""")
def overlap_dedup_by_run(t):
    """Runs that number their findings anew, as read_logs() does."""
    f = t("findings").withColumn("run_id", F.expr("concat('run', ord % 3)"))
    f = f.withColumn("ord", F.row_number().over(Window.partitionBy("run_id").orderBy("ord")))
    return A.overlap_dedup(f).select("run_id", F.col("ord").cast("long").alias("place"))


FP = "case when snippet is not null and trim(snippet) <> '' then substr(sha256(concat(rule_id, chr(10), array_to_string([x for x in [trim(y) for y in string_split(snippet, chr(10))] if x <> ''], chr(10)))), 1, 32) end"


@query(f"select ord, {FP} as fp from {{findings}}")
def content_fp(t):
    return t("findings").select("ord", T.content_fingerprint(F.col("rule_id"), F.col("snippet")).alias("fp"))


@query("select ord, substr(sha256(concat_ws('|', rule_id, coalesce(uri, ''), cast(start_line as varchar), message)), 1, 32) as fp from {findings}")
def line_fp(t):
    return t("findings").select("ord", T.line_fingerprint(F.col("rule_id"), F.col("uri"), F.col("start_line"), F.col("message")).alias("fp"))


def _diffed(t) -> DataFrame:
    f = t("findings").withColumn("fp", T.content_fingerprint(F.col("rule_id"), F.col("snippet")))
    return A.baseline_diff(f.where("side = 0"), f.where("side = 1"))


DIFFED = f"""(with f as materialized (select *, {FP} as fp from {{findings}})
select * exclude (k), case when fp is null then null when k is null then 'new' else 'unchanged' end as baseline_state from f left join (select distinct fp as k from f where side = 1 and fp is not null) on fp = k where side = 0
union all select *, 'absent' from f where side = 1 and fp is not null and fp not in (select fp from f where side = 0 and fp is not null))"""


@query(f"select ord, fp, baseline_state from {DIFFED}")
def baseline_diff(t):
    return _diffed(t).select("ord", "fp", "baseline_state")


@query(f"select coalesce(baseline_state, 'none') as state, count(*) as n from {DIFFED} group by 1")
def baseline_summary(t):
    return _diffed(t).groupBy(F.coalesce("baseline_state", F.lit("none")).alias("state")).agg(F.count("*").alias("n"))


def _thresholds(t) -> DataFrame:
    return t("suppressions").groupBy("rule_id").agg((F.max("s_ord") % 10 / 10).cast("double").alias("suppress_below"))


THRESHOLDS = "(select rule_id, cast(max(s_ord) % 10 as double) / 10 as suppress_below from {suppressions} group by rule_id)"


@query(f"select ord, coalesce(suppress_below <> 0 and coalesce(confidence, 0) < suppress_below, false) as dropped from {{findings}} f left join {THRESHOLDS} t on f.rule_id = t.rule_id")
def threshold_keep(t):
    return A.with_threshold(t("findings"), _thresholds(t)).select("ord", "dropped")


@query(f"select ord, f.rule_id, confidence from {{findings}} f join {THRESHOLDS} t on f.rule_id = t.rule_id where suppress_below <> 0 and coalesce(confidence, 0) < suppress_below")
def threshold_dropped(t):
    return A.with_threshold(t("findings"), _thresholds(t)).where("dropped").select("ord", "rule_id", "confidence")


SUPPRESSED = "(select f.*, (select min(struct_pack(s := s.s_ord, r := s.reason)).r from {suppressions} s where s.rule_id = f.rule_id and (s.file = '' or replace(replace(s.file, './src//', 'src/'), 'src/x/../', 'src/') = replace(f.uri, './', ''))) as suppressed_by from %s f)"


@query(f"select ord, suppressed_by from {SUPPRESSED % '{findings}'}")
def suppress_apply(t):
    return A.apply_suppressions(t("findings"), t("suppressions")).select("ord", "suppressed_by")


@query("""
select rule_id, path as file, arg_min(s_ord, struct_pack(a := side, b := s_ord)) as s_ord, arg_max(reason, struct_pack(a := side, b := s_ord)) as reason
from (select rule_id, case when file = '' then '' else replace(replace(file, './src//', 'src/'), 'src/x/../', 'src/') end as path, s_ord, reason, case when s_ord % 3 = 0 then 1 else 0 end as side from {suppressions}) group by rule_id, path""")
def suppression_upsert(t):
    s = t("suppressions")
    return A.suppression_upsert(s.where("s_ord % 3 <> 0"), s.where("s_ord % 3 = 0")).select("rule_id", "file", "s_ord", "reason")


@query("select s_ord, rule_id, case when file = '' then '(all)' else file end as file from {suppressions} where reason like 'why 1%'")
def suppression_list(t):
    return V.listed(t("suppressions"), "why 1").select("s_ord", "rule_id", "file")


def _gated(t) -> DataFrame:
    return A.apply_suppressions(_diffed(t), t("suppressions"))


ACT = "(suppressed_by is null and coalesce(baseline_state, '') not in ('unchanged', 'absent'))"
GATE = f"""(select run_id, case when count(*) filter ({ACT} and level = 'error' and confidence > 0.85) > 0 then 'reject' when count(*) filter ({ACT}) = 0 then 'merge' else 'review' end as decision,
count(*) filter ({ACT}) as n_actionable, count(*) filter ({ACT} and level = 'error' and confidence > 0.85) as n_rejecting from {SUPPRESSED % DIFFED} group by run_id)"""


@query(GATE[1:-1])
def gate_verdict(t):
    return A.gate(_gated(t))


@query(f"select f.run_id, decision, ord, level from {SUPPRESSED % DIFFED} f join {GATE} g on f.run_id = g.run_id where suppressed_by is null and (decision = 'reject' and level = 'error' or decision = 'review' and level in ('error', 'warning'))")
def verdict_relevant(t):
    f = _gated(t)
    return A.relevant(f, A.gate(f)).select("run_id", "decision", "ord", "level")


@query("select uri, level, count(*) as n from {findings} where level in ('error', 'warning') group by uri, level", "severity_filter")
def _severity(t):
    return t("findings").where(F.col("level").isin("error", "warning")).groupBy("uri", "level").agg(F.count("*").alias("n"))


@query("select level, case level when 'error' then 0 when 'warning' then 1 when 'note' then 2 else 3 end as priority, count(*) as n, count(distinct uri) as files from {findings} group by level")
def severity_counts(t):
    return V.severity_table(t("findings"))


@query("select ord, case level when 'error' then 8.0::double when 'warning' then 5.0::double else 2.0::double end as severity, case when tier = 'comprehensive' then 'high' else 'medium' end as precision from {findings}")
def github_enrich(t):
    return V.scores(t("findings")).select("ord", "severity", "precision")


@query("select ord, start_line + 20 as start_line from {findings} where start_line between 10 and 30")
def line_range_filter(t):
    return V.within_lines(t("findings"), 10, 30, 20).select("ord", "start_line")


@query("select ord, greatest(start_line - 1, 0) as line, greatest(end_line - 1, 0) as end_line, case level when 'error' then 1 when 'warning' then 2 else 3 end as severity, concat('quern/', coalesce(tier, 'instant')) as source from {findings} where uri is not null")
def diagnostics(t):
    return V.diagnostics(t("findings")).select("ord", "line", F.col("last_line").alias("end_line"), "severity", "source")


FUNCTIONS = "(select p_partkey as fn_ord, concat('src/f', cast(p_partkey % 300 as string), '.go') as uri, concat('fn', cast(p_partkey as string)) as name, cast(p_partkey % 40 as int) as start_line, cast(p_partkey % 40 + p_size as int) as end_line from {part})"


@query(f"select f.ord, (select min(struct_pack(a := g.end_line - g.start_line, b := g.fn_ord, c := g.name)).c from {FUNCTIONS} g where g.uri = f.uri and f.start_line between g.start_line and g.end_line) as function from {{findings}} f")
def enclosing_function(t):
    fn = t("part").select(F.col("p_partkey").alias("fn_ord"), F.concat(F.lit("src/f"), (F.col("p_partkey") % 300).cast("string"), F.lit(".go")).alias("uri"), F.concat(F.lit("fn"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_partkey") % 40).cast("int").alias("start_line"), (F.col("p_partkey") % 40 + F.col("p_size")).cast("int").alias("end_line"))
    return A.enclosing(t("findings"), fn).select("ord", "function")


RULE_ROWS = " union all ".join("select %r as rule_id, cast(%r as varchar[]) as cwe, cast(%r as varchar[]) as owasp" % (r.id, r.cwe, r.owasp) for r in R.BUILT_IN)


@query(f"select 'CWE' as taxonomy, list_sort(list(distinct x)) as taxa from (select unnest(cwe) as x from (select * from ({RULE_ROWS}) where rule_id in (select rule_id from ({_scan_sql(R.BUILT_IN)})))) union all select 'OWASP', list_sort(list(distinct x)) from (select unnest(owasp) as x from (select * from ({RULE_ROWS}) where rule_id in (select rule_id from ({_scan_sql(R.BUILT_IN)}))))")
def taxonomies(t):
    """Distinct taxa of the rules that found something."""
    found = R.regex_scan(artifacts(t), R.BUILT_IN).select("rule_id").distinct()
    taxa = lambda pick: F.coalesce(F.try_element_at(F.create_map(*[x for r in R.BUILT_IN for x in (F.lit(r.id), F.array(*map(F.lit, pick(r))).cast("array<string>"))]), F.col("rule_id")), F.array().cast("array<string>"))
    rows = found.select(F.explode(F.concat(F.transform(taxa(lambda r: r.cwe), lambda x: F.struct(F.lit("CWE").alias("taxonomy"), x.alias("id"))), F.transform(taxa(lambda r: r.owasp), lambda x: F.struct(F.lit("OWASP").alias("taxonomy"), x.alias("id"))))).alias("x"))
    return rows.groupBy("x.taxonomy").agg(F.sort_array(F.collect_set("x.id")).alias("taxa"))


@query("select count(*) as analyses, count(*) filter (error <> '') as errors, cast(sum(finding_count) as bigint) as findings, count(*) filter (cache_result = 'hit') as hits, count(*) filter (cache_result = 'miss') as misses, round(count(*) filter (cache_result = 'hit') / count(*) filter (cache_result <> ''), 6) as hit_rate, round(sum(finding_count) / count(*), 6) as avg_findings from {analysis_events}")
def metrics_summary(t):
    return M.metrics_summary(t("analysis_events")).withColumns({c: F.round(c, 6) for c in ("hit_rate", "avg_findings")})


@query("select tier, count(*) as n, round(avg(ms), 6) as avg_ms, round(count(*) filter (error <> '') / count(*), 6) as error_rate from {analysis_events} where ts > (select max(ts) - interval 5 day from {analysis_events}) group by tier")
def metrics_by_tier(t):
    return M.windowed(t("analysis_events"), 5 * 86400).groupBy("tier").agg(F.count("*").alias("n"), r6(F.avg("ms"), "avg_ms"), r6(F.count_if(F.col("error") != "") / F.count("*"), "error_rate"))


@query("select tier, a[cast(floor((len(a) - 1) * 0.5) as int) + 1] as p50, a[cast(floor((len(a) - 1) * 0.95) as int) + 1] as p95, a[cast(floor((len(a) - 1) * 0.99) as int) + 1] as p99 from (select tier, list_sort(list(ms)) as a from {analysis_events} group by tier)")
def latency_percentiles(t):
    return M.percentiles(t("analysis_events"), "tier", "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("select cast(date_trunc('hour', ts) as timestamp) as hour, count(*) as n, cast(sum(finding_count) as bigint) as findings from {analysis_events} group by 1")
def metrics_hourly(t):
    return t("analysis_events").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("finding_count").alias("findings")).select(F.col("w.start").alias("hour"), "n", "findings")


@query("select ord, ts, tier from {analysis_events} order by ts desc, ord desc limit 50")
def recent_events(t):
    return V.recent(t("analysis_events")).select("ord", "ts", "tier")


@query("select tier, cache_result, count(*) as n, round(avg(finding_count), 6) as findings from {analysis_events} group by tier, cache_result")
def cache_stats(t):
    return V.cache_table(t("analysis_events")).withColumn("findings", F.round("findings", 6))


@query("select ord, uri, hash from (select *, lag(hash) over (partition by uri order by ts, ord) as was from {analysis_events}) where was is null or was <> hash")
def changed_only(t):
    return M.changed_only(t("analysis_events")).select("ord", "uri", "hash")


@query("with g as (select team, ts, case when ts - lag(ts) over (partition by team order by ts) <= interval 10 minute then 0 else 1 end as fresh from {analysis_events}), s as (select team, ts, sum(fresh) over (partition by team order by ts rows unbounded preceding) as no from g) select team, count(*) as changes, min(ts) as first_ts, max(ts) as last_ts from s group by team, no")
def debounce_sessions(t):
    return M.sessions(t("analysis_events"), "team", "10 minutes")


@query("select variant, count(*) as runs, round(avg(total), 6) as total_mean, round(coalesce(stddev_samp(total), 0), 6) as total_std, round(avg(errors), 6) as errors_mean, round(coalesce(stddev_samp(errors), 0), 6) as errors_std from {runs} group by variant")
def variant_summary(t):
    s = M.summarize(t("runs"), "variant", ["total", "errors"])
    return s.select("variant", "runs", *[r6(F.col(f"{m}_{n}"), f"{m}_{n}") for m in ("total", "errors") for n in ("mean", "std")])


@query("with s as (select variant, avg(total) as t, avg(errors) as e from {runs} group by variant), b as (select * from s where variant = '1-URGENT') select s.variant, round(case when b.t <> 0 then (s.t - b.t) / b.t * 100 else 0 end, 6) as total_pct, round(case when b.e <> 0 then (s.e - b.e) / b.e * 100 else 0 end, 6) as errors_pct from s, b where s.variant <> '1-URGENT'")
def variant_delta(t):
    d = M.deltas(M.summarize(t("runs"), "variant", ["total", "errors"]), "variant", "1-URGENT", ["total", "errors"])
    return d.select("variant", r6(F.col("total_pct"), "total_pct"), r6(F.col("errors_pct"), "errors_pct"))


@query("select run_id, count(*) as total, count(*) filter (coalesce(tier, 'comprehensive') = 'comprehensive') as llm, count(*) filter (tier = 'instant') as instant, count(*) filter (level = 'error') as errors, count(*) filter (level = 'warning') as warnings, count(*) filter (level = 'note') as notes, count(*) filter (level = 'error' and confidence > 0.8) as sure_errors, round(sum(coalesce(confidence, 0)) / count(*), 6) as avg_conf from {findings} group by run_id")
def run_metrics(t):
    return M.run_measures(t("findings")).withColumn("avg_conf", F.round("avg_conf", 6))


PROFILE = "(select team, rule_id, count(*) as total, count(*) filter (verdict = 'useful') as useful, count(*) filter (verdict = 'noise') as noise, count(*) filter (verdict = 'wrong') as wrong, avg(confidence) filter (verdict = 'noise') as noise_conf from {feedback} group by team, rule_id)"


@query("select verdict, count(*) as n, round(count(*) / (select count(*) from {feedback}), 6) as rate from {feedback} group by verdict")
def feedback_stats(t):
    return V.verdict_rates(t("feedback")).withColumn("rate", F.round("rate", 6))


@query(f"select team, rule_id, total, useful, noise, wrong from {PROFILE}")
def team_profiles(t):
    return M.profiles(t("feedback")).select("team", "rule_id", "total", "useful", "noise", "wrong")


@query(f"select team, rule_id, round(noise / total, 6) as noise_rate, round(case when noise / total >= 0.7 and coalesce(noise_conf, 0) > 0 then noise_conf else 0 end, 6) as suppress_below from {PROFILE}")
def profile_thresholds(t):
    return M.profiles(t("feedback")).select("team", "rule_id", r6(F.col("noise_rate"), "noise_rate"), r6(F.col("suppress_below"), "suppress_below"))


@query(f"select rule_id, round(avg(noise / total), 6) as noise_rate, count(*) as teams, cast(sum(total) as bigint) as feedback from {PROFILE} group by rule_id")
def cross_org(t):
    c = M.cross_team(M.profiles(t("feedback")))
    return c.select("rule_id", r6(F.col("noise_rate"), "noise_rate"), "teams", "feedback")


def _cases(t) -> DataFrame:
    """A case an order: expected findings of one side, actual ones of the other."""
    f = t("findings").withColumn("case_id", F.floor(F.col("ord") / 100))
    want = F.struct("ord", F.expr("if(ord % 5 = 0, '', level)").alias("level"), F.expr("if(ord % 4 = 0, rule_id, 'any')").alias("rule_id"), F.expr("if(ord % 7 = 0, 0, start_line)").alias("lo"), F.expr("if(ord % 7 = 0, 0, end_line)").alias("hi"), F.expr("ord % 3 <> 0").alias("must_find"))
    got = F.struct("ord", "level", "rule_id", F.expr("if(uri is null, null, start_line)").alias("line"), "uri", "confidence", (F.col("ord") % 100).cast("int").alias("no"))
    both = [F.array_sort(F.collect_list(F.when(F.col("side") == side, x))).alias(c) for side, x, c in ((0, want, "expected"), (1, got, "actual"))]
    return f.groupBy("case_id").agg(*both).withColumn("source", F.expr("concat('src/f', case_id % 300, '.go')"))


CASES = """(
with recursive c as (
  select ord // 100 as case_id, concat('f', cast(ord // 100 % 300 as varchar), '.go') as name,
    list(struct_pack(level := case when ord % 5 = 0 then '' else level end, rule_id := case when ord % 4 = 0 then rule_id else 'any' end, lo := case when ord % 7 = 0 then 0 else start_line end, hi := case when ord % 7 = 0 then 0 else end_line end, must := ord % 3 <> 0) order by ord) filter (side = 0) as e,
    coalesce(list(struct_pack(level := level, rule_id := rule_id, line := case when uri is null then null else start_line end, uri := uri, confidence := confidence, no := cast(ord % 100 as int)) order by ord) filter (side = 1), []) as a
  from {findings} group by all),
fold as (
  select case_id, name, coalesce(e, []) as e, a, 1 as i, cast([] as int[]) as used, 0 as missed from c
  union all
  select case_id, name, e, a, i + 1, case when m is null then used else list_append(used, m) end, missed + case when m is null and e[i].must then 1 else 0 end
  from (select *, list_filter(a, lambda x: (e[i].level = '' or e[i].level = x.level) and (e[i].rule_id = 'any' or e[i].rule_id = x.rule_id) and (e[i].lo = 0 and e[i].hi = 0 or x.line is null or x.line between e[i].lo - 5 and e[i].hi + 5) and not list_contains(used, x.no))[1].no as m from fold where i <= len(e))),
done as (
  select case_id, len(used) as tp, len(a) - len(used) as fp, missed as fn, len(list_filter(a, lambda x: not list_contains(used, x.no) and coalesce(x.uri, '') <> '' and not suffix(x.uri, name))) as hallucinations,
    coalesce(list_avg([x.confidence for x in a if list_contains(used, x.no)]), 0) as tp_conf, coalesce(list_avg([x.confidence for x in a if not list_contains(used, x.no)]), 0) as fp_conf
  from fold where i = len(e) + 1),
rated as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as r from done)
select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1 from rated)"""


@query(f"select case_id, cast(tp as int) as tp, cast(fp as int) as fp, cast(fn as int) as fn, cast(hallucinations as int) as hallucinations, round(tp_conf, 6) as tp_conf, round(fp_conf, 6) as fp_conf, round(p, 6) as precision, round(r, 6) as recall, round(f1, 6) as f1 from {CASES}")
def score_case(t):
    s = M.score_cases(_cases(t))
    return s.select("case_id", "tp", "fp", "fn", "hallucinations", *[r6(F.col(c), c) for c in ("tp_conf", "fp_conf", "precision", "recall", "f1")])


TOTAL = """(select *, case when mp + mr > 0 then 2 * mp * mr / (mp + mr) else 0 end as mf from (select sum(tp) / sum(tp + fp) as mp, sum(tp) / sum(tp + fn) as mr, avg(p) as p, avg(r) as r, avg(f1) as f1, sum(hallucinations) / sum(tp + fp) as h, coalesce(avg(tp_conf) filter (tp_conf > 0), 0) - coalesce(avg(fp_conf) filter (fp_conf > 0), 0) as c from %s))"""


@query(f"select round(mp, 6) as micro_precision, round(mr, 6) as micro_recall, round(mf, 6) as micro_f1, round(p, 6) as macro_precision, round(r, 6) as macro_recall, round(f1, 6) as macro_f1, round(h, 6) as hallucination_rate, round(c, 6) as calibration from {TOTAL % CASES}")
def score_aggregate(t):
    total = M.score_total(M.score_cases(_cases(t)))
    return total.select(*[r6(F.col(c), c) for c in total.columns])


@query(f"select case_id % 500 as group_id, count(*) as runs, cast(round(avg(tp)) as bigint) as tp, cast(round(avg(fp)) as bigint) as fp, cast(round(avg(fn)) as bigint) as fn, cast(round(avg(hallucinations)) as bigint) as hallucinations, round(avg(p), 6) as precision_mean, round(coalesce(stddev_samp(p), 0), 6) as precision_std, round(avg(f1), 6) as f1_mean, round(coalesce(stddev_samp(f1), 0), 6) as f1_std from {CASES} group by 1")
def score_runs(t):
    """Cases of the same remainder as runs of one case."""
    s = M.score_runs(M.score_cases(_cases(t)).withColumn("group_id", F.col("case_id") % 500), "group_id")
    return s.select("group_id", "runs", "tp", "fp", "fn", "hallucinations", *[r6(F.col(f"{c}_{x}"), f"{c}_{x}") for c in ("precision", "f1") for x in ("mean", "std")])
