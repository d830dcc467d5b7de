"""Registered queries of selection, lifecycle and exchange operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exchange as X
from ..operators import lifecycle as L
from ..operators import rules as R
from ..operators import selection as S
from .registry import ARTIFACTS, GATE, _gated, _scan_sql, artifacts, query, r6

PATHS = "(select distinct uri as path from {findings} where uri is not null)"


@query(f"select path, suffix(path, '.go') and not contains(path, 'f12.go') and not contains(path, '/f3/') as watched, starts_with(path, './src') or suffix(path, '.py') as other from {PATHS}")
def watch_filter(t):
    p = t("findings").where("uri is not null").select(F.col("uri").alias("path")).distinct()
    return p.select("path", S.watched(F.col("path"), ["**/*.go"], ["**/f12.go", "**/f3/**"]).alias("watched"), S.watched(F.col("path"), ["./src/**", "*.py"], []).alias("other"))


SELECTORS = [S.Selector("docs/*.md"), S.Selector("src/f?.go", "*.go"), S.Selector("src/*[0-4].py", "f[0-9].py")]


@query(f"select path, 0 as selector from {PATHS} union all select path, 1 from {PATHS} where suffix(path, '.go') union all select path, 2 from {PATHS} where regexp_matches(path, '/f[0-9]\\.py$')")
def context_select(t):
    p = t("findings").where("uri is not null").select(F.col("uri").alias("path")).distinct()
    return S.context_selectors(p, SELECTORS)


@query(f"select path, 1 as selector from {PATHS} where regexp_full_match(path, 'src/f[^/]\\.go') union all select path, 2 from {PATHS} where regexp_full_match(path, 'src/[^/]*[0-4]\\.py')")
def context_files(t):
    p = t("findings").where("uri is not null").select(F.col("uri").alias("path")).distinct()
    return S.context_files(p, SELECTORS).select("path", "selector")


def _todo(prompt: str, _: str) -> list[dict]:
    """A model of fixed answers: its findings are the prompt's lines that end in a bracket."""
    return [{"rule_id": "m1", "level": "note", "message": line.strip(), "start_line": no, "end_line": no, "confidence": 0.5} for no, line in enumerate(prompt.split("\n")) if line.endswith(")")]


@query(f"select path as uri, cast(no as int) as start_line, trim(line, ' ') as message from (select path, unnest(string_split(content, chr(10))) as line, unnest(range(1, len(string_split(content, chr(10))) + 1)) as no from {ARTIFACTS}) where suffix(line, ')')")
def model_scan(t):
    return S.model_scan(artifacts(t), "find what looks odd", _todo).select("uri", "start_line", "message")


_FAST = [r for r in R.BUILT_IN if r.category == "maintainability"]
_INSTANT = [r for r in R.BUILT_IN if r.category == "security"]


@query(f"select a.path, x.tier, count(f.uri) as findings from {ARTIFACTS} a cross join (select unnest(['instant', 'fast']) as tier) x left join (select uri, 'instant' as tier from ({_scan_sql(_INSTANT)}) union all select uri, 'fast' from ({_scan_sql(_FAST)})) f on f.uri = a.path and f.tier = x.tier group by all")
def tier_messages(t):
    scan = lambda rules: lambda a: R.regex_scan(a, rules)
    return S.tier_messages(artifacts(t), [("instant", scan(_INSTANT)), ("fast", scan(_FAST))])


REMOVED = "(select distinct rule_id as r, case when s_ord % 2 = 0 then '' else replace(replace(file, './src//', 'src/'), 'src/x/../', 'src/') end as f from {suppressions} where s_ord % 5 = 0)"
CLEAN = "(select *, replace(replace(file, './src//', 'src/'), 'src/x/../', 'src/') as nf from {suppressions})"


def _removals(t):
    return t("suppressions").where("s_ord % 5 = 0").select("rule_id", F.expr("if(s_ord % 2 = 0, '', file)").alias("file"))


@query(f"select s_ord from {CLEAN} where not exists (select 1 from {REMOVED} where r = rule_id and f = nf)")
def unsuppress(t):
    return L.unsuppress(t("suppressions"), _removals(t)).select("s_ord")


@query(f"select s_ord from (select *, row_number() over (partition by rule_id, nf order by s_ord) as place from {CLEAN}) where place > 1 or not exists (select 1 from {REMOVED} where r = rule_id and f = nf)")
def unsuppress_first(t):
    return L.unsuppress(t("suppressions"), _removals(t), first_only=True).select("s_ord")


@query("select ord from (select ord, row_number() over (order by ts desc, ord desc) as rn, count(*) over () as n from {analysis_events}) where rn <= case when n <= 500 then n else n - ((n - 501) // 50 + 1) * 50 end")
def retained_events(t):
    return L.retained(t("analysis_events"), ["ts", "ord"], 500).select("ord")


@query("with c as (select ord % 97 as k, max(struct_pack(a := ts, b := ms)) as e from {analysis_events} where ord % 3 = 0 group by 1), last as (select max(ts) as now from {analysis_events}) select ord, case when e is null then 'miss' when epoch(e.a) + 86400 >= epoch(now) then 'hit' else 'expired' end as state, case when epoch(e.a) + 86400 >= epoch(now) then e.b end as value from (select ord, ord % 101 as k from {analysis_events}) w left join c on c.k = w.k cross join last")
def ttl_lookup(t):
    e = t("analysis_events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.lit(e.agg(F.max("ts")).first()[0])
    cache = e.where("ord % 3 = 0").select((F.col("ord") % 97).alias("k"), F.col("ts").alias("created"), F.col("ms").alias("value"))
    return L.fresh_entries(e.select("ord", (F.col("ord") % 101).alias("k")), cache, "k", now, 86400).select("ord", "state", "value")


@query("select ord, uri from {analysis_events} qualify row_number() over (partition by uri order by ts desc, ord desc) = 1")
def latest_generation(t):
    return L.latest_generation(t("analysis_events"), "uri", ["ts", "ord"]).select("ord", "uri")


@query("select team, rule_id, count(*) as n from {feedback} where team is distinct from 't3' group by all")
def team_delete(t):
    return L.without_team(t("feedback"), "t3").groupBy("team", "rule_id").agg(F.count("*").alias("n"))


@query("select rule_id, count(*) as n from {feedback} where team = 't2' and rule_id in (select rule_id from {suppressions} where s_ord % 4 = 0) group by all")
def profile_lookup(t):
    return L.profile_lookup(t("feedback"), "t2", t("suppressions").where("s_ord % 4 = 0")).groupBy("rule_id").agg(F.count("*").alias("n"))


GUID = "concat(substr(md5(k), 1, 8), '-', substr(md5(k), 9, 4), '-4', substr(md5(k), 14, 3), '-a', substr(md5(k), 18, 3), '-', substr(md5(k), 21, 12))"
GUIDS = f"(select o_orderkey, o_custkey, case when o_orderkey % 4 = 0 then concat('given', k) else {GUID} end as guid from (select *, cast(o_orderkey as varchar) as k from {{orders}}))"


def _runs(t):
    return L.with_guid(t("orders").select("o_orderkey", "o_custkey", F.expr("if(o_orderkey % 4 = 0, concat('given', o_orderkey), '')").alias("guid")), "o_orderkey")


@query(f"select o_orderkey, guid from {GUIDS}")
def run_guid(t):
    return _runs(t).select("o_orderkey", "guid")


@query(f"select o_orderkey, lag(guid) over (partition by o_custkey order by o_orderkey, guid) as baseline_guid from {GUIDS}")
def run_baseline(t):
    return L.link_baselines(_runs(t), "o_custkey", "o_orderkey").select("o_orderkey", "baseline_guid")


@query("select c_custkey as target, variant, cast(run as int) as run from {customer} cross join (select unnest(['base', 'tuned']) as variant) cross join (select unnest(range(1, 4)) as run)")
def experiment_grid(t):
    return L.experiment_grid(t("customer").select(F.col("c_custkey").alias("target")), ["base", "tuned"], 3)


@query("select uri, case when count(*) filter (level = 'error') > 12 then 'reject' when max(confidence) < 0.9 then 'merge' else 'review' end as decision from {findings} where uri is not null group by uri")
def custom_gate(t):
    policy = [("reject", "count_if(level = 'error') > 12"), ("merge", "max(confidence) < 0.9")]
    return L.custom_gate(t("findings").where("uri is not null"), policy, "uri")


@query("select ord, case when start_line % 3 > 0 and coalesce(uri, '') <> '' then uri end as path, case when start_line % 3 > 0 and coalesce(uri, '') <> '' and ord % 2 > 0 then 1 end as end_line, cast((start_line % 3 > 0 and coalesce(uri, '') <> '') as int) + 1 as n from {findings}")
def related_filter(t):
    related = F.array(F.struct(F.col("uri").alias("path"), F.expr("start_line % 3").alias("start_line"), F.expr("cast(ord % 2 as int)").alias("end_line"), F.lit("").alias("message")), F.struct(F.lit("a.go").alias("path"), F.lit(3).alias("start_line"), F.lit(0).alias("end_line"), F.lit("m").alias("message")), F.struct(F.lit("").alias("path"), F.lit(3).alias("start_line"), F.lit(0).alias("end_line"), F.lit("m").alias("message")))
    f = t("findings").select("ord", X.related_locations(related).alias("r"))
    own = F.when(F.size("r") == 2, F.get("r", F.lit(0)))
    return f.select("ord", own["path"].alias("path"), own["end_line"].alias("end_line"), F.size("r").alias("n"))


@query("select ord, case when start_line % 2 = 0 then concat('line ', cast(start_line as varchar)) end as text, case when start_line % 2 = 0 then end_line end as last from {findings}")
def fixes(t):
    f = t("findings").withColumns({"recommendation": F.col("message"), "replacement": F.expr("if(start_line % 2 = 0, concat('line ', start_line), '')")})
    return X.with_fix(f).select("ord", "fix.text", F.col("fix.end_line").alias("last"))


@query(f"select f.ord, case when a.path is not null and f.start_line <= len(l) then array_to_string(l[f.start_line:f.end_line], chr(10)) || case when f.end_line < len(l) then chr(10) else '' end end as snippet from (select ord, concat('src/u', cast(ord % 50 as varchar), case ord % 50 % 4 when 0 then '.go' when 1 then '.py' when 2 then '.ts' else '.txt' end) as uri, start_line, end_line from {{findings}}) f left join (select path, string_split(content, chr(10)) as l from {ARTIFACTS}) a on a.path = f.uri")
def snippet_join(t):
    uri = F.expr("concat('src/u', ord % 50, case ord % 50 % 4 when 0 then '.go' when 1 then '.py' when 2 then '.ts' else '.txt' end)")
    return X.with_snippets(t("findings").drop("snippet").withColumn("uri", uri), artifacts(t)).select("ord", "snippet")


def _related_ids(r: R.Rule) -> str:
    return ",".join([f"CWE:{x.removeprefix('CWE-')}" for x in r.cwe] + [f"OWASP:{x}" for x in r.owasp])


@query("select x.id, x.text, x.relations, count(*) as n from (%s) f join (%s) x on x.id = f.rule_id group by all" % (_scan_sql(R.BUILT_IN), " union all ".join(f"select '{r.id}' as id, '{r.message}' as text, '{_related_ids(r)}' as relations" for r in R.BUILT_IN)))
def descriptors(t):
    """Descriptors of the rules that found something, with how often."""
    scan = R.regex_scan(artifacts(t), R.BUILT_IN)
    n = scan.groupBy(F.col("rule_id").alias("id")).agg(F.count("*").alias("n"))
    return X.descriptors(scan.sparkSession, R.BUILT_IN).join(n, "id").select("id", "text", F.array_join("relations", ",").alias("relations"), "n")


@query("""select c_custkey, sha256(concat('{"file_path":"', c_name, '","model":"', case when c_custkey % 2 = 0 then '' else c_mktsegment end, '","policies":{"a":"', cast(c_custkey as varchar), '","z":"1"}}')) as key from {customer}""")
def struct_key(t):
    c = t("customer").select("c_custkey", F.col("c_name").alias("file_path"), F.expr("if(c_custkey % 2 = 0, null, c_mktsegment)").alias("model"), F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.col("c_custkey").cast("string")).alias("policies"))
    return c.select("c_custkey", X.struct_key(["file_path", "model"], F.col("policies")).alias("key"))


@query(f"select path, substr(sha256(concat(content, chr(0), 'rules', chr(0), path)), 1, 32) as key from {ARTIFACTS}")
def short_key(t):
    return artifacts(t).select("path", X.short_key(F.col("content"), F.lit("rules"), F.col("path")).alias("key"))


@query(f"select a.path, sha256(concat(content, chr(0), a.path)) as key, count(f.uri) as findings from {ARTIFACTS} a left join ({_scan_sql(R.BUILT_IN)}) f on f.uri = a.path group by a.path, content")
def cache_entries(t):
    return X.cache_entries(artifacts(t), R.regex_scan(artifacts(t), R.BUILT_IN))


HEAD = "concat('## Analysis Summary', chr(10), chr(10), '**Decision:** ', decision, ' | **Findings:** ', cast(n as varchar), ' | **Files:** ', cast(files as varchar), chr(10), chr(10), '### Findings by Severity', chr(10), '| Severity | Count |', chr(10), '|----------|-------|', chr(10))"
PRIO = "case level when 'error' then 0 when 'warning' then 1 when 'note' then 2 else 3 end"
BODY = "concat('<details>', chr(10), '<summary><strong>', level, '</strong> — ', rule_id, ': ', message, case when uri is null then '' else concat(' in <code>', uri, ':', cast(start_line as varchar), '</code>') end, '</summary>', chr(10), chr(10), '**Rule:** ', rule_id, chr(10), case when confidence is null then '' else concat('**Confidence:** ', printf('%.2f', confidence), chr(10)) end, case when uri is null then '' else concat('**File:** `', uri, '` lines ', cast(start_line as varchar), '-', cast(end_line as varchar), chr(10)) end, chr(10), '> ', message, chr(10), chr(10), '</details>', chr(10), chr(10))"


@query(f"""select run_id, 0 as part, 0 as priority, '' as uri, 0::bigint as ord, {HEAD} as text from {GATE} g join (select run_id as r, count(*) as n, count(distinct uri) as files from {{findings}} group by 1) on r = run_id
union all select run_id, 1, {PRIO}, '', 0, concat('| ', level, ' | ', cast(count(*) as varchar), ' |', chr(10)) from {{findings}} where level in ('error', 'warning', 'note') group by run_id, level
union all select run_id, 2, {PRIO}, coalesce(uri, ''), ord, {BODY} from {{findings}} union all select run_id, 3, 0, '', 0, concat('---', chr(10)) from {GATE}""")
def markdown(t):
    from ..operators import findings as A

    return X.markdown(t("findings"), A.gate(_gated(t)))


@query("select run_id, uri, start_line, ord, concat('    ', rpad(concat(cast(start_line as varchar), ':1'), 6, ' '), ' ', rpad(level, 7, ' '), '  ', rule_id, '  ', message, case when confidence is null then '' else concat(' (', printf('%.2f', confidence), ')') end) as text from (select * replace (coalesce(uri, '') as uri) from {findings}) union all select distinct run_id, coalesce(uri, ''), 0, -1::bigint, concat('  ', coalesce(uri, '')) from {findings}")
def pretty(t):
    return X.pretty(t("findings"))


@query("select run_id, array_to_string([x for x in [case when e > 0 then concat(cast(e as varchar), ' error', case when e = 1 then '' else 's' end) end, case when w > 0 then concat(cast(w as varchar), ' warning', case when w = 1 then '' else 's' end) end, case when n > 0 then concat(cast(n as varchar), ' note', case when n = 1 then '' else 's' end) end] if x is not null], ', ') as text from (select run_id, count(*) filter (level = 'error') as e, count(*) filter (level = 'warning') as w, count(*) filter (level = 'note') as n from {findings} group by run_id)")
def totals_line(t):
    return X.totals_line(t("findings"))


@query("select ord, concat(cast(ord as varchar), ',', case when uri like '%1%' then concat('\"', uri, ' \"\"x\"\",\"') else uri end, ',', error) as line from {analysis_events}")
def metrics_csv(t):
    e = t("analysis_events").withColumn("file", F.expr("if(uri like '%1%', concat(uri, ' \"x\",'), uri)"))
    return e.select("ord", X.csv_line(["ord", "file", "error"]).alias("line"))


@query("select c_custkey, translate(concat('//git@#', c_name, ' /x:'), '/\\: ', '----') as name from {customer}")
def run_name(t):
    return t("customer").select("c_custkey", X.run_name(F.concat_ws("", F.lit("//git@#"), "c_name", F.lit(" /x:"))).alias("name"))


@query("""select rule_id, string_agg(concat('[', case when verdict in ('noise', 'wrong') then 'NOISE' else 'USEFUL' end, ' PATTERN] Rule ', rule_id, ':', chr(10), 'Finding: "', verdict, '"', chr(10), case when confidence > 0.5 then concat('Context: team ', team, chr(10)) else '' end, chr(10)), '' order by team, confidence, verdict) as text
from (select *, row_number() over (partition by rule_id order by team, confidence, verdict) as rn from {feedback}) where rn <= 3 group by rule_id""")
def few_shot_text(t):
    """The first three pieces of feedback on each rule as examples."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("rule_id").orderBy("team", "confidence", "verdict"))
    e = t("feedback").withColumn("place", place).where("place <= 3").select("rule_id", "verdict", "place", F.col("verdict").alias("message"), F.expr("if(confidence > 0.5, concat('team ', team), '')").alias("reason"))
    return X.few_shot(e, "rule_id", "place")


@query("with q as (select embedding as v from {embeddings} where vec_id = (select min(vec_id) from {embeddings})), s as (select vec_id, list_sum([cast(x[1] as double) * cast(x[2] as double) for x in list_zip(embedding, v)]) / sqrt(list_sum([cast(x as double) * cast(x as double) for x in embedding])) / sqrt(list_sum([cast(x as double) * cast(x as double) for x in v])) as c from {embeddings}, q where vec_id % 3 = 0) select vec_id, round(c, 6) as cosine from s order by c desc, vec_id limit 3")
def similar_topk(t):
    """The three examples nearest to the first vector, of those that a team's filter leaves."""
    e = t("embeddings")
    first = e.orderBy("vec_id").first().embedding
    return X.similar_examples(e.where("vec_id % 3 = 0"), first, 3).select("vec_id", r6(F.col("cosine"), "cosine"))


@query("""select run_id, ord, concat('{"ruleId":"', rule_id, '","level":"', level, '","message":{"text":"', message, '"}', case when uri is null then '' else concat(',"locations":[{"physicalLocation":{"artifactLocation":{"uri":"', uri, '"},"region":{"startLine":', cast(start_line as varchar), ',"endLine":', cast(end_line as varchar), '}}}]') end, ',"properties":{', case when tier is null then '' else concat('"tier":"', tier, '"') end, '}}') as result from {findings} where confidence is null""")
def nested_results(t):
    return X.nested_run(t("findings").where("confidence is null"))



