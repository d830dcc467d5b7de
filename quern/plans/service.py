"""Registered queries of bursts, sliding figures, profiles and policies, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bursts as B
from ..operators import measures as M
from ..operators import nearest as N
from ..operators import policy as Y
from ..operators import reports as P
from ..operators import sliding as S
from .registry import GATE, _gated, query, r6
from .reporting import PACKAGES, _packages

BURSTS = "(select *, max(case when fresh then ts end) over (order by ts rows unbounded preceding) as burst from (select *, coalesce(ts - lag(ts) over (order by ts) > interval 10 minute, true) as fresh from (select distinct ts from {analysis_events})))"


@query(f"select burst, uri as path, count(*) as changes, max(e.ts) as last_ts from {{analysis_events}} e join {BURSTS} b on b.ts = e.ts group by burst, uri")
def debounce_paths(t):
    """Bursts of all files together, with their paths."""
    e = t("analysis_events").withColumns({"ts": F.col("ts").cast("timestamp"), "path": F.col("uri")})
    return B.bursts(e, "10 minutes", "1 hour").select(F.col("burst").cast("timestamp_ntz").alias("burst"), "path", "changes", F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


EVENTS = "(select *, ms // 3 as queue_ms, ms + 7 as total_ms, ord % 90 as tokens_in, ord % 11 as tokens_out from {analysis_events})"


def _events(t) -> DataFrame:
    return t("analysis_events").selectExpr("*", "ms div 3 as queue_ms", "ms + 7 as total_ms", "ord % 90 as tokens_in", "ord % 11 as tokens_out")


RANK = "a[cast(floor((len(a) - 1) * {0}) as int) + 1]"
MEANS = "round(avg(ms), 6) as avg_ms, round(avg(queue_ms), 6) as avg_queue_ms, round(avg(tokens_out), 6) as avg_tokens_out, round(coalesce(count(*) filter (cache_result = 'hit') / nullif(count(*) filter (cache_result <> ''), 0), 0), 6) as hit_rate"


@query(f"""select until, n, errors, findings, tokens_in, max_ms, {RANK.format(0.5)} as p50, {RANK.format(0.95)} as p95, {RANK.format(0.99)} as p99, avg_ms, avg_queue_ms, avg_tokens_out, hit_rate, round(n / 60, 6) as per_minute from (
select until, count(*) as n, count(*) filter (error <> '') as errors, cast(sum(finding_count) as bigint) as findings, cast(sum(tokens_in) as bigint) as tokens_in, max(ms) as max_ms, list_sort(list(ms)) as a, {MEANS}
from (select *, time_bucket(interval 15 minute, ts) + interval 15 minute * unnest([1, 2, 3, 4]) as until from {EVENTS}) group by until)""")
def last_hour(t):
    """The last hour's figures every quarter of an hour, from sums and counts by minute."""
    e = _events(t)
    h = S.last_hours(S.minute_sums(e), S.minute_counts(e), 60, 15)
    return h.select(F.col("until").cast("timestamp_ntz").alias("until"), "n", "errors", "findings", "tokens_in", "max_ms", "p50", "p95", "p99", *[r6(F.col(c), c) for c in ("avg_ms", "avg_queue_ms", "avg_tokens_out", "hit_rate", "per_minute")])


STATS = f"""(select * from (select count(*) as n, count(*) filter (error <> '') as errors, cast(sum(finding_count) as bigint) as findings, cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(tokens_out) as bigint) as tokens_out,
 count(*) filter (cache_result = 'hit') as hits, round(avg(tokens_in), 6) as avg_tokens_in, round(count(*) / (epoch(max(ts)) - epoch(min(ts))) * 60, 6) as per_minute from {EVENTS}),
(select w_n, w_avg_ms, w_avg_total_ms, w_max_ms, {RANK.format(0.5)} as w_p50, {RANK.format(0.99)} as w_p99 from (select count(*) as w_n, round(avg(ms), 6) as w_avg_ms, round(avg(total_ms), 6) as w_avg_total_ms, max(ms) as w_max_ms, list_sort(list(ms)) as a from {EVENTS} where ts > (select max(ts) - interval 5 day from {{analysis_events}}))))"""


@query(f"select * from {STATS}")
def service_stats(t):
    row, _ = S.service_stats(_events(t), 5 * 1440)
    return row.select("n", "errors", "findings", "tokens_in", "tokens_out", "hits", r6(F.col("avg_tokens_in"), "avg_tokens_in"), r6(F.col("per_minute"), "per_minute"), "w_n", r6(F.col("w_avg_ms"), "w_avg_ms"), r6(F.col("w_avg_total_ms"), "w_avg_total_ms"), "w_max_ms", "w_p50", "w_p99")


@query(f"select 1 as place, printf('%-20s%d', 'Total Analyses:', n) as text from {STATS} union all select 3, printf('%-20s%d', 'Total Findings:', findings) from {STATS} union all select 7, printf('%-20s%.0fms', 'P50:', cast(w_p50 as double)) from {STATS} union all select 10, printf('%-20s%.0fms', 'Max:', cast(w_max_ms as double)) from {STATS} union all select 21, printf('%-20s%d', 'Total In:', tokens_in) from {STATS}")
def service_report(t):
    """Some lines of the plain report."""
    return S.report(*S.service_stats(_events(t), 5 * 1440)).where("place in (1, 3, 7, 10, 21)")


@query("select team, rule_id, round(case when coalesce(u, 0) <> 0 and coalesce(n, 0) <> 0 then u - n else 0 end, 6) + 0.0 as conf_calibration from (select team, rule_id, avg(confidence) filter (verdict = 'useful') as u, avg(confidence) filter (verdict = 'noise') as n from {feedback} group by all)")
def conf_calibration(t):
    return M.profiles(t("feedback")).select("team", "rule_id", (F.round("conf_calibration", 6) + F.lit(0.0)).alias("conf_calibration"))


@query("with s as (select variant, avg(total) as t, avg(cost) as c from {runs} group by variant), b as (select * from s where variant = '1-URGENT') select s.variant, round((s.t - b.t) / b.t * 100, 6) as total_pct, round(s.c - b.c, 4) as cost_diff from s, b where s.variant <> '1-URGENT'")
def variant_difference(t):
    """One measure's change in percent, the other's as it is."""
    d = M.deltas(M.summarize(t("runs"), "variant", ["total", "cost"]), "variant", "1-URGENT", ["total", "cost"], ("cost",))
    return d.select("variant", r6(F.col("total_pct"), "total_pct"), F.round("cost_diff", 4).alias("cost_diff"))


@query(f"select condition, round(avg(c), 6) as conf_mean, round(avg(total), 6) as total_mean from (select condition, run, sum(total) as total, sum(total * (cast(substr(package, 2) as int) + 1) / 10) / sum(total) as c from {PACKAGES} group by all) group by condition")
def condition_confidence(t):
    """Mean confidence weighted by a package's findings."""
    p = _packages(t).withColumn("conf", (F.substring("package", 2, 9).cast("int") + 1) / 10)
    s = P.two_level(p, "condition", "run", ["total"], weighted="conf")
    return s.select("condition", r6(F.col("conf_mean"), "conf_mean"), r6(F.col("total_mean"), "total_mean"))


@query(GATE[1:-1].replace("n_actionable,", "c_open,").replace("as n_rejecting", "as c_blocker").replace("as n_actionable", "as c_open"))
def policy_gate(t):
    """The built-in gate, as a policy file says it."""
    return Y.decide(_gated(t)).select("run_id", "decision", F.col("c_open"), F.col("c_blocker"))


POLICY = """
# by file
let hard = level = "error" and tier in ("instant", "fast")
let sure = hard and confidence >= 0.5
default merge
reject when sure > 4 and hard > sure
review when hard > 3 or (hard = 2 and sure = 0)
"""
HARD = "level = 'error' and coalesce(tier, '') in ('instant', 'fast')"


@query(f"select uri, case when sure > 4 and hard > sure then 'reject' when hard > 3 or hard = 2 and sure = 0 then 'review' else 'merge' end as decision, hard as c_hard, sure as c_sure from (select uri, count(*) filter ({HARD}) as hard, count(*) filter ({HARD} and coalesce(confidence, 0) >= 0.5) as sure from {{findings}} where uri is not null group by uri)")
def policy_file(t):
    return Y.decide(t("findings").where("uri is not null"), Y.parse_policy(POLICY), "uri")


@query("""with e as (select vec_id, label, [cast(x as double) for x in embedding] as v from {embeddings}),
s as (select q.vec_id as no, x.vec_id as example_id, list_sum([a[1] * a[2] for a in list_zip(q.v, x.v)]) / sqrt(list_sum([a * a for a in q.v])) / sqrt(list_sum([a * a for a in x.v])) as c from e q join e x on x.label = q.label where q.vec_id % 10 = 1 and x.vec_id % 10 <> 1)
select no, cast(row_number() over w as integer) as rank, example_id, round(c, 6) as cosine from s window w as (partition by no order by c desc, example_id) qualify row_number() over w <= 3""")
def nearest_examples(t):
    """Of each question's group the three nearest examples; every tenth vector is a question, its label the group."""
    e = t("embeddings").select("vec_id", F.col("label").alias("team"), F.col("embedding").alias("v"))
    found = N.nearest_examples(e.where("vec_id % 10 = 1").withColumnRenamed("vec_id", "no"), e.where("vec_id % 10 <> 1").withColumnRenamed("vec_id", "id"), "team", 3)
    return found.select("no", "rank", "example_id", r6(F.col("cosine"), "cosine"))
