"""Views of the driver's tables in the shape of the engine's own: SQL that both engines read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "findings": """
select l_orderkey * 100 + l_linenumber as ord, concat('run', cast(l_orderkey % 7 as string)) as run_id, l_linenumber % 2 as side,
  concat('r', cast(p % 40 as string)) as rule_id,
  case when p % 13 = 0 then null else concat(case when s % 3 = 0 then './' else '' end, 'src/f', cast(l_orderkey % 300 as string), case when p % 2 = 0 then '.go' else '.py' end) end as uri,
  cast(s % 50 + 1 as int) as start_line, cast(s % 50 + 1 + cast(floor(q) as int) % 9 as int) as end_line,
  case when p % 11 = 0 then null else round(0.4 + d * 6, 2) end as confidence,
  case when rf = 'R' then 'error' when rf = 'A' then 'warning' when ls = 'O' then 'note' else 'none' end as level,
  case when l_linenumber = 1 then 'instant' when l_linenumber = 2 then 'fast' when l_linenumber = 3 then null else 'comprehensive' end as tier,
  concat('m', cast(p % 5 as string)) as message,
  case when s % 9 = 0 then null when s % 9 = 1 then '  ' else concat('  x', cast(p % 20 as string), chr(10), chr(10), '  y ', cast(l_orderkey % 3001 as string), ' ') end as snippet
from (select l_orderkey, l_linenumber, min(l_partkey) as p, min(l_suppkey) as s, min(l_quantity) as q, min(l_discount) as d, min(l_returnflag) as rf, min(l_linestatus) as ls
  from {lineitem} group by l_orderkey, l_linenumber) as l""",
    "lines": """
select user_id, event_id, case event_id % 20
  when 0 then 'password = "secret123"' when 1 then 'q := "SELECT a FROM t WHERE id=" + id + "x"' when 2 then 'exec.Command("sh " + arg)' when 3 then 'os.Open(dir + name)'
  when 4 then 'h := md5.Sum(data)' when 5 then 'InsecureSkipVerify: true,' when 6 then '  v, _ := load()' when 7 then 'if err != nil { }'
  when 8 then concat('  return (x)', chr(10), '  y := 1') when 9 then 'for i := range xs { defer f.Close() }' when 10 then '// TODO: fix this' when 11 then '// if old then go'
  when 12 then '  fmt.Print("x")' when 13 then 'return fmt.Errorf("bad %s", err)' when 14 then '  if n > 4321 {' when 15 then ''
  when 16 then 'token := "abc"; secret: ''longer value''' when 17 then 'FIXME : xxx  BUG:' else concat('plain line ', cast(event_id as string)) end as line
from {events}""",
    "suppressions": """
select s_suppkey as s_ord, concat('r', cast(s_suppkey % 45 as string)) as rule_id,
  case when s_suppkey % 4 = 0 then '' else concat(case when s_suppkey % 3 = 0 then './src//' else 'src/x/../' end, 'f', cast(s_suppkey * 7 % 300 as string), '.go') end as file, concat('why ', cast(s_suppkey as string)) as reason
from {supplier}""",
    "analysis_events": """
select event_id as ord, ts, event_type as tier, concat('t', cast(user_id % 5 as string)) as team, concat('src/u', cast(user_id as string), '.go') as uri,
  case event_id % 4 when 0 then 'hit' when 1 then 'miss' when 2 then 'stale' else '' end as cache_result, case when event_id % 17 = 0 then 'failed' else '' end as error,
  event_id % 6 as finding_count, cast(floor(value * 10) as bigint) as ms, sha256(cast(event_id % 3 as string)) as hash
from {events}""",
    "feedback": """
select concat('t', cast(event_id % 6 as string)) as team, concat('r', cast(user_id % 40 as string)) as rule_id,
  case when event_type = 'purchase' then 'useful' when event_type = 'error' then 'wrong' else 'noise' end as verdict, round(cast(event_id % 50 as double) / 50, 2) as confidence
from {events}""",
    "runs": """
select o_orderpriority as variant, o_orderkey % 5 as run, cast(count(*) as double) as total, cast(count(case when o_orderstatus = 'F' then 1 end) as double) as errors, avg(o_totalprice) as cost
from {orders} group by o_orderpriority, o_orderkey % 5""",
}


def _expand(sql: str) -> str:
    while found := re.search("{(%s)}" % "|".join(VIEWS), sql):
        sql = sql.replace(found[0], f"({VIEWS[found[1]].strip()})")
    return sql


def for_duckdb(sql: str) -> str:
    return re.sub(r"{(%s)}" % "|".join(TABLES), r"\1", _expand(sql))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _expand(VIEWS[name]).replace("sha256(cast(event_id % 3 as string))", "sha2(cast(event_id % 3 as string), 256)")
    # braces of the text itself are doubled, as spark.sql() formats it
    named = re.sub(r"{{(%s)}}" % "|".join(TABLES), r"{\1}", sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(named, **{t: view(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql})
