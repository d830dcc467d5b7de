"""Registered queries on the structure of source files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings as A
from ..operators import syntax as S
from ..sources.loaders import parse_rules
from .registry import query

#: By language: ending, first line, header of the function, its parameter, handler, if, last line
LANGUAGES = [
    (".go", "package main", "func (s *S%) f(#) {", "a@ int", "if err != nil {", "if x {", ""),
    (".java", "class S% {", "void f(#) throws E {", "int a@", "try { z(); } catch (E e) {", "if (x) {", "}"),
    (".js", "class S% {", "f(#) {", "a@", "try { z(); } catch (e) {", "if (x) {", "}"),
    (".ts", "class S% {", "f(#): void {", "a@: number", "try { z(); } catch (e) {", "if (x) {", "}"),
    (".c", "int g;", "int f(#) {", "int a@", "if (err) {", "if (x) {", ""),
    (".rs", "impl S% {", "pub fn f(&self, #) -> i32 {", "a@: i32", "if err {", "if x {", "}"),
]


def sources(t) -> DataFrame:
    """A file a user in one of six languages: comments and strings with braces in them, parameters, a handler, nested ifs, and
    a line an event."""
    u = t("events").groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in LANGUAGES]), (F.col("user_id") % 6 + 1).cast("int"))
    params = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("user_id") % 8 + 1).cast("int")), lambda i: F.replace(pick(3), F.lit("@"), i.cast("string"))), ", ")
    named = lambda c: F.replace(F.replace(c, F.lit("%"), (F.col("user_id") % 5).cast("string")), F.lit("#"), params)
    deep = (F.col("user_id") % 7 + 1).cast("int")
    body = F.when(F.floor(F.col("user_id") / 6) % 2 == 0, "").otherwise("y();")
    lines = [named(pick(1)), F.lit("// func g() { /* { */"), named(pick(2)), F.lit(' x = "} // {";'), pick(4), body, F.lit("}")]
    text = F.concat_ws("\n", *lines, F.array_repeat(pick(5), deep), F.lit("y();"), F.array_repeat(F.lit("}"), deep), F.array_repeat(F.lit("y();"), F.col("n")), F.lit("}"), pick(6))
    return u.select(F.concat(F.lit("src/u"), F.col("user_id").cast("string"), pick(0)).alias("path"), text.alias("content"))


FILES = "(select user_id as u, user_id % 7 + 1 as k, user_id % 6 as lang, count(*) as n, 9 + 2 * (user_id % 7 + 1) + count(*) as last, concat('src/u', cast(user_id as varchar), ['.go', '.java', '.js', '.ts', '.c', '.rs'][user_id % 6 + 1]) as uri from {events} group by user_id)"
NAME = "case when lang = 4 then '<anonymous>' else 'f' end"


def _rows(rule: str) -> DataFrame:
    return lambda t: S.syntax_scan(sources(t), [r for r in S.AST_RULES if r.id == rule]).select("uri", "rule_id", "start_line", "end_line", "message")


LONG = f"select uri, 'AST001' as rule_id, 3 as start_line, cast(last as integer) as end_line, concat('function \"', {NAME}, '\" is ', cast(last - 2 as varchar), ' lines long (max 50)') as message from {FILES} where last - 2 > 50"
DEEP = f"select uri, 'AST002' as rule_id, 12 as start_line, cast(4 + 2 * k as integer) as end_line, 'nesting depth 5 exceeds maximum 4' as message from {FILES} where k > 4"
EMPTY = f"select uri, 'AST003' as rule_id, 5 as start_line, 7 as end_line, 'empty error handler at line 5' as message from {FILES} where lang < 4 and u // 6 % 2 = 0"
MANY = f"select uri, 'AST004' as rule_id, 3 as start_line, cast(last as integer) as end_line, concat('function \"f\" has ', cast(u % 8 + 1 as varchar), ' parameters (max 5)') as message from {FILES} where lang <> 4 and u % 8 + 1 > 5"
for _name, _rule, _sql in (("check_length", "AST001", LONG), ("check_nesting", "AST002", DEEP), ("check_handlers", "AST003", EMPTY), ("check_params", "AST004", MANY)):
    query(_sql, _name)(_rows(_rule))


@query(f"select uri, {NAME} as name, case when lang = 4 then '' else concat('S', cast(u % 5 as varchar)) end as class, 3 as start_line, cast(last as integer) as end_line, case when lang <> 4 then cast(u % 8 + 1 as integer) end as params from {FILES}")
def function_index(t):
    return S.function_index(sources(t)).select("uri", "name", "class", "start_line", "end_line", "params")


@query(f"select u.ord, case when u.start_line between 3 and f.last then concat(case when f.lang = 4 then '' else concat('S', cast(f.u % 5 as varchar), '.') end, {NAME}) end as place from (select ord, ord % 700 as u, start_line from {{findings}}) u left join {FILES} f on f.u = u.u")
def logical_location(t):
    """The qualified name of the function around each finding, from the files' own index."""
    endings = F.element_at(F.array(*[F.lit(x[0]) for x in LANGUAGES]), (F.col("ord") % 700 % 6 + 1).cast("int"))
    f = t("findings").withColumn("uri", F.concat(F.lit("src/u"), (F.col("ord") % 700).cast("string"), endings))
    return A.enclosing(f, S.function_index(sources(t))).select("ord", S.qualified_name().alias("place"))


RULES = """{"rules": [
  {"id": "L1", "type": "ast", "ast_check": "function-length", "ast_config": {"max_lines": 20}, "level": "note", "confidence": 0.5, "message": "long", "languages": ["go", "java"]},
  {"id": "P1", "type": "ast", "ast_check": "param-count", "ast_config": {"max_params": 2}, "level": "warning", "confidence": 1, "message": "many"},
  {"id": "T1", "pattern": "throws E", "level": "note", "confidence": 0.7, "message": "throws"},
  {"id": "N1", "type": "ast", "ast_check": "no-such-check", "level": "note", "confidence": 1, "message": "none"}]}"""


@query(f"select 'L1' as rule_id, uri, 3 as start_line from {FILES} where lang < 2 and last - 2 > 20 union all select 'P1', uri, 3 from {FILES} where lang <> 4 and u % 8 + 1 > 2 union all select 'T1', uri, 3 from {FILES} where lang = 1")
def rules_from_file(t):
    """Rules of a file, with patterns and with checks that carry their own limits."""
    return S.scan(sources(t), parse_rules(RULES)).select("rule_id", "uri", "start_line")
