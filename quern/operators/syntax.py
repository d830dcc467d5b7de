"""Checks on the structure of source files, and the index of their functions: Python by its syntax tree, languages of braces
by an outline of their blocks."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.braces import Function, Outline, Statement, outline
from ..functions.text import EXTENSION_LANGUAGE, detect_language, language_matches
from .rules import Rule, regex_scan

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
CONTROL = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith)


def _python(source: str) -> Outline:
    tree = ast.parse(source)
    functions, control, handlers = [], [], []

    def count(a: ast.arguments) -> int:
        # bare * and ** ones count only with a type
        return len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + sum(s is not None and s.annotation is not None for s in (a.vararg, a.kwarg))

    todo = [(tree, 0, "")]
    while todo:
        node, depth, owner = todo.pop()
        owner = node.name if isinstance(node, ast.ClassDef) else owner
        for child in ast.iter_child_nodes(node):
            # an elif is as deep as its if
            chained = isinstance(node, ast.If) and isinstance(child, ast.If) and child in node.orelse and child.col_offset == node.col_offset
            deeper = depth + (isinstance(child, CONTROL) and not chained)
            if deeper > depth:
                control.append(Statement(child.lineno, child.end_lineno, deeper))
            if isinstance(child, FUNCTIONS):
                functions.append(Function(child.name, owner, child.lineno, child.end_lineno, count(child.args)))
            if isinstance(child, ast.ExceptHandler) and all(isinstance(s, ast.Pass) for s in child.body):
                handlers.append((child.lineno, child.end_lineno))
            todo.append((child, deeper, owner))
    return Outline(sorted(functions, key=lambda f: (f.start, -f.end)), control, sorted(handlers))


def file_outline(path: str, content: str | None) -> Outline | None:
    """What a file holds; None if its language isn't known or it can't be read."""
    ending = path[path.rfind(".") :].lower() if "." in path else ""
    lang = EXTENSION_LANGUAGE.get(ending)
    if lang is None or content is None:
        return None
    try:
        return _python(content) if lang == "python" else outline(content, lang)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


@dataclass(frozen=True)
class Check:
    """A check by name: the field of a rule's configuration that sets its limit, the default, and the matches of an outline:
    (first line, last line, message)."""

    field: str
    default: int
    run: Callable[[Outline, int], list[tuple[int, int, str]]]


def _long(o: Outline, most: int) -> list:
    return [(f.start, f.end, f'function "{f.name}" is {f.end - f.start + 1} lines long (max {most})') for f in o.functions if f.end - f.start + 1 > most]


def _deep(o: Outline, most: int) -> list:
    # what is nested in a reported statement isn't reported again
    return [(c.start, c.end, f"nesting depth {c.depth} exceeds maximum {most}") for c in o.control if c.depth == most + 1]


def _empty(o: Outline, _: int) -> list:
    return [(a, b, f"empty error handler at line {a}") for a, b in o.empty_handlers]


def _many(o: Outline, most: int) -> list:
    return [(f.start, f.end, f'function "{f.name}" has {f.params} parameters (max {most})') for f in o.functions if f.params is not None and f.params > most]


CHECKS = {"empty-handler": Check("", 0, _empty), "function-length": Check("max_lines", 50, _long), "nesting-depth": Check("max_depth", 4, _deep), "param-count": Check("max_params", 5, _many)}

#: The built-in rules on structure, in file order.
AST_RULES = [
    Rule("AST001", "note", 1.0, "Function exceeds maximum length", "maintainability", ast_check="function-length", ast_config={"max_lines": 50}),
    Rule("AST002", "warning", 0.9, "Deeply nested code block", "maintainability", ast_check="nesting-depth", ast_config={"max_depth": 4}),
    Rule("AST003", "warning", 0.95, "Empty error handling block", "reliability", cwe=["CWE-252"], ast_check="empty-handler"),
    Rule("AST004", "note", 1.0, "Function has too many parameters", "maintainability", ast_check="param-count", ast_config={"max_params": 5}),
]


def limit(rule: Rule) -> int:
    """A rule's limit; one that is no number is the check's default."""
    check = CHECKS[rule.ast_check]
    said = rule.ast_config.get(check.field, check.default)
    return int(said) if isinstance(said, int | float) else check.default


def _known(artifacts: DataFrame) -> DataFrame:
    return artifacts.where(detect_language(F.col("path")) != "").select("path", "content")


def _each(convert: Callable[[str, Outline], list[tuple]], names: list[str], kinds: list[pa.DataType]):
    """Of (path, content) rows what convert() gives of their outlines; a file is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (found := file_outline(path, content)) is not None:
                    rows += convert(path, found)
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def syntax_scan(artifacts: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """A finding for each match of each rule with a check, in artifacts (path, content) of a known language that the rule is
    for: uri, rule_ord, rule_id, level, confidence, message, start_line, end_line. Rules with an unknown check find nothing; files
    that can't be read, null and empty ones have no findings."""
    rules = [(i, r) for i, r in enumerate(AST_RULES if rules is None else rules) if r.ast_check in CHECKS]

    def convert(path: str, found: Outline) -> list[tuple]:
        return [(path, i, a, b, text) for i, r in rules for a, b, text in sorted(CHECKS[r.ast_check].run(found, limit(r)))]

    hits = _known(artifacts).mapInArrow(_each(convert, ["uri", "rule_ord", "start_line", "end_line", "message"], [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]), "uri string, rule_ord int, start_line int, end_line int, message string")
    of = lambda pick, kind: F.try_element_at(F.create_map(*[x for i, r in rules for x in (F.lit(i), F.lit(pick(r)))]), F.col("rule_ord")) if rules else F.lit(None).cast(kind)
    applies = F.lit(False)
    for i, r in rules:
        applies = applies | ((F.col("rule_ord") == i) & language_matches(F.col("uri"), r.languages))
    return hits.where(applies).select("uri", "rule_ord", of(lambda r: r.id, "string").alias("rule_id"), of(lambda r: r.level, "string").alias("level"), of(lambda r: float(r.confidence), "double").alias("confidence"), "message", "start_line", "end_line")


def scan(artifacts: DataFrame, rules: list[Rule], tier: str = "instant") -> DataFrame:
    """The findings of all rules, with a pattern or with a check: uri, rule_ord, rule_id, level, message, confidence,
    start_line, end_line, tier. rule_ord is a rule's place in the list."""
    columns = ["uri", "rule_ord", "rule_id", "level", "message", "confidence", "start_line", "end_line"]
    patterns = regex_scan(artifacts, rules, tier).withColumn("end_line", F.col("start_line")).select(*columns)
    return patterns.unionByName(syntax_scan(artifacts, rules).select(*columns)).withColumn("tier", F.lit(tier))


def function_index(artifacts: DataFrame) -> DataFrame:
    """The functions of artifacts: uri, fn_ord (place in the file), name, class (or receiver, or empty), start_line, end_line,
    params (null where a language's functions don't tell)."""
    convert = lambda path, found: [(path, i, f.name, f.owner, f.start, f.end, f.params) for i, f in enumerate(found.functions)]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    return _known(artifacts).mapInArrow(_each(convert, ["uri", "fn_ord", "name", "class", "start_line", "end_line", "params"], kinds), "uri string, fn_ord int, name string, class string, start_line int, end_line int, params int")


def qualified_name() -> Column:
    """Of findings with function and class: the function's name behind its class."""
    return F.when(F.coalesce("class", F.lit("")) != "", F.concat_ws(".", "class", "function")).otherwise(F.col("function"))
