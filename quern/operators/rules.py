"""Rules, and the regular-expression scan that makes findings of artifacts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import language_matches


@dataclass(frozen=True)
class Rule:
    id: str
    level: str
    confidence: float
    message: str
    category: str
    pattern: str = ""
    languages: list[str] = field(default_factory=list)
    cwe: list[str] = field(default_factory=list)
    owasp: list[str] = field(default_factory=list)
    references: list[str] = field(default_factory=list)
    remediation: str = ""
    ast_check: str = ""
    ast_config: dict[str, int] = field(default_factory=dict)


#: The built-in regex rules, in file order.
BUILT_IN = [
    Rule("S2068", "error", 0.85, "Hard-coded credentials detected", "security", r"""(?i)(password|passwd|pwd|secret|api_key|apikey|api_secret|auth_token|access_token|private_key)\s*[:=]\s*["'][^"']{4,}["']""", [], ["CWE-259", "CWE-798"], ["A07:2021"]),
    Rule("S3649", "error", 0.75, "Possible SQL injection vulnerability", "security", r"""(?i)(SELECT|INSERT|UPDATE|DELETE|EXEC|EXECUTE)\s+.*(\+\s*["']|\+\s*\w+\s*\+|fmt\.Sprintf.*%[sv])""", [], ["CWE-89"], ["A03:2021"]),
    Rule("S2076", "error", 0.7, "Possible command injection vulnerability", "security", r"""exec\.(Command|CommandContext)\s*\([^)]*\+|os/exec.*\+.*["']""", ["go"], ["CWE-78"], ["A03:2021"]),
    Rule("S2083", "warning", 0.65, "Possible path traversal vulnerability", "security", r"(os\.(Open|Create|ReadFile|WriteFile)|ioutil\.(ReadFile|WriteFile)|filepath\.Join)\s*\([^)]*\+", ["go"], ["CWE-22"], ["A01:2021"]),
    Rule("S4426", "warning", 0.9, "Use of weak cryptographic algorithm", "security", r"(md5|sha1|des|rc4)\.(New|Sum)", ["go"], ["CWE-327", "CWE-328"]),
    Rule("S4830", "error", 0.95, "TLS certificate verification disabled", "security", r"InsecureSkipVerify\s*:\s*true", ["go"], ["CWE-295"]),
    Rule("S1086", "warning", 0.75, "Error return value is ignored", "reliability", r"(?m)^\s*[a-zA-Z_][a-zA-Z0-9_]*\s*,\s*_\s*:?=", ["go"], ["CWE-252"]),
    Rule("S1068", "warning", 0.9, "Empty error handling block", "reliability", r"if\s+err\s*!=\s*nil\s*\{\s*\}", ["go"], ["CWE-252"]),
    Rule("S1144", "warning", 0.85, "Unreachable code detected", "reliability", r"(?m)^\s*(return|panic|os\.Exit)\s*\([^)]*\)\s*\n\s*[a-zA-Z]", ["go"], ["CWE-561"]),
    Rule("S2259", "warning", 0.8, "Defer statement inside a loop", "reliability", r"for\s+.*\{[^}]*defer\s+", ["go"], ["CWE-404"]),
    Rule("S1135", "note", 1.0, "Track this TODO/FIXME comment", "maintainability", r"(?i)(TODO|FIXME|HACK|XXX|BUG)[\s:]+"),
    Rule("S125", "note", 0.7, "Remove this commented-out code", "maintainability", r"(?m)^\s*//\s*(if|for|func|return|var|const|type|switch|select)\s+"),
    Rule("S106", "note", 0.8, "Replace this debug statement with a logger", "maintainability", r"(?m)^\s*(fmt\.Print|log\.Print|println)\s*\(", ["go"]),
    Rule("G601", "note", 0.8, "Use %w instead of %s to wrap errors", "maintainability", r"fmt\.Errorf\s*\([^)]*%s[^)]*,\s*err\s*\)", ["go"]),
    Rule("S109", "note", 0.5, "Extract this magic number into a constant", "maintainability", r"(?m)^\s*(?:if|for|switch|case|return)\s+.*[^0-9][2-9]\d{2,}[^0-9]"),
]


def to_java(pattern: str) -> str:
    """A linear-time dialect's pattern for Java: only \\n ends lines, case folds by Unicode, and \\s is the five
    ASCII spaces without the vertical tab."""
    out, in_class, i = ["(?du)"], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(r"\t\n\f\r " if in_class else r"[\t\n\f\r ]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            if two[0] in "[]":
                in_class = two[0] == "["
            out.append(two[0])
            i += 1
    return "".join(out)


#: Matches that a step of the running count of lines covers
STEP = 256


def _lines(parts: Column) -> Column:
    """The line of each match of parts (gap before it, match), from 1: line ends in all that stands before. Counted in
    blocks of STEP, so that no array is copied once a match."""
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    last = lambda a: F.element_at(a, -1)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / STEP).cast("int")), lambda j: F.slice(parts, j * STEP + 1, STEP))
    starts = F.aggregate(blocks, F.array(F.lit(1)), lambda s, b: F.array_append(s, last(s) + F.aggregate(b, F.lit(0), lambda n, p: n + breaks(p.gap) + breaks(p.match))))

    def inside(block: Column, j: Column) -> Column:
        # line ends up to each match's end; its own ones come off again
        ends = F.aggregate(block, F.array(F.get(starts, j)), lambda s, p: F.array_append(s, last(s) + breaks(p.gap) + breaks(p.match)))
        return F.zip_with(F.slice(ends, 2, STEP), block, lambda e, p: e - breaks(p.match))

    return F.flatten(F.transform(blocks, inside))


def regex_scan(artifacts: DataFrame, rules: list[Rule], tier: str = "instant") -> DataFrame:
    """A finding for each non-overlapping match of each rule with a pattern that applies to an artifact's language; no
    such rules, no findings.

    artifacts: (path, content). The line is that of the match's first character. The rules are part of the plan and
    lines are counted within a row, so nothing is joined or shuffled: each artifact unfolds into its rules, and those
    into their matches."""
    rules = [(i, r) for i, r in enumerate(rules) if r.pattern]
    content = F.col("content")

    def found(i: int, r: Rule) -> Column:
        java = to_java(r.pattern)
        parts = lambda m: F.filter(F.arrays_zip(F.split(content, java, -1).alias("gap"), m.alias("match")), lambda p: p.match.isNotNull())
        row = lambda m: F.struct(F.lit(i).alias("rule_ord"), F.lit(r.id).alias("rule_id"), F.lit(r.level).alias("level"), F.lit(r.message).alias("message"), F.lit(r.confidence).alias("confidence"), parts(m).alias("parts"))
        # the matches are looked for once, and what stands between them only where there are any
        once = F.transform(F.array(F.regexp_extract_all(content, F.lit(java), F.lit(0))), lambda m: F.when(F.size(m) > 0, row(m)))
        return F.when(language_matches(F.col("path"), r.languages), F.get(once, F.lit(0)))

    none = "array<struct<rule_ord:int,rule_id:string,level:string,message:string,confidence:double,parts:array<struct<gap:string,match:string>>>>"
    each = F.array_compact(F.array(*[found(i, r) for i, r in rules])) if rules else F.array().cast(none)
    rows = artifacts.select("path", F.explode(each).alias("r"))
    rows = rows.select("path", "r.*").withColumn("line", _lines(F.col("parts")))
    return rows.select(F.col("path").alias("uri"), "rule_ord", "rule_id", "level", "message", "confidence", F.posexplode(F.arrays_zip("line", F.col("parts.match").alias("match"))).alias("match_ord", "p")).select("uri", "rule_ord", "match_ord", "rule_id", "level", "message", "confidence", F.col("p.line").alias("start_line"), F.col("p.match").alias("match"), F.lit(tier).alias("tier"))
