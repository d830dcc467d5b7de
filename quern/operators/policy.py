"""Gates that are written in files: which findings are counted under a name, and what follows from the counts.

    # comment
    default review
    let open    = not suppressed and state not in ("unchanged", "absent")
    let blocker = open and level = "error" and confidence > 0.85
    reject when blocker > 0
    merge when open = 0

A `let` names findings; names above may be used in it. A `when` line compares counts of named findings; the first that holds
decides. Conditions know level, rule, file, line, confidence (0 if missing), tier, state (baseline state, or empty) and suppressed; =, <>,
<, <=, >, >=, in (...), not in (...), like, and, or, not and brackets. They become aggregates of one pass over the findings."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a condition may ask of a finding, as SQL
FIELDS = {"level": "level", "rule": "rule_id", "file": "coalesce(uri, '')", "line": "coalesce(start_line, 0)", "confidence": "coalesce(confidence, 0D)", "tier": "coalesce(tier, '')", "state": "coalesce(baseline_state, '')", "suppressed": "suppressed_by is not null"}
DECISIONS = ("merge", "reject", "review")
_TOKEN = re.compile(r'\s*(?:(?P<string>"(?:\\.|[^"\\])*")|(?P<number>\d+(?:\.\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<sign><=|>=|<>|[=<>(),]))')
_WORDS = {"and", "or", "not", "in", "like"}


class PolicyError(ValueError):
    """What is wrong with a policy, and in which line."""


@dataclass(frozen=True)
class Policy:
    default: str
    #: name -> SQL condition on a finding
    named: dict[str, str]
    #: (decision, SQL condition on counts c_<name>), in order
    rules: list[tuple[str, str]]


def _sql(text: str, known: dict[str, str], where: str) -> str:
    """A condition as SQL; known: what names stand for."""
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise PolicyError(f"{where}: can't read {text[at:].strip()!r}")
        at = m.end()
        if m["string"]:
            plain = re.sub(r"\\(.)", r"\1", m["string"][1:-1])
            out.append("'" + plain.replace("\\", "\\\\").replace("'", "\\'") + "'")
        elif (word := m["word"]) and word.lower() not in _WORDS:
            if word not in known:
                raise PolicyError(f"{where}: unknown name {word!r}")
            out.append(f"({known[word]})")
        else:
            out.append(m[0].strip())
    if not out:
        raise PolicyError(f"{where}: a condition is missing")
    return " ".join(out)


def parse_policy(text: str, name: str = "policy") -> Policy:
    """A policy from its text; raises PolicyError with the line for what can't be read."""
    default, named, rules = "review", {}, []
    for no, line in enumerate(text.splitlines(), 1):
        # a number sign in a string is no comment
        line, where = re.sub(r'("(?:\\.|[^"\\])*")|#.*', lambda m: m[1] or "", line).strip(), f"{name}:{no}"
        if not line:
            continue
        if m := re.fullmatch(r"default\s+(\w+)", line):
            default = m[1]
            if default not in DECISIONS:
                raise PolicyError(f"{where}: unknown decision {default!r}")
        elif m := re.fullmatch(r"let\s+([A-Za-z_]\w*)\s*=\s*(.+)", line):
            if m[1] in FIELDS or m[1] in named or m[1].lower() in _WORDS:
                raise PolicyError(f"{where}: {m[1]!r} is taken")
            named[m[1]] = _sql(m[2], FIELDS | named, where)
        elif m := re.fullmatch(r"(\w+)\s+when\s+(.+)", line):
            if m[1] not in DECISIONS:
                raise PolicyError(f"{where}: unknown decision {m[1]!r}")
            rules.append((m[1], _sql(m[2], {n: f"c_{n}" for n in named}, where)))
        else:
            raise PolicyError(f"{where}: neither default, let nor when")
    return Policy(default, named, rules)


def load_policy(folder: str, otherwise: Policy) -> Policy:
    """The policy of a folder: of several .policy files the one whose name comes last; without any, or without the folder, another."""
    files = sorted(p for p in Path(folder).iterdir() if p.is_file() and p.suffix == ".policy") if os.path.isdir(folder) else []
    return parse_policy(files[-1].read_text(encoding="utf-8"), files[-1].name) if files else otherwise


#: The built-in gate as a policy
DEFAULT = parse_policy("""
default review
let open = not suppressed and state not in ("unchanged", "absent")
let blocker = open and level = "error" and confidence > 0.85
reject when blocker > 0
merge when open = 0
""")


def decide(findings: DataFrame, policy: Policy = DEFAULT, key: str = "run_id") -> DataFrame:
    """A decision a run: (key, decision, and c_<name>, how many findings each name stands for). findings: rule_id, level, uri,
    start_line, confidence, tier, and baseline_state and suppressed_by where there are any."""
    missing = {c: F.lit(None).cast("string") for c in ("baseline_state", "suppressed_by", "tier") if c not in findings.columns}
    counts = findings.withColumns(missing).groupBy(key).agg(F.count("*").alias("c_all"), *[F.count_if(F.expr(sql)).alias(f"c_{n}") for n, sql in policy.named.items()])
    decision: Column = F.lit(policy.default)
    for name, sql in reversed(policy.rules):
        decision = F.when(F.expr(sql), F.lit(name)).otherwise(decision)
    return counts.select(key, decision.alias("decision"), *[f"c_{n}" for n in policy.named])
