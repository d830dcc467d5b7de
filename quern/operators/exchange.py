"""Findings and rules in the forms that other tools read: descriptors, fixes, keys, JSON, Markdown, CSV, nested runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .reports import priority
from .rules import Rule


def related_locations(related: Column) -> Column:
    """Of structs (path, start_line, end_line, message) those with a path and a line above 0; an end that isn't above 0
    and an empty message become null."""
    kept = F.filter(related, lambda r: (F.coalesce(r.path, F.lit("")) != "") & (r.start_line > 0))
    return F.transform(kept, lambda r: F.struct(r.path.alias("path"), r.start_line.alias("start_line"), F.when(r.end_line > 0, r.end_line).alias("end_line"), F.nullif(r.message, F.lit("")).alias("message")))


def with_fix(findings: DataFrame) -> DataFrame:
    """findings (uri, start_line, end_line, recommendation, replacement) with fix: what to put in place of which lines;
    null without a replacement."""
    fix = F.struct(F.col("recommendation").alias("description"), "uri", "start_line", "end_line", F.col("replacement").alias("text"))
    return findings.withColumn("fix", F.when(F.coalesce("replacement", F.lit("")) != "", fix))


def with_snippets(findings: DataFrame, files: DataFrame) -> DataFrame:
    """findings with the snippet of their lines from files (path, content); null where there is no such file or line."""
    content = files.select(F.col("path").alias("s_path"), F.col("content").alias("s_content"))
    joined = findings.join(content, F.col("uri") == F.col("s_path"), "left")
    return joined.withColumn("snippet", T.snippet(F.col("s_content"), F.col("start_line"), F.greatest("start_line", "end_line"))).drop("s_path", "s_content")


def descriptors(spark: SparkSession, rules: list[Rule], policies: DataFrame | None = None) -> DataFrame:
    """Rules as tools describe them (id, level, text, help_text, help_markdown, help_uri, relations), and enabled
    policies (name, severity, instruction, enabled) as rules of their own."""
    schema = "id string, level string, text string, remediation string, references array<string>, cwe array<string>, owasp array<string>"
    rows = spark.createDataFrame([(r.id, r.level, r.message, r.remediation, r.references, r.cwe, r.owasp) for r in rules], schema)
    none = F.array().cast("array<string>")
    if policies is not None:
        rows = rows.unionByName(policies.where("enabled").select(F.col("name").alias("id"), F.col("severity").alias("level"), F.col("instruction").alias("text"), F.lit("").alias("remediation"), none.alias("references"), none.alias("cwe"), none.alias("owasp")))
    links = F.when(F.size("references") > 0, F.array_join(F.transform("references", lambda x: F.concat(F.lit("\n- "), x)), ""))
    fixed = F.nullif(F.col("remediation"), F.lit(""))
    help_of = lambda a, b: F.nullif(F.concat_ws("\n\n", F.concat(F.lit(a), fixed), F.concat(F.lit(b), links)), F.lit(""))
    relations = F.concat(F.transform("cwe", lambda x: F.concat(F.lit("CWE:"), F.regexp_replace(x, "^CWE-", ""))), F.transform("owasp", lambda x: F.concat(F.lit("OWASP:"), x)))
    return rows.select("id", "level", "text", help_of("", "References:").alias("help_text"), help_of("**Remediation:** ", "**References:**").alias("help_markdown"), T.help_uri(F.col("references"), F.col("cwe")).alias("help_uri"), relations.alias("relations"))


def struct_key(fields: list[str], named: Column | None = None) -> Column:
    """sha256 of the fields as a JSON object in this order, missing ones empty; named: a map column `policies` that
    comes last, in order of its keys."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]
    if named is not None:
        parts.append(F.map_from_entries(F.array_sort(F.map_entries(named))).alias("policies"))
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def short_key(*parts: Column) -> Column:
    """The first 32 hex digits of the key of parts."""
    return F.substring(T.content_key(*parts), 1, 32)


def cache_entries(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """A cache entry an artifact (path, content): its key and how many findings are stored under it."""
    n = findings.groupBy(F.col("uri").alias("f_uri")).agg(F.count("*").alias("n"))
    return artifacts.select("path", T.content_key(F.col("content"), F.col("path")).alias("key")).join(n, F.col("path") == F.col("f_uri"), "left").select("path", "key", F.coalesce("n", F.lit(0)).cast("long").alias("findings"))


def markdown(findings: DataFrame, verdicts: DataFrame, key: str = "run_id") -> DataFrame:
    """A run's report in parts, each a row: (key, part, priority, uri, ord, text), in that order. Part 0 is the heading,
    1 a row of the table of severities, 2 a finding, 3 the end. A report of any length is written by sorting the parts."""
    n = findings.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("uri").alias("files"))
    none = [F.lit(0).alias("priority"), F.lit("").alias("uri"), F.lit(0).cast("long").alias("ord")]
    total = F.coalesce("n", F.lit(0)).cast("string")
    head = F.concat(F.lit("## Analysis Summary\n\n**Decision:** "), "decision", F.lit(" | **Findings:** "), total, F.lit(" | **Files:** "), F.coalesce("files", F.lit(0)).cast("string"), F.lit("\n"), F.when(F.col("n").isNull(), "\nNo findings detected.\n").otherwise("\n### Findings by Severity\n| Severity | Count |\n|----------|-------|\n"))
    # both rows of a run come of one, so that what the verdicts rest on is worked out once
    both = F.inline(F.array(F.struct(F.lit(0).alias("part"), head.alias("text")), F.struct(F.lit(3).alias("part"), F.lit("---\n").alias("text"))))
    heads = verdicts.join(n, key, "left").select(key, both).select(key, "part", *none, "text")
    known = findings.where(F.col("level").isin("error", "warning", "note")).groupBy(key, "level").agg(F.count("*").alias("n"))
    rows = known.select(key, F.lit(1).alias("part"), priority(F.col("level")).alias("priority"), none[1], none[2], F.concat(F.lit("| "), "level", F.lit(" | "), F.col("n").cast("string"), F.lit(" |\n")).alias("text"))
    placed, line = F.coalesce("uri", F.lit("")), F.coalesce("start_line", F.lit(0))
    where = F.when(placed == "", "").when(line > 0, F.concat(F.lit(" in <code>"), placed, F.lit(":"), line.cast("string"), F.lit("</code>"))).otherwise(F.concat(F.lit(" in <code>"), placed, F.lit("</code>")))
    span = F.concat(line.cast("string"), F.lit("-"), F.greatest(line, F.coalesce("end_line", F.lit(0))).cast("string"))
    file = F.when(placed == "", "").when(line > 0, F.concat(F.lit("**File:** `"), placed, F.lit("` lines "), span, F.lit("\n"))).otherwise(F.concat(F.lit("**File:** `"), placed, F.lit("`\n")))
    sure = F.when(F.col("confidence").isNotNull(), F.concat(F.lit("**Confidence:** "), F.format_string("%.2f", "confidence"), F.lit("\n"))).otherwise("")
    body = F.concat(F.lit("<details>\n<summary><strong>"), "level", F.lit("</strong> — "), "rule_id", F.lit(": "), T.truncate_bytes(F.col("message"), 80), where, F.lit("</summary>\n\n**Rule:** "), "rule_id", F.lit("\n"), sure, file, F.lit("\n> "), "message", F.lit("\n\n</details>\n\n"))
    items = findings.select(key, F.lit(2).alias("part"), priority(F.col("level")).alias("priority"), placed.alias("uri"), "ord", body.alias("text"))
    return heads.unionByName(rows).unionByName(items)


def pretty(findings: DataFrame, key: str = "run_id") -> DataFrame:
    """A run's findings as plain lines, by file and line: (key, uri, start_line, ord, text); a file's name is a line of
    its own before them (ord -1)."""
    placed, line = F.coalesce("uri", F.lit("")), F.coalesce("start_line", F.lit(0)).alias("start_line")
    sure = F.when(F.col("confidence").isNotNull(), F.concat(F.lit(" ("), F.format_string("%.2f", "confidence"), F.lit(")"))).otherwise("")
    text = F.concat(F.lit("    "), F.rpad(F.concat(line.cast("string"), F.lit(":1")), 6, " "), F.lit(" "), F.rpad("level", 7, " "), F.lit("  "), "rule_id", F.lit("  "), "message", sure)
    rows = findings.select(key, placed.alias("uri"), line, "ord", text.alias("text"))
    names = rows.select(key, "uri").distinct().select(key, "uri", F.lit(0).alias("start_line"), F.lit(-1).cast("long").alias("ord"), F.concat(F.lit("  "), "uri").alias("text"))
    return rows.unionByName(names)


def totals_line(findings: DataFrame, key: str = "run_id") -> DataFrame:
    """What a run's plain report ends with: 1 error, 2 warnings, 3 notes."""
    n = findings.groupBy(key).agg(*[F.count_if(F.col("level") == x).alias(x) for x in ("error", "warning", "note")])
    said = [F.when(F.col(x) > 0, F.concat(F.col(x).cast("string"), F.lit(f" {x}"), F.when(F.col(x) == 1, "").otherwise("s"))) for x in ("error", "warning", "note")]
    return n.select(key, F.concat_ws(", ", *said).alias("text"))


def csv_field(c: Column) -> Column:
    """Quoted, with quotes doubled, where a comma, a quote or a line end is in it; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(columns: list[str]) -> Column:
    return F.concat_ws(",", *[csv_field(F.col(c)) for c in columns])


def run_name(path: Column) -> Column:
    """A name for files and folders: each slash, backslash, colon and space becomes a dash, one for one."""
    return F.translate(path, "/\\: ", "----")


def few_shot(examples: DataFrame, key: str, order: str) -> DataFrame:
    """A text a key for a prompt: examples (rule_id, message, reason, verdict) in order. Callers pass the few that were
    retrieved for a key."""
    label = F.when(F.col("verdict").isin("noise", "wrong"), "NOISE PATTERN").otherwise("USEFUL PATTERN")
    why = F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit("Context: "), "reason", F.lit("\n"))).otherwise("")
    each = F.concat(F.lit("["), label, F.lit("] Rule "), "rule_id", F.lit(':\nFinding: "'), "message", F.lit('"\n'), why, F.lit("\n"))
    rows = examples.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), each.alias("t")))).alias("x"))
    return rows.select(key, F.array_join("x.t", "").alias("text"))


def similar_examples(examples: DataFrame, vector: list[float], k: int = 3) -> DataFrame:
    """The k examples (vec_id, embedding, ...) nearest to one vector by cosine, ties to the smaller vec_id. Vectors of
    length 0 or of other dimensions take no part."""
    asked = F.array(*[F.lit(float(x)) for x in vector])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    own, e = sum(x * x for x in vector) ** 0.5, F.col("embedding")
    norm = F.sqrt(dot(e, e))
    fit = examples.where(F.size(e) == len(vector)).withColumn("norm", norm).where(f"norm > 0 and {float(own)}D > 0")
    return fit.withColumn("cosine", dot(e, asked) / (F.col("norm") * F.lit(own))).drop("norm").orderBy(F.desc("cosine"), "vec_id").limit(k)


def nested_run(findings: DataFrame, key: str = "run_id") -> DataFrame:
    """Findings as JSON results of the static-analysis interchange format, a row a finding: (key, ord, result)."""
    region = F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    props = F.struct(F.col("confidence"), F.col("tier"))
    result = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.when(F.col("uri").isNotNull(), F.array(place)).alias("locations"), props.alias("properties"))
    return findings.select(key, "ord", F.to_json(result).alias("result"))
