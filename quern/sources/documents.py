"""Whole interchange documents of any length: logs of runs, verdicts, cache entries.

A document is a head, its items and a tail, each a row of its own: (key, part, ord, text). Rows are sorted by range, so each
task writes a piece of one document or of several, and a long document is many pieces. A document's files, joined in the
order of their names, are its text: join_document() copies them, and read_log_pieces() reads them where they are. No row and
no task ever holds a document."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import views
from ..operators.rules import Rule
from .scratch import working_table

#: Columns of a finding that its JSON result is made of, besides ord.
FIELDS = "rule_id level message uri start_line end_line snippet confidence tier function class baseline_state suppressed_by".split()
#: Schema and version of the interchange format.
SCHEMA, VERSION = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json", "2.1.0"
RESULT = "ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int,snippet:struct<text:string>>>,logicalLocations:array<struct<name:string,kind:string,fullyQualifiedName:string>>>>, fingerprints map<string,string>, partialFingerprints map<string,string>, baselineState string, suppressions array<struct<kind:string,justification:string>>, properties struct<confidence:double,tier:string,ord:bigint>"


def _ends(heads: DataFrame, key: str) -> DataFrame:
    """Heads and tails as parts; both rows of a document come of one, so that what heads rest on is worked out once."""
    return heads.select(key, F.inline(F.array(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"), F.col("head").alias("text")), F.struct(F.lit(2).alias("part"), F.lit(0).cast("long").alias("ord"), F.col("tail").alias("text")))))


def parts(heads: DataFrame, items: DataFrame, key: str = "run_id") -> DataFrame:
    """heads (key, head, tail), a row a document, and items (key, ord, text) as parts of documents: (key, part, ord, text). Part 0 is
    the head, 1 an item, 2 the tail; items but the first begin with a comma. ord tells a document's items apart; items of
    documents without a head are left out."""
    first = items.groupBy(F.col(key).alias("f_key")).agg(F.min("ord").alias("first"))
    comma = F.when(F.col("ord") == F.col("first"), "").otherwise(",")
    body = items.join(first, F.col(key).eqNullSafe(F.col("f_key"))).join(heads.select(F.col(key).alias("h_key")), F.col(key).eqNullSafe(F.col("h_key")), "left_semi")
    body = body.select(key, F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), F.concat(comma, "text").alias("text"))
    return _ends(heads, key).unionByName(body)


def _given(c: str, columns: list[str], kind: str = "string") -> Column:
    return F.col(c) if c in columns else F.lit(None).cast(kind)


def result(findings: DataFrame) -> Column:
    """A finding as a JSON result: place, snippet, function, both fingerprints, baseline state, suppression, severity and
    precision. Columns that findings lack, and nulls, are left out."""
    has, c = findings.columns, F.col
    given = lambda name, kind="string": _given(name, has, kind)
    fp = T.content_fingerprint(c("rule_id"), given("snippet"))
    line = T.line_fingerprint(c("rule_id"), c("uri"), F.coalesce("start_line", F.lit(0)), c("message"))
    some = lambda test, x: F.when(test, x)
    named = F.concat_ws(".", F.nullif(given("class"), F.lit("")), given("function"))
    logical = some(given("function").isNotNull(), F.array(F.struct(given("function").alias("name"), F.lit("function").alias("kind"), named.alias("fullyQualifiedName"))))
    region = F.struct(c("start_line").alias("startLine"), c("end_line").alias("endLine"), some(given("snippet").isNotNull(), F.struct(given("snippet").alias("text"))).alias("snippet"))
    place = F.struct(F.struct(F.struct(c("uri").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"), logical.alias("logicalLocations"))
    severity, precision = views.severity_score(c("level")), views.precision(given("tier"))
    properties = F.struct(given("confidence", "double").alias("confidence"), given("tier").alias("tier"), c("ord").alias("ord"), severity.alias("security-severity"), precision.alias("precision"))
    suppression = some(given("suppressed_by").isNotNull(), F.array(F.struct(F.lit("external").alias("kind"), given("suppressed_by").alias("justification"))))
    return F.to_json(F.struct(c("rule_id").alias("ruleId"), c("level").alias("level"), F.struct(c("message").alias("text")).alias("message"), some(c("uri").isNotNull(), F.array(place)).alias("locations"), some(fp.isNotNull(), F.struct(fp.alias("contentHash/v1"))).alias("fingerprints"), F.struct(line.alias("primaryLocationLineHash")).alias("partialFingerprints"), given("baseline_state").alias("baselineState"), suppression.alias("suppressions"), properties.alias("properties")))


def _taxonomies(rules: list[Rule]) -> list[dict]:
    """CWE and OWASP numbers of all rules, in the order in which they come up."""
    out = []
    for name, prefix, pick in (("CWE", "CWE-", lambda r: r.cwe), ("OWASP", "", lambda r: r.owasp)):
        ids = dict.fromkeys(x.removeprefix(prefix) for r in rules for x in pick(r))
        out += [{"name": name, "taxa": [{"id": x} for x in ids]}] if ids else []
    return out


def _described(r: Rule) -> dict:
    links = "".join(f"\n- {x}" for x in r.references)
    text = "\n\n".join(x for x in (r.remediation, links and f"References:{links}") if x)
    out: dict = {"id": r.id, "shortDescription": {"text": r.message}, "defaultConfiguration": {"level": r.level}}
    if text:
        out["help"] = {"text": text}
    related = [{"target": {"id": x.removeprefix("CWE-"), "toolComponent": {"name": "CWE"}}, "kinds": ["relevant"]} for x in r.cwe]
    related += [{"target": {"id": x, "toolComponent": {"name": "OWASP"}}, "kinds": ["relevant"]} for x in r.owasp]
    return out | ({"relationships": related} if related else {})


def log_heads(runs: DataFrame, rules: list[Rule], tool: str = "quern", version: str = "1", key: str = "run_id") -> DataFrame:
    """head and tail of a log for each of runs (key, guid, baseline_guid, scope, persona, directory; all but the key may be
    absent): tool with its rules, taxonomies, invocation, identity and properties."""
    driver = {"name": tool, "version": version, "rules": [_described(r) for r in rules]}
    said = lambda name: _given(name, runs.columns)
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f',"{name}":'), F.to_json(value)))
    guid, own = said("guid"), F.struct(said("scope").alias("inputScope"), said("persona").alias("persona"))
    place = F.struct(F.struct(F.coalesce(said("directory"), F.lit("")).alias("uri")).alias("workingDirectory"), F.lit(True).alias("executionSuccessful"))
    text = F.concat(
        F.lit(f'{{"$schema":"{SCHEMA}","version":"{VERSION}","runs":[{{"tool":{{"driver":{json.dumps(driver)}}},"taxonomies":{json.dumps(_taxonomies(rules))}'),
        F.coalesce(field("invocations", F.array(place)), F.lit("")),
        F.coalesce(field("automationDetails", F.when(guid.isNotNull(), F.struct(guid.alias("guid")))), F.lit("")),
        F.coalesce(F.when(said("baseline_guid").isNotNull(), F.concat(F.lit(',"baselineGuid":"'), said("baseline_guid"), F.lit('"'))), F.lit("")),
        F.coalesce(field("properties", own), F.lit("")),
        F.lit(',"results":['),
    )
    return runs.select(key, text.alias("head"), F.lit("]}]}").alias("tail"))


def run_logs(findings: DataFrame, runs: DataFrame, rules: list[Rule], key: str = "run_id") -> DataFrame:
    """The logs of runs as parts, with all their findings; a run without findings has an empty list."""
    return parts(log_heads(runs, rules, key=key), findings.select(key, "ord", result(findings).alias("text")), key)


def verdict_documents(verdicts: DataFrame, relevant: DataFrame, key: str = "run_id") -> DataFrame:
    """Verdicts (key, decision, reason) as parts: decision, reason, and every relevant finding as a result."""
    head = F.to_json(F.struct("decision", "reason"))
    heads = verdicts.select(key, F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"relevant_findings":[')).alias("head"), F.lit("]}").alias("tail"))
    return parts(heads, relevant.select(key, "ord", result(relevant).alias("text")), key)


def cache_documents(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """A cache entry an artifact (path, content) as parts, by path: its key and all its findings (uri, ord, ...)."""
    key = F.to_json(F.struct(T.content_key(F.col("content"), F.col("path")).alias("key"), F.col("path")))
    heads = artifacts.select("path", F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit(',"results":[')).alias("head"), F.lit("]}").alias("tail"))
    return parts(heads, findings.select(F.col("uri").alias("path"), "ord", result(findings).alias("text")), "path")


def _in_order(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartitionByRange(key, "part", "ord").sortWithinPartitions(key, "part", "ord")


def _write(ordered: DataFrame, text: Column, path: str, key: str, compression: str) -> None:
    ordered.select(key, text.alias("value")).write.mode("append").partitionBy(key).option("compression", compression).text(path)


def write_documents(rows: DataFrame, path: str, key: str = "run_id", compression: str = "none") -> None:
    """Parts in order, a folder a document, a line a part. A task writes a piece of each document in its range. compression:
    none, gzip or another codec of Spark's text files; what reads pieces knows it by their names."""
    _write(_in_order(rows, key), F.col("text"), path, key, compression)


def write_logs(findings: DataFrame, runs: DataFrame, rules: list[Rule], path: str, key: str = "run_id", compression: str = "none") -> None:
    """What write_documents() leaves of run_logs(): findings are put in order by their columns and become text as they are written, so
    no text, which is several times as large, is dealt out. findings and runs are read twice."""
    heads, fields = log_heads(runs, rules, key=key), [c for c in FIELDS if c in findings.columns]
    items = findings.select(key, F.col("ord").cast("long").alias("ord"), *fields)
    first = items.groupBy(F.col(key).alias("f_key")).agg(F.min("ord").alias("first")).join(heads.select(F.col(key).alias("h_key")), F.col("f_key").eqNullSafe(F.col("h_key")), "left_semi")
    # a table of its own has a known size: where it is small, findings stay where they are for this join
    with working_table(first, "first") as known:
        body = items.join(known, F.col(key).eqNullSafe(F.col("f_key"))).withColumn("part", F.lit(1)).withColumn("leads", F.col("ord") == F.col("first")).drop("f_key", "first")
        ordered = _in_order(_ends(heads, key).unionByName(body, allowMissingColumns=True), key)
        _write(ordered, F.when(F.col("part") == 1, F.concat(F.when(F.col("leads"), "").otherwise(","), result(ordered))).otherwise(F.col("text")), path, key, compression)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(folder, place, file, bytes): the pieces of each document that write_documents() left, in order; contents aren't read."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    folder = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    return files.select(folder.alias("folder"), "file", "bytes").withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy("file")) - 1)


def join_document(spark: SparkSession, folder: str, target: str) -> None:
    """Copy the pieces of one document, in order, into one file, a buffer at a time; compressed ones become plain text."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    io, source, out_path = jvm.org.apache.hadoop.io.IOUtils, jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(target)
    files = source.getFileSystem(conf)
    out = out_path.getFileSystem(conf).create(out_path, True)
    try:
        for name in sorted(s.getPath().getName() for s in files.listStatus(source) if s.getPath().getName().startswith("part-")):
            at = jvm.org.apache.hadoop.fs.Path(source, name)
            piece, codec = files.open(at), codecs.getCodec(at)
            piece = codec.createInputStream(piece) if codec else piece
            io.copyBytes(piece, out, conf, False)
            piece.close()
    finally:
        out.close()


def read_log_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The findings of logs that write_documents() left under path, read by lines side by side: the columns of read_logs(), with
    ord, both fingerprints, baseline state and function. run_id is the folder's value."""
    lines = spark.read.text(path).where(F.col("value").rlike(r'^,?\{"ruleId":'))
    r = lines.select(F.col("run_id").cast("string").alias("run_id"), F.from_json(F.ltrim("value", F.lit(",")), RESULT).alias("r"))
    at = F.get("r.locations", F.lit(0))
    physical, logical = at["physicalLocation"], F.get(at["logicalLocations"], F.lit(0))
    return r.select("run_id", F.col("r.properties.ord").alias("ord"), F.col("r.ruleId").alias("rule_id"), "r.level", F.col("r.message.text").alias("message"), physical["artifactLocation"]["uri"].alias("uri"), physical["region"]["startLine"].alias("start_line"), physical["region"]["endLine"].alias("end_line"), physical["region"]["snippet"]["text"].alias("snippet"), "r.properties.confidence", "r.properties.tier", F.col("r.baselineState").alias("baseline_state"), F.element_at("r.fingerprints", "contentHash/v1").alias("content_fp"), F.element_at("r.partialFingerprints", "primaryLocationLineHash").alias("line_fp"), logical["fullyQualifiedName"].alias("function"))
