"""Secret scan with multipart credential linking, as DataFrame operations only.

Patterns give spans of six kinds. Assignments, access ids and long hex strings are reported as they are.
Bare keys, logins and endpoints are weak: an interval join within a scope of text around them reports one
only where a complementary part stands beside it (a key needs an identifier, a login needs a secret, an
endpoint needs an access id or a strong secret)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: kind: (pattern, group that holds the value, fewest characters of the value)
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "key": (r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40),
    "login": (r"""(?i:user(?:_?name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.+-]{3,})""", 1, 3),
    "endpoint": (r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{3,}""", 0, 3),
}
BASE = ("assign", "access", "hex")
#: weak kind: the kinds of which one must stand within the scope
COMPLEMENTS = {"key": ("access", "login"), "login": ("assign", "hex", "key"), "endpoint": ("access", "assign", "hex")}
TRIGGERS = ("assign", "access", "hex", "key")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _parts(kind: str) -> Column:
    """The texts between the matches, the matches and their values."""
    pattern, group, _ = KINDS[kind]
    text = F.col("text")
    return F.struct(
        F.lit(kind).alias("kind"),
        F.arrays_zip(
            F.split(text, pattern, -1).alias("gap"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        ).alias("parts"),
    )


def all_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, kind, start, end) of every pattern's matches, weak ones included, in code points."""
    # the cheapest test first; a document without a trigger has nothing to report
    tests = [F.col("text").contains("AKIA"), *(F.col("text").rlike(KINDS[k][0]) for k in TRIGGERS if k != "access")]
    hit = _keyed(docs).where(tests[0] | tests[1] | tests[2] | tests[3])
    kinds = hit.select("doc_id", "text_hash", F.explode(F.array(*map(_parts, KINDS))).alias("x"))
    rows = kinds.select("doc_id", "text_hash", F.col("x.kind").alias("kind"), F.posexplode("x.parts").alias("no", "p")).where("p.match is not null")
    rows = rows.select("doc_id", "text_hash", "kind", "no", F.length("p.gap").alias("gap"), F.length("p.match").alias("len"), F.length("p.value").alias("value")).distinct()
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("doc_id", "text_hash", "kind").orderBy("no"))
    fewest = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[2])])
    return rows.withColumn("end", end).where(F.col("value") >= fewest[F.col("kind")]).select("doc_id", "text_hash", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def linked(spans: DataFrame, scope: int) -> DataFrame:
    """The weak spans that have a complementary part within `scope` code points.

    Both sides are dealt into bins as wide as the scope, so that the interval condition becomes an
    equi-join; a bin holds as many spans as fit in its width, however many the document has."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope))).alias("bin")
    needs = F.create_map(*[x for k, v in COMPLEMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    weak = spans.where(F.col("kind").isin(*COMPLEMENTS)).select("*", bins(F.col("start") - scope, F.col("end") + scope)).withColumn("needs", needs[F.col("kind")]).withColumn("needed", F.explode("needs")).drop("needs")
    part = spans.select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash"), F.col("kind").alias("c_kind"), F.col("start").alias("c_start"), F.col("end").alias("c_end"), bins(F.col("start"), F.col("end")).alias("c_bin"))
    on = weak.doc_id.eqNullSafe(part.c_id) & (weak.text_hash == part.c_hash) & (weak.bin == part.c_bin) & (weak.needed == part.c_kind) & (part.c_start <= weak.end + scope) & (part.c_end >= weak.start - scope)
    return weak.join(part, on, "left_semi").select(*spans.columns).distinct()


def secret_spans(docs: DataFrame, scope: int = 240) -> DataFrame:
    """(doc_id, text_hash, kind, start, end): the base spans and the weak spans that are linked."""
    spans = written(all_spans(docs), "spans")
    return spans.where(F.col("kind").isin(*BASE)).unionByName(linked(spans, scope))


def secret_report(docs: DataFrame, scope: int = 240) -> DataFrame:
    """A row per row of docs (doc_id, text, ...): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end by start, then kind as in KINDS; base_sha256 is of the base ones alone. Null
    texts count as empty; rows that repeat or lack a doc_id are each judged by their own text; other columns
    are ignored; an empty table gives no rows."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    item = F.struct("start", order[F.col("kind")].alias("order"), "end", "kind")
    named = secret_spans(docs, scope).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(item)).alias("found")).withColumnsRenamed({"doc_id": "s_id", "text_hash": "s_hash"})
    keyed = _keyed(docs).select("doc_id", "text_hash")
    both = keyed.join(named, keyed.doc_id.eqNullSafe(named.s_id) & (keyed.text_hash == named.s_hash), "left")
    found = F.coalesce("found", F.array().cast(named.schema["found"].dataType))
    held = both.select("doc_id", found.alias("found"))
    join = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s.kind == k)).cast("long")
    return held.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(join(F.filter("found", lambda s: s.kind.isin(*BASE))), 256).alias("base_sha256"), join(F.col("found")).alias("spans"))
