"""Column functions on text, paths and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File name endings of each language name a rule may carry.
LANGUAGE_ENDINGS = {
    "go": [".go"],
    "java": [".java"],
    "python": [".py"],
    "javascript": [".js", ".jsx"],
    "js": [".js", ".jsx"],
    "typescript": [".ts", ".tsx"],
    "ts": [".ts", ".tsx"],
    "c": [".c", ".h"],
    "rust": [".rs"],
}
#: Lower-cased extension to language.
EXTENSION_LANGUAGE = {".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".c": "c", ".h": "c", ".rs": "rust"}


def language_matches(path: Column, languages: list[str]) -> Column:
    """Whether a rule for these languages applies to a path; no languages: to all. Case counts."""
    if not languages:
        return F.lit(True)
    found = F.lit(False)
    for ending in sorted({e for name in languages for e in LANGUAGE_ENDINGS.get(name, [])}):
        found = found | path.endswith(ending)
    return found


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.[^./]*$", 0)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored expression: * and ? stay within a folder, [a-z] and [^a-z] are classes, a backslash
    takes the next character as it is."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^/" + body[1:] if body.startswith("^") else body).replace("[", r"\[").replace("&", r"\&") + "]")
            i = end
        else:
            if c == "\\" and i + 1 < len(pattern):
                i += 1
            out.append(r"\Q" + pattern[i] + r"\E")
        i += 1
    return "^" + "".join(out) + r"\z"


def detect_language(path: Column) -> Column:
    """Language by the extension in lower case; empty if unknown."""
    known = F.create_map(*[F.lit(x) for kv in EXTENSION_LANGUAGE.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(extension(path))), F.lit(""))


def line_count(content: Column) -> Column:
    return (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).cast("long")


def token_estimate(content: Column) -> Column:
    return F.floor(F.octet_length(content) / 4).cast("long")


def normalize_path(path: Column) -> Column:
    """Slashes for backslashes, `.`, `..` and empty parts resolved, `.` for nothing."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(flat, "/"), lambda p: (p != "") & (p != "."))
    rooted = flat.startswith("/")

    def step(done: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        above_root = (p == "..") & (F.size(done) == 0) & rooted
        return F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(above_root, done).otherwise(F.array_append(done, p))

    clean = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), clean)).when(clean == "", ".").otherwise(clean)


def normalized_snippet(snippet: Column) -> Column:
    """Lines without white space at their ends; blank lines dropped."""
    lines = F.transform(F.split(snippet, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def content_fingerprint(rule_id: Column, snippet: Column) -> Column:
    """32 hex digits of the rule and the normalised snippet; null without one."""
    norm = normalized_snippet(snippet)
    return F.when(F.coalesce(norm, F.lit("")) != "", F.substring(F.sha2(F.concat(rule_id, F.lit("\n"), norm), 256), 1, 32))


def line_fingerprint(rule_id: Column, uri: Column, line: Column, message: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", rule_id, F.coalesce(uri, F.lit("")), line.cast("string"), message), 256), 1, 32)


def content_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def snippet(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end of content, from 1; the end is clamped, and a line feed follows unless the last line is in."""
    lines = F.split(content, "\n")
    last = F.least(F.greatest(start, end), F.size(lines))
    text = F.array_join(F.slice(lines, start, F.greatest(last - start + 1, F.lit(0))), "\n")
    return F.when((start >= 1) & (start <= F.size(lines)), F.concat(text, F.when(last < F.size(lines), "\n").otherwise("")))


def last_json_field(text: Column, field: str, default: str = "") -> Column:
    """A string field of a text that is a JSON object or ends with one: of the whole text, else of what begins with the
    last brace from which on the rest is an object that has the field. If words follow, of the last flat object in it; else
    the default."""
    # in brackets, as a parser passes over what follows a value
    whole = lambda t: F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    said = lambda t: F.when(F.rtrim(t).endswith("}") & F.try_variant_get(whole(t), "$[1]", "variant").isNull(), F.nullif(F.try_variant_get(whole(t), f"$[0].{field}", "string"), F.lit("")))
    parts = F.split(text, r"\{")
    rest = lambda i: F.concat(F.lit("{"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "{"))
    ends = F.when(F.size(parts) > 1, F.aggregate(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), F.lit(None).cast("string"), lambda s, i: F.when(s.isNotNull(), s).otherwise(said(rest(i)))))
    objects = F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0))
    return F.coalesce(said(text), ends, F.nullif(F.get_json_object(F.try_element_at(objects, F.lit(-1)), f"$.{field}"), F.lit("")), F.lit(default))


def truncate_bytes(text: Column, size: int) -> Column:
    """At most size bytes, the last three of them dots where something was cut."""
    cut = F.decode(F.substring(F.encode(text, "UTF-8"), 1, size - 3), "UTF-8")
    return F.when(F.octet_length(text) <= size, text).otherwise(F.concat(cut, F.lit("...")))


def help_uri(references: Column, cwe: Column) -> Column:
    """The first reference, or the page of the first CWE number, or null."""
    number = F.regexp_extract(F.try_element_at(cwe, F.lit(1)), r"(\d+)$", 1)
    return F.coalesce(F.try_element_at(references, F.lit(1)), F.when(number != "", F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), number, F.lit(".html"))))
