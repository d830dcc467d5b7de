"""What is analysed, by what, and in which order: watch patterns, context files, tiers, a model's findings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, glob_regex


def _matches(path: Column, pattern: str) -> Column:
    """A watch pattern: **/dir/** anywhere below a folder; a prefix and a suffix around **; *.ending; else a plain glob
    on the file name."""
    pattern = pattern.replace("\\", "/")
    if pattern.startswith("**/") and pattern.endswith("/**") and len(pattern) > 5:
        return path.contains(f"/{pattern[3:-3]}/")
    parts = pattern.split("**")
    if len(parts) == 2:
        before, after = parts[0].removesuffix("/"), parts[1].removeprefix("/")
        rest = F.lit(True) if not after else path.endswith(after[1:]) if after.startswith("*") else path.contains(after)
        return path.startswith(before) & rest
    if pattern.startswith("*") and "/" not in pattern:
        return path.endswith(pattern[1:])
    return basename(path).rlike(glob_regex(pattern))


def watched(path: Column, watch: list[str], ignore: list[str]) -> Column:
    """Whether changes of a path count: none of the ignored patterns, and one of the watched ones if there are any."""
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^file://", "")
    some = F.lit(not watch)
    for p in watch:
        some = some | _matches(clean, p)
    for p in ignore:
        some = some & ~_matches(clean, p)
    return some


@dataclass(frozen=True)
class Selector:
    """Context files by a glob on their path, for artifacts whose file name matches only_for (empty: for all)."""

    pattern: str
    only_for: str = ""


def context_selectors(artifacts: DataFrame, selectors: list[Selector]) -> DataFrame:
    """(path, selector): the places in the list of the selectors that apply to each artifact."""
    name = basename(F.col("path"))
    hit = F.array_compact(F.array(*[F.when(name.rlike(glob_regex(s.only_for)) if s.only_for else F.lit(True), F.lit(i)) for i, s in enumerate(selectors)]))
    return artifacts.select("path", F.explode(hit).alias("selector"))


def context_files(files: DataFrame, selectors: list[Selector]) -> DataFrame:
    """files (path, content, ...) with the selectors whose pattern they match, a row each; paths are relative."""
    hit = F.array_compact(F.array(*[F.when(F.col("path").rlike(glob_regex(s.pattern.removeprefix("./"))), F.lit(i)) for i, s in enumerate(selectors)]))
    return files.select(F.explode(hit).alias("selector"), "*")


Scan = Callable[[DataFrame], DataFrame]


def progressive(artifacts: DataFrame, tiers: list[tuple[str, Scan]]) -> Iterator[tuple[str, DataFrame]]:
    """Tier by tier, each over all artifacts before the next: the findings, for a caller that shows the quick ones first
    and may stop after any tier."""
    for name, scan in tiers:
        yield name, scan(artifacts).withColumn("tier", F.lit(name))


def tier_messages(artifacts: DataFrame, tiers: list[tuple[str, Scan]]) -> DataFrame:
    """One message an artifact and tier, also where nothing was found: path, tier, findings."""
    names = F.array(*[F.lit(name) for name, _ in tiers])
    asked = artifacts.select("path").distinct().select("path", F.explode(names).alias("tier"))
    found = None
    for name, f in progressive(artifacts, tiers):
        n = f.groupBy(F.col("uri").alias("f_path")).agg(F.count("*").alias("n")).withColumn("f_tier", F.lit(name))
        found = n if found is None else found.unionByName(n)
    on = (F.col("path") == F.col("f_path")) & (F.col("tier") == F.col("f_tier"))
    return asked.join(found, on, "left").select("path", "tier", F.coalesce("n", F.lit(0)).cast("long").alias("findings"))


FOUND = "uri string, rule_id string, level string, message string, start_line int, end_line int, confidence double"


def model_scan(artifacts: DataFrame, instructions: str, model: Callable[[str, str], list[dict]]) -> DataFrame:
    """Findings of a model: model(prompt, instructions) gives dicts with the names of FOUND, for each artifact. Without
    instructions nothing is asked. A finding that names no file is the artifact's. What the model raises fails the job."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = dict(zip(names, (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True))
        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [{**f, "uri": f.get("uri") or path} for f in model(f"// File: {path}\n{content}", instructions)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in types.items()], names)

    asked = artifacts.select("path", "content").where(F.lit(bool(instructions)))
    return asked.mapInArrow(run, FOUND)
