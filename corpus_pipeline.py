"""From raw documents to mixed, sharded training data.

STAGES lists (name, function): each function takes (spark, docs, sf_dir), works on all that the stage before
kept, and returns a DataFrame, which is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import decontaminate, mixing, near_dedup, quality, queries, sharding
from quern.llm.common import written


_PLACE = "place_among_repeats"


def _hidden(docs: DataFrame, taken: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns whose names an operator takes for its own renamed, and how."""
    names = {}
    for c in docs.columns:
        if c in taken:
            names[c] = f"kept_aside_{c}"
            while names[c] in docs.columns:
                names[c] += "_"
    return docs.withColumnsRenamed(names), names


def _shown(df: DataFrame, names: dict[str, str], docs: DataFrame) -> DataFrame:
    """docs' own columns again."""
    return df.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more. Null and empty texts are scored too; repeated rows share their
    fate; a column that is called quality_score comes back as it was. No labels: all score 0.5 and stay. An empty table gives none."""
    model = quality.fit(docs, queries.table(spark, sf_dir, "labels"))
    hidden, names = _hidden(docs, ["quality_score"])
    return _shown(quality.score(hidden, model).where("quality_score >= 0.5"), names, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id. Texts
    without words and rows without an id stay. Rows that repeat an id stay or go together, but of those that repeat
    id and text one stays, that with the first JSON. An empty table gives none; all columns come back as they were."""
    hidden, names = _hidden(docs, [_PLACE])
    kept = near_dedup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    stay = hidden.join(kept, "doc_id", "left_semi").select(*hidden.columns)
    first = Window.partitionBy("doc_id", F.xxhash64("text"), F.crc32("text")).orderBy(F.to_json(F.struct(*hidden.columns)))
    # a doc_id that occurs once is a partition of its own, so nothing large is put in order
    one = stay.withColumn(_PLACE, F.row_number().over(first)).where(f"{_PLACE} = 1").drop(_PLACE)
    return _shown(one.unionByName(hidden.where("doc_id is null")), names, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item. Null and empty texts have no words and stay; rows that
    repeat an id are judged by their own texts; an empty benchmark keeps all."""
    hit = decontaminate.contamination(docs, queries.table(spark, sf_dir, "benchmark")).where("contaminated")
    hit = hit.select(F.col("doc_id").alias("hit_id"), "text_hash").distinct()
    return docs.join(hit, docs.doc_id.cast("long").eqNullSafe(hit.hit_id) & (F.xxhash64(docs.text.cast("string")) == hit.text_hash), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, by the target weights of domains, languages and sources; no document twice. A null language
    or source is a node of its own; texts without words go with their place in their leaf's order; columns that are
    called mix_... come back as they were. An empty table gives none."""
    hidden, names = _hidden(docs, [f"mix_{x}" for x in (*queries.LEVELS, "tokens", "epoch")])
    return _shown(mixing.mix(hidden, queries.LEVELS, queries.WEIGHTS, fraction=0.5, epochs=1), names, docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot in a seeded shuffle; see external_shuffle() for nulls and repeats.
    Columns that are called shard or slot are replaced; an empty table gives none."""
    return sharding.external_shuffle(docs, shards=8)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", shard),
]

#: The classifier and the shuffle can't be said in SQL; the stages are tested against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
