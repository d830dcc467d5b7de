"""The examples nearest to each of many questions, within their groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Examples that a task compares with at a time, and questions that it takes at a time
BLOCK, QUESTIONS = 4096, 4096


def _units(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(k: int):
    """Of rows in order of turn, each turn examples and then questions: each question's k best of them, ties to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, ids, units, waiting = None, None, None, []
        for batch in batches:
            pdf = batch.to_pandas()
            out = []
            cuts = np.flatnonzero((pdf["turn"] != pdf["turn"].shift()) | (pdf["asked"] != pdf["asked"].shift())).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(pdf)], strict=True):
                part = pdf.iloc[a:b]
                if not part["asked"].iloc[0]:
                    if part["turn"].iloc[0] != turn:
                        turn, waiting, units = part["turn"].iloc[0], [], None
                    waiting.append(part)
                    continue
                if part["turn"].iloc[0] != turn:  # nothing to compare with
                    continue
                if units is None:
                    all_of = pd.concat(waiting).sort_values("id", kind="stable")
                    ids, units = all_of["id"].to_numpy(), _units(all_of["v"].tolist())
                scores = _units(part["v"].tolist()) @ units.T
                for no, row in zip(part["no"].tolist(), scores, strict=True):
                    first = np.argsort(-row, kind="stable")[:k]
                    out += [(no, int(ids[i]), float(row[i])) for i in first]
            columns = zip(*out, strict=True) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["no", "example_id", "cosine"])

    return run


def nearest_examples(questions: DataFrame, examples: DataFrame, group: str = "team", k: int = 3, min_cosine: float | None = None) -> DataFrame:
    """For each question the k examples of its group with the highest cosine: (no, rank, example_id, cosine), ties to the smaller id.

    questions: (no long, group, v array of numbers), examples: (id long, group, v). Nulls, vectors of length 0 or with a part that is no
    finite number take no part, and only vectors with equally many parts are compared. A group's examples are dealt into blocks;
    each block meets each part of its group's questions in a task of its own, and the best of all blocks are merged, so neither a
    group's examples nor its questions meet in one task."""
    fine = lambda df: df.withColumn("v", F.col("v").cast("array<double>")).where(F.col(group).isNotNull() & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)))
    place = [F.col(group).cast("string").alias("g"), F.size("v").alias("dim")]
    asked, known = fine(questions).select("no", *place, "v"), fine(examples).select("id", *place, "v")
    size = lambda df, name, most: df.groupBy("g", "dim").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = size(known, "blocks", BLOCK).join(size(asked, "parts", QUESTIONS), ["g", "dim"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = known.join(sizes, ["g", "dim"]).withColumn("block", own("id", "blocks")).withColumn("part", every("parts"))
    right = asked.join(sizes, ["g", "dim"]).withColumn("part", own("no", "parts")).withColumn("block", every("blocks"))
    turn = F.concat_ws(":", "block", "part", "dim", "g").alias("turn")
    none = F.lit(None).cast("long")
    rows = left.select(turn, F.lit(False).alias("asked"), "id", none.alias("no"), "v").unionByName(right.select(turn, F.lit(True).alias("asked"), none.alias("id"), "no", "v"))
    found = rows.repartition("turn").sortWithinPartitions("turn", "asked").mapInArrow(_best(k), "no long, example_id long, cosine double")
    found = found if min_cosine is None else found.where(F.col("cosine") >= min_cosine)
    rank = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("cosine"), "example_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("no", "rank", "example_id", "cosine")
