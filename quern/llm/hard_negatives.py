"""Hard negatives for contrastive training, scored with Kronecker-packed products.

The components of many candidates, less their least one, stand in separate fields of one wide integer, a dimension an
integer. A field is wide enough for a whole inner product, so an anchor's components, less their least one, are each
multiplied once with the integer of their dimension, and the sum holds every candidate's product in its field. What
was taken off is added again when the fields are read, in whole numbers of any size, so scores are exact.

Anchors first meet the candidates of their own label, of which the best are their positives; then all others,
for the best ones in the range that each positive's score gives. Both times blocks of candidates come one at a time
and anchors stream past them."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_long, discard, key_number, order_key, whole, written

#: Components in a block, candidates in one wide integer, groups that labels are hashed to, anchors of one turn
BLOCK_COMPONENTS, FIELDS, LABEL_GROUPS, ANCHOR_ROWS = 1 << 18, 1024, 16, 4096
#: Quantised components below this are summed up in 64 bits where sums fit
NARROW = 1 << 31


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id, label (as a string), x (doubles), times: distinct rows without nulls or non-finite components."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    # -0.0 and 0.0 are one number
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform(x, lambda v: v.cast("double") + F.lit(0.0)).alias("x"))
    return rows.groupBy("vec_id", "label", "x").agg(F.count("*").alias("times"))


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row of a block's rows, in order of vec_id."""
    pdf = pdf.sort_values("vec_id", kind="stable")
    names, codes = np.unique(pdf["label"].to_numpy(str), return_inverse=True)
    raw = lambda c, kind: np.asarray(c, kind).tobytes()
    return pd.DataFrame({"dim": [len(pdf["x"].iloc[0])], "block": [pdf["block"].iloc[0]], "labels": [names.tolist()], "codes": [raw(codes, "<i4")], "ids": [raw(pdf["vec_id"], "<i8")], "times": [raw(pdf["times"], "<i8")], "rows": [raw(np.stack(pdf["x"].to_numpy()), "<f8")]})


@dataclass
class Packed:
    """Candidates whose components are packed, a wide integer a dimension, in fields of as many bits as are needed."""

    q: np.ndarray
    low: list[int] = field(init=False)
    integers: dict[int, list[int]] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        low = self.q.min(axis=0)
        self.q = self.q - low
        self.low, self.top, self.sums = low.tolist(), int(self.q.max()), self.q.sum(axis=1)
        self.most_sum = int(self.sums.max())

    def packed(self, width: int) -> list[int]:
        if width not in self.integers:
            if width <= 64:
                columns = [c.astype(f"<u{width // 8}").tobytes() for c in self.q.T]
            else:
                columns = [b"".join(int(v).to_bytes(width // 8, "little") for v in c) for c in self.q.T]
            self.integers[width] = [int.from_bytes(c, "little") for c in columns]
        return self.integers[width]

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Exact inner products with all candidates: 64-bit integers if they fit, else Python's."""
        least = min(anchor)
        biased = [v - least for v in anchor]
        most = self.top * sum(biased)
        width = 32 if most < 1 << 32 else 64 if most < 1 << 63 else (most.bit_length() + 7) // 8 * 8
        total = sum(map(operator.mul, biased, self.packed(width))).to_bytes(len(self.q) * width // 8, "little")
        # (anchor - least) * (q - low) = anchor * q - anchor * low - least * (q - low)
        constant = sum(map(operator.mul, anchor, self.low))
        if width <= 64 and self.sums.dtype != object and most + abs(constant) + abs(least) * self.most_sum < 1 << 63:
            return np.frombuffer(total, f"<u{width // 8}").astype(np.int64) + (constant + least * self.sums)
        step = width // 8
        fields = [int.from_bytes(total[i : i + step], "little") for i in range(0, len(total), step)]
        return np.array(fields, object) + (constant + least * self.sums.astype(object))


def best(scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Of row positions in rising order those of the k highest scores, ties to the first."""
    if len(rows) <= k:
        return rows
    s = scores[rows]
    least = np.sort(s)[len(s) - k] if s.dtype == object else np.partition(s, len(s) - k)[len(s) - k]
    above = (s > least).astype(bool)
    return np.sort(np.concatenate([rows[above], rows[(s == least).astype(bool)][: k - int(above.sum())]]))


class _Candidates:
    """A block, unpacked: rows in order of vec_id, in groups of up to FIELDS, those with wide components apart."""

    def __init__(self, row: dict, scale: int):
        self.ids, self.times, codes = (np.frombuffer(row[c], kind) for c, kind in (("ids", "<i8"), ("times", "<i8"), ("codes", "<i4")))
        self.codes, self.labels = codes, {n: i for i, n in enumerate(row["labels"])}
        x = np.frombuffer(row["rows"], "<f8").reshape(-1, row["dim"])
        wide = (np.abs(x) >= NARROW / scale).any(axis=1)
        self.groups: list[tuple[np.ndarray, Packed]] = []
        for kind in (False, True):
            rows = np.flatnonzero(wide == kind)
            for i in range(0, len(rows), FIELDS):
                part = rows[i : i + FIELDS]
                q = np.array([[whole(v, scale) for v in r] for r in x[part].tolist()], object) if kind else np.floor(x[part] * scale).astype(np.int64)
                self.groups.append((part, Packed(q)))

    def scores(self, anchor: list[int]) -> np.ndarray:
        parts = [(rows, p.scores(anchor)) for rows, p in self.groups]
        out = np.empty(len(self.ids), np.result_type(*(s.dtype for _, s in parts)))
        for rows, s in parts:
            out[rows] = s
        return out


def _search(k: int, scale: int, low_pct: int | None = None, high_pct: int = 0):
    """Of rows in order of pair, each pair a block and then its anchors: the anchors' best of the block. Without low_pct,
    of their own label; with it, of other labels for each positive score, between these percentages of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pair = None
        for batch in batches:
            out: list[tuple] = []
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if row["rows"] is not None:
                    block, pair = _Candidates(row, scale), row["pair"]
                    continue
                if row["pair"] != pair:  # no vector of the block has this length
                    continue
                scores, own = block.scores([whole(v, scale) for v in row["x"]]), block.labels.get(row["label"], -1)
                if low_pct is None:
                    found = [(0, best(scores, np.flatnonzero((block.codes == own) & (block.ids != row["vec_id"])), k))]
                else:
                    found, other = [], block.codes != own
                    for place, key in (w.values() for w in row["wanted"]):
                        p = key_number(key)
                        # low_pct * p <= 100 * score <= high_pct * p
                        inside = other & (scores >= -(-low_pct * p // 100)).astype(bool) & (scores <= high_pct * p // 100).astype(bool)
                        found.append((place, best(scores, np.flatnonzero(inside), k)))
                for place, rows in found:
                    for at in rows.tolist():
                        n = int(scores[at])
                        out.append((row["no"], place, int(block.ids[at]), int(block.times[at]), order_key(n), as_long(n)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["no", "place", "vec_id", "times", "key", "score"])

    return run


def _meet(blocks: DataFrame, anchors: DataFrame, n_anchors: int, n_blocks: int, first, last, search) -> DataFrame:
    """What search() finds where anchors (no, dim, ...) meet the blocks first to last."""
    parts = max(1, math.ceil(n_anchors / ANCHOR_ROWS), min(math.ceil(n_anchors / 256), math.ceil(64 / n_blocks)))
    pair = F.concat_ws(":", "dim", "block", "part").alias("pair")
    left = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(pair, *blocks.columns)
    asked = anchors.withColumn("part", F.pmod("no", F.lit(parts))).withColumn("block", F.explode(F.sequence(first, last)))
    rows = left.drop("block").unionByName(asked.select(pair, *anchors.columns), allowMissingColumns=True)
    rows = rows.repartition(min(20_000, parts * n_blocks), "pair").sortWithinPartitions("pair", F.col("rows").isNull())
    return rows.mapInArrow(search, "no long, place int, vec_id long, times long, key binary, score long")


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each key, with repeated rows one by one, and their rank."""
    by = Window.partitionBy(*keys).orderBy(F.desc("key"), "vec_id")
    cut = found.withColumn("at", F.row_number().over(by)).where(F.col("at") <= k)
    each = cut.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("times"), F.lit(k)).cast("int"))))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "copy"))).where(F.col("rank") <= k)


def hard_negatives(anchors: DataFrame, vectors: DataFrame, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95, scale: int = 256) -> DataFrame:
    """For each anchor and each of its positives the best negatives: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    anchors, vectors: (vec_id long, label, embedding array, ...). Scores are inner products of floor(scale * component).
    An anchor's positives are its best rows of the same label, without its own vec_id; a positive's negatives the best of
    other labels whose score is from low_pct to high_pct % of the positive's (none if that is negative). Ties go to the
    smaller vec_id. Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; vectors of
    another length are not compared. A row that is repeated is a candidate each time; a repeated anchor is asked once. Scores that
    leave 64 bits are ranked exactly and given as the nearest 64-bit number. Empty tables give no rows; other columns are
    ignored."""
    rows = written(taking_part(vectors).withColumn("group", F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int")), "candidates")
    # 16 rows at most
    sizes = {r["group"]: math.ceil(r["n"] / BLOCK_COMPONENTS) for r in rows.groupBy("group").agg(F.sum(F.size("x")).alias("n")).collect()}
    starts = np.cumsum([0, *(sizes.get(g, 0) for g in range(LABEL_GROUPS))]).tolist()
    of = lambda xs: F.get(F.array(*map(F.lit, xs)), F.col("group"))
    n_blocks = max(1, starts[-1])
    dealt = rows.select("*", F.size("x").alias("dim"), (of(starts[:-1]) + F.pmod(F.xxhash64("vec_id", "x"), F.greatest(of(starts[1:]) - of(starts[:-1]), F.lit(1)))).cast("int").alias("block"))
    blocks = written(dealt.groupBy("dim", "block").applyInPandas(_block, "dim int, block int, labels array<string>, codes binary, ids binary, times binary, rows binary"), "blocks")
    asked = taking_part(anchors).withColumn("group", F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int"))
    asked = written(asked.select(F.xxhash64("vec_id", "label", "x").alias("no"), "vec_id", "label", "x", F.size("x").alias("dim"), "group"), "anchors")
    n = asked.count()
    own = asked.where(of(starts[1:]) > of(starts[:-1]))
    found = _meet(blocks, own, n, n_blocks, of(starts[:-1]), of(starts[1:]) - 1, _search(positives, scale))
    chosen = written(_ranked(found, ["no"], positives).select("no", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), "key", F.col("score").alias("positive_score")), "positives")
    wanted = chosen.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("wanted"))
    second = asked.join(wanted, "no").drop("group")
    hard = _ranked(_meet(blocks, second, n, n_blocks, F.lit(0), F.lit(n_blocks - 1), _search(negatives, scale, low_pct, high_pct)), ["no", "place"], negatives)
    out = hard.select("no", "place", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(chosen, ["no", "place"]).join(asked.select("no", F.col("vec_id").alias("anchor_id")), "no")
    result = written(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    for done in (rows, blocks, asked, chosen):
        discard(done)
    return result
