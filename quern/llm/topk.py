"""Exact top-k by inner product with a bit-sliced index.

Vectors of integers are cut into blocks; of each block the index keeps one bitmap for each attribute and bit.
A query's weighted sum of attributes is added up bitmap by bitmap with carry-save adders, for all rows of a
block at once. The k best rows are then selected from the most significant slice of the sums downward, and
rows that tie at the boundary are resolved by their ids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_long, discard, order_key, whole, written

BLOCK_ROWS = 16_384
#: Queries that a task asks of one block: about as many bytes as the block itself
QUERY_ROWS = 4096
#: Pairs of a block and a part of the queries to make at least, down to 256 queries a part
MIN_PAIRS = 64


#: Quantised components below this stand in 64 bits with room for sums
NARROW = 1 << 24


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, dim, x, wide): rows without null or non-finite components, as doubles; wide if a quantised component reaches
    NARROW. floor(scale * component) is taken in whole numbers of any size, where it is used."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    # -0.0 and 0.0 are one number
    doubles = F.transform(x, lambda v: v.cast("double") + F.lit(0.0))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("dim"), doubles.alias("x"))
    return rows.withColumn("wide", F.exists("x", lambda v: F.abs(v) >= float(NARROW) / scale))


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit integers if all are narrow, else Python's."""
    if not len(x) or np.abs(x).max() < NARROW / scale:
        return np.floor(x * scale).astype(np.int64)
    return np.array([whole(v, scale) for v in x.ravel().tolist()], object).reshape(x.shape)


def _build(scale: int):
    """The slices of one block: for each bit and attribute, a bitmap of the rows in rising order of id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        x = _integers(np.stack(pdf["x"].to_numpy()), scale)
        low = x.min(axis=0)
        x = x - low
        bits = max(1, int(x.max()).bit_length())
        room = -len(x) % 64
        slices = [np.packbits(np.pad((x >> b & 1).astype(np.uint8), ((0, room), (0, 0))), axis=0, bitorder="little").T.copy() for b in range(bits)]
        return pd.DataFrame({"dim": [x.shape[1]], "block": [pdf["block"].iloc[0]], "wide": [pdf["wide"].iloc[0]], "n": [len(x)], "bits": [bits], "low": [[str(v) for v in low.tolist()]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "times": [pdf["times"].to_numpy(np.int64).tobytes()], "slices": [np.stack(slices).tobytes()]})

    return run


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS, scale: int = 256) -> DataFrame:
    """A row a block of about block_rows distinct vectors: dim, block, wide, n, bits, low, ids, times (how often each is
    there), slices. Rows are dealt by a hash; repeated ones are counted before, so none makes a block hot. Wide vectors
    have blocks of their own, of a hundredth of the rows, as they have many slices."""
    vectors = written(vectors.groupBy("vec_id", "dim", "x", "wide").agg(F.count("*").alias("times")), "vectors")
    blocks = max(1, math.ceil(vectors.count() / block_rows))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("part", F.when(F.col("wide"), F.pmod(F.xxhash64("x"), F.lit(100))).otherwise(0))
    index = dealt.groupBy("dim", "block", "wide", "part").applyInPandas(_build(scale), "dim int, block int, wide boolean, n int, bits int, low array<string>, ids binary, times binary, slices binary")
    index = written(index, "bit-slices")
    discard(vectors)
    return index


def weighted_sums(slices: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Bitmaps, from the lowest bit, of the sums of weight * attribute over a block. slices: (bits, attributes,
    words); weights: not negative."""
    waiting: dict[int, list[np.ndarray]] = {}
    for j in range(int(weights.max()).bit_length() if len(weights) else 0):
        chosen = np.flatnonzero((weights >> j & 1).astype(bool))
        for b in range(len(slices) if len(chosen) else 0):
            waiting.setdefault(j + b, []).append(slices[b, chosen])
    out, level = [], 0
    while waiting:
        maps = np.concatenate(waiting.pop(level)) if level in waiting else np.zeros((1, slices.shape[2]), np.uint64)
        while len(maps) > 1:  # full adders on triples, a half adder for the last two
            n = len(maps) // 3 * 3
            if n:
                a, b, c = maps[0:n:3], maps[1:n:3], maps[2:n:3]
                ab = a ^ b
                maps, carry = np.concatenate([ab ^ c, maps[n:]]), a & b | c & ab
            else:
                maps, carry = maps[:1] ^ maps[1:], maps[:1] & maps[1:]
            waiting.setdefault(level + 1, []).append(carry)
        out.append(maps[0])
        level += 1
    return out or [np.zeros(slices.shape[2], np.uint64)]


def select_top(sums: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest sums among the rows of a bitmap, ties to the lower position."""
    sure, even = np.zeros_like(rows), rows.copy()
    for s in reversed(sums):
        more = sure | even & s
        n = int(np.bitwise_count(more).sum())
        if n > k:
            even &= s
        else:
            sure = more
            even &= ~s
            if n == k:
                even[:] = 0
                break
    at = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    first = at(sure)
    return np.concatenate([first, at(even)[: max(0, k - len(first))]])


class _Block:
    """One block of the index, unpacked."""

    def __init__(self, row: dict):
        self.bits, self.low = row["bits"], np.array([int(v) for v in row["low"]], object)
        self.ids, self.times = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["times"], np.int64)
        self.slices = np.frombuffer(row["slices"], np.uint64).reshape(self.bits, row["dim"], -1)
        self.full = self._bitmap(0, row["n"])

    def _bitmap(self, start: int, end: int) -> np.ndarray:
        rows = np.zeros(self.slices.shape[2] * 64, np.uint8)
        rows[start:end] = 1
        return np.packbits(rows, bitorder="little").view(np.uint64)

    def best(self, vec_id: int, q: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(vec_id, times, score) of the k best distinct vectors but those with the query's own id."""
        # a negative weight takes the complement of its attribute, which the constant makes good
        below = (q < 0).astype(bool)
        sums = weighted_sums(np.where(below[None, :, None], ~self.slices, self.slices), np.abs(q))
        constant = int(q.astype(object) @ self.low) + int(q[below].sum()) * ((1 << self.bits) - 1)
        rows = self.full
        a, b = np.searchsorted(self.ids, vec_id), np.searchsorted(self.ids, vec_id, "right")
        if a < b:
            rows = rows & ~self._bitmap(a, b)
        for at in select_top(sums, rows, k).tolist():
            total = sum(int(s[at >> 6] >> np.uint64(at & 63)) % 2 << i for i, s in enumerate(sums))
            yield int(self.ids[at]), int(self.times[at]), total + constant


def _search(k: int, scale: int):
    """Of rows in order of pair, each pair a block of the index and then its queries, each query's best of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, blocks, began = None, [], False
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            columns = {c: batch.column(c) for c in ("pair", "dim", "n", "bits", "low", "ids", "times", "slices")}
            pairs, no, vec_id = (batch.column(c).to_pylist() for c in ("pair", "no", "vec_id"))
            is_block, xs = (np.asarray(batch.column("slices").is_valid()), batch.column("x"))
            for i, of in enumerate(pairs):
                if is_block[i]:
                    # a pair's blocks, of narrow and of wide vectors, come before its queries
                    blocks, began = [*(blocks if of == pair and not began else []), _Block({c: v[i].as_py() for c, v in columns.items()})], False
                    pair = of
                elif of == pair:  # queries of a length that no vector of the block has meet no block
                    began, q = True, _integers(np.asarray(xs[i].values), scale)
                    for block in blocks:
                        for vec, times, score in block.best(vec_id[i], q, k):
                            for c, v in zip(out, (no[i], vec_id[i], vec, times, order_key(score), as_long(score)), strict=True):
                                c.append(v)
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], ["no", "query_id", "vec_id", "times", "key", "score"])

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, scale: int = 256, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each query's k highest inner products of floor(scale * component): query_id, rank, vec_id, score.

    queries, vectors: (vec_id long, embedding array, ...). A query's own vec_id is no candidate of its; ties
    go to the smaller vec_id. Vectors that are null, empty, lack an id or hold null or non-finite components
    take no part; vectors of another length than the query's are not compared with it. A vector that is
    repeated is a candidate each time; a repeated query is asked once. Every finite component counts, of any size: scores are
    ranked exactly, and one that leaves 64 bits is given as the nearest 64-bit number.
    Fewer candidates give fewer rows; empty tables give none. Other columns are ignored.

    Each part of up to QUERY_ROWS queries meets each block of the index in a task's turn: the block comes first, the
    queries after it one by one, so a task holds one block however many queries there are. Work grows with queries times
    blocks."""
    index = build_index(quantised(vectors, scale), block_rows, scale)
    asked = written(quantised(queries, scale).drop("wide").distinct().withColumn("no", F.xxhash64("vec_id", "x")), "queries")
    n, blocks = asked.count(), index.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0] + 1
    parts = max(1, math.ceil(n / QUERY_ROWS), min(math.ceil(n / 256), math.ceil(MIN_PAIRS / blocks)))
    pair = F.concat_ws(":", "dim", "block", "part").alias("pair")
    spread = lambda df, name, count: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    left = spread(index, "part", parts).select(pair, "dim", "n", "bits", "low", "ids", "times", "slices")
    right = spread(asked.withColumn("part", F.pmod("no", F.lit(parts))), "block", blocks).select(pair, "no", "vec_id", "x")
    rows = left.unionByName(right, allowMissingColumns=True).repartition(min(20_000, parts * blocks), "pair").sortWithinPartitions("pair", F.col("slices").isNull())
    found = rows.mapInArrow(_search(k, scale), "no long, query_id long, vec_id long, times long, key binary, score long")
    by = Window.partitionBy("no", "query_id").orderBy(F.desc("key"), "vec_id")
    best = found.withColumn("at", F.row_number().over(by)).where(F.col("at") <= k)
    each = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("times"), F.lit(k)).cast("int"))))
    rank = F.row_number().over(Window.partitionBy("no", "query_id").orderBy("at", "copy"))
    result = written(each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "best")
    for done in (index, asked):
        discard(done)
    return result
