"""MinHash near-duplicate detection with odd sketches.

Each text's set of word shingles becomes a MinHash signature. Bands of the signature give candidate
buckets; the same samples, folded into a parity bitmap (odd sketch), give a similarity estimate from the
population count of an XOR, which discards candidates that are far below the threshold. A second parity
bitmap, of the whole set, bounds the number of differing shingles from below. What is left is confirmed on
the full shingle sets, and confirmed links are joined into components.

Work stays near-linear in the size of a group of copies: equal sets are merged first; each bucket is then
compared with one pivot a round and members that already share a component are not compared again. Buckets
that still hold several components once pivots find few new links are compared whole, in blocks of 1024
members: each task tests the bitmaps of its sorted runs and gives only the pairs that pass, so no link is
lost to a cap.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, discard, mix64, written

BANDS, ROWS = 30, 5
SKETCH_BITS = 512
SET_BITS = 2048
BLOCK = 1024
_hashes = WordHashes()
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_XOR = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_ROW_MUL = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BAND_NO = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_SAMPLE_NO = np.arange(BANDS * ROWS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; fewer words than width make one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    best = np.full(len(_MUL), np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 1024):
        part = (shingles[None, i : i + 1024] ^ _XOR[:, None]) * _MUL[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    return mix64((mix64(samples.reshape(BANDS, ROWS)) * _ROW_MUL).sum(axis=1, dtype=np.uint64) + _BAND_NO).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of the number of samples that fall on each of SKETCH_BITS bits, as 64-bit words."""
    bits = mix64(samples + _SAMPLE_NO) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch_limit(threshold: float, slack_sigmas: float = 7.0) -> int:
    """Largest XOR population count of two sketches that may still come from sets of that similarity.

    With k samples, the samples that differ are binomial(k, 1 - J); each adds two to the symmetric difference
    d, and an odd sketch of n bits shows n/2 * (1 - exp(-2 d / n)) odd bits of it. The slack covers both
    spreads, so that a true link is discarded with a probability of about 1e-11."""
    k, n = BANDS * ROWS, SKETCH_BITS
    spread = 2 * math.sqrt(k * threshold * (1 - threshold)) + 2
    d = min(2 * k, 2 * k * (1 - threshold) + slack_sigmas * spread)
    return math.ceil(n / 2 * (1 - math.exp(-2 * d / n)))


def set_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap of a whole set. The XOR of two has no more odd bits than the sets have differing
    members, so unlike the samples' sketch it never discards a true link."""
    odd = np.bincount((shingles % np.uint64(SET_BITS)).astype(np.int64), minlength=SET_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signatures(width: int):
    def run(batches):
        for batch in batches:
            n, rows = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(text, width)
                n.append(len(s))
                if len(s):
                    samples = min_hashes(s)
                    rows.append((xxhash.xxh3_128_digest(s.tobytes()), band_keys(samples), odd_sketch(samples), set_sketch(s)))
                else:
                    rows.append((None,) * 4)
            kinds = (pa.binary(), *[pa.list_(pa.int64())] * 3)
            made = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *made], ["doc_id", "n_shingles", "digest", "bands", "sketch", "whole"])

    return run


def _packed(batches):
    """(doc_id, text) to (rep, packed): the text compressed, as it is shuffled more than once."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(pack, batch.column(1).cast(pa.binary()).to_pylist()), pa.binary())], ["rep", "packed"])


def _linked(width: int, pct: int):
    """Of rows (a, b, x, y) with packed texts, the pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        recent: dict[bytes, np.ndarray] = {}

        def full(packed: bytes) -> np.ndarray:
            if packed not in recent:
                if len(recent) >= 64:
                    recent.pop(next(iter(recent)))
                recent[packed] = shingle_set(unpack(packed), width)
            return recent[packed]

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = full(x.as_py()), full(y.as_py())
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both * 100 >= (len(s) + len(t) - both) * pct)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _longs(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _close_in_blocks(pct: int, limit: int):
    """Of rows sorted by (key, one, two), the pairs within each such run that lie in different groups and
    may be similar enough by size, by samples and by whole sets. A run holds two blocks at most."""
    names = ("key", "one", "two", "rep", "group", "block", "n")

    def pairs(rows: dict[str, np.ndarray]):
        m = len(rows["rep"])
        new = np.ones(m, bool)
        new[1:] = np.any([rows[c][1:] != rows[c][:-1] for c in names[:3]], axis=0)
        starts = np.flatnonzero(new)
        end = np.repeat(np.append(starts[1:], m), np.diff(np.append(starts, m)))
        partners = end - np.arange(m) - 1
        total = np.cumsum(partners)
        at = 0
        while at < m:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 200_000)))
            i = np.repeat(np.arange(at, to), partners[at:to])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(partners[at:to]) - partners[at:to], partners[at:to])
            at = to
            p, q = rows["n"][i], rows["n"][j]
            ok = (rows["group"][i] != rows["group"][j]) & (np.minimum(p, q) * 100 >= np.maximum(p, q) * pct)
            ok &= (rows["one"][i] == rows["two"][i]) | (rows["block"][i] != rows["block"][j])
            i, j, most = i[ok], j[ok], (p + q)[ok] * (100 - pct)
            for column in ("whole", "sketch"):
                odd = np.bitwise_count(rows[column][i] ^ rows[column][j]).sum(axis=1, dtype=np.int64)
                ok = odd * (100 + pct) <= most if column == "whole" else odd <= limit
                i, j = i[ok], j[ok]
            a, b = rows["rep"][i], rows["rep"][j]
            yield np.minimum(a, b), np.maximum(a, b)

    def run(batches):
        held = None

        def out(rows):
            for a, b in pairs(rows):
                if len(a):
                    a, b = np.unique(np.stack([a, b]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names} | {"sketch": _longs(batch.column("sketch"), SKETCH_BITS // 64), "whole": _longs(batch.column("whole"), SET_BITS // 64)}
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
            last = np.all([rows[c] == rows[c][-1] for c in names[:3]], axis=0)  # this run may go on
            held = {c: v[last] for c, v in rows.items()}
            if not last.all():
                yield from out({c: v[~last] for c, v in rows.items()})
        if held is not None:
            yield from out(held)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): alternating large-star and small-star rounds,
    each written to the shared folder, until the edges no longer change. component is the smallest node."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("m")))).alias("x"))
        new = written(small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)
        e = new
        if now == mark:
            break
        mark = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _beside(members: DataFrame, one: DataFrame, most: int = 512) -> DataFrame:
    """Members (key, rep, ...) with their key's row of `one` (key, m, ...), m being the number of members.

    A key with more than `most` members and a two-thousandth of all is dealt over parts, each with a copy of its row:
    there are fewer than 2000 such keys, whatever the size, and these alone are broadcast."""
    limit = max(most, (one.agg(F.sum("m")).first()[0] or 0) // 2000)
    parts = F.ceil(F.col("m") / limit).cast("int")
    hot = one.where(F.col("m") > limit).select(F.col("key").alias("hot"), parts.alias("parts"))
    dealt = members.join(F.broadcast(hot), F.col("key") == F.col("hot"), "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))).cast("int")).drop("hot", "parts")
    return dealt.join(one.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), ["key", "part"]).drop("part")


def near_duplicates(docs: DataFrame, threshold_pct: int = 80, width: int = 5, max_pivot_rounds: int = 4) -> DataFrame:
    """Group documents whose sets of `width`-word shingles have a Jaccard similarity of threshold_pct % or more.

    docs: (doc_id long, text string, ...). Returns a row per input row: doc_id, n_shingles (size of the set),
    component_id (smallest doc_id that links reach, its own included), kept (doc_id = component_id).
    Words are split at ASCII white space after lower-casing A-Z. Null, empty and blank texts have no
    shingles, link with nothing and stay. Rows that repeat a doc_id count as one document in the links and
    each give a row. Rows without a doc_id link with nothing: component_id is null, kept is true. Other
    columns are ignored; an empty table gives no rows."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sigs = written(base.mapInArrow(_signatures(width), "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>, whole array<long>"), "signatures")
    reps = written(
        sigs.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct(F.col("n_shingles").alias("n"), "bands", "sketch", "whole"), "doc_id").alias("x")).select("digest", "rep", "x.*"),
        "classes",
    )
    edges = _links(base, reps, threshold_pct, width, max_pivot_rounds)
    groups = components(edges)
    member = sigs.select("doc_id", "n_shingles", "digest").join(reps.select("digest", "rep"), "digest", "left")
    out = member.join(groups, member.rep == groups.node, "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    result = written(out.select("doc_id", "n_shingles", found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept")), "groups")
    for done in (sigs, reps):
        discard(done)
    return result


def _links(base: DataFrame, reps: DataFrame, pct: int, width: int, max_pivot_rounds: int) -> DataFrame:
    """Links (a, b) between class representatives that join the same documents as all links do."""
    entry = reps.select("rep", F.explode("bands").alias("key"))
    shared = entry.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("key", F.col("lo").alias("pivot"))
    members = written(entry.join(shared, "key"), "buckets")
    limit = sketch_limit(pct / 100)
    sketch = reps.select("rep", "n", "sketch", "whole")
    side = lambda x: sketch.select(*[F.col(c).alias(c + x) for c in sketch.columns])

    def nearest(pairs: DataFrame) -> DataFrame:
        """Of pairs (rep, pivot), those that may be similar enough by size, samples and whole sets; of each
        rep the one that differs least. Its other pairs come up again if this one is no link."""
        odd = lambda c: F.expr(f"aggregate(zip_with({c}1, {c}2, (p, q) -> bit_count(p ^ q)), 0, (s, p) -> s + p)")
        both = pairs.join(side("1"), F.col("rep") == F.col("rep1")).join(side("2"), F.col("pivot") == F.col("rep2"))
        sizes = F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * pct
        # with i in common of u in all, u - i differ; 100 i >= pct u leaves at most (100 - pct) / (100 + pct) of n1 + n2
        ok = sizes & (odd("whole") * (100 + pct) <= (F.col("n1") + F.col("n2")) * (100 - pct)) & (odd("sketch") <= limit)
        best = both.where(ok).groupBy("rep").agg(F.min_by("pivot", F.struct(odd("whole") + odd("sketch"), "pivot")).alias("pivot"))
        return best.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()

    # a doc_id that is repeated with other texts has several; a link of any of them counts
    texts = written(base.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(_packed, "rep long, packed binary").join(members.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep", "packed"]), "texts")

    def links(near: DataFrame) -> DataFrame:
        """Of pairs (a, b), those whose full sets are similar enough."""
        near = written(near, "candidates")
        full = near.join(texts.select(F.col("rep").alias("a"), F.col("packed").alias("x")), "a").join(texts.select(F.col("rep").alias("b"), F.col("packed").alias("y")), "b")
        out = written(full.select("a", "b", "x", "y").mapInArrow(_linked(width, pct), "a long, b long").distinct(), "links")
        discard(near)
        return out

    edges = links(nearest(members.where("rep <> pivot").select("rep", "pivot").distinct()))
    new, left, old = edges, members.select("key", "rep"), members
    for turn in range(max_pivot_rounds + 1):
        groups = components(edges)
        edges = written(groups.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")), "stars")
        named = left.join(groups, left.rep == groups.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("group"))
        mixed = named.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("m"), F.min(F.struct(F.xxhash64("rep", "key", F.lit(turn)).alias("h"), F.col("rep").alias("pivot"), F.col("group").alias("pivot_group"))).alias("p")).where("lo <> hi")
        mixed = written(mixed.select("key", "m", "p.pivot", "p.pivot_group"), "mixed")
        left = written(_beside(named, mixed), "unresolved")
        discard(old)
        old = left
        n, all_pairs = left.agg(F.count("*"), F.coalesce(F.sum((F.col("m") - 1) / 2), F.lit(0.0))).first()
        if not n:
            break
        if turn == max_pivot_rounds or all_pairs <= 16 * n or turn and new.count() * 50 < n and all_pairs <= 4096 * n:
            blocks = F.ceil(F.col("m") / BLOCK).cast("int")
            dealt = left.select("key", "rep", "group", blocks.alias("blocks"), F.pmod(F.xxhash64("rep", F.lit(turn)), blocks).cast("int").alias("block"))
            dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            dealt = dealt.select("key", "rep", "group", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
            runs = dealt.join(sketch, "rep").repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
            edges = edges.unionByName(links(runs.mapInArrow(_close_in_blocks(pct, limit), "a long, b long").distinct()))
            break
        new = links(nearest(left.where("group <> pivot_group").select("rep", "pivot").distinct()))
        edges, left = edges.unionByName(new), left.select("key", "rep")
    for done in (old, texts):
        discard(done)
    return edges
