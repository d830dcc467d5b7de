"""Hierarchical Pitman-Yor language model.

Each preceding word (and the text's start) has a restaurant of its own; all of them share one parent, the restaurant
of words, whose customers are their tables. The parent's base has no atoms, so a word sits at one table there and
what is left of its mass goes to unknown words. Tables of the context restaurants are sampled by Gibbs: a pair's
number of tables is drawn from its exact law given the tables of all other pairs, how its customers sit at them being
summed over (generalised Stirling numbers). Discounts and strengths of both levels are drawn from a grid by their
likelihood under the seating, once a sweep. Over the retained sweeps the predictive probabilities are averaged.

A draw replaces all of a pair's tables at once, whatever its number of customers, so a frequent pair is as near to the
posterior after a sweep as a rare one. Pairs are reseated side by side; of other pairs' draws the totals T and k are known
as of the sweep's start. A pair seen once has one customer at one table and needs no draw.

Layout: texts become blocks of two million tokens or more, each a row with its distinct words and the places of its
tokens among them. Blocks ask buckets of keys: a message holds the distinct keys of one block that fall into one
bucket, packed. A hot word or pair is thus one key a block, not a row an occurrence, and the number of buckets
grows with the corpus, so none outgrows a task. Texts are cut into words once, pairs are counted and looked up by
the same messages, and blocks are stored bucketed by their number, so they aren't shuffled when answers arrive."""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, discard, kept, mix64, new_path, written

BLOCK_TOKENS = 2_000_000
#: Bytes of text that a bucket of keys stands for
BUCKET_BYTES = 16 << 20
# no word holds a space
_END = xxhash.xxh3_64_intdigest(b" ")
_START = xxhash.xxh3_64_intdigest(b"  ")
_ODD = np.uint64(0x9E3779B97F4A7C15)
DISCOUNTS = np.arange(0.05, 0.96, 0.05)
STRENGTHS = np.array([0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0])
_hashes = WordHashes()


def token_keys(text: bytes | None) -> np.ndarray:
    """Hashes of the start, of each word and of the end of a text."""
    words = (text or b"").lower().split()
    own = np.empty(len(words) + 2, np.uint64)
    own[0], own[-1] = _START, _END
    own[1:-1] = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    return own


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(context * _ODD + word)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is 1: not learnt from. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


# messages

MESSAGE = "at long, source long, kind int, a binary, b binary, c binary"
_MESSAGE = pa.schema([("at", pa.int64()), ("source", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers, compressed with bytes of equal weight side by side; rising ones by their differences."""
    x = x.view(np.uint64) if x.dtype.itemsize == 8 else x.astype(np.uint64)
    if rising:
        x = np.diff(x, prepend=np.uint64(0))
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unpack(data: bytes, rising: bool = False) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(data)[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    x = out.view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if rising else x


def counts(data: bytes, columns: int = 1) -> np.ndarray:
    """Packed numbers as signed ones, a row each; they are stored column by column."""
    return unpack(data).view(np.int64).reshape(columns, -1)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A number below buckets that rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _dealt(bucket: np.ndarray):
    """(bucket, slice) of an array in order of rising bucket."""
    ends = [*np.flatnonzero(np.diff(bucket)).tolist(), len(bucket) - 1]
    start = 0
    for end in ends if len(bucket) else []:
        yield int(bucket[end]), slice(start, end + 1)
        start = end + 1


def _messages(rows: list[tuple], table: bool = False):
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _MESSAGE, strict=True)]
    return pa.Table.from_arrays(arrays, schema=_MESSAGE) if table else pa.RecordBatch.from_arrays(arrays, schema=_MESSAGE)


def _received(table: pa.Table, order: str = "source") -> list[dict]:
    return table.sort_by(order).to_pylist()


def _distinct(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each distinct key starts."""
    first = np.ones(len(sorted_keys), bool)
    first[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(first)


def _by_key(keys: np.ndarray, *values: np.ndarray):
    """Distinct keys in rising order and the sums of values by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = _distinct(keys)
    return keys[at], [np.add.reduceat(v[order], at) if len(at) else v for v in values]


def _bucketed(df: DataFrame, name: str, key: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, bucketed by key in as many parts as a shuffle has; and the table's name."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    parts, path = int(spark.conf.get("spark.sql.shuffle.partitions")), new_path(spark, name)
    df.write.bucketBy(parts, key).option("path", path).saveAsTable(table)
    return kept(spark.table(table), path), table


# blocks

HOME = "at long, doc_id array<long>, held_out array<boolean>, size array<long>, words binary, tokens binary"
_HOME = [c.split()[0] for c in HOME.split(", ")]


def _home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block a row: documents and their numbers of tokens; its distinct words; for each token, the start of a text
    included, the rank of its word by frequency in the block, as words are in the order of their hashes."""
    no, parts, rows, held = TaskContext.get().partitionId() << 40, [], [], 0

    def block():
        nonlocal no, parts, rows, held
        flat = np.concatenate(parts)
        order = np.argsort(flat)
        first = _distinct(flat[order])
        n = np.diff(np.append(first, len(flat)))
        rank = np.empty(len(n), np.int64)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(n))
        at = np.empty(len(flat), np.int64)
        at[order] = np.repeat(rank, n)
        # the words' ranks lead back to their order
        words = pack(flat[order][first], rising=True), pack(rank)
        row = [no, [r[0] for r in rows], [r[1] for r in rows], [len(p) - 1 for p in parts], len(words[0]).to_bytes(4, "little") + words[0] + words[1], pack(at)]
        types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary())
        no, parts, rows, held = no + 1, [], [], 0
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], _HOME)

    for batch in batches:
        for text, *row in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parts.append(token_keys(text))
            rows.append(row)
            held += len(parts[-1])
            if held >= BLOCK_TOKENS:
                yield block()
    if parts:
        yield block()


class Block:
    """A block's distinct words and pairs, in the order of their keys, and what each token refers to."""

    def __init__(self, row: dict):
        self.no, self.size = row["at"], np.array(row["size"], np.int64)
        cut = 4 + int.from_bytes(row["words"][:4], "little")
        self.words = unpack(row["words"][4:cut], rising=True)
        # a block's places fit into 32 bits, and many arrays of them are held at once
        place = np.argsort(unpack(row["words"][cut:]).view(np.int64)).astype(np.int32)
        flat = place[unpack(row["tokens"]).view(np.int64)]
        keep = np.ones(len(flat), bool)
        keep[np.cumsum(self.size + 1) - 1] = False
        self.u, self.w = flat[keep], flat[1:][keep[:-1]]
        self.learnt = np.repeat(~np.array(row["held_out"], bool), self.size)
        h = pair_keys(self.words[self.u], self.words[self.w])
        order = np.argsort(h).astype(np.int32)
        h = h[order]
        first = _distinct(h)
        self.pairs = h[first]
        #: how often a pair is learnt from here
        self.n = np.add.reduceat(self.learnt[order].astype(np.int64), first)
        self.pair = np.empty(len(h), np.int32)
        self.pair[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(h))))
        self.pair_u, self.pair_w = self.u[order[first]], self.w[order[first]]


def _ask(buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                for to, s in _dealt(_bucket(b.pairs, buckets)):
                    yield _messages([(to, b.no, 0, pack(b.pairs[s], rising=True), pack(b.n[s]), None)])

    return run


def _count(asked: pa.Table) -> pa.Table:
    """To each block how often its pairs are learnt from anywhere, and which of those seen more than once it is to
    tell of: the first block that learns from a pair is."""
    rows = _received(asked)
    keys, n = [unpack(r["a"], rising=True) for r in rows], np.concatenate([counts(r["b"])[0] for r in rows])
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    first = _distinct(flat[order])
    times = np.diff(np.append(first, len(flat)))
    total = np.empty(len(flat), np.int64)
    total[order] = np.repeat(np.add.reduceat(n[order], first), times)
    has = order[n[order] > 0]
    tells = np.zeros(len(flat), bool)
    tells[has[_distinct(flat[has])]] = True
    tells &= total > 1
    out, at = [], 0
    for r, k in zip(rows, keys, strict=True):
        s = slice(at, at + len(k))
        out.append((r["source"], r["at"], 0, pack(total[s]), np.packbits(tells[s]).tobytes(), None))
        at += len(k)
    return _messages(out, True)


def _learn(buckets: int):
    """Of a block and its pairs' counts: 0 the counts, for later; 1 its pairs to tell of, by bucket; 2 its words, by
    bucket, with customers as a context, as a word, and how many pairs seen once they are in as either; 3 all its pairs
    seen more than once, by bucket."""

    def run(home: pa.Table, replies: pa.Table) -> pa.Table:
        b = Block(home.to_pylist()[0])
        rows = _received(replies)
        n = np.concatenate([counts(r["a"])[0] for r in rows])
        tells = np.concatenate([np.unpackbits(np.frombuffer(r["b"], np.uint8), count=len(counts(r["a"])[0])).astype(bool) for r in rows])
        out = [(b.no, b.no, 0, pack(n), None, None)]
        bucket = _bucket(b.pairs, buckets)
        at = np.flatnonzero(tells)
        order = np.lexsort((b.pair_u[at], bucket[at]))
        at = at[order]
        u, w = b.words[b.pair_u], b.words[b.pair_w]
        for to, s in _dealt(bucket[at]):
            i = at[s]
            out.append((to, b.no, 1, pack(u[i], rising=True), pack(w[i]), pack(n[i])))
        once, size = (n == 1) & (b.n == 1), len(b.words)
        told = [np.bincount(x, minlength=size) for x in (b.u[b.learnt], b.w[b.learnt], b.pair_u[once], b.pair_w[once])]
        for to, s in _dealt(_bucket(b.words, buckets)):
            out.append((to, b.no, 2, pack(b.words[s], rising=True), pack(np.concatenate([x[s] for x in told])), None))
        many = np.flatnonzero(n > 1)
        for to, s in _dealt(bucket[many]):
            out.append((to, b.no, 3, pack(b.pairs[many[s]], rising=True), None, None))
        return _messages(out, True)

    return run


def _merge_words(told: pa.Table) -> pa.Table:
    rows = _received(told)
    key, sums = _by_key(np.concatenate([unpack(r["a"], rising=True) for r in rows]), *np.concatenate([counts(r["b"], 4) for r in rows], axis=1))
    return _messages([(rows[0]["at"], 0, 0, pack(key, rising=True), pack(np.concatenate(sums)), None)], True)


# seating


@dataclass(frozen=True)
class Law:
    """Discounts and strengths of contexts and of their parent; the parent's customers and words."""

    d: float = 0.5
    theta: float = 3.0
    d0: float = 0.5
    theta0: float = 3.0
    customers: int = 0
    words: int = 0

    def parent(self, k):
        """Probability of a word with k tables; of an unknown word without an argument."""
        return (k - self.d0) / (self.theta0 + self.customers)

    def unknown(self) -> float:
        return (self.theta0 + self.d0 * self.words) / (self.theta0 + self.customers)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: Stirling's series seven steps above."""
    z = np.asarray(x, float) + 7
    low = (z - 1) * (z - 2) * (z - 3) * (z - 4) * (z - 5) * (z - 6) * (z - 7)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) - np.log(low)


def rising(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each d the sum over n of log (1 - d)(2 - d)...(n - 1 - d)."""
    n, times = np.unique(n[n > 1], return_counts=True)
    return ((log_gamma(n[None, :] - d[:, None]) - log_gamma(1 - d)[:, None]) * times).sum(axis=1)


def openings(tables: np.ndarray, customers: np.ndarray) -> np.ndarray:
    """For each d and theta: the sum over restaurants of log of theta's part, prod (theta + d i) / prod (theta + j)."""
    t, t_times = np.unique(tables[tables > 0], return_counts=True)
    c, c_times = np.unique(customers[customers > 0], return_counts=True)
    d, theta = DISCOUNTS[:, None], STRENGTHS[None, :]
    out = np.zeros((len(DISCOUNTS), len(STRENGTHS)))
    for i in range(0, len(t), 4096):
        x, times = t[None, None, i : i + 4096], t_times[i : i + 4096]
        ratio = (theta / d)[:, :, None]
        out += (((x - 1) * np.log(d)[:, :, None] + log_gamma(ratio + x) - log_gamma(ratio + 1)) * times).sum(axis=2)
    for i in range(0, len(c), 4096):
        x, times = c[None, i : i + 4096], c_times[i : i + 4096]
        out -= ((log_gamma(theta.T + x) - log_gamma(theta.T + 1)) * times).sum(axis=1)[None, :]
    return out


#: Pairs of up to this many customers have their weights by recursion, others by an integral
RECURSION = 512


@functools.lru_cache(maxsize=32)
def _recursion(d: float, top: int) -> np.ndarray:
    """[n, t]: log of the number of ways, weighted by (1 - d)(2 - d)... at each table, to seat n customers at t tables."""
    out = np.full((top + 1, top + 1), -np.inf)
    out[1, 1] = 0
    for n in range(1, top):
        t = np.arange(1, n + 2)
        with np.errstate(divide="ignore"):
            out[n + 1, 1 : n + 2] = np.logaddexp(out[n, : n + 1], np.log(np.maximum(n - d * t, 0)) + out[n, 1 : n + 2])
    return out


def _along_the_cut(n: int, t: np.ndarray, d: np.ndarray, nodes: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The coefficient of x^n in (1 - (1 - x)^d)^t, by an integral along the cut from 1 on, and how much the sum may be off."""
    u = np.linspace(math.log(1e-9 / n), math.log(1e3), nodes)
    t, d = t[:, None], d[:, None]
    turn = np.log1p(-np.exp(d * u - 1j * math.pi * d))
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.exp(t * turn - (n + 1) * np.log1p(np.exp(u)) + u) * ((u[1] - u[0]) / math.pi)
        size = np.abs(e)
        # what cancels out, what lies below the first node, and all of it where the nodes are too far apart to follow its turns
        lost = (size[:, 1:] > 1e-8 * size.max(axis=1, keepdims=True)) & (t * np.abs(np.diff(turn.imag, axis=1)) > 1)
        return e.imag.sum(axis=1), 1e-9 * size.sum(axis=1) + 10 * size[:, 0] + np.where(lost.any(axis=1), np.inf, 0)


def _at_the_saddle(n: int, t: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The log of the same coefficient by its saddle point, for many tables, where the integral's parts cancel out."""
    low, high = (np.log(d) - np.log(n / t)) / (1 - d) - 2, np.zeros(t.shape)
    for _ in range(42):
        mid = (low + high) / 2
        with np.errstate(divide="ignore"):
            above = np.log1p(-np.exp(mid)) + np.log(d) + (d - 1) * mid - np.log(-np.expm1(d * mid)) > np.log(n / t)
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    z = np.exp(low)
    x, f, f1, f2 = 1 - z, -np.expm1(d * low), d * z ** (d - 1), d * (1 - d) * z ** (d - 2)
    spread = t * ((x * f1 + x * x * f2) / f - (x * f1 / f) ** 2)
    return t * np.log(f) - n * np.log1p(-z) - 0.5 * np.log(2 * math.pi * np.maximum(spread, 1e-300))


def seatings(n: int, t: np.ndarray, d: float | np.ndarray) -> np.ndarray:
    """log of the weighted number of ways to seat n customers at t tables, as by _recursion(), for any n; above RECURSION each t may
    have a discount of its own."""
    if n <= RECURSION:
        return _recursion(float(d), RECURSION)[n, t]
    t = np.asarray(t, float)
    d = np.broadcast_to(d, t.shape)
    found, off = _along_the_cut(n, t, d)
    sure, alone = found > 1e3 * off, t == n
    log = np.where(alone, n * np.log(d), np.log(np.where(sure, np.maximum(found, 1e-300), 1.0)))
    rest = ~sure & ~alone
    if rest.any():
        log[rest] = _at_the_saddle(n, t[rest], d[rest])
    return log + math.lgamma(n + 1) - log_gamma(t + 1) - t * np.log(d)


def _weights(n: int, t: np.ndarray, total: np.ndarray, k: np.ndarray, customers: np.ndarray, law: Law) -> np.ndarray:
    """log of the probability, but for a constant, of t tables (all from 1 to n, if these are few) for a pair of n customers, whose context has `total` tables
    for other words, whose word k in other contexts, and whose parent so many other customers."""
    gain = lambda start, steps: log_gamma(start + steps) - log_gamma(start)
    ratio = law.theta / law.d + total
    # a word without other tables has its first one from the base, which is the same for every t
    first = np.maximum(k, 1) - law.d0
    if n <= RECURSION:  # all numbers of tables, one step from each to the next
        i = np.arange(n)
        steps = (law.theta + law.d * (total + i)) * np.where(k + i > 0, k + i - law.d0, 1.0) / (law.theta0 + customers + i)
        return seatings(n, t, law.d) + np.cumsum(np.log(steps), axis=1)
    return seatings(n, t, law.d) + t * math.log(law.d) + gain(ratio, t) + log_gamma(k + t - law.d0) - log_gamma(first) - gain(law.theta0 + customers, t)


def _pick(log: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A column of each row, by the rows' log weights."""
    p = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
    return (p < (rng.random(len(p)) * p[:, -1])[:, None]).sum(axis=1)


def reseat(n: np.ndarray, tables: np.ndarray, total: np.ndarray, k: np.ndarray, law: Law, rng: np.random.Generator) -> np.ndarray:
    """Gibbs draw of each pair's number of tables from its law given all others. n: customers of each pair; tables: their
    present number; total: tables of its context; k: tables of its word in all contexts. How customers sit at them is
    summed over, so a draw doesn't depend on the present number but through the others' sums."""
    out, others = np.ones(len(n), np.int64), (total - tables, k - tables, law.customers - tables)
    order = np.argsort(n, kind="stable")
    first = _distinct(n[order])
    for lo, hi in zip(first, np.append(first[1:], len(n)), strict=True):
        size = int(n[order[lo]])
        if size < 2:
            continue
        step = max(1, 500_000 // size) if size <= RECURSION else 1
        for at in (order[i : min(hi, i + step)] for i in range(lo, hi, step)):
            of = [x[at].astype(float)[:, None] for x in others]
            if size <= RECURSION:
                t = np.arange(1, size + 1)
                out[at] = 1 + _pick(_weights(size, t, *of, law), rng)
            else:
                out[at] = _draw_many(size, *(x[0] for x in of), law, rng)
    return out


def _draw_many(n: int, total: np.ndarray, k: np.ndarray, customers: np.ndarray, law: Law, rng: np.random.Generator) -> int:
    """A draw for a pair of many customers: the range that holds the weight is found on ever finer grids, then drawn from
    on a grid of 128 cells at most."""
    weigh = lambda t: _weights(n, t, total, k, customers, law)
    low, high = 1, n
    while high - low > 128:
        t = np.unique(np.concatenate([np.geomspace(low, high, 16), np.linspace(low, high, 16)]).astype(np.int64))
        w = weigh(t)
        likely = np.flatnonzero(w > w.max() - 40)
        new = int(t[max(0, likely[0] - 1)]), int(t[min(len(t) - 1, likely[-1] + 1)])
        if new[1] - new[0] > (high - low) * 0.7:
            break
        low, high = new
    edges = np.unique(np.linspace(low, high + 1, min(128, high - low + 1) + 1).astype(np.int64))
    middle = (edges[:-1] + edges[1:] - 1) // 2
    at = int(_pick((weigh(middle) + np.log(np.diff(edges)))[None, :], rng)[0])
    return int(rng.integers(edges[at], edges[at + 1]))


def ways(n: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """For each discount the sum over pairs of seatings()."""
    small, width = n <= RECURSION, RECURSION + 1
    times = np.bincount(n[small] * width + tables[small], minlength=width * width)
    at = np.flatnonzero(times)
    out = np.array([_recursion(float(d), RECURSION).ravel()[at] @ times[at] for d in DISCOUNTS])
    for m, t in zip(n[~small].tolist(), tables[~small].tolist(), strict=True):
        out += seatings(m, np.full(len(DISCOUNTS), t), DISCOUNTS)
    return out


SEATS = "at long, u binary, w binary, n binary, tables binary, kept binary, fits array<double>"
_SEATS = [c.split()[0] for c in SEATS.split(", ")]


def _seats(at: int, u, w, n, tables, kept) -> pa.Table:
    """A bucket's pairs in order of their contexts; kept: numbers of tables, state by state."""
    row = [at, pack(u, rising=True), pack(w), pack(n), pack(tables), pack(kept), ways(n, tables)]
    types = [pa.int64(), *[pa.binary()] * 5, pa.list_(pa.float64())]
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], _SEATS)


def _first_seats(told: pa.Table) -> pa.Table:
    """All customers of a pair at one table."""
    rows = _received(told)
    u, w, n = (np.concatenate([unpack(r[c], rising=c == "a") for r in rows]) for c in "abc")
    order = np.lexsort((w, u))
    n = n[order].view(np.int64)
    return _seats(rows[0]["at"], u[order], w[order], n, np.ones(len(n), np.int64), np.zeros(0, np.int64))


def _tell(buckets: int, states: int):
    """For each distinct word of a bucket's pairs: its tables as a context and as a word, of the present seating or of
    each kept state, to the words' bucket."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                u, w = unpack(row["u"], rising=True), unpack(row["w"])
                none = np.zeros(len(u), np.int64)
                sums = [x for t in counts(row["kept" if states else "tables"], states or 1) for x in (np.concatenate([t, none]), np.concatenate([none, t]))]
                key, sums = _by_key(np.concatenate([u, w]), *sums)
                for to, s in _dealt(_bucket(key, buckets)):
                    yield _messages([(to, row["at"], 0, pack(key[s], rising=True), pack(np.concatenate([x[s] for x in sums])), None)])

    return run


def _add_up(told: list[dict], words: pa.Table, states: int):
    """A bucket's words: keys; what is known of them (four rows); tables as a context and as a word in each state; and
    of each message where its keys are."""
    row = words.to_pylist()[0]
    key, known = unpack(row["a"], rising=True), counts(row["b"], 4)
    tables, places = np.tile(known[2:], (states, 1)), []
    for r in told:
        places.append(np.searchsorted(key, unpack(r["a"], rising=True)))
        tables[:, places[-1]] += counts(r["b"], 2 * states)  # a message names no word twice
    return key, known, tables, places


ANSWERS = "at long, source long, kind int, a binary, b binary, c binary, parent array<long>, fits array<double>"


def _answer(told: pa.Table, words: pa.Table) -> pa.Table:
    """To each source the tables of its words; and to -1 what the laws' likelihoods need."""
    rows, no = _received(told), words["at"][0].as_py()
    _, known, tables, places = _add_up(rows, words, 1)
    out = _messages([*((r["source"], no, 0, pack(tables[:, p].ravel()), None, None) for r, p in zip(rows, places, strict=True)), (-1, no, 0, None, None, None)], True)
    parent = [None] * len(rows) + [[int(tables[1].sum()), int((tables[1] > 0).sum())]]
    fits = [None] * len(rows) + [np.concatenate([openings(tables[0], known[0]).ravel(), rising(tables[1], DISCOUNTS)])]
    return out.append_column("parent", pa.array(parent, pa.list_(pa.int64()))).append_column("fits", pa.array(fits, pa.list_(pa.float64())))


def _sweep(law: Law, keep: bool, seed: int):
    """Reseat a bucket's pairs given the answers of all buckets of words; add the seating to the kept ones if keep."""

    def run(seats: pa.Table, answers: pa.Table) -> pa.Table:
        row = seats.to_pylist()[0]
        u, w = unpack(row["u"], rising=True), unpack(row["w"])
        n, tables, kept = (counts(row[c])[0] for c in ("n", "tables", "kept"))
        found = np.concatenate([counts(r["a"], 2) for r in _received(answers)], axis=1)
        key = np.unique(np.concatenate([u, w]))
        tables = reseat(n, tables, found[0, np.searchsorted(key, u)], found[1, np.searchsorted(key, w)], law, np.random.default_rng([seed, row["at"]]))
        return _seats(row["at"], u, w, n, tables, np.concatenate([kept, tables]) if keep else kept)

    return run


def _draw(law: Law, parent: np.ndarray, fits: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> Law:
    """Discounts and strengths, one after the other, from their grids given the seating."""

    def pick(grid, log):
        p = np.exp(log - log.max())
        return int(rng.choice(len(grid), p=p / p.sum()))

    near = lambda grid, x: int(np.abs(np.log(grid) - math.log(x)).argmin())
    size = len(DISCOUNTS) * len(STRENGTHS)
    contexts = fits[:size].reshape(len(DISCOUNTS), len(STRENGTHS))
    if len(sizes):  # no pair was seen twice otherwise
        contexts = contexts + sizes[:, None]
    words = openings(parent[1:2], parent[:1]) + fits[size:, None]
    i, j = pick(DISCOUNTS, contexts[:, near(STRENGTHS, law.theta)]), 0
    j = pick(STRENGTHS, contexts[i])
    a = pick(DISCOUNTS, words[:, near(STRENGTHS, law.theta0)])
    b = pick(STRENGTHS, words[a])
    return Law(float(DISCOUNTS[i]), float(STRENGTHS[j]), float(DISCOUNTS[a]), float(STRENGTHS[b]), int(parent[0]), int(parent[1]))


def _grown(df: DataFrame, column: str) -> np.ndarray:
    """Sum over rows of an array column, element by element."""
    rows = df.select(F.posexplode(column)).groupBy("pos").agg(F.sum("col")).collect()
    out = np.zeros(len(rows))
    for pos, x in rows:
        out[pos] = x
    return out


def _final_words(states: int):
    """A bucket's words: customers as a context and as a word, then tables as either in each state."""

    def run(told: pa.Table, words: pa.Table) -> pa.Table:
        key, known, tables, _ = _add_up(_received(told), words, states)
        return _messages([(words["at"][0].as_py(), 0, 0, pack(key, rising=True), pack(np.concatenate([known[:2], tables]).ravel()), None)], True)

    return run


def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a bucket's words: tokens, words that have any, and in each state the parent's customers."""
    for batch in batches:
        for data, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = counts(data, rows)
            yield pa.RecordBatch.from_arrays([pa.array([[int(x[1].sum()), int((x[1] > 0).sum()), *x[3::2].sum(axis=1).tolist()]], pa.list_(pa.int64()))], ["parent"])


def _reply_words(states: int):
    """To each block what is known of its words."""

    def run(asked: pa.Table, words: pa.Table) -> pa.Table:
        row = words.to_pylist()[0]
        key, known = unpack(row["a"], rising=True), counts(row["b"], 2 + 2 * states)
        return _messages([(r["source"], r["at"], 1, pack(known[:, np.searchsorted(key, unpack(r["a"], rising=True))].ravel()), None, None) for r in _received(asked)], True)

    return run


def _reply_pairs(states: int):
    """To each block the tables, state by state, of its pairs seen more than once."""

    def run(asked: pa.Table, seats: pa.Table) -> pa.Table:
        row = seats.to_pylist()[0]
        h, tables = pair_keys(unpack(row["u"], rising=True), unpack(row["w"])), counts(row["kept"], states)
        order = np.argsort(h)
        h, tables = h[order], tables[:, order]
        return _messages([(r["source"], r["at"], 2, pack(tables[:, np.searchsorted(h, unpack(r["a"], rising=True))].ravel()), None, None) for r in _received(asked)], True)

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(tokens: int, known_words: int, laws: list[Law]):
    def run(home: pa.Table, replies: pa.Table) -> pa.Table:
        b, states = Block(home.to_pylist()[0]), len(laws)
        rows = _received(replies)
        of = lambda kind, width: np.concatenate([counts(r["a"], width) for r in rows if r["kind"] == kind] or [np.zeros((width, 0), np.int64)], axis=1)
        n, told, many = of(0, 1)[0], of(1, 2 + 2 * states), of(2, states)
        tables = np.ones((states, len(n)), np.int64)
        tables[:, n > 1] = many
        c, m = told[0], told[1]
        p = np.zeros(len(n))
        for s, law in enumerate(laws):
            parent = np.where(m > 0, law.parent(told[3 + 2 * s]), law.unknown())
            share = (law.theta + law.d * told[2 + 2 * s]) / (law.theta + c)
            p += np.where(n > 0, n - law.d * tables[s], 0.0) / (law.theta + c[b.pair_u]) + share[b.pair_u] * parent[b.pair_w]
        log, base = np.log10(p / states), np.log10((m + 0.5) / (tokens + 0.5 * (known_words + 1)))
        at = np.cumsum(b.size) - b.size
        add = lambda x: pa.array(np.add.reduceat(x, at))
        ids = [home[x].combine_chunks().flatten() for x in ("doc_id", "held_out")]
        return pa.table([*ids, pa.array(b.size), add((m > 0)[b.w].astype(np.int64)), add(base[b.w]), add(log[b.pair])], [x.split()[0] for x in SCORED.split(", ")])

    return run


def language_model(docs: DataFrame, not_learnt: Column | None = None, sweeps: int = 3, burn_in: int = 1, seed: int = 11) -> DataFrame:
    """Learn from the texts of docs (doc_id, text, ...) and score all of them: a row each with doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score (unigrams with 0.5 added) and score, the log10 probability of the
    text and its end. Rows where not_learnt is true (none by default; null counts as false) aren't learnt from. sweeps:
    how often all is reseated; those after burn_in are averaged.

    Words are split at ASCII white space after lower-casing A-Z and known by 64-bit hashes (of a billion distinct
    words two are expected to fall together with a probability of 0.03). Null and empty texts are their end alone.
    Other columns are ignored; repeated rows each count and give a row; an empty table gives none. Where nothing is
    learnt every token has the probability 1. Counts and base_score depend on the texts alone; score also on the
    seed and the number of buckets (bytes of text over BUCKET_BYTES), not on partitions or batches."""
    skip = F.lit(False) if not_learnt is None else F.coalesce(not_learnt, F.lit(False))
    plain = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), skip.alias("held_out"))
    buckets = math.ceil((plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BUCKET_BYTES) + 1
    home, table = _bucketed(plain.mapInArrow(_home, HOME), "blocks", "at")
    counted = home.mapInArrow(_ask(buckets), MESSAGE).groupBy("at").applyInArrow(_count, MESSAGE)
    learnt = written(home.groupBy("at").cogroup(counted.groupBy("at")).applyInArrow(_learn(buckets), MESSAGE), "learnt", "kind")
    kind = lambda k: learnt.where(F.col("kind") == k)
    words = written(kind(2).groupBy("at").applyInArrow(_merge_words, MESSAGE), "words")
    seats = written(kind(1).groupBy("at").applyInArrow(_first_seats, SEATS), "seats")
    law, laws, rng = Law(), [], np.random.default_rng(seed)
    keep_from = min(burn_in, sweeps - 1)

    def told(states: int) -> DataFrame:
        return seats.mapInArrow(_tell(buckets, states), MESSAGE).groupBy("at").cogroup(words.groupBy("at"))

    for turn in range(sweeps):
        answers = written(told(0).applyInArrow(_answer, ANSWERS), "answers")
        parent = _grown(answers, "parent")
        if not len(parent):
            break
        law = _draw(law, parent, _grown(answers, "fits"), _grown(seats, "fits"), rng)
        messages = answers.where("at >= 0").drop("parent", "fits")
        new = written(seats.groupBy("at").cogroup(messages.groupBy("at")).applyInArrow(_sweep(law, turn >= keep_from, seed + turn), SEATS), "seats")
        for old in (seats, answers):
            discard(old)
        seats, laws = new, [*laws, law] if turn >= keep_from else laws
    laws = laws or [law]
    final = written(told(len(laws)).applyInArrow(_final_words(len(laws)), MESSAGE), "words")
    sums = _grown(final.select("b", F.lit(2 + 2 * len(laws)).alias("rows")).mapInArrow(_parents, "parent array<long>"), "parent")
    tokens, known_words, *customers = [int(x) for x in sums] or [0, 0, *[0] * len(laws)]
    laws = [replace(x, customers=k, words=known_words) for x, k in zip(laws, customers, strict=True)]
    discard(words)
    of_words = kind(2).select("at", "source", "a").groupBy("at").cogroup(final.groupBy("at")).applyInArrow(_reply_words(len(laws)), MESSAGE)
    of_pairs = kind(3).select("at", "source", "a").groupBy("at").cogroup(seats.select("at", "u", "w", "kept").groupBy("at")).applyInArrow(_reply_pairs(len(laws)), MESSAGE)
    replies = kind(0).unionByName(of_words).unionByName(of_pairs)
    scored = home.groupBy("at").cogroup(replies.groupBy("at")).applyInArrow(_score(tokens, known_words, laws), SCORED)
    result = written(scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"), "scores")
    for done in (home, learnt, seats, final):
        discard(done)
    docs.sparkSession.sql(f"drop table {table}")
    return result


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, perplexity: 10 to the mean negative score of a token."""
    return scored.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))
