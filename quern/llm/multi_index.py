"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut into halves, each with a codebook of its own; the pairs of a codeword of the first and one of the
second half are the cells of a product grid. Vectors at a cosine of at least t are no further apart than
sqrt(2 - 2 t). For a vector y whose nearest codeword is a, anything that is nearer to codeword c lies at least
(|y - c|^2 - |y - a|^2) / (2 |c - a|) away from y, the distance to the plane between the two. So the squares of the
two halves' distances bound from below how far the vectors of a cell are. Cells are visited in rising order of that
bound until it passes 2 - 2 t for a target recall of 1, when nothing can be missed, or a smaller stop that was
measured on the sample for a lower target. What is met is verified by its cosine in doubles.

Exact copies are one class. A pair of cells is visited from one side only. Of what a task verifies it gives the number
of links a class and the edges of a forest that joins what is linked, never all pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .near_dedup import components

#: Vectors that codebooks are fitted on, vectors a cell to aim at, codewords a half at most, members and visitors of a task's turn
SAMPLE, PER_CELL, MOST_WORDS, MEMBERS, VISITORS = 16_384, 512, 256, 2048, 16_384
#: Room for rounding in bounds
SLACK = 1e-9


def _prepared(kind: str):
    """Of (vec_id, label, vector) rows, dim, a digest of label and vector, and the vector's bytes as `kind`; the latter three
    are null for what links with nothing. Doubles are scaled by a power of two, which leaves all cosines as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, digests, raw = [], [], []
            for vec_id, label, vector in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x = None if vec_id is None or label is None or not vector or None in vector else np.array(vector, np.float64)
                if x is None or not np.isfinite(x).all() or not x.any():
                    dims.append(None), digests.append(None), raw.append(None)
                    continue
                if kind == "<f8":
                    x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))
                v = (x + 0.0).astype(kind).tobytes()  # no -0.0
                dims.append(len(x)), digests.append(xxhash.xxh3_128_digest(f"{label}\0{len(x)}\0".encode() + v)), raw.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "label", "dim", "digest", "vec"])

    return run


def _raw(vec: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vec), kind).reshape(len(vec), -1).astype(np.float64)


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = _raw(raw, kind)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_codebook(x: np.ndarray, words: int, rounds: int = 12) -> np.ndarray:
    """Codewords of a sample by Lloyd's rounds, from `words` of its rows that are far apart; fewer if rows repeat."""
    start, gap = [0], np.full(len(x), np.inf)
    while len(start) < words:
        gap = np.minimum(gap, ((x - x[start[-1]]) ** 2).sum(axis=1))
        far = int(gap.argmax())
        if gap[far] < 1e-12:
            break
        start.append(far)
    books = x[start].copy()
    for _ in range(rounds):
        near = distances(x, books).argmin(axis=1)
        for w in range(len(books)):
            if (own := near == w).any():
                books[w] = x[own].mean(axis=0)
    return np.unique(books, axis=0)


def distances(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances of rows and codewords."""
    return np.maximum(0, (x * x).sum(axis=1)[:, None] + (books * books).sum(axis=1) - 2 * x @ books.T)


class Grid:
    """The product grid of two codebooks."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books = (first, second)
        self.between = [np.sqrt(distances(b, b)) for b in self.books]

    @classmethod
    def fit(cls, x: np.ndarray, words: int) -> Grid:
        half = (x.shape[1] + 1) // 2
        return cls(fit_codebook(x[:, :half], words), fit_codebook(x[:, half:], words))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each row's own cell, and for both halves the square of how far away what another codeword is nearest to must be."""
        half, home, out = len(self.books[0][0]), np.zeros(len(x), np.int64), []
        for part, book, between in zip((x[:, :half], x[:, half:]), self.books, self.between, strict=True):
            d = distances(part, book)
            own = d.argmin(axis=1)
            home = home * len(book) + own
            # codewords that all but agree give no bound
            gap = np.where(between[own] > 1e-4, (d - d[np.arange(len(x)), own][:, None]) / np.maximum(2 * between[own], 1e-4), 0)
            out.append(np.maximum(0, gap - SLACK) ** 2)
        return home, out

    def visits(self, bounds: list[np.ndarray], row: int, stop: float) -> np.ndarray:
        """The cells of a row's multi-sequence traversal: in rising order of the sum of both halves' bounds, up to stop."""
        a, b = (x[row] for x in bounds)
        first, second = np.flatnonzero(a <= stop), np.flatnonzero(b <= stop)
        sums = a[first][:, None] + b[second]
        order = np.argsort(sums, axis=None, kind="stable")
        order = order[: int((sums <= stop).sum())]
        return first[order // len(second)] * len(self.books[1]) + second[order % len(second)]

    def stop(self, x: np.ndarray, cosine: float, recall: float) -> float:
        """How far to go for a target recall: for 1 as far as linked vectors can be apart; for less, as far as that share of
        the sample's vectors needed to meet another at just that cosine in a random direction."""
        most = 2 - 2 * cosine + SLACK
        if recall >= 1:
            return most
        rng = np.random.default_rng(11)
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        norm = np.linalg.norm(away, axis=1, keepdims=True)
        other = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * away / np.where(norm > 0, norm, 1)
        (_, bounds), (home, _) = self.bounds(x), self.bounds(other)
        rows, width = np.arange(len(x)), len(self.books[1])
        return min(most, float(np.quantile(bounds[0][rows, home // width] + bounds[1][rows, home % width], recall)))


def _visiting(grids: dict[int, tuple[Grid, float]], kind: str, with_vector: bool):
    """Of classes (no, label, dim, vec, times), a row for their own cell (home) and each cell with a higher number that they
    visit. A length without a grid is one cell."""
    names = ["label", "dim", "cell", "no", "home"] + ["vec", "times"] * with_vector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist(), np.int64)
            rows, cells, homes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if int(dim) not in grids:
                    rows.append(at), cells.append(np.zeros(len(at), np.int64)), homes.append(np.ones(len(at), bool))
                    continue
                grid, stop = grids[int(dim)]
                home, bounds = grid.bounds(_unit(batch.column("vec").take(pa.array(at)).to_pylist(), kind))
                for i, place in enumerate(at.tolist()):
                    seen = grid.visits(bounds, i, stop)
                    seen = seen[seen >= home[i]]
                    rows.append(np.full(len(seen), place)), cells.append(seen), homes.append(seen == home[i])
            take = pa.array(np.concatenate(rows))
            column = lambda c: batch.column(c).take(take)  # noqa: E731, B023
            out = [column("label"), column("dim"), pa.array(np.concatenate(cells), pa.int64()), column("no"), pa.array(np.concatenate(homes))]
            out += [column("vec"), column("times")] if with_vector else []
            full = pa.RecordBatch.from_arrays(out, names)
            for i in range(0, full.num_rows, 10_000):
                yield full.slice(i, 10_000)

    return run


class _Turn:
    """The members of one block of a cell, and what is found out about them."""

    def __init__(self, no: np.ndarray, vec: list[bytes], times: np.ndarray, kind: str):
        self.no, self.times = no, times
        self.x = _raw(vec, kind)
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.links, self.root = np.zeros(len(no), np.int64), np.arange(len(no))
        self.place = {n: i for i, n in enumerate(no.tolist())}

    def meet(self, no: np.ndarray, home: np.ndarray, vec: list[bytes], times: np.ndarray, kind: str, cosine: float) -> tuple[list, list]:
        """(no, links) of visitors, and edges. Visitors that are members here meet only members with a higher number."""
        x = _raw(vec, kind)
        close = (x @ self.x.T) / (np.sqrt((x * x).sum(axis=1))[:, None] * self.norm) >= cosine
        own = [self.place.get(n, -1) if h else -1 for n, h in zip(no.tolist(), home.tolist(), strict=True)]
        for i, at in enumerate(own):
            if at >= 0:
                close[i] &= self.no > no[i]
        self.links += times @ close
        counts = close @ self.times
        edges = []
        for i in np.flatnonzero(close.any(axis=1)).tolist():
            met = np.flatnonzero(close[i])
            roots, first = np.unique(self.root[met], return_index=True)
            mine = self.root[own[i]] if own[i] >= 0 else -1
            edges += [(int(no[i]), int(self.no[met[f]])) for r, f in zip(roots.tolist(), first.tolist(), strict=True) if r != mine]
            roots = np.unique(np.append(roots, mine)) if mine >= 0 else roots
            if len(roots) > 1:
                self.root[np.isin(self.root, roots)] = roots[0]
        return [(int(n), int(c)) for n, c in zip(no[counts > 0], counts[counts > 0], strict=True)], edges


def _verify(cosine: float, kind: str):
    """Of rows in order of turn, each turn members and then visitors: (a, null, links) counts and (a, b, 0) edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, key, waiting = None, None, []

        def out(counts: list, edges: list) -> pa.RecordBatch:
            a = [c[0] for c in counts] + [e[0] for e in edges]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([None] * len(counts) + [e[1] for e in edges], pa.int64()), pa.array([c[1] for c in counts] + [0] * len(edges), pa.int64())], ["a", "b", "links"])

        def ended() -> list:
            return [] if turn is None else [(int(n), int(c)) for n, c in zip(turn.no, turn.links, strict=True) if c]

        for batch in batches:
            counts, edges = [], []
            keys, side = batch.column("turn").to_pylist(), batch.column("side").to_numpy(zero_copy_only=False)
            edge = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or side[i] != side[i - 1]), len(keys)]
            for lo, hi in zip(edge, edge[1:], strict=False):
                for lo2 in range(lo, hi, 512):
                    part = batch.slice(lo2, min(512, hi - lo2))
                    no, times, home = (part.column(c).to_numpy(zero_copy_only=False) for c in ("no", "times", "home"))
                    vec = part.column("vec").to_pylist()
                    if side[lo] == 0:
                        if keys[lo] != key:
                            counts += ended()
                            turn, key, waiting = None, keys[lo], []
                        waiting.append((no, vec, times))
                        continue
                    if keys[lo] != key:  # a turn without members
                        continue
                    if turn is None:
                        turn = _Turn(np.concatenate([w[0] for w in waiting]), [v for w in waiting for v in w[1]], np.concatenate([w[2] for w in waiting]), kind)
                        waiting = []
                    more = turn.meet(no, home, vec, times, kind, cosine)
                    counts, edges = counts + more[0], edges + more[1]
            yield out(counts, edges)
        yield out(ended(), [])

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.98, recall: float = 1.0, per_cell: int = PER_CELL) -> DataFrame:
    """Links of vectors of the same label at a cosine of at least `cosine`: vec_id, n_links (other vectors linked directly),
    component_id (smallest vec_id that links reach, its own included), kept (vec_id = component_id), a row an input row.

    vectors: (vec_id long, label, embedding array, ...). Vectors that are null, empty, zero or hold null or non-finite
    components, and those with a null label, link with nothing; vectors of other lengths aren't compared. Rows without a vec_id
    link with nothing either: component_id is null, kept true. Rows that repeat a vec_id are vectors of their own. An empty table
    gives no rows; other columns are ignored. Codebooks are fitted on the SAMPLE vectors with the smallest hashes; all are
    indexed. A recall of 1 loses no link; with less, cells are left out that this share of sampled neighbours doesn't need."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = written(base.mapInArrow(_prepared(kind), "vec_id long, label string, dim int, digest binary, vec binary"), "unit-vectors")
    classes = rows.where("digest is not null").groupBy("digest", "label", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.min("vec").alias("vec"))
    classes = written(classes.withColumn("no", F.monotonically_increasing_id()), "vector-classes")
    # one number, and SAMPLE rows at most
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    words = max(1, min(MOST_WORDS, round(math.sqrt(largest / per_cell))))
    grids: dict[int, tuple[Grid, float]] = {}
    if words > 1:
        by_dim: dict[int, list[bytes]] = {}
        for r in classes.select("dim", "vec").orderBy(F.xxhash64("digest")).limit(SAMPLE).collect():
            by_dim.setdefault(r.dim, []).append(r.vec)
        for dim, raw in by_dim.items():
            x = _unit(raw, kind)
            grid = Grid.fit(x, words)
            grids[dim] = grid, grid.stop(x, cosine, recall)
    cell = ["label", "dim", "cell"]
    visit = lambda full: classes.mapInArrow(_visiting(grids, kind, full), "label string, dim int, cell long, no long, home boolean" + ", vec binary, times long" * full)
    sizes = visit(False).groupBy(*cell).agg(F.count_if("home").alias("m"), F.count("*").alias("v")).where("m > 0")
    sizes = sizes.select(*[F.col(c).alias(f"s_{c}") for c in cell], F.ceil(F.col("m") / MEMBERS).cast("int").alias("blocks"), F.ceil(F.col("v") / VISITORS).cast("int").alias("parts"))
    met = visit(True).join(sizes, (F.col("label") == F.col("s_label")) & (F.col("dim") == F.col("s_dim")) & (F.col("cell") == F.col("s_cell")))
    block, part = F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("no", F.lit(1)), F.col("parts")).cast("int")
    here = lambda b, p, side: F.struct(b.alias("block"), p.alias("part"), F.lit(side).alias("side"))
    as_member = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: here(block, p, 0))).otherwise(F.array().cast("array<struct<block:int,part:int,side:int>>"))
    # a cell's own members meet the blocks from theirs on
    as_visitor = F.transform(F.sequence(F.when(F.col("home"), block).otherwise(0), F.col("blocks") - 1), lambda b: here(b, part, 1))
    turns = met.select(*cell, "no", "home", "vec", "times", F.explode(F.concat(as_member, as_visitor)).alias("x"))
    turns = turns.select(F.concat_ws(":", "x.block", "x.part", "cell", "dim", "label").alias("turn"), F.col("x.side").alias("side"), "no", "home", "vec", "times")
    found = written(turns.repartition("turn").sortWithinPartitions("turn", "side").mapInArrow(_verify(cosine, kind), "a long, b long, links long"), "met")
    links = found.where("b is null").groupBy(F.col("a").alias("l_no")).agg(F.sum("links").alias("links"))
    groups = written(classes.select("no", "rep").join(components(found.where("b is not null").select("a", "b")), F.col("no") == F.col("node")), "groups")
    least = groups.groupBy("component").agg(F.min("rep").alias("least"))
    named = groups.join(least, "component").select(F.col("no").alias("g_no"), "least")
    each = classes.select("digest", "rep", "times", "no").join(links, F.col("no") == F.col("l_no"), "left").join(named, F.col("no") == F.col("g_no"), "left")
    each = each.select(F.col("digest").alias("c_digest"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component"))
    out = rows.select("vec_id", "digest").join(each, F.col("digest") == F.col("c_digest"), "left")
    component = F.coalesce("component", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
    result = written(out, "vector-groups")
    for done in (rows, classes, found, groups):
        discard(done)
    return result
