"""Repair of conversations by cheapest edits, with Four-Russians tables of symbol blocks.

A turn is a symbol: its role's initial and its fault. Edits turn a conversation's initials into (s?(ua)+)?; the
automaton of that pattern has four states, and the costs of finishing from each of them, less the smallest, form a
vector of which only some tens can come up. For every vector and every block of BLOCK symbols a table holds the
vector before the block and the cost that it adds, so costs are carried from a conversation's end to its start a
block at a lookup. The edits are then traced from the start: each block is expanded backward from the vector behind
it, and of the cheapest edits the one with the least letter is taken, which gives the least text of all cheapest ones.

Conversations of any length are cut into chunks of turns. What a chunk does to each possible vector is worked out
for all chunks at once; one pass over a conversation's chunks from the last to the first picks the vectors between
them, one from the first to the last the states. Only the digest of repaired texts has to stream a conversation."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

CHUNK = 4096
#: Symbols of a table's block
BLOCK = 3
#: Costs of edits by letter, of leaving a truncated turn in, and "impossible"
KEEP, REROLE, DELETE, INSERT, TRUNCATED, NEVER = 0, 1, 2, 5, 5, 10**6
#: States: nothing yet, after system, after user, after assistant. By state: where an initial leads.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: Where a turn of the user or the assistant leads, and whose it is
NEXT = [USER, USER, ASSISTANT, USER]
#: A turn's code is its initial's number plus four times its fault's
INITIALS, FAULTS = "sua", ("", "truncated", "blank", "duplicate")
#: Symbols by code: blank and duplicate turns only go
SYMBOLS = np.array([*range(8), *[8] * 8], np.uint8)
N_SYMBOLS = 9
SPACES = r"[^\x20\x09-\x0D]"


def _edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a turn, in order of letters."""
    if symbol == 8:
        return [("D", DELETE, state)]
    out, more = [("D", DELETE, state)], TRUNCATED * (symbol >= 4)
    initial = "sua?"[symbol % 4]
    if initial in STEP[state]:
        out.append(("K", KEEP + more, STEP[state][initial]))
    return [*out, ("R", REROLE + more, NEXT[state])]


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Costs of finishing from each state if turns may be inserted first."""
    best = list(costs)
    for _ in range(3):
        best = [min(c, INSERT + best[NEXT[s]]) for s, c in enumerate(best)]
    return tuple(best)


LAST = _closed([0, NEVER, NEVER, 0])


def before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The cost vector before a turn, given the one behind it."""
    return _closed([min(cost + after[to] for _, cost, to in _edits(symbol, s)) for s in range(4)])


class Tables:
    """All cost vectors that come up, less their smallest cost, and what each symbol and block makes of each of them."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        number: dict[tuple[int, ...], int] = {}

        def place(v: tuple[int, ...]) -> tuple[int, int]:
            low = min(v)
            v = tuple(x - low for x in v)
            if v not in number:
                number[v] = len(self.vectors)
                self.vectors.append(v)
            return number[v], low

        self.last, _ = place(LAST)
        rows, at = [], 0
        while at < len(self.vectors):
            rows.append([place(before(s, self.vectors[at])) for s in range(N_SYMBOLS)])
            at += 1
        one = np.array(rows, np.int64)
        #: [vector behind, symbol] -> vector before, added cost
        self.to, self.cost = one[:, :, 0].astype(np.int32), one[:, :, 1].astype(np.int32)
        # [vector behind, block], the block's first symbol the most significant digit
        self.block_to, self.block_cost = self.to, self.cost
        for _ in range(BLOCK - 1):  # a symbol more in front
            self.block_cost = (self.block_cost[:, None, :] + self.cost[self.block_to].transpose(0, 2, 1)).reshape(len(self.vectors), -1)
            self.block_to = self.to[self.block_to].transpose(0, 2, 1).reshape(len(self.vectors), -1)
        self._traced: dict[tuple[int, bytes, int], tuple[str, int]] = {}

    @staticmethod
    def blocks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the whole blocks, and the symbols behind them."""
        n = len(symbols) // BLOCK * BLOCK
        return symbols[:n].reshape(-1, BLOCK).astype(np.int64) @ (N_SYMBOLS ** np.arange(BLOCK - 1, -1, -1)), symbols[n:]

    def through(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector behind the symbols the one before them and the added cost."""
        whole, rest = self.blocks(symbols)
        at, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for s in rest[::-1]:
            at, cost = self.to[at, s], cost + self.cost[at, s]
        for b in whole[::-1]:
            at, cost = self.block_to[at, b], cost + self.block_cost[at, b]
        return at, cost

    def _expand(self, behind: int, block: bytes, state: int) -> tuple[str, int]:
        """The least of a block's cheapest edits from a state on, and the state behind it. The block is expanded
        backward first; edits at its end may be inserted only before its last turn."""
        if (found := self._traced.get((behind, block, state))) is not None:
            return found
        costs = [self.vectors[behind]]
        for s in reversed(block):
            costs.append(before(s, costs[-1]))
        costs.reverse()
        out, i, at = [], 0, state
        while i < len(block):
            options = _edits(block[i], at)
            insert = ("I", INSERT, NEXT[at])
            for letter, cost, to in [options[0], insert, *options[1:]]:  # in order of letters
                new = i + (letter != "I")
                if cost + costs[new][to] == costs[i][at]:
                    out.append(letter)
                    i, at = new, to
                    break
        if len(self._traced) >= 500_000:
            self._traced.clear()
        self._traced[behind, block, state] = found = ("".join(out), at)
        return found

    def trace(self, behind: int, symbols: np.ndarray, state: int) -> tuple[str, int]:
        """The least of the cheapest edits of these symbols from a state on, given the vector behind them; and the state
        behind them."""
        raw, ends = symbols.tobytes(), [behind]
        parts = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        for part in reversed(parts[1:]):
            if len(part) == BLOCK:
                ends.append(int(self.block_to[ends[-1], functools.reduce(lambda n, s: n * N_SYMBOLS + s, part)]))
            else:
                ends.append(int(functools.reduce(lambda v, s: self.to[v, s], reversed(part), ends[-1])))
        out = []
        for part, end in zip(parts, reversed(ends), strict=bool(parts)):
            text, state = self._expand(end, part, state)
            out.append(text)
        return "".join(out), state

    def finish(self, state: int) -> str:
        """What is inserted behind the last turn."""
        return "I" * (LAST[state] // INSERT)


@functools.cache
def tables() -> Tables:
    return Tables()


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with nulls as one space, damaged by crc32 of conv_id:turn modulo 20: rows
    of 0 go, 1 empties their text, 2 takes . ! ? out of it, 3 repeats them, 4 gives them to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    k = F.col("kind")
    words = F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), words.alias("text"), F.explode(F.sequence(F.lit(1), F.when(k == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def _last_is_open(text: Column) -> Column:
    """Whether the last character that is no white space doesn't end a sentence."""
    return ~F.right(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), F.lit(1)).isin(".", "!", "?")


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, chunk, no, role, text, code of rows (conv_id, turn, role, text), written in order: conversations by turn
    (nulls first), then by role, then by a hash of the text; rows that agree in all come in any order.

    The order is made by range, with a number as the last key, so neither a long conversation nor repeated rows meet in
    one task. A chunk is up to CHUNK neighbours of one conversation."""
    base = written(rows.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("h"), F.crc32("text").alias("h2"), F.monotonically_increasing_id().alias("row")), "turns")
    spoken = F.col("text").rlike(SPACES)
    first = base.where(spoken).groupBy("conv_id", "role", "h", "h2").agg(F.min(F.struct("turn", "row"))["row"].alias("first_row"))
    first = first.select(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("h").alias("f_h"), F.col("h2").alias("f_h2"), "first_row")
    same = F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("h") == F.col("f_h")) & (F.col("h2") == F.col("f_h2"))
    fault = F.when(~spoken, 2).when(F.col("row") != F.col("first_row"), 3).when(_last_is_open(F.col("text")), 1).otherwise(0)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + 4 * fault
    keys = ["conv_id", "turn", "role", "h", "row"]
    ordered = base.join(first, same, "left").select("conv_id", "turn", "role", "text", "h", "row", code.cast("int").alias("code")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    no = F.monotonically_increasing_id()
    out = written(ordered.select("conv_id", "role", "text", "code", no.alias("no")).withColumn("chunk", F.floor(F.col("no") / CHUNK)), "ordered-turns")
    discard(base)
    return out


def _batch(names: tuple[str, ...], arrays: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, list(names))


def _columns(names: tuple[str, ...], kinds: tuple[pa.DataType, ...], rows: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return _batch(names, [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)])


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, chunk, codes, what the chunk does to each vector, and its first and last initial with how many neighbours
    within it can't follow each other."""
    t = tables()
    for batch in batches:
        to, costs, bad = [], [], []
        for codes in batch.column("codes").to_pylist():
            c = np.array(codes, np.uint8)
            at, cost = t.through(SYMBOLS[c])
            to.append(at.astype("<i4").tobytes())
            costs.append(cost.astype("<i8").tobytes())
            bad.append(int(_illegal(c[:-1] % 4, c[1:] % 4).sum()))
        yield _batch(("conv_id", "chunk", "codes", "to", "costs", "illegal"), [*(batch.column(x) for x in ("conv_id", "chunk", "codes")), pa.array(to, pa.binary()), pa.array(costs, pa.binary()), pa.array(bad, pa.int64())])


def _illegal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ~((a == 0) & (b == 1) | (a == 1) & (b == 2) | (a == 2) & (b == 1))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks from the last to the first of each conversation, the vector behind each and the cost from it on."""
    t, conv, begun, at, total = tables(), None, False, 0, 0
    for batch in batches:
        behind, costs = [], []
        for c, to, cost in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "to", "costs")), strict=True):
            if not begun or c != conv:
                conv, begun, at, total = c, True, t.last, 0
            behind.append(at)
            total += int(np.frombuffer(cost, "<i8")[at])
            at = int(np.frombuffer(to, "<i4")[at])
            costs.append(total + t.vectors[at][START])
        yield _batch(("conv_id", "chunk", "codes", "illegal", "behind", "cost"), [*(batch.column(x) for x in ("conv_id", "chunk", "codes", "illegal")), pa.array(behind, pa.int32()), pa.array(costs, pa.int64())])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the same chunks from first to last, the edits of each from the state before it; the last one's with what is
    inserted behind it. A conversation's first chunk has the cost of all."""
    t, conv, state, held, last = tables(), None, START, None, 0
    names = ("conv_id", "chunk", "start", "edits", "cost", "illegal", "blank", "duplicate", "truncated")
    for batch in batches:
        kinds, rows = (batch.column("conv_id").type, pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5), []
        for c, chunk, codes, illegal, behind, cost in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "chunk", "codes", "illegal", "behind", "cost")), strict=True):
            codes, new = np.array(codes, np.uint8), held is None or c != conv
            if held is not None:
                rows.append([*held[:3], held[3] + t.finish(state) * new, *held[4:]])
            if new:
                conv, state = c, START
            else:
                illegal += int(_illegal(last, codes[0] % 4))
            edits, end = t.trace(behind, SYMBOLS[codes], state)
            faults = np.bincount(codes // 4, minlength=4).tolist()
            held = [c, chunk, state, edits, cost if new else 0, illegal, faults[2], faults[3], faults[1]]
            state, last = end, codes[-1] % 4
        yield _columns(names, kinds, rows)
    if held is not None:
        yield _columns(names, kinds, [[*held[:3], held[3] + t.finish(state), *held[4:]]])


def edits(rows: DataFrame) -> DataFrame:
    """A row a chunk of numbered() turns: conv_id, chunk, start (the state before it), edits (letters), cost (of the whole
    conversation, at its first chunk; else 0), illegal, blank, duplicate, truncated.

    A chunk's turns are gathered, CHUNK at most; a conversation's chunks are streamed, not gathered."""
    name = _kind(rows)
    chunks = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("no", "code"))).alias("x")).select("conv_id", "chunk", F.col("x.code").alias("codes"))
    maps = chunks.mapInArrow(_maps, f"conv_id {name}, chunk long, codes array<int>, to binary, costs binary, illegal long")
    back = maps.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk")).mapInArrow(_vectors, f"conv_id {name}, chunk long, codes array<int>, illegal long, behind int, cost long")
    forth = back.sortWithinPartitions("conv_id", "chunk").mapInArrow(_traces, f"conv_id {name}, chunk long, start int, edits string, cost long, illegal long, blank long, duplicate long, truncated long")
    return written(forth, "edits")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks' edits, each followed by the chunk's turns in order, the repaired turns."""
    names, roles = ("conv_id", "chunk", "at", "role", "text", "edit"), {USER: b"user", ASSISTANT: b"assistant"}
    state, todo, at, ends = START, "", 0, 0
    for batch in batches:
        kinds, out = (batch.column("conv_id").type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()), []
        text, role = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("text", "role"))
        for i, (c, chunk, start, letters) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("conv_id", "chunk", "start", "edits")), strict=True)):
            if letters is not None:
                state, todo, at, ends = start, letters, 0, len(letters.rstrip("I"))
                continue
            while True:
                edit = todo[at] if at < len(todo) else ""
                if edit == "I":
                    state = NEXT[state]
                    out.append((c, chunk, at, roles[state], b"", edit))
                elif edit == "K":
                    state = STEP[state][chr(role[i][0])]
                    out.append((c, chunk, at, role[i], text[i], edit))
                elif edit == "R":
                    state = NEXT[state]
                    out.append((c, chunk, at, roles[state], text[i], edit))
                at += 1
                # behind a turn comes the next one, and behind the last what is inserted there
                if edit == "" or edit != "I" and at < ends:
                    break
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        made = [pa.array(x, pa.binary()).cast(k) if n in ("role", "text") else pa.array(x, k) for n, x, k in zip(names, columns, kinds, strict=True)]
        yield _batch(names, made)


def _lines(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks' edits, with no -1, and their turns."""
    heads = found.select("conv_id", "chunk", F.lit(-1).cast("long").alias("no"), "start", "edits")
    return heads.unionByName(rows.select("conv_id", "chunk", "no", "role", "text"), allowMissingColumns=True)


def _repaired(lines: DataFrame) -> DataFrame:
    return lines.mapInArrow(_applied, f"conv_id {_kind(lines)}, chunk long, at int, role string, text string, edit string")


def _kind(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def repair(rows: DataFrame) -> DataFrame:
    """The repaired turns of rows (conv_id, turn, role, text, ...): conv_id, chunk, at, role, text, edit (K kept, R given
    another role, I inserted), in order of chunk and at within a conversation. Deleted turns are left out. Nulls in
    role and text count as one space, a null conv_id is a conversation of its own; empty tables give none."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    turns = numbered(rows.select("conv_id", "turn", text("role"), text("text")))
    lines = _lines(turns, edits(turns))
    return _repaired(lines.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "no"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of repaired turns in order, each conversation's hash; only the hash so far is held."""
    conv, sha = None, None
    for batch in batches:
        kinds, done = (batch.column("conv_id").type, pa.string()), []
        role, text = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("role", "text"))
        for i, c in enumerate(batch.column("conv_id").to_pylist()):
            if sha is None or c != conv:
                if sha is not None:
                    done.append((conv, sha.hexdigest()))
                conv, sha = c, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(role[i] + b":")
            sha.update(text[i])
        yield _columns(("conv_id", "sha"), kinds, done)
    if sha is not None:
        yield _columns(("conv_id", "sha"), kinds, [(conv, sha.hexdigest())])


def repair_report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row a conv_id of conversations: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of its
    rows (conv_id, turn, role, text; no nulls but in conv_id and turn), all as the cheapest edits have it.

    gaps: turns missing between the lowest and the highest (nulls don't count). Each row's first fault counts; illegal:
    neighbours whose roles' initials can't follow each other. Of conversations without rows: zeros, an empty audit and
    the hash of nothing. Rows without a conv_id are one conversation. Rows that share a turn come by role and then by a
    hash of the text. Very long texts are streamed one by one; an audit has a letter or so a row and must fit in one."""
    turns = numbered(rows)
    found = edits(turns)
    lines = _lines(turns, found).repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "no")
    sha = _repaired(lines).mapInArrow(_digests, f"conv_id {_kind(rows)}, sha string")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "edits"))), lambda x: x.edits), "")
    sums = found.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in counts], audit.alias("audit"))
    turn = F.col("turn")
    spans = rows.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max(turn) - F.min(turn) + 1 - F.count("*")).cast("long").alias("gaps"))
    out = conversations.select(F.col("conv_id").alias("id")).distinct()
    for part in (spans, sums, sha):
        out = out.join(part, F.col("id").eqNullSafe(part["conv_id"]), "left").drop("conv_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.select(F.col("id").alias("conv_id"), *[zero(c) for c in ("gaps", *counts)], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
    result = written(out, "repairs")
    for done in (turns, found):
        discard(done)
    return result
