"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary's trie gets failure links: where no edge goes on, the link pops the pieces that a greedy
matcher would have emitted by then and leads to the state of what is left. Their numbers are computed once
for each state, so counting a word's pieces takes one pass over it and builds no piece."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class PieceCounter:
    """Automaton over the bytes of words: first pieces come from `initial`, all later ones from `continuing`."""

    ROOT, REST = 0, 1

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]):
        self.edges: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((self.ROOT, initial), (self.REST, continuing)):
            for piece in pieces:
                at = root
                for b in piece:
                    if b not in self.edges[at]:
                        self.edges[at][b] = len(self.edges)
                        self.edges.append({})
                        ends.append(False)
                    at = self.edges[at][b]
                ends[at] = at > self.REST
        self.fail = [-1] * len(self.edges)
        self.pops = [0] * len(self.edges)
        queue = deque((root, b, to) for root in (self.ROOT, self.REST) for b, to in self.edges[root].items())
        while queue:
            parent, b, state = queue.popleft()
            if ends[state]:  # all of it is one piece
                self.fail[state], self.pops[state] = self.REST, 1
            else:
                # what the parent pops, and then on from its link, until the byte fits
                at, popped = self.fail[parent], self.pops[parent]
                while at >= 0 and b not in self.edges[at]:
                    at, popped = self.fail[at], popped + self.pops[at]
                if at >= 0:
                    self.fail[state], self.pops[state] = self.edges[at][b], popped
            queue.extend((state, x, to) for x, to in self.edges[state].items())

    def count(self, word: bytes) -> int:
        """Pieces of a word, 0 if it can't be cut."""
        at, n = self.ROOT, 0
        edges, fail, pops = self.edges, self.fail, self.pops
        for b in word:
            while b not in edges[at]:
                if fail[at] < 0:
                    return 0
                n += pops[at]
                at = fail[at]
            at = edges[at][b]
        while at > self.REST:
            if fail[at] < 0:
                return 0
            n += pops[at]
            at = fail[at]
        return n


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}


def load_pieces(path: str) -> tuple[set[bytes], set[bytes]]:
    """Pieces of a byte-level vocabulary file (JSON): those that begin with a space start a word, without it;
    those that hold no space continue it. Each single byte may start a word too."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    of = _byte_of_char()
    pieces = [bytes(of[c] for c in token) for token in vocabulary if all(c in of for c in token)]
    initial = {p[1:] for p in pieces if p[:1] == b" " and b" " not in p[1:] and len(p) > 1} | {bytes([b]) for b in range(256)}
    return initial, {p for p in pieces if b" " not in p}


_counters: dict[str, PieceCounter] = {}


class _Counts(dict):
    """word -> number of pieces, remembered."""

    def __init__(self, counter: PieceCounter, limit: int = 500_000):
        super().__init__()
        self.counter, self.limit = counter, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.limit:
            self.clear()
        self[word] = n = self.counter.count(word)
        return n


_counts: dict[str, _Counts] = {}


def _counts_for(path: str) -> _Counts:
    if path not in _counts:
        _counts[path] = _Counts(PieceCounter(*load_pieces(path)))
    return _counts[path]


def piece_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """A row per row of docs (doc_id, text, ...): doc_id, n_words, n_pieces, n_unknown, longest.

    Words are the runs of bytes between ASCII white space. n_pieces counts the greedy longest-match pieces of
    all words, one for each word that the vocabulary can't cut (n_unknown); longest is the most pieces of a
    word. Null and empty texts have zeros. Other columns are ignored; repeated rows each give a row; an
    empty table gives none. vocabulary: a byte-level vocabulary file that every executor can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts_for(vocabulary)
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                n = list(map(counts.__getitem__, (text or b"").split()))
                unknown = n.count(0)
                rows.append((len(n), sum(n) + unknown, unknown, max(n, default=0) or min(1, unknown)))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_words", "n_pieces", "n_unknown", "longest"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_words long, n_pieces long, n_unknown long, longest long")
