"""Token ids in wavelet matrices, one compressed file a shard.

A wavelet matrix keeps a sequence as bit planes, from the most significant bit down; each plane is in the
order that a stable sort by the bits above gives. Rank over a plane leads from a position to its place in
the next plane, so the file answers access, rank (counts in a prefix), select and find without the ids. Planes are
compressed in blocks with a directory of their ranks, so a query unpacks the blocks on its way and no more."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, written

MAGIC = b"QWVMTRX2"
END_ID = 2
#: Bits of a plane that are compressed together and have their rank stored
BLOCK_BITS = 1 << 19


def build_planes(ids: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[int]]:
    """The packed bit planes of ids and the number of zeros of each."""
    rest, planes, zeros = ids.astype(np.uint16 if levels <= 16 else np.uint32), [], []
    for level in range(levels - 1, -1, -1):
        bit = (rest >> rest.dtype.type(level)) & rest.dtype.type(1) != 0
        planes.append(np.packbits(bit, bitorder="little"))
        low = rest[~bit]
        zeros.append(len(low))
        rest = np.concatenate([low, rest[bit]])
    return planes, zeros


class WaveletMatrix:
    """Queries on stored bit planes. Each plane is cut into blocks of BLOCK_BITS bits; ranks holds for each plane the
    number of ones before each block and in all. A query reads the blocks it needs and no others; blocks that were
    read are kept."""

    def __init__(self, read: Callable[[int, int], bytes], zeros: list[int], ranks: list[list[int]], n: int):
        self.n, self.zeros, self.ranks, self.levels = n, zeros, [np.array(r, np.int64) for r in ranks], len(zeros)
        self._read = read
        self._kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _block(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """64-bit words of a block, and the ones before each of them and in all."""
        if (level, block) not in self._kept:
            words = np.zeros(BLOCK_BITS // 64, np.uint64)
            data = np.frombuffer(self._read(level, block), np.uint8)
            words.view(np.uint8)[: len(data)] = data
            self._kept[level, block] = words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return self._kept[level, block]

    def _bits(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits at these positions (False at the end) and the ones before them."""
        bit, ones = np.zeros(len(at), bool), np.full(len(at), self.ranks[level][-1])
        block = np.where(at < self.n, at // BLOCK_BITS, -1)
        for b in np.unique(block[block >= 0]).tolist():
            i = np.flatnonzero(block == b)
            words, before = self._block(level, b)
            place = at[i] - b * BLOCK_BITS
            word, shift = words[place >> 6], (place & 63).astype(np.uint64)
            bit[i] = word >> shift & np.uint64(1) != 0
            ones[i] = self.ranks[level][b] + before[place >> 6] + np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
        return bit, ones

    def access(self, positions) -> np.ndarray:
        """The ids at these positions."""
        at = np.atleast_1d(np.asarray(positions, np.int64))
        out = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            bit, ones = self._bits(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            out = out * 2 + bit
        return out

    def _descend(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Where the symbol's run would end in the last plane's order, had the sequence ended at these positions."""
        for level in range(self.levels):
            _, ones = self._bits(level, at)
            at = self.zeros[level] + ones if symbol >> (self.levels - 1 - level) & 1 else at - ones
        return at

    def rank(self, symbol: int, ends) -> np.ndarray:
        """How often symbol stands before each of these positions."""
        ends = np.minimum(np.atleast_1d(np.asarray(ends, np.int64)), self.n)
        if not 0 <= symbol < 1 << self.levels:
            return np.zeros(len(ends), np.int64)
        at = self._descend(symbol, np.append(ends, 0))
        return at[:-1] - at[-1]

    def count(self, symbol: int, start: int = 0, end: int | None = None) -> int:
        a, b = self.rank(symbol, [start, self.n if end is None else end]).tolist()
        return b - a

    def _select_bit(self, level: int, one: bool, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th (from 0) bits of that kind in a plane."""
        upto = self.ranks[level] if one else np.minimum(np.arange(len(self.ranks[level])) * BLOCK_BITS, self.n) - self.ranks[level]
        block = np.searchsorted(upto, k, "right") - 1
        out = np.empty(len(k), np.int64)
        for b in np.unique(block).tolist():
            i = np.flatnonzero(block == b)
            words, before = self._block(level, b)
            if not one:
                words, before = ~words, np.arange(len(before)) * 64 - before
            left = k[i] - upto[b]
            word = np.searchsorted(before, left, "right") - 1
            bits = words[word, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)
            inside = (np.cumsum(bits, axis=1, dtype=np.int64) > (left - before[word])[:, None]).argmax(axis=1)
            out[i] = b * BLOCK_BITS + word * 64 + inside
        return out

    def select(self, symbol: int, ks) -> np.ndarray:
        """Positions of the k-th (from 0) occurrences of a symbol; -1 if there are not so many."""
        ks = np.atleast_1d(np.asarray(ks, np.int64))
        out, known = np.full(len(ks), -1, np.int64), (ks >= 0) & (ks < self.count(symbol))
        if known.any():
            at = self._descend(symbol, np.zeros(1, np.int64)) + ks[known]
            for level in range(self.levels - 1, -1, -1):
                one = bool(symbol >> (self.levels - 1 - level) & 1)
                at = self._select_bit(level, one, at - self.zeros[level] if one else at)
            out[known] = at
        return out

    def find(self, symbol: int) -> np.ndarray:
        """All positions of a symbol in rising order."""
        return self.select(symbol, np.arange(self.count(symbol)))

    def decode(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        rest = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            plane = np.concatenate([self._block(level, b)[0] for b in range(len(self.ranks[level]) - 1)] or [np.zeros(0, np.uint64)])
            bit = np.unpackbits(plane.view(np.uint8), count=self.n, bitorder="little").view(bool)
            out = np.empty(self.n, kind)
            out[~bit] = rest[: self.zeros[level]]
            out[bit] = rest[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            rest = out
        return rest


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The file format: magic, length of the header, JSON header, then zstandard frames: documents' ids, their
    numbers of tokens, and the blocks of each bit plane. The header has each frame's size and each block's rank."""
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    planes, zeros = build_planes(ids, levels)
    pack = zstandard.ZstdCompressor(level=1).compress
    frames = [pack(np.array([d or 0 for d in doc_ids], "<i8").tobytes()), pack(np.array(lengths, "<i8").tobytes())]
    meta, blocks, ranks = [len(f) for f in frames], [], []
    for p in planes:
        parts = [p[i : i + BLOCK_BITS // 8] for i in range(0, len(p), BLOCK_BITS // 8)]
        packed = [pack(x.tobytes()) for x in parts]
        blocks.append([len(x) for x in packed])
        ranks.append(np.cumsum([0, *(int(np.bitwise_count(x).sum()) for x in parts)]).tolist())
        frames += packed
    head = json.dumps({"n": len(ids), "docs": len(doc_ids), "zeros": zeros, "meta": meta, "blocks": blocks, "ranks": ranks, "null_docs": [i for i, d in enumerate(doc_ids) if d is None]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(frames)


def open_shard(read_at: Callable[[int, int], bytes]) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """(doc_ids, numbers of tokens, matrix) of a shard file, of which read_at(offset, size) gives bytes. Planes are
    read when they are asked for."""
    start = read_at(0, 12)
    if start[:8] != MAGIC:
        raise ValueError("not a token shard")
    size = struct.unpack("<I", start[8:12])[0]
    head = json.loads(read_at(12, size))
    sizes = [*head["meta"], *(x for level in head["blocks"] for x in level)]
    offsets = (12 + size + np.cumsum([0, *sizes])).tolist()
    first = np.cumsum([len(head["meta"]), *(len(level) for level in head["blocks"])]).tolist()
    unpack = zstandard.ZstdDecompressor().decompress
    frame = lambda i: unpack(read_at(offsets[i], sizes[i]))
    docs: list[int | None] = np.frombuffer(frame(0), "<i8").tolist()
    for i in head["null_docs"]:
        docs[i] = None
    return docs, np.frombuffer(frame(1), "<i8"), WaveletMatrix(lambda level, block: frame(first[level] + block), head["zeros"], head["ranks"], head["n"])


def unpack_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    return open_shard(lambda at, size: data[at : at + size])


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class _Memory(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers, remembered for up to `limit` pre-tokens."""

    def __init__(self, model, limit: int):
        super().__init__()
        self.model, self.limit = model, limit
        # fixed values: the printable characters that byte-level vocabularies write for themselves; other bytes are
        # written as the characters from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.written = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        pieces = self.model.tokenize(word.encode().decode("latin-1").translate(self.written))
        self[word] = ids = struct.pack(f"<{len(pieces)}I", *[t.id for t in pieces])
        return ids


class Encoder:
    """Whole texts to ids with a byte-level BPE tokenizer, through a memory of pre-tokens.

    Pre-tokens are encoded each on their own, so a text's ids are those of its pre-tokens end to end, and the
    tokenizer's model gives those of one pre-token. Texts of the Latin letters, digits and signs below are cut by a
    plain pattern, where its classes say the same as the tokenizer's Unicode ones; texts with other characters or a
    special token's string, and all texts of a tokenizer that isn't of this kind, go to the tokenizer whole."""

    LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
    DIGITS = "0-9²³¹¼½¾"
    SPACES = r"\t\n\r \u00a0\u202f"
    SIGNS = "!-/:-@[-`{-~¡-©«-±´¶-¸»¿×÷‐-‧‰-›€™"
    CUT = rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{SPACES}{LETTERS}{DIGITS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.cuts = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.find = re.compile(self.CUT).findall
        self.known = re.compile(f"[{self.SPACES}{self.LETTERS}{self.DIGITS}{self.SIGNS}]*").fullmatch
        self.memory = _Memory(self.tokenizer.model, limit)

    def _plain(self, text: str) -> bool:
        return self.cuts and self.known(text) is not None and not any(s in text for s in self.special)

    def __call__(self, text: str | None) -> bytes:
        """ids of a text as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return b""
        if self._plain(text):
            return b"".join(map(self.memory.__getitem__, self.find(text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, shard_tokens: int = 1 << 23) -> DataFrame:
    """Write the ids of docs (doc_id, text, ...) in ascending doc_id order to shard files under path.

    Each text's ids are followed by end_id. A shard closes at the first document that brings it to
    shard_tokens. Null texts count as empty; rows without a doc_id come first; rows that repeat one stand
    together, by text. Returns the manifest: file, task, no, n_docs, n_tokens, base (ids in all shards before).
    An empty table writes nothing. A task that is run again writes new files; the manifest names the ones
    that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, no = encoder(tokenizer), TaskContext.get().partitionId(), 0
        fs, top = _filesystem(path)
        fs.create_dir(top, recursive=True)
        ids, lengths, parts, held = [], [], [], 0
        end = np.array([end_id], "<u4").tobytes()

        def flush():
            nonlocal ids, lengths, parts, held, no
            name = f"{task:06d}-{no:06d}-{uuid.uuid4().hex}.wvm"
            with fs.open_output_stream(f"{top}/{name}") as f:
                f.write(pack_shard(ids, lengths, np.frombuffer(b"".join(parts), "<u4")))
            row = pa.RecordBatch.from_pydict({"file": [name], "task": [task], "no": [no], "n_docs": [len(ids)], "n_tokens": [held]}, schema=pa.schema([("file", pa.string()), ("task", pa.int32()), ("no", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
            ids, lengths, parts, held, no = [], [], [], 0, no + 1
            return row

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = enc(text.as_py())
                ids.append(doc)
                lengths.append(len(data) // 4 + 1)
                parts += (data, end)
                held += lengths[-1]
                if held >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(ordered.mapInArrow(run, "file string, task int, no int, n_docs long, n_tokens long"), "token-manifest")
    tasks = manifest.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    # a row a task, of which there are far fewer than files
    tasks = tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("task").orderBy("no")) - F.col("n_tokens")
    return manifest.withColumn("inside", inside).join(tasks, "task").withColumn("base", F.col("before") + F.col("inside")).drop("before", "inside")


def read_tokens(manifest: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids, n_end, first_end) of every document in the shard files that the manifest names;
    ids as little-endian unsigned 32-bit integers. n_end, by rank: how often the end's id stands in it, which is once
    unless the text spells it; first_end, by select: the place of the first in the document."""
    names = ["doc_id", "start", "n_tokens", "ids", "n_end", "first_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _filesystem(path)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{top}/{row['file']}") as f:
                    docs, lengths, matrix = open_shard(lambda at, size, f=f: f.read_at(size, at))
                    ids, ends = matrix.decode().astype("<u4"), np.cumsum(lengths)
                    starts = ends - lengths
                    before = matrix.rank(end_id, np.append(starts, matrix.n))
                    first = matrix.select(end_id, before[:-1]) - starts
                n_end = np.diff(before)
                for a in range(0, len(docs), 512):
                    s = slice(a, a + 512)
                    data = [ids[i:j].tobytes() for i, j in zip(starts[s].tolist(), ends[s].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(docs[s], pa.int64()), *map(pa.array, (row["base"] + starts[s], lengths[s])), pa.array(data, pa.binary()), *map(pa.array, (n_end[s], first[s]))], names)

    files = written(manifest.select("file", "base"), "token-files")
    # a task a file: without the number, so few bytes would be put together in one task
    return files.repartition(max(1, min(files.count(), 100_000))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, n_end long, first_end long")


def token_table(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write docs' tokens to path (the shared folder by default) and read them back: see both functions."""
    path = path or new_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, tokenizer, path), path)
