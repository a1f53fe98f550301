"""Byte-level BPE as a monoid: results of two neighbours join by encoding a window over their border anew.

A long text is halved, its halves are split into pieces recursively and joined: pieces are split again from the last but
one of the left side on, until a border falls on one of the right side's, from where both go on alike. Every piece is
encoded by itself. A short one is merged pair by pair in rank order; a long one is halved, its halves are encoded
recursively and joined. A join re-encodes the bytes of the last tokens of the left and the first tokens of the right
side, in a window that grows while it does not fit its surroundings. It fits once each pair of neighbours at the window's
two edges encodes to itself: a sequence in which every adjacent pair does is the encoding of its bytes (the first merge
across a border of the whole would be a merge across that border of the pair). Decoding concatenates chunks of tokens'
bytes, neighbour by neighbour up the tree.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import parts

LEAF_BYTES, LEAF_CHARS, LEAF_TOKENS = 64, 1 << 16, 1 << 14
LONG_BYTES = 256  # windows from here on are merged with a heap
CACHE_ENTRIES = 100_000
SPACES = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def ranges(major: str, low: int, high: int) -> str:
    """The code points of a major category in [low, high) as the inside of a character class."""
    out, start = [], None
    for cp in range(low, high + 1):
        inside = cp < high and unicodedata.category(chr(cp))[0] == major
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=4)
def splitter(high: int) -> re.Pattern:
    """public_tokenizers.PATTERN for texts whose code points lie below `high`, by classes that re can look up at once."""
    letters, numbers = ranges("L", 0, high), ranges("N", 0, high)
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


_WIDE = re.compile("[\U00010000-\U0010ffff]")


def pieces(text: str) -> list[str]:
    if text.isascii():
        return splitter(0x80).findall(text)
    return splitter(sys.maxunicode + 1 if _WIDE.search(text) else 0x10000).findall(text)


def split(text: str, leaf: int = LEAF_CHARS) -> list[str]:
    """The pieces of a whole text, by halves."""
    if len(text) <= leaf:
        return pieces(text)
    half = len(text) // 2
    return seam(split(text[:half], leaf), split(text[half:], leaf))


def seam(left: list[str], right: list[str]) -> list[str]:
    """The pieces of two neighbouring texts as one, from the pieces of each.

    What the pattern takes depends on three characters at most behind a piece's start, or on one behind its end, so all
    pieces but the last two of a text stay whatever follows. From a border that both sides have, they go on alike.
    """
    if not left or not right:
        return left or right
    keep = max(0, len(left) - 2)
    open_end, n = "".join(left[keep:]), 2
    while n < len(right):
        new = pieces(open_end + "".join(right[:n]))
        ends, at = {}, 0
        for i, p in enumerate(new[:-2]):
            at += len(p)
            ends[at] = i + 1
        at = len(open_end)
        for j, p in enumerate(right[:n]):
            if at in ends:
                return left[:keep] + new[: ends[at]] + right[j:]
            at += len(p)
        n *= 2
    return left[:keep] + pieces(open_end + "".join(right))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder(dict):
    """Piece -> ids, filled as pieces come; bounded by starting anew when full."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF_BYTES, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.ranks, self.leaf, self.entries = ranks, leaf, entries
        self.tokens = {i: b for b, i in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.size = max(ranks.values(), default=0) + 1
        self.single = [ranks.get(bytes([x]), 0) for x in range(256)]
        self.pairs = {  # two neighbours as one number -> the token that they merge to
            left * self.size + right: i
            for b, i in ranks.items()
            for k in range(1, len(b))
            if (left := ranks.get(b[:k])) is not None and (right := ranks.get(b[k:])) is not None
        }

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "replace")
        ids = tuple(self.tree(raw))
        if len(raw) <= 64:
            if len(self) >= self.entries:
                self.clear()
            self[piece] = ids
        return ids

    def merged(self, raw: bytes) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until none is left."""
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        if len(raw) > LONG_BYTES:
            return self.merged_long(raw)
        get, size, none = self.pairs.get, self.size, self.size
        ids = [self.single[x] for x in raw]
        got = [get(a * size + b, none) for a, b in zip(ids, ids[1:])]
        while got:
            best = min(got)
            if best == none:
                break
            i = got.index(best)
            ids[i] = best
            del ids[i + 1], got[i]
            if i < len(got):
                got[i] = get(best * size + ids[i + 1], none)
            if i:
                got[i - 1] = get(ids[i - 1] * size + best, none)
        return ids

    def merged_long(self, raw: bytes) -> list[int]:
        """The same merges, the next one taken from a heap of (rank, place): n log n for n bytes."""
        n, get, size = len(raw), self.pairs.get, self.size
        ids = [self.single[x] for x in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [get(a * size + b, -1) for a, b in zip(ids, ids[1:])] + [-1]  # what a token and the next one merge to
        heap = [rank * n + i for i, rank in enumerate(now) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            if now[i] != rank:
                continue
            gone = after[i]
            ids[i], now[gone] = rank, -1
            after[i] = end = after[gone]
            ids[gone] = -1
            if end < n:
                before[end] = i
                now[i] = got = get(rank * size + ids[end], -1)
                if got >= 0:
                    heapq.heappush(heap, got * n + i)
            else:
                now[i] = -1
            if (b := before[i]) >= 0:
                now[b] = got = get(ids[b] * size + rank, -1)
                if got >= 0:
                    heapq.heappush(heap, got * n + b)
        return [x for x in ids if x >= 0]

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens next to each other stay as they are."""
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) >= self.entries:
                self.fits.clear()
            known = self.fits[a, b] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j = len(left), 0  # the window is left[i:] + right[:j]
        grow_l = grow_r = 1
        while True:
            i, j = max(0, i - grow_l), min(len(right), j + grow_r)
            window = self.merged(b"".join(self.tokens[t] for t in left[i:] + right[:j]))
            bad_l = i > 0 and not self.stable(left[i - 1], window[0])
            bad_r = j < len(right) and not self.stable(window[-1], right[j])
            if not bad_l and not bad_r:
                return left[:i] + window + right[j:]
            grow_l, grow_r = bad_l * max(1, len(left) - i), bad_r * max(1, j)

    def tree(self, raw: bytes) -> list[int]:
        if len(raw) <= self.leaf:
            return self.merged(raw)
        half = 1 << (len(raw) - 1).bit_length() - 1  # tokens of repeated characters, often powers of two, end there
        return self.join(self.tree(raw[:half]), self.tree(raw[half:]))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in split(text):
            out += self[piece]
        return out


_made: dict[str, Encoder] = {}


def _encoder(ranks, key: str) -> Encoder:
    """One encoder a worker and vocabulary file, kept over tasks."""
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(ranks.value)
    return _made[key]


def _encoded(enc: Encoder, texts: list[str | None]) -> pa.ListArray:
    get, sizes, flat = enc.__getitem__, [0], []
    for t in texts:
        if t:
            for ids in map(get, split(t)):
                flat += ids
        sizes.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))


class Decoder:
    """Ids to bytes; an id without a token is an error."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = pa.array([tokens.get(i) for i in range(max(tokens, default=-1) + 1)], pa.large_binary())

    def leaf(self, ids: pa.Array) -> bytes:
        got = self.tokens.take(ids.cast(pa.int64()))
        if got.null_count:
            raise ValueError(f"no token has the id {ids.filter(got.is_null())[0]}")
        ends = np.frombuffer(got.buffers()[1], dtype=np.int64)
        return got.buffers()[2][int(ends[got.offset]) : int(ends[got.offset + len(got)])].to_pybytes() if len(got) else b""

    def decode(self, ids: pa.Array) -> bytes:
        """Leaves of LEAF_TOKENS ids, then neighbours joined up the tree."""
        level = [self.leaf(ids.slice(lo, LEAF_TOKENS)) for lo in range(0, len(ids), LEAF_TOKENS)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""

    def column(self, lists: pa.ListArray) -> pa.Array:
        return pa.array([None if x is None else self.decode(x) for x in (v.values if v.is_valid else None for v in lists)], pa.binary())


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with `out`, array<int>: the ids of the whole text, in place of a column of that name. Null text counts as
    empty and has no ids.

    The vocabulary (one file of ranks, under 2 MB) is read once by the driver and broadcast.
    """
    d, name = docs.withColumn("_text_", F.col(f"`{text}`")).drop(out), "_text_"
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    at, own = d.columns.index(name), [i for i, c in enumerate(d.columns) if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks, path)
        for part in parts(batches, at):
            ids = _encoded(enc, part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in own), ids], names=[*(part.schema.names[i] for i in own), out])

    return d.mapInArrow(run, _with(d.drop(name), f"`{out}` array<int>"))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """rows with `out`, binary, in place of a column of that name: the tokens' bytes in order; null ids give null, no ids
    nothing, an id that the vocabulary lacks fails."""
    d = rows.drop(out)
    ranks = rows.sparkSession.sparkContext.broadcast(load_ranks(path))
    at = d.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder({i: b for b, i in ranks.value.items()})
        for part in parts(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns, decoder.column(part.column(at))], names=[*part.schema.names, out])

    return d.mapInArrow(run, _with(d, f"`{out}` binary"))


def _with(df: DataFrame, more: str):
    from pyspark.sql.types import StructType

    return StructType(df.schema.fields + StructType.fromDDL(more).fields)


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, `keep`, ids and bytes (decoded from the ids) per document, in one pass; null text counts as empty."""
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *[F.col(f"`{c}`") for c in keep or []], F.col(f"`{text}`").alias("_text_"))
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    at = len(d.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks, path)
        decoder = Decoder(enc.tokens)
        for part in parts(batches, at):
            ids = _encoded(enc, part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:at], ids, decoder.column(ids)], names=[*part.schema.names[:at], "ids", "bytes"])

    return d.mapInArrow(run, _with(d.drop("_text_"), "ids array<int>, bytes binary"))
