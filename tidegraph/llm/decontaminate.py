"""Benchmark decontamination with an Aho-Corasick automaton over normalised item windows.

Each text is normalised and scanned once for a block of windows, as a string of words' codes; hits are mapped back to the
original's code points. The benchmark is a stated query set: its distinct windows are dealt into blocks of bounded number,
one automaton each, broadcast to the workers. A usual benchmark is one block; more blocks are further passes of the same
rows, without a shuffle, which hand on the words hit so far; the last one turns them into spans.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import drop, parts, stored

WINDOW = 10
WIDTH = 3  # characters of a word's code: 2 097 151 words
BLOCK_WINDOWS = 50_000  # windows of one automaton, each of WIDTH * size nodes at most

# A-Z to a-z; other ASCII that is neither letter nor digit to a space; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode("utf-8", "replace").translate(_FOLD).split(b" ") if w]


def windows(item: list[str], size: int = WINDOW) -> list[str]:
    """The item's windows as text, words between single spaces; a shorter item is one window."""
    return [" ".join(item[i : i + size]) for i in range(max(1, len(item) - size + 1))] if item else []


def coded(number: int) -> str:
    """A word's number as WIDTH characters, of another alphabet at each place, so that no match begins inside a word."""
    return "".join(chr((1 + k) * 256 + (number >> 7 * k) % 128) for k in range(WIDTH))


def automaton(owned: list[tuple[str, list[str]]]) -> tuple[dict[str, str], object]:
    """Words' codes, and one automaton over the windows as strings of them; each carries its length and its items."""
    import ahocorasick

    codes: dict[str, str] = {}
    a = ahocorasick.Automaton()
    for window, ids in owned:
        own = window.split(" ")
        for w in own:
            if w not in codes:
                codes[w] = coded(len(codes) + 1)
        a.add_word("".join([codes[w] for w in own]), (len(own), tuple(ids)))
    a.make_automaton()
    return codes, a


def hits(found: list[str], codes: dict[str, str], auto) -> tuple[set[int], set[str]]:
    """The indexes of hit words and the items with an occurring window; words of no window are number 0."""
    hit: set[int] = set()
    items: set[str] = set()
    if codes:
        for at, (n, ids) in auto.iter("".join([codes.get(w, NO_WORD) for w in found])):
            last = at // WIDTH
            hit.update(range(last - n + 1, last + 1))
            items.update(ids)
    return hit, items


NO_WORD = coded(0)


def word_spans(text: str, hit: list[int]) -> list[dict[str, int]]:
    """Runs of hit words as spans of the original text, code points, end exclusive."""
    marks = [m.span() for m in _WORD.finditer(text)]
    out: list[dict[str, int]] = []
    for k, i in enumerate(hit):
        if k and hit[k - 1] == i - 1:
            out[-1]["end"] = marks[i][1]
        else:
            out.append({"start": marks[i][0], "end": marks[i][1]})
    return out


_autos: dict[str, object] = {}


def _auto(owned, key: str):
    """One automaton a worker, kept over tasks until another one is asked for."""
    if key not in _autos:
        _autos.clear()
        _autos[key] = automaton(owned.value)
    return _autos[key]


def _pass(d: DataFrame, block: list[tuple[str, list[str]]], last: bool) -> DataFrame:
    """Rows (row, _t) or (row, _t, _hit, _items), scanned for one block; the last one adds _n and _spans."""
    shared, key = d.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    before, whole = "_hit" in d.columns, d.select("row", "_t").schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, auto = _auto(shared, key)
        for batch in parts(batches, 1):
            n, hit, items, spans = [], [], [], []
            old = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()) if before else [((), ())] * batch.num_rows
            for t, (was_hit, had) in zip(batch.column(1).to_pylist(), old):
                found = words(t)
                h, i = hits(found, codes, auto)
                hit.append(sorted(h.union(was_hit)))
                items.append(sorted(i.union(had)))
                n.append(len(found))
                spans.append(word_spans(t, hit[-1]) if last and hit[-1] else [])
            cols = {"row": batch.column(0), "_t": batch.column(1), "_hit": pa.array(hit, pa.list_(pa.int32())), "_items": pa.array(items, pa.list_(pa.string()))}
            if last:
                cols |= {"_n": pa.array(n, pa.int64()), "_spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
            yield pa.RecordBatch.from_pydict(cols)

    from pyspark.sql.types import StructType

    more = StructType.fromDDL("_hit array<int>, _items array<string>" + ", _n bigint, _spans array<struct<start: int, end: int>>" * last)
    return d.mapInArrow(run, StructType(whole + more.fields))


def _owned(benchmark: DataFrame, item_id: str, item_text: str, size: int) -> DataFrame:
    """(w, ids), stored: the distinct windows and, sorted, the items that have them."""
    asked = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1, rows=64):
            rows = [(i, w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in set(windows(words(t), size))]
            yield pa.RecordBatch.from_pydict({"id": pa.array([r[0] for r in rows], pa.string()), "w": pa.array([r[1] for r in rows], pa.string())})

    return stored(asked.mapInArrow(cut, "id string, w string").groupBy("w").agg(F.array_sort(F.collect_set("id")).alias("ids")), "windows")


def _scanned(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, size: int, block_windows: int) -> DataFrame:
    """`row` (all columns of docs, packed so that no name can clash) with _n, _hit, _items and _spans."""
    owned = _owned(benchmark, item_id, item_text, size)
    blocks = max(1, -(-owned.count() // block_windows))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("_t"))
    for b in range(blocks):
        block = [(r.w, list(r.ids)) for r in owned.filter(F.pmod(F.xxhash64("w"), F.lit(blocks)) == b).toLocalIterator()]
        out = _pass(out, block, b + 1 == blocks)
    drop(owned)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, hit_words (indexes), items (ids, sorted as strings) and spans (of the original text) per row.

    Null and wordless texts have no words and no hit. Benchmark rows without id or text contribute nothing; repeated
    rows and windows count once. An empty benchmark hits nothing.
    """
    out = _scanned(docs.select(doc_id, text), benchmark, text, item_id, item_text, size, block_windows)
    return out.select(F.col(f"row.{doc_id}").alias("doc_id"), F.col("_n").alias("n_words"), F.col("_hit").alias("hit_words"), F.col("_items").alias("items"), F.array_sort("_spans").alias("spans"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows without a hit word, with the columns they came with. Null texts and, if the benchmark is empty, all rows stay."""
    return _scanned(docs, benchmark, text, item_id, item_text, size, block_windows).filter(F.size("_hit") == 0).select("row.*")
