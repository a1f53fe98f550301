"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and stored as sorted hash arrays.

Words are 63-bit hashes; a word's number is its place among the sorted hashes, so a bigram is one 64-bit key of two
numbers and a longer n-gram a 63-bit hash of its words' numbers. Workers pre-aggregate keys in chunks; one exchange deals them by ranges of the key that hold equal shares of
the tokens, tasks sort and sum them and write arrays into the shared folder. Scorers map these files into memory and
look up each batch's distinct keys in sorted order. The driver sees one row a file, never a key.

The order is a parameter of two or more. Texts begin with order - 1 marks; the longest n-grams are counted as they come, each
shorter one by the kinds of words before it. Longer n-grams are nearly all distinct, so arrays grow with the order.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import ODD, mix, runs
from .util import fresh_path, parts

CHUNK_TOKENS = 2_000_000
TOKENS_A_SHARD = 4_000_000
OPEN_SHARDS = 64  # of one array that a worker has mapped at a time
MOST_WORDS = (1 << 31) - 2  # distinct words whose numbers fit into half a key
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = int(mix(np.array([0x5EED], dtype=np.uint64))[0] >> np.uint64(1))


def tokens(text: str | None) -> np.ndarray:
    """The hashes of a text's words, A-Z lower-cased, and then the end."""
    flat = b" ".join((text or "").encode("utf-8", "replace").translate(_FOLD).split())
    if not flat:
        return np.array([END], dtype=np.int64)
    return np.concatenate(((runs(flat, 1) >> np.uint64(1)).astype(np.int64), [END]))


@dataclass
class Shards:
    """Files of one sorted array (keys, and values beside them), in the order of their keys."""

    folder: str
    files: list[tuple[str, int, int, int]]  # name, rows, least key, sum of the first column
    columns: tuple[str, ...]
    running: bool = False  # whether running sums of the first column lie beside it

    def rows(self) -> int:
        return sum(f[1] for f in self.files)

    def open(self) -> "Mapped":
        return Mapped(self)


class Mapped:
    """Shards mapped into memory; values are read for keys asked in any order."""

    def __init__(self, shards: Shards):
        self.names = shards.columns
        self.first = np.array([f[2] for f in shards.files], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum([f[1] for f in shards.files]))).astype(np.int64)
        self.shards = shards
        self.maps: OrderedDict[int, dict[str, np.ndarray]] = OrderedDict()
        self.before = np.concatenate(([0], np.cumsum([f[3] for f in shards.files]))) if shards.running else None

    def shard(self, s: int) -> dict[str, np.ndarray]:
        """The arrays of one shard; of OPEN_SHARDS mapped ones the one that was asked for longest ago is closed for it."""
        if s not in self.maps:
            if len(self.maps) >= OPEN_SHARDS:
                self.maps.popitem(last=False)
            name, n = self.shards.files[s][:2]
            files = ("key", *self.names, *(["sum"] if self.shards.running else []))
            self.maps[s] = {c: np.memmap(f"{self.shards.folder}/{name}.{c}", dtype=np.int64, mode="r", shape=(n,)) for c in files}
        self.maps.move_to_end(s)
        return self.maps[s]

    def masses(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of the first column before each place, and its value there; both read from the mapped files."""
        asked, back = np.unique(places, return_inverse=True)
        shard = np.searchsorted(self.starts, asked, side="right") - 1
        less, own = np.zeros(len(asked)), np.zeros(len(asked))
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            if s >= len(self.shards.files):
                less[at] = self.before[-1]
                continue
            m, pos = self.shard(s), asked[at] - self.starts[s]
            own[at] = m[self.names[0]][pos]
            less[at] = self.before[s] + m["sum"][pos] - own[at]
        return less[back], own[back]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of each key its place in the whole array (-1: none) and its values (0: none)."""
        asked, back = np.unique(keys, return_inverse=True)
        place = np.full(len(asked), -1, dtype=np.int64)
        out = [np.zeros(len(asked), dtype=np.int64) for _ in self.names]
        if len(self.first) and len(asked):
            shard = np.searchsorted(self.first, asked, side="right") - 1
            for s in np.unique(shard[shard >= 0]):
                own = np.flatnonzero(shard == s)
                m = self.shard(s)
                at = np.searchsorted(m["key"], asked[own])
                ok = at < len(m["key"])
                ok[ok] = m["key"][at[ok]] == asked[own][ok]
                own, at = own[ok], at[ok]
                place[own] = self.starts[s] + at
                for o, c in zip(out, self.names):
                    o[own] = m[c][at]
        return place[back], [o[back] for o in out]


def _local(path: str) -> str:
    """The shared folder as a path that workers can map."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"{path}: the model's arrays need a shared folder that is mounted on every machine")
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _summed(keys: np.ndarray, values: np.ndarray, fixed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their rows of values; the last `fixed` columns follow from the key and are kept."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sums = values.shape[1] - fixed
    return keys[at], np.concatenate((np.add.reduceat(values[:, :sums], at, axis=0), values[at, sums:]), axis=1)


def write_shards(parts: DataFrame, shards: int, spark_path: str, columns: tuple[str, ...], running: bool = False, fixed: int = 0) -> Shards:
    """Rows (pid, key, *columns) summed by key, but for the last `fixed` columns, into `shards` sorted files; pid must not
    fall as the key grows."""
    folder = _local(spark_path)
    dealt = parts.repartitionById(shards, F.col("pid")).sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        task = TaskContext.get()
        name, n, least, kept, out, total = f"{columns[0]}-{task.partitionId():05d}-{task.taskAttemptId()}", 0, None, None, {}, 0
        os.makedirs(folder, exist_ok=True)
        try:
            for batch in batches:
                k = batch.column(1).to_numpy()
                v = np.stack([batch.column(2 + i).to_numpy() for i in range(len(columns))], axis=1)
                if kept:
                    k, v = np.concatenate((kept[0], k)), np.concatenate((kept[1], v))
                k, v = _summed(k, v, fixed)
                if not len(k):
                    continue
                kept, k, v = (k[-1:], v[-1:]), k[:-1], v[:-1]  # the last key may go on
                least = least if least is not None else int(k[0] if len(k) else kept[0][0])
                n += _append(out, folder, name, columns, k, v, total if running else None)
                total += int(v[:, 0].sum())
            if kept:
                n += _append(out, folder, name, columns, *kept, total if running else None)
        finally:
            for f in out.values():
                f.close()
        if n:
            total += int(kept[1][:, 0].sum()) if kept else 0
            yield pa.RecordBatch.from_pydict({"name": [name], "n": pa.array([n], pa.int64()), "least": pa.array([least], pa.int64()), "total": pa.array([total], pa.int64())})

    rows = dealt.select("pid", "key", *columns).mapInArrow(run, "name string, n bigint, least bigint, total bigint").collect()
    return Shards(folder, sorted([(r.name, r.n, r.least, r.total) for r in rows], key=lambda r: r[2]), columns, running)


def _append(out: dict, folder: str, name: str, columns: tuple[str, ...], k: np.ndarray, v: np.ndarray, total: int | None) -> int:
    arrays = {"key": k} | {c: v[:, i] for i, c in enumerate(columns)} | ({} if total is None else {"sum": np.cumsum(v[:, 0]) + total})
    for c, a in arrays.items():
        if c not in out:
            out[c] = open(f"{folder}/{name}.{c}", "wb")
        np.ascontiguousarray(a, dtype=np.int64).tofile(out[c])
    return len(k)


def _rows(pid: np.ndarray, keys: np.ndarray, values: np.ndarray, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(keys), 65536):
        cut = slice(lo, lo + 65536)
        yield pa.RecordBatch.from_pydict({"pid": pa.array(pid[cut].astype(np.int32)), "key": pa.array(keys[cut])} | {c: pa.array(values[cut, i]) for i, c in enumerate(columns)})


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Token arrays of texts, about CHUNK_TOKENS at a time."""
    held, n = [], 0
    for batch in parts(batches, 0):
        for t in batch.column(0).to_pylist():
            held.append(tokens(t))
            n += len(held[-1])
            if n >= CHUNK_TOKENS:
                yield held
                held, n = [], 0
    if held:
        yield held


def _windows(ids: np.ndarray, sizes: np.ndarray, begin: int, order: int) -> np.ndarray:
    """A row a token: the order - 1 words before it in its text, marks where the text begins, and the word itself."""
    at = np.arange(len(ids)) + (order - 1) * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded = np.full(len(ids) + (order - 1) * len(sizes), begin, dtype=np.int64)
    padded[at] = ids
    return np.stack([padded[at - back] for back in range(order - 1, -1, -1)], axis=1)


def _keys(words: np.ndarray) -> np.ndarray:
    """One key for each row of words' numbers: of two words both numbers, of more a 63-bit hash; -1 where a word is unknown."""
    out = (words[:, 0] << 32) | words[:, 1]
    if words.shape[1] > 2:
        h = out.astype(np.uint64)
        for c in range(2, words.shape[1]):
            h = mix(h * ODD + words[:, c].astype(np.uint64) + np.uint64(1))
        out = (h >> np.uint64(1)).astype(np.int64)
    unknown = words[:, 0] < 0
    for c in range(1, words.shape[1]):
        unknown |= words[:, c] < 0
    out[unknown] = -1
    return out


def _packed(words: np.ndarray) -> np.ndarray:
    """Words' numbers, two to a column."""
    if words.shape[1] % 2:
        words = np.concatenate((words, np.zeros((len(words), 1), np.int64)), axis=1)
    return (words[:, 0::2] << 32) | words[:, 1::2]


def _unpacked(packed: np.ndarray, n: int) -> np.ndarray:
    return np.stack((packed >> 32, packed & 0xFFFFFFFF), axis=2).reshape(len(packed), -1)[:, :n]


def _share(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of keys that are hashes of 63 bits."""
    return (keys.astype(np.float64) / 2.0**63 * shards).astype(np.int64).clip(0, shards - 1)


FOLLOWERS = ("total", "one", "two", "more")  # of a context: the sum of counts after it, and words by their count


def _followers(n: np.ndarray) -> np.ndarray:
    return np.stack((n, n == 1, n == 2, n > 2), axis=1).astype(np.int64)


def _types(columns: tuple[str, ...]) -> str:
    return "pid int, key bigint, " + ", ".join(f"{c} bigint" for c in columns)


def _each(shards: Shards, *, of: tuple[str, ...]) -> Iterator:
    """A function over batches of shard numbers that yields their arrays of these columns, CHUNK_TOKENS rows at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        opened = shards.open()
        for batch in batches:
            for s in batch.column(0).to_pylist():
                if s < len(shards.files):
                    m = opened.shard(s)
                    for lo in range(0, len(m["key"]), CHUNK_TOKENS):
                        yield [np.asarray(m[c][lo : lo + CHUNK_TOKENS]) for c in of]

    return read


@dataclass
class Level:
    """N-grams of three words or more: their counts, the followers of their contexts, and the discounts."""

    grams: Shards
    stats: Shards
    discounts: tuple[float, float, float]


@dataclass
class Model:
    """Word hashes and counts, bigram keys and counts, and per word: total and kinds of followers, kinds of predecessors;
    then a level for each longer order, from three words on."""

    words: Shards
    pairs: Shards
    stats: Shards
    train_tokens: int
    distinct: int
    documents: int
    discounts: tuple[tuple[float, float, float], tuple[float, float, float]]
    kinds: tuple[int, int, int]  # words that follow one, two, more kinds of words
    higher: list[Level]


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts one, two and more, from the numbers of counts one to four."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    out = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.0), float(i + 1)) for i, d in enumerate(out))


def train(docs: DataFrame, text: str = "text", order: int = 2) -> Model:
    """Counts all rows of docs; null texts count as empty, repeated rows as often as they come. An order below two is an error."""
    if order < 2:
        raise ValueError(f"order {order}; the least is 2")
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{text}`").alias("text"))
    size = d.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = int(max(spark.sparkContext.defaultParallelism * 2, size[1] // (6 * TOKENS_A_SHARD) + 1))
    root = fresh_path(spark, "lm")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            k, n = np.unique(np.concatenate(chunk), return_counts=True)
            yield from _rows(_share(k, shards), k, n[:, None], ("n",))

    words = write_shards(d.mapInArrow(count_words, "pid int, key bigint, n bigint"), shards, f"{root}/words", ("n",), running=True)
    distinct = words.rows()
    if distinct > MOST_WORDS:
        raise ValueError(f"{distinct} distinct words; pairs of the numbers of {MOST_WORDS} fit into one key")
    begin = distinct  # the number that stands before a text's first word

    def dealt(known: Mapped, keys: np.ndarray, length: int) -> np.ndarray:
        return _shard(keys, known, shards, begin) if length == 2 else _share(keys, shards)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.open()
        for chunk in _chunks(batches):
            ids, _ = known.find(np.concatenate(chunk))
            w = _windows(ids, np.array([len(c) for c in chunk]), begin, order)
            k, v = _distinct(w)
            yield from _rows(dealt(known, k, order), k, v, _columns(order))

    grams = write_shards(d.mapInArrow(count, _types(_columns(order))), shards, f"{root}/grams-{order}", _columns(order), fixed=len(_columns(order)) - 1)
    levels: list[tuple[Shards, Shards]] = []
    for length in range(order, 2, -1):
        each = _numbers(spark, grams)
        read = _each(grams, of=_columns(length))

        def contexts(batches: Iterator[pa.RecordBatch], read=read, length=length) -> Iterator[pa.RecordBatch]:
            known = words.open()
            for n, *packed in read(batches):
                k, v = _summed(_keys(_unpacked(np.stack(packed, axis=1), length)[:, :-1]), _followers(n))
                yield from _rows(dealt(known, k, length - 1), k, v, FOLLOWERS)

        def shorter(batches: Iterator[pa.RecordBatch], read=read, length=length) -> Iterator[pa.RecordBatch]:
            known = words.open()
            for _, *packed in read(batches):
                k, v = _distinct(_unpacked(np.stack(packed, axis=1), length)[:, 1:])
                yield from _rows(dealt(known, k, length - 1), k, v, _columns(length - 1))

        stats = write_shards(each.mapInArrow(contexts, _types(FOLLOWERS)), shards, f"{root}/followers-{length}", FOLLOWERS)
        less = _columns(length - 1)
        below = write_shards(each.mapInArrow(shorter, _types(less)), shards, f"{root}/grams-{length - 1}", less, fixed=len(less) - 1)
        levels.insert(0, (replace(grams, columns=("n",)), stats))
        grams = below
    pairs = grams
    names = (*FOLLOWERS, "before")

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, n in _each(pairs, of=("key", "n"))(batches):
            zero = np.zeros((len(n), 1), np.int64)
            a = _summed(k >> 32, np.concatenate((_followers(n), zero), axis=1))
            b = _summed(k & 0xFFFFFFFF, np.concatenate((np.repeat(zero, 4, axis=1), zero + 1), axis=1))
            key, v = _summed(np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1])))
            yield from _rows(key * shards // (distinct + 1), key, v, names)

    stats = write_shards(_numbers(spark, pairs).mapInArrow(kinds, _types(names)), shards, f"{root}/stats", names)
    (of_pairs, of_words, *more) = _tally(spark, [(pairs, "n"), (stats, "before"), *((g, "n") for g, _ in levels)])
    higher = [Level(g, f, _discounts(t[:4])) for (g, f), t in zip(levels, more)]
    return Model(words, pairs, stats, sum(f[3] for f in words.files), distinct, size[0], (_discounts(of_pairs[:4]), _discounts(of_words[:4])), (of_words[0], of_words[1], of_words[4]), higher)


def _columns(length: int) -> tuple[str, ...]:
    """The count of an n-gram and, of three words or more, its words' numbers."""
    return ("n", *[f"w{i}" for i in range((length + 1) // 2)]) if length > 2 else ("n",)


def _distinct(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their values by _columns."""
    if words.shape[1] == 2:  # the words are in the key
        k, n = np.unique(_keys(words), return_counts=True)
        return k, n[:, None]
    k, at, n = np.unique(_keys(words), return_index=True, return_counts=True)
    return k, np.concatenate((n[:, None], _packed(words[at])), axis=1)


def _numbers(spark: SparkSession, *arrays: Shards) -> DataFrame:
    """The numbers of the shards, one to a task."""
    most = max(1, *[len(a.files) for a in arrays])
    return spark.range(0, most, 1, most)


def _tally(spark: SparkSession, arrays: list[tuple[Shards, str]]) -> list[list[int]]:
    """Of each array's column how many values are one, two, three, four, and more than two."""
    names = [f"c{i}" for i in range(5 * len(arrays))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [(a.open(), len(a.files), c) for a, c in arrays]
        for batch in batches:
            for s in batch.column(0).to_pylist():
                row = []
                for m, files, c in opened:
                    n = np.asarray(m.shard(s)[c]) if s < files else np.zeros(0, np.int64)
                    row += [(n == i).sum() for i in (1, 2, 3, 4)] + [(n > 2).sum()]
                yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in row], names=names)

    rows = _numbers(spark, *[a for a, _ in arrays]).mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
    sums = [int(x) for x in rows.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in names]).first()]
    return [sums[i : i + 5] for i in range(0, len(sums), 5)]


def _shard(keys: np.ndarray, known: Mapped, shards: int, begin: int) -> np.ndarray:
    """The shard of each sorted key, by the share of tokens that its first word, and its second within it, come after.

    The mark before a text's first word stands last and is as frequent as the end.
    """
    starts_n = float(known.find(np.array([END]))[1][0][0])
    tokens_n = float(known.before[-1])
    a, b = keys >> 32, keys & 0xFFFFFFFF
    less, own = known.masses(a)
    own = np.where(a == begin, starts_n, own)
    at = less + own * (known.masses(b)[0] / max(1.0, tokens_n))
    return np.minimum((at / max(1.0, tokens_n + starts_n) * shards).astype(np.int64), shards - 1)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """doc_id, `keep`, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) per row; a null text is empty, that is, its end."""
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *(keep or []), F.col(f"`{text}`").alias("_t"))
    own = d.columns[:-1]
    (d1, d2, d3), (e1, e2, e3) = model.discounts
    sum_kinds = model.pairs.rows()
    v = model.distinct

    def less(c: np.ndarray, one: float, two: float, more: float) -> np.ndarray:
        return c - np.select([c == 0, c == 1, c == 2], [0.0, one, two], more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, stats = model.words.open(), model.pairs.open(), model.stats.open()
        higher = [(level.grams.open(), level.stats.open(), level.discounts) for level in model.higher]
        left = (e1 * model.kinds[0] + e2 * model.kinds[1] + e3 * model.kinds[2]) / max(1, sum_kinds) if sum_kinds else 1.0
        for batch in parts(batches, len(own)):
            texts = [tokens(t) for t in batch.column(len(own)).to_pylist()]
            sizes = np.array([len(t) for t in texts])
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            ids, (c,) = words.find(np.concatenate(texts))
            w = _windows(ids, sizes, v, len(higher) + 2)
            before = w[:, -2]
            _, (n,) = pairs.find(_keys(w[:, -2:]))
            _, (total, one, two, more, _) = stats.find(before)
            _, (_, _, _, _, kinds_before) = stats.find(ids)
            low = less(kinds_before, e1, e2, e3) / max(1, sum_kinds) + left / (v + 1)
            p = np.where(total > 0, less(n, d1, d2, d3) / np.maximum(1, total) + (d1 * one + d2 * two + d3 * more) / np.maximum(1, total) * low, low)
            for length, (grams, after, (f1, f2, f3)) in enumerate(higher, 3):
                _, (n,) = grams.find(_keys(w[:, -length:]))
                _, (total, one, two, more) = after.find(_keys(w[:, -length:-1]))
                p = np.where(total > 0, less(n, f1, f2, f3) / np.maximum(1, total) + (f1 * one + f2 * two + f3 * more) / np.maximum(1, total) * p, p)
            base = np.log10((c + 0.5) / (model.train_tokens + 0.5 * (v + 1)))
            cols = {name: batch.column(k) for k, name in enumerate(own)}
            yield pa.RecordBatch.from_pydict(cols | {
                "n_tokens": pa.array(sizes.astype(np.int64)), "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), first)), "train_tokens": pa.array([model.train_tokens] * len(sizes), pa.int64()),
                "base_score": pa.array(np.add.reduceat(base, first)), "score": pa.array(np.add.reduceat(np.log10(p), first)),
            })

    from pyspark.sql.types import StructType

    return d.mapInArrow(run, StructType(d.schema.fields[:-1] + StructType.fromDDL("n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").fields))
