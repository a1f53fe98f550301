"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile is a list of the most frequent character 1- to 3-grams, most frequent first, ties by code points. Letters are
lower-cased, every run of other characters is one blank. A text is compared with each language's profile by how far each
of its own most frequent n-grams is from its place there; absent ones count as the whole length of a profile.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import parts

PROFILE = 400
BLANK = 32
FLUSH = 1_000_000
SALTS = 8
MAX_LANGUAGES = 2000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank if it is no letter."""
    table = np.full(0x110000, BLANK, dtype=np.int64)
    for cp in range(0x110000):
        if (c := chr(cp)).isalpha():
            table[cp] = ord(c.lower()[0])
    return table


def grams(text: str | None) -> np.ndarray:
    """All n-grams of one text as numbers of 21 bits a character; empty if it has no letter."""
    a = folding()[np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype="<u4")]
    blank = a == BLANK
    if blank.all():
        return np.empty(0, np.int64)
    a = np.concatenate(([BLANK], a, [BLANK]))
    blank = a == BLANK
    a = a[np.concatenate(([True], ~(blank[1:] & blank[:-1])))]
    two = (a[:-1] << 21) | a[1:]
    return np.concatenate((a[a != BLANK], two, (two[:-1] << 21) | a[2:]))


def ranked(values: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent values, most frequent first, ties by value."""
    return values[np.lexsort((values, -counts))[:size]]


class Profiles:
    """Languages' profiles, ready to be compared with."""

    def __init__(self, by_lang: dict[str, np.ndarray], size: int = PROFILE):
        self.size, self.langs = size, sorted(by_lang)
        self.sorted = []
        for lang in self.langs:
            order = np.argsort(by_lang[lang], kind="stable")
            self.sorted.append((by_lang[lang][order], order.astype(np.int64)))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language, as a share of the largest possible one."""
        place, out = np.arange(len(own)), []
        for values, ranks in self.sorted:
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            gone = values[at] != own
            out.append(np.where(gone, self.size, np.minimum(np.abs(ranks[at] - place), self.size)).sum())
        return np.array(out, dtype=np.float64) / (self.size * max(1, len(own)))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties: the first by name) and the share of the runner-up in the two distances."""
        g = grams(text)
        if not len(g) or not self.langs:
            return UNKNOWN, 0.0
        d = self.distances(ranked(*np.unique(g, return_counts=True), self.size))
        best = int(np.argmin(d))
        if len(d) == 1:
            return self.langs[0], float(1 - d[0])
        second = float(np.delete(d, best).min())
        return self.langs[best], second / (second + d[best]) if second else 0.5


def train(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles of all languages named in docs, counted over all its rows; rows without text or language teach nothing.

    Tasks count by language and send on sums; each language's counts are dealt over SALTS groups to be ranked, and the
    driver gets SALTS * size rows a language at most.
    """
    d = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def merged(parts):
            v, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return v, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        def rows():
            for name, parts in kept.items():
                v, n = merged(parts)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(v), pa.string()), "gram": pa.array(v), "n": pa.array(n)})

        for batch in parts(batches, 1):
            by: dict[str, list[np.ndarray]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(name, []).append(grams(t))
            for name, found in by.items():
                v, n = np.unique(np.concatenate(found), return_counts=True)
                kept.setdefault(name, []).append((v, n))
                held += len(v)
            if held > FLUSH:
                kept = {name: [merged(parts)] for name, parts in kept.items()}
                held = sum(len(p[0][0]) for p in kept.values())
                if held > FLUSH // 2:
                    yield from rows()
                    kept, held = {}, 0
        yield from rows()

    sums = d.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    dealt = sums.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    by_count = Window.partitionBy("lang", "salt").orderBy(F.desc("n"), "gram")
    best = dealt.withColumn("r", F.row_number().over(by_count)).filter(F.col("r") <= size).select("lang", "gram", "n").toArrow().to_pydict()
    out: dict[str, list[tuple[int, int]]] = {}
    for name, g, n in zip(best["lang"], best["gram"], best["n"]):
        out.setdefault(name, []).append((g, n))
    if len(out) > MAX_LANGUAGES:
        raise ValueError(f"{len(out)} languages; profiles of {MAX_LANGUAGES} fit into a broadcast")
    return {name: ranked(np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), size) for name, rows in out.items()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text", size: int = PROFILE, keep: list[Column] | None = None) -> DataFrame:
    """doc_id, `keep`, lang_pred and score per row; `und` and 0 where the text is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast((profiles, size))
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *(keep or []), F.col(f"`{text}`").alias("_t"))
    own = d.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Profiles(*shared.value)
        for batch in parts(batches, len(own)):
            got = [p.predict(t) for t in batch.column(len(own)).to_pylist()]
            cols = {c: batch.column(k) for k, c in enumerate(own)}
            yield pa.RecordBatch.from_pydict(cols | {"lang_pred": pa.array([x[0] for x in got], pa.string()), "score": pa.array([x[1] for x in got], pa.float64())})

    from pyspark.sql.types import StructType

    return d.mapInArrow(run, StructType(d.schema.fields[:-1] + StructType.fromDDL("lang_pred string, score double").fields))
