"""Chunking of JSON, text and messages, key counts, and covering subsets; greedy packing is sequential, so Python."""

from __future__ import annotations

import itertools
import json
import random
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

CHARS_A_TOKEN = 4


def _pack(parts: list[str], size: int, overlap: int, sep: str, split: Callable[[str], list[str]]) -> list[str]:
    """Parts joined greedily up to `size` characters; each chunk begins with the last parts of the one before, up to `overlap`."""
    out, now = [], []
    length = lambda xs: sum(map(len, xs)) + len(sep) * max(0, len(xs) - 1)
    for part in itertools.chain.from_iterable([p] if len(p) <= size else split(p) for p in parts):
        if now and length([*now, part]) > size:
            out.append(sep.join(now))
            tail: list[str] = []
            for x in reversed(now):
                if length([x, *tail]) > overlap or length([x, *tail, part]) > size:
                    break
                tail.insert(0, x)
            now = tail
        now.append(part)
    return [*out, sep.join(now)] if now else out


def by_size(text: str, size: int, overlap: int) -> list[str]:
    """Fixed size, cut at blanks where there are some; the next chunk starts `overlap` characters before the cut."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text) and (blank := text.rfind(" ", at + 1, end)) > at + size // 2:
            end = blank
        out.append(text[at:end].strip())
        at = end if end >= len(text) else max(end - overlap, at + 1)
    return [x for x in out if x]


def by_sentence(text: str, size: int, overlap: int) -> list[str]:
    return _pack([s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s], size, overlap, " ", lambda p: by_size(p, size, overlap))


def text_chunks(text: str, tokens: int, overlap: int) -> list[str]:
    """Paragraphs packed up to a size; long ones by sentence, then by size. A short text is one chunk."""
    size, over = tokens * CHARS_A_TOKEN, overlap * CHARS_A_TOKEN
    if len(text) <= size:
        return [text]
    return _pack([p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()], size, over, "\n\n", lambda p: by_sentence(p, size, over))


def _elements(items: list[str], size: int, overlap: int, wrap: str) -> list[str]:
    return [f"{wrap[0]}{c}{wrap[1]}" for c in _pack(items, size, overlap, ", ", lambda p: [p])]


def json_chunks(content: str, tokens: int, overlap: int) -> list[str]:
    """An array by elements, an object by keys, each chunk valid JSON of its kind; anything else as text."""
    size, over = tokens * CHARS_A_TOKEN, overlap * CHARS_A_TOKEN
    try:
        data = json.loads(content)
    except ValueError:
        return text_chunks(content, tokens, overlap)
    if len(content) <= size or not isinstance(data, (list, dict)) or not data:
        return [content]
    if isinstance(data, list):
        return _elements([json.dumps(x, ensure_ascii=False) for x in data], size, over, "[]")
    return _elements([f"{json.dumps(k, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False)}" for k, v in data.items()], size, over, "{}")


def message_chunks(content: str, tokens: int, overlap: int) -> list[str]:
    """Messages kept whole: a JSON array, `Speaker: text` turns, else lines."""
    size, over = tokens * CHARS_A_TOKEN, overlap * CHARS_A_TOKEN
    if len(content) <= size:
        return [content]
    try:
        if isinstance(json.loads(content), list):
            return json_chunks(content, tokens, overlap)
    except ValueError:
        pass
    turns = [t for t in re.split(r"\n(?=[^\n:]{1,40}: )", content) if t.strip()]
    parts = turns if len(turns) > 1 else [x for x in content.split("\n") if x.strip()]
    return _pack(parts, size, over, "\n", lambda p: by_size(p, size, over))


KINDS = {"text": text_chunks, "json": json_chunks, "message": message_chunks}


def chunks_udf(kind: str = "text", tokens: int = 3000, overlap: int = 200):
    """A batched function from content to its chunks; null gives none."""
    cut = KINDS[kind]

    @F.pandas_udf("array<string>")
    def chunks(s: pd.Series) -> pd.Series:
        return s.map(lambda x: cut(x, tokens, overlap) if x else [])

    return chunks


def key_count(data, depth: int = 2) -> int:
    """Keys of nested objects down to a depth; arrays are looked through, as a level."""
    if depth <= 0:
        return 0
    if isinstance(data, dict):
        return len(data) + sum(key_count(v, depth - 1) for v in data.values())
    return sum(key_count(v, depth) for v in data) if isinstance(data, list) else 0


def key_count_udf(depth: int = 2):
    def one(s):
        try:
            return key_count(json.loads(s), depth) if s else 0
        except ValueError:
            return 0

    @F.pandas_udf("bigint")
    def count(s: pd.Series) -> pd.Series:
        return s.map(one).astype("int64")

    return count


def json_dense(content: str, threshold: float = 0.15) -> bool:
    """Whether a JSON text has many elements or keys for its size."""
    data = json.loads(content)
    n = len(data) if isinstance(data, list) else key_count(data, 2)
    return n / max(1, len(content) // CHARS_A_TOKEN) * (100 if isinstance(data, list) else 50) / 100 > threshold


def covering(items: list, k: int, seed: int = 0, most: int = 1000) -> list[list]:
    """Subsets of k items such that each pair is in one; greedy over all subsets, or over a seeded sample if there are many."""
    import math

    if len(items) <= k:
        return [list(items)]
    index = range(len(items))
    left = {frozenset(p) for p in itertools.combinations(index, 2)}
    rng, out = random.Random(seed), []
    every = [c for c in itertools.combinations(index, k)] if math.comb(len(items), k) <= most else None
    while left:
        if every is not None:
            best = max(every, key=lambda c: sum(frozenset(p) in left for p in itertools.combinations(c, 2)))
        else:
            start = set(min(left, key=sorted))  # grown from an uncovered pair by what covers most
            while len(start) < k:
                rest = [i for i in index if i not in start]
                rng.shuffle(rest)
                start.add(max(rest, key=lambda i: sum(frozenset((i, j)) in left for j in start)))
            best = tuple(sorted(start))
        left -= {frozenset(p) for p in itertools.combinations(best, 2)}
        out.append([items[i] for i in best])
    return out
