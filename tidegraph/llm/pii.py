"""Personal data by a semi-Markov conditional random field over candidate segments.

Base spans (e-mail, IP, card and phone by fixed patterns) are always reported. Around every digit, `@` and `+` the text
is cut into tokens; whole candidate segments of up to MAX_TOKENS tokens that could be of a type are scored by features
of the whole span and its surroundings, and a dynamic program over segment ends picks boundaries and types together.
Text between segments scores zero. The weights maximise the conditional likelihood of sentences made here from rules.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import parts

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
MAX_TOKENS, MAX_CHARS = 24, 80  # the longest segment of the field; longer data is a base span or none

# The patterns of the base kinds.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@+]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds: leftmost, non-overlapping per kind, failing matches dropped."""
    out, floor = [], 0
    at = text.find("@")
    while at >= 0:  # the local part is the run before an @, so a text is walked once
        run = text[floor:at]
        start = floor + len(run.rstrip(LOCAL))
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    for m in _IP.finditer(text):
        if all(len(p := q.lstrip("0")) <= 3 and int(p or 0) <= 255 for q in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of text around anchors, widened to white space and for context; anchors 16 characters apart share one."""
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        i = m.start()
        if out and i - out[-1][1] <= 16:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    wide: list[tuple[int, int]] = []
    for a, b in out:
        low = max(text.rfind(" ", max(0, a - MAX_CHARS), a), text.rfind("\n", max(0, a - MAX_CHARS), a)) + 1
        ends = [e for e in (text.find(" ", b, b + MAX_CHARS), text.find("\n", b, b + MAX_CHARS)) if e >= 0]
        low, high = max(low, a - MAX_CHARS, 0), min(ends, default=min(len(text), b + MAX_CHARS))
        if wide and low <= wide[-1][1]:
            wide[-1] = (wide[-1][0], max(high, wide[-1][1]))
        else:
            wide.append((low, high))
    return wide


_CUES = {
    "email": re.compile(r"e-?mail|contact|write|reach", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|from|login", re.I),
    "card": re.compile(r"card|visa|master|credit|pay|paid", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobile|cell|ring", re.I),
    "ssn": re.compile(r"ssn|social", re.I),
    "iban": re.compile(r"iban|account|bank|transfer", re.I),
}
_SHAPES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9]){12,18}"),
    "phone": re.compile(r"\+?(\([0-9]{2,4}\)|[0-9]{1,4})([\x20.-]?(\([0-9]{2,4}\)|[0-9]{2,4})){1,5}"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,4})?"),
}


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(span: str) -> list[str]:
    """The types that a whole span could be of."""
    digits = sum(map(str.isdigit, span))
    if "@" in span:
        return ["email"] if span.count("@") == 1 and _SHAPES["email"].fullmatch(span) else []
    if digits < 4:
        return []
    out = []
    if span.count(".") == 3 and _SHAPES["ip"].fullmatch(span):
        out.append("ip")
    if 13 <= digits <= 19 and _SHAPES["card"].fullmatch(span):
        out.append("card")
    if 7 <= digits <= 15 and _SHAPES["phone"].fullmatch(span):
        out.append("phone")
    if digits == 9 and _SHAPES["ssn"].fullmatch(span):
        out.append("ssn")
    if span[:2].isalpha() and _SHAPES["iban"].fullmatch(span):
        out.append("iban")
    return out


def features(text: str, s: int, e: int, kind: str) -> list[str]:
    """Features of the whole span [s, e) as `kind`, with its neighbours and the words before it."""
    span = text[s:e]
    before, after = text[s - 1 : s], text[e : e + 1]
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    f = [f"{kind}:bias", f"{kind}:groups={min(len(groups), 7)}", f"{kind}:digits={min(sum(groups), 20)}"]
    if before.isalnum() or after.isalnum() or (before and before in "@+._/=$€#") or (after and after in "@/%"):
        f.append(f"{kind}:cut")
    if (before in "-.,:" and before and text[s - 2 : s - 1].isdigit()) or (after in "-.,:" and after and text[e + 1 : e + 2].isdigit()):
        f.append(f"{kind}:runs_on")
    if span[0] == "+":
        f.append(f"{kind}:plus")
    if "(" in span:
        f.append(f"{kind}:brackets")
    seps = {c for c in span if not c.isalnum()}
    f.append(f"{kind}:seps={''.join(sorted(seps))[:4]}")
    if kind == "card":
        f.append(f"card:luhn={luhn(''.join(c for c in span if c.isdigit()))}")
    elif kind == "iban":
        f.append(f"iban:check={_iban(span)}")
    elif kind == "ip":
        f.append(f"ip:octets={all(int(p) <= 255 for p in span.split('.'))}")
    elif kind == "email":
        f.append(f"email:tld={span.rpartition('.')[2].isalpha()}")
    elif kind == "phone":
        f += [f"phone:last={groups[-1]}", f"phone:first={groups[0]}"]
        if re.fullmatch(r"(19|20)[0-9]{2}[-. ][0-9]{1,2}[-. ][0-9]{1,2}|[0-9]{1,2}[-. ][0-9]{1,2}[-. ](19|20)?[0-9]{2}", span):
            f.append("phone:date")
    if _CUES[kind].search(text[max(0, s - 24) : s]):
        f.append(f"{kind}:cue")
    return f


def segments(text: str, low: int, high: int) -> tuple[list[int], list[tuple[int, int, str, list[str]]]]:
    """Token borders of text[low:high], and candidate segments (first border, last border, kind, features)."""
    marks = [low] + [m.end() for m in _TOKEN.finditer(text, low, high)]
    out = []
    for i in range(len(marks) - 1):
        first = text[marks[i]]
        if not (first.isalnum() or first in "+(._%-") or (i and first.isalnum() and text[marks[i] - 1].isalnum() and first.isdigit() == text[marks[i] - 1].isdigit()):
            continue
        digits = at = 0
        for j in range(i + 1, min(len(marks), i + MAX_TOKENS + 1)):
            token = text[marks[j - 1] : marks[j]]
            digits += len(token) if token[0].isdigit() else 0
            at += token == "@"
            if digits > 34 or at > 1 or token == "\n" or marks[j] - marks[i] > MAX_CHARS:
                break
            if token[-1].isalnum() and (at or digits >= 7 or digits >= 4 and token[0].isdigit()):
                for kind in candidates(text[marks[i] : marks[j]]):
                    out.append((i, j, kind, features(text, marks[i], marks[j], kind)))
    return marks, out


class Model:
    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, feats: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in feats)

    def best(self, text: str, low: int, high: int) -> list[tuple[int, int, str]]:
        """The best segmentation of a region: (start, end, kind) of its segments."""
        marks, segs = segments(text, low, high)
        if not segs:
            return []
        ending: dict[int, list[tuple[int, str, float]]] = {}
        for i, j, kind, feats in segs:
            if (s := self.score(feats)) > 0:
                ending.setdefault(j, []).append((i, kind, s))
        top, back = [0.0] * len(marks), [None] * len(marks)
        for j in range(1, len(marks)):
            top[j] = top[j - 1]
            for i, kind, s in ending.get(j, ()):
                if top[i] + s > top[j]:
                    top[j], back[j] = top[i] + s, (i, kind)
        out, j = [], len(marks) - 1
        while j > 0:
            if back[j]:
                i, kind = back[j]
                out.append((marks[i], marks[j], kind))
                j = i
            else:
                j -= 1
        return out[::-1]

    def gradient(self, text: str, truth: set[tuple[int, int, str]], low: int, high: int) -> dict[str, float]:
        """Observed minus expected feature counts of one region, by forward and backward sums over segments."""
        marks, segs = segments(text, low, high)
        n = len(marks)
        scores = [self.score(s[3]) for s in segs]
        starting: dict[int, list[int]] = {}
        ending: dict[int, list[int]] = {}
        for k, (i, j, _, _) in enumerate(segs):
            starting.setdefault(i, []).append(k)
            ending.setdefault(j, []).append(k)

        def add(values: list[float]) -> float:
            m = max(values)
            return m + math.log(sum(math.exp(v - m) for v in values))

        fore, back = [0.0] * n, [0.0] * n
        for j in range(1, n):
            fore[j] = add([fore[j - 1]] + [fore[segs[k][0]] + scores[k] for k in ending.get(j, ())])
        for i in range(n - 2, -1, -1):
            back[i] = add([back[i + 1]] + [back[segs[k][1]] + scores[k] for k in starting.get(i, ())])
        g: dict[str, float] = {}
        for (i, j, kind, feats), s in zip(segs, scores):
            d = ((marks[i], marks[j], kind) in truth) - math.exp(min(0.0, fore[i] + s + back[j] - fore[-1]))
            if abs(d) > 1e-6:
                for f in feats:
                    g[f] = g.get(f, 0.0) + d
        return g


def _sentence(rng: random.Random) -> tuple[str, set[tuple[int, int, str]]]:
    """A made sentence with personal data and look-alikes, and its true segments."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(("an", "re", "ti", "lo", "que", "der", "mi", "sh", "ou")) for _ in range(rng.randint(1, 4)))

    def card(k: int) -> str:
        body = rng.choice("3456") + digits(k - 2)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def iban() -> str:
        country, body = rng.choice(("DE", "FR", "ES", "GB")), digits(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{check:02d}{body}"

    def spaced(s: str, sep: str) -> str:
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    made = {
        "email": lambda: f"{word()}{rng.choice(('.', '_', ''))}{digits(rng.randint(0, 2))}{word()}@{word()}{digits(1)}.{rng.choice(('com', 'org', 'example.com', 'co.uk', 'fr'))}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": lambda: rng.choice((lambda s: s, lambda s: spaced(s, " "), lambda s: spaced(s, "-")))(card(rng.choice((13, 15, 16, 16, 16, 19)))),
        "phone": lambda: rng.choice((f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{rng.randint(20, 99)} {digits(3)} {digits(3)} {digits(3)}", f"+1-{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}")),
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "iban": lambda: rng.choice((lambda s: s, lambda s: spaced(s, " ")))(iban()),
    }
    decoys = (
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"${rng.randint(1, 99)},{digits(3)},{digits(3)}.{digits(2)}", lambda: digits(rng.randint(4, 18)), lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        lambda: f"{digits(3)} {digits(3)} {digits(3)}", lambda: f"{rng.randint(300, 999)}.{digits(3)}.{digits(3)}.{digits(3)}", lambda: f"{word()}@{word()}", lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}", lambda: f"{digits(4)}-{digits(4)}", lambda: f"{digits(10)}", lambda: f"#{digits(8)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{digits(5)} {digits(5)}",
    )
    cues = {"email": "email", "ip": "ip", "card": "card", "phone": "call", "ssn": "ssn", "iban": "iban"}
    text, truth = word(), set()
    for _ in range(rng.randint(1, 3)):
        text += "".join(f" {word()}" for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.6:
            kind = rng.choice(KINDS)
            text += f" {cues[kind]}" * (rng.random() < 0.4) + rng.choice((" ", ": ", " (")) if rng.random() < 0.7 else " "
            span = made[kind]()
            truth.add((len(text), len(text) + len(span), kind))
            text += span
        else:
            text += " " + rng.choice(decoys)()
        text += rng.choice(("", ",", ".", ""))
    return text + " " + word(), truth


@lru_cache(maxsize=4)
def trained(sentences: int = 500, epochs: int = 4, seed: int = 7) -> Model:
    """The model after stochastic gradient steps with a little L2, the same on each call."""
    rng = random.Random(seed)
    data = [_sentence(rng) for _ in range(sentences)]
    model = Model({})
    for epoch in range(epochs):
        rate = 0.5 / (1 + epoch)
        for text, truth in data:
            for low, high in regions(text):
                for f, d in model.gradient(text, truth, low, high).items():
                    w = model.weights.get(f, 0.0)
                    model.weights[f] = w + rate * (d - 0.002 * w)
    return model


def find(text: str | None, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, kind, end): the model adds those that overlap no base span. Null has none."""
    if not text or not _ANCHOR.search(text):
        return [], []
    base = base_spans(text)
    more, k = [], 0
    by_start = sorted((s, e) for s, _, e in base)
    reach = 0
    for low, high in regions(text):
        for s, e, kind in model.best(text, low, high):
            while k < len(by_start) and by_start[k][0] < e:
                reach = max(reach, by_start[k][1])
                k += 1
            if reach <= s:
                more.append((s, KINDS.index(kind), e))
    return base, sorted(base + more)


SPANS = "array<struct<start: int, kind: string, end: int>>"


def _spans(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    return pa.array([[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in x] for x in found], pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, base_spans and spans (start, kind, end; code points) per row. Null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model or trained()).weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(shared.value)
        for batch in parts(batches, 1):
            found = [find(t, m) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _spans([x[0] for x in found]), _spans([x[1] for x in found])], names=["doc_id", "base_spans", "spans"])

    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, base_spans {SPANS}, spans {SPANS}")


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span, or run of overlapping spans, as [KIND] of its first."""
    if not spans:
        return text
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", model: Model | None = None) -> DataFrame:
    """docs with personal data masked; n_chars, if there, is counted again."""
    shared = docs.sparkSession.sparkContext.broadcast((model or trained()).weights)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(shared.value)
        for batch in parts(batches, 1):
            new = [masked(t, find(t, m)[1]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["row", "t"])

    def column(c: str):
        if c == text:
            return F.col("t").alias(c)
        return F.length("t").cast(dict(docs.dtypes)[c]).alias(c) if c == n_chars else F.col(f"row.`{c}`").alias(c)

    return d.mapInArrow(run, d.schema).select(*[column(c) for c in docs.columns])
