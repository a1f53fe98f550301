"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Voters are lexicons and patterns (fixed lists of insults in groups, insults aimed at someone, shouting, density, and
lexicons learned from labelled training rows). The label model estimates each voter's accuracy by expectation
maximisation over the counts of vote patterns of all documents, and the voters' correlations given the label, by which
dependent voters share their say. A logistic regression on word and voter features then learns the posteriors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import drop, parts, split_by, stored

SAMPLE_ROWS = 20_000  # bound of the rows that the classifier is fitted on
LEARNED_WORDS = 300  # size of either learned lexicon
ABSTAIN, CLEAN, TOXIC = 0, 1, 2

# Common English insults, in groups that vote separately.
LEXICONS = {
    "wits": "idiot idiots idiotic moron morons moronic stupid dumb fool imbecile dimwit halfwit brainless",
    "filth": "trash garbage scum filth filthy vermin rubbish scumbag",
    "worth": "worthless pathetic loser losers useless failure nobody",
    "disgust": "disgusting hateful repulsive revolting sickening",
    "mockery": "clown clowns joke freak weirdo creep jerk",
}
_INSULT = {w for ws in LEXICONS.values() for w in ws.split()}
_WORD = re.compile(r"[^\W\d_]+")
_AIMED = re.compile(r"\b(?:you|your|they|he|she|this)\W+(?:\w+\W+){0,3}?(?:" + "|".join(sorted(_INSULT)) + r")\b", re.I)
STEM_CHARS = (8, 7, 6, 5, 4)
LEAST_G, PRECISION = 50.0, 20  # log-likelihood ratio against chance, and toxic to clean rows, of what is learned
STEM_WORDS = 8  # words that a stem must begin, so that it is more than one word's beginning
VOTERS = (*LEXICONS, "aimed", "shouting", "density", "learned_words", "learned_stems", "none")
N_WORDS_SCALE = 100.0


@dataclass
class Lexicon:
    """Learned words and word beginnings (stems of STEM_CHARS characters; two at least, and more than chance brings, count) with their log-likelihood ratios."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    clean_rate: float = 0.0  # stems among the words of clean rows

    def __post_init__(self):
        self.starts = {x[:4] for x in self.stems}


def found(text: str | None, lexicon: Lexicon) -> tuple[list[int], dict[str, int], int]:
    """Votes by voter, counts of known words and stems (as `stem*`), and the number of words of a whole text."""
    text = text or ""
    words = _WORD.findall(text.lower())
    known, stems = lexicon.words, lexicon.stems
    counts: dict[str, int] = {}
    hits: dict[str, int] = {}
    starts = lexicon.starts
    for w in words:
        if w in _INSULT or w in known:
            counts[w] = counts.get(w, 0) + 1
        if stems and w[:4] in starts:
            for k in STEM_CHARS:
                if w[:k] in stems:
                    hits[f"{w[:k]}*"] = hits.get(f"{w[:k]}*", 0) + 1
                    break
    n = sum(hits.values())
    if n >= 2 and n >= 2 + 4 * lexicon.clean_rate * len(words):
        counts |= hits
    insults = sum(n for w, n in counts.items() if w in _INSULT)
    votes = [TOXIC if any(w in counts for w in ws.split()) else ABSTAIN for ws in LEXICONS.values()]
    aimed = insults and _AIMED.search(text)
    votes.append(TOXIC if aimed else ABSTAIN)
    votes.append(TOXIC if insults and any(w.isupper() and w.lower() in _INSULT for w in _WORD.findall(text)) else ABSTAIN)
    votes.append(TOXIC if insults >= 2 and insults * 500 >= len(words) else ABSTAIN)
    quiet = CLEAN if not counts else ABSTAIN
    votes.append(TOXIC if any(w in known for w in counts) else ABSTAIN)
    votes.append(TOXIC if any(w[-1] == "*" for w in counts) else ABSTAIN)
    votes.append(quiet)
    return votes, counts, len(words)


class LabelModel:
    """Class prior, vote probabilities by voter and class, and how much each voter's say is shared with others."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 40):
        k = patterns.shape[1]
        seen = np.stack([patterns == v for v in (ABSTAIN, CLEAN, TOXIC)], axis=2).astype(float)  # pattern, voter, vote
        w = counts / max(1.0, counts.sum())
        score = seen[:, :, TOXIC].sum(axis=1) - seen[:, :, CLEAN].sum(axis=1)
        q = np.where(score > 0, 0.9, np.where(score < 0, 0.05, 0.2))
        self.share = np.ones(k)
        for step in range(rounds):
            self.prior = float(np.clip((w * q).sum(), 0.01, 0.6))
            self.log = []
            for c in (1 - q, q):
                n = np.einsum("p,pkv->kv", w * c, seen) + 1e-3
                self.log.append(np.log(n / n.sum(axis=1, keepdims=True)))
            if step == rounds // 2:  # correlation of votes beyond what the label explains
                signed = seen[:, :, TOXIC] - seen[:, :, CLEAN]
                rest = signed - sum(c[:, None] * ((w * c) @ signed / max(1e-9, (w * c).sum())) for c in (1 - q, q))
                cov = (rest * w[:, None]).T @ rest
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
                self.correlation = cov / np.outer(sd, sd)
                self.share = 1 / np.maximum(1, np.clip(self.correlation, 0, 1).sum(axis=1) - 1e-9)
            q = self.posterior(patterns)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(toxic | votes)."""
        at = np.arange(patterns.shape[1])
        clean = np.log(1 - self.prior) + (self.share * self.log[0][at, patterns]).sum(axis=1)
        toxic = np.log(self.prior) + (self.share * self.log[1][at, patterns]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(clean - toxic, -50, 50)))


def _features(votes: list[int], counts: dict[str, int], n: int, vocabulary: dict[str, int]) -> tuple[list[int], list[float]]:
    """Sparse features: intercept, voters for and against, insults a hundred words, known words (log counts)."""
    k = len(VOTERS)
    at, x = [0], [1.0]
    for i, v in enumerate(votes):
        if v != ABSTAIN:
            at.append(1 + i)
            x.append(1.0 if v == TOXIC else -1.0)
    insults = sum(c for w, c in counts.items() if w in _INSULT)
    if insults:
        at += [1 + k, 2 + k]
        x += [min(3.0, N_WORDS_SCALE * insults / max(1, n)), float(np.log1p(insults))]
    for w, c in counts.items():
        if w in vocabulary:
            at.append(3 + k + vocabulary[w])
            x.append(float(np.log1p(c)))
    return at, x


def _rows(docs: DataFrame, doc_id: str, text: str, own: Column) -> DataFrame:
    """(doc_id, text, hash of the text, own)."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.coalesce(F.xxhash64(F.col(f"`{text}`")), F.lit(0)).alias("h"), own.alias("own"))


def _only(d: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of d that are among chosen (doc_id, h, n, toxic), each text once; only texts that may be among them move."""
    key = lambda i, h: F.xxhash64(F.coalesce(F.col(i).cast("string"), F.lit("")), F.col(h))
    c = chosen.select(F.col("doc_id").alias("_i"), F.col("h").alias("_h"), "n", "toxic")
    may, _ = split_by(d, key("doc_id", "h"), c.select(key("_i", "_h").alias("k")))
    got = may.join(c, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_i"))).select("text", "h", "n", "toxic")
    return got.filter("n = 1").unionByName(got.filter("n > 1").dropDuplicates(["h"])).select("text", "toxic")


def _distinct_rows(d: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(text, toxic) of each distinct text among the rows of d that may be learned from and are labelled, once, with its
    largest label; without labels, of all such rows. Which row stands for a text is decided on ids and hashes alone."""
    light = d.filter("own").groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    light = light.withColumn("toxic", F.lit(0)) if labels is None else light.join(labels, "doc_id")
    first = light.groupBy("h").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "n")).alias("f"), F.max("toxic").alias("toxic"))
    return _only(d.filter("own"), first.select("f.doc_id", "h", "f.n", "toxic"))


def _sampled(d: DataFrame, bound: int) -> DataFrame:
    """`bound` distinct texts at most of the rows that may be learned from, the first by a hash of the text's hash."""
    light = d.filter("own").groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    first = light.groupBy("h").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "n")).alias("f"))
    chosen = first.select("f.doc_id", "h", "f.n", F.lit(0).alias("toxic")).orderBy(F.xxhash64(F.lit("fit"), "h"), "h").limit(bound)
    return _only(d.filter("own"), stored(chosen, "fit"))


def learn_lexicon(labelled: DataFrame, size: int = LEARNED_WORDS) -> Lexicon:
    """Words of all rows (text, toxic) whose share of toxic rows differs most from the rest's, by the log-likelihood ratio;
    those whose ratio is no significant one are not learned. Null labels don't come here; null texts have no word."""
    labelled = stored(labelled, "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}
        for batch in parts(batches, 0):
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in set(_WORD.findall((t or "").lower())):
                    sums.setdefault(w, [0, 0])[1 if y else 0] += 1
            if len(sums) > 500_000:
                yield pa.RecordBatch.from_pydict({"w": pa.array(list(sums), pa.string()), "c": [x[0] for x in sums.values()], "t": [x[1] for x in sums.values()]})
                sums = {}
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(sums), pa.string()), "c": pa.array([x[0] for x in sums.values()], pa.int64()), "t": pa.array([x[1] for x in sums.values()], pa.int64())})

    both = labelled.agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.count("*")).first()
    toxic = both[0] or 0
    clean = (both[1] or 0) - toxic
    if not toxic or not clean:
        drop(labelled)
        return Lexicon()
    sums = stored(labelled.select("text", "toxic").mapInArrow(count, "w string, c bigint, t bigint").groupBy("w").agg(F.sum("c").alias("c"), F.sum("t").alias("t")), "words")
    drop(labelled)
    share = toxic / (toxic + clean)
    n = F.col("t") + F.col("c")
    g = 2 * (F.col("t") * F.log(F.col("t") / (n * share)) + F.coalesce(F.col("c") * F.log(F.nullif(F.col("c"), F.lit(0)) / (n * (1 - share))), F.lit(0.0)))
    telling = (F.col("g") > LEAST_G) & (F.col("t") >= PRECISION * F.col("c"))
    words = sums.filter("t > 0").withColumn("g", g).filter(telling).orderBy(F.desc("g"), "w").limit(size).collect()
    stem = F.explode(F.array(*[F.substring("w", 1, k) for k in STEM_CHARS]))
    stems = sums.withColumn("stem", stem).filter(F.length("stem") < F.length("w")).groupBy("stem").agg(F.sum("c").alias("c"), F.sum("t").alias("t"), F.max("t").alias("most"), F.count("*").alias("n"))
    stems = stems.filter((F.col("t") > 0) & (F.col("n") >= STEM_WORDS) & (2 * F.col("most") <= F.col("t"))).withColumn("g", g).filter((F.col("g") > LEAST_G) & (F.col("t") >= 4 * F.col("c"))).orderBy(F.desc("g"), "stem").limit(size).collect()
    shortest = [r for r in stems if not any(r.stem != o.stem and r.stem.startswith(o.stem) for o in stems)]
    rate = sum(r.c for r in shortest) / max(1, sums.agg(F.sum("c")).first()[0] or 0)
    drop(sums)
    return Lexicon({r.w: float(r.g) for r in words}, {r.stem: float(r.g) for r in stems}, rate)


@dataclass
class Classifier:
    lexicon: Lexicon
    vocabulary: dict[str, int]
    weights: np.ndarray
    labels: LabelModel | None = None

    def score(self, text: str | None) -> float:
        votes, counts, n = found(text, self.lexicon)
        at, x = _features(votes, counts, n, self.vocabulary)
        z = float(np.dot(self.weights[at], x))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", bound: int = SAMPLE_ROWS) -> Classifier:
    """Lexicons learn from all labelled rows where learn_from holds, each text once; votes of all rows fit the label model.

    Vote patterns reach the driver as counts (one row a distinct pattern), the classifier's rows as `bound` texts at most.
    Null texts vote like empty ones; rows whose label is null teach nothing; without labels the fixed lists remain.
    """
    spark = docs.sparkSession
    d = _rows(docs, doc_id, text, learn_from)
    known = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lexicon = learn_lexicon(_distinct_rows(d, known))
    shared = spark.sparkContext.broadcast(lexicon)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}
        for batch in parts(batches, 0):
            for t in batch.column(0).to_pylist():
                key = "".join(map(str, found(t, shared.value)[0]))
                sums[key] = sums.get(key, 0) + 1
        yield pa.RecordBatch.from_pydict({"votes": pa.array(list(sums), pa.string()), "n": pa.array(list(sums.values()), pa.int64())})

    rows = d.select("text").mapInArrow(vote, "votes string, n bigint").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return Classifier(lexicon, {}, np.array([-3.0] + [0.5] * len(VOTERS) + [0.5, 0.5]))
    patterns = np.array([[int(c) for c in r.votes] for r in rows])
    model = LabelModel(patterns, np.array([r.n for r in rows], dtype=float))
    vocabulary = {w: i for i, w in enumerate(sorted(_INSULT | set(lexicon.words) | {f"{x}*" for x in lexicon.stems}))}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 0):
            got = [(f[0], *_features(*f, vocabulary)) for f in (found(t, shared.value) for t in batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_pydict({"votes": pa.array([g[0] for g in got], pa.list_(pa.int32())), "at": pa.array([g[1] for g in got], pa.list_(pa.int32())), "x": pa.array([g[2] for g in got], pa.list_(pa.float64()))})

    sample = _sampled(d, bound).select("text").mapInArrow(featured, "votes array<int>, at array<int>, x array<double>").toArrow().to_pydict()
    size = 3 + len(VOTERS) + len(vocabulary)
    if not sample["votes"]:
        return Classifier(lexicon, vocabulary, np.concatenate(([-3.0], np.full(size - 1, 0.5))), model)
    q = model.posterior(np.array(sample["votes"]))
    at, x = np.concatenate(sample["at"]).astype(int), np.concatenate(sample["x"])
    row = np.repeat(np.arange(len(q)), [len(a) for a in sample["at"]])
    w, velocity = np.zeros(size), np.zeros(size)
    for _ in range(300):  # full batches with momentum
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[at] * x, minlength=len(q)), -30, 30)))
        g = np.bincount(at, weights=(p - q)[row] * x, minlength=size) / len(q) + 1e-4 * w
        velocity = 0.9 * velocity - 0.5 * g
        w += velocity
    return Classifier(lexicon, vocabulary, w, model)


def score(docs: DataFrame, classifier: Classifier, doc_id: str = "doc_id", text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """doc_id, `keep`, score and predicted per row; every text, also an empty or null one, gets a score."""
    shared = docs.sparkSession.sparkContext.broadcast((classifier.lexicon, classifier.vocabulary, classifier.weights))
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *(keep or []), F.col(f"`{text}`").alias("_t"))
    own = d.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(*shared.value)
        for batch in parts(batches, len(own)):
            s = [c.score(t) for t in batch.column(len(own)).to_pylist()]
            cols = {name: batch.column(k) for k, name in enumerate(own)}
            yield pa.RecordBatch.from_pydict(cols | {"score": pa.array(s, pa.float64()), "predicted": pa.array([int(v >= 0.5) for v in s], pa.int32())})

    from pyspark.sql.types import StructType

    return d.mapInArrow(run, StructType(d.schema.fields[:-1] + StructType.fromDDL("score double, predicted int").fields))
