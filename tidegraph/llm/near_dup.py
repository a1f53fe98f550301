"""Near-duplicate detection: ProbMinHash signatures of weighted word shingles, banding, verification, classes.

A text's shingles are its runs of five words (fewer words: one shingle of all), weighted 1 + ln(count). Each shingle is
a Poisson process of its weight; a signature register keeps the shingle whose point arrives first, and arrivals stop
once they come later than the latest register. Two registers agree with the probability Jaccard similarity.

Two texts are linked if the probability Jaccard similarity of their weighted shingles, or the Jaccard similarity of their
shingle sets, is 0.8 or more. Both are the same unless a shingle repeats inside a text; a text in which one does is also
signed with all weights one, so that bands are drawn for whichever similarity makes the link.

Equal texts collapse first. Registers are banded; documents of a band's bucket are candidates:
* a bucket of up to SMALL documents gives its pairs, so a row meets SMALL others at most;
* a larger one gives each member's pair with the bucket's centre, the member that shares most buckets with others, so a
  large group of true copies costs one pair a member and is linked through its centre;
* members of large buckets that these links leave in different classes are joined on shingles that two similar texts must
  share (prefix filter, those rare in the group first). No bucket is dropped, and no link between classes is lost.
Every candidate is verified on whole texts but those that sizes and bitmaps of the shingle sets prove to be unlike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import ODD, mix, runs
from .util import drop, parts, split_by, stored

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
BITS = 2048
SMALL = 12
SAMPLE = 32  # members of a centre, about, that choose the order of its shingles, and nothing else

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    """ASCII letters lower-cased, other ASCII but digits as blanks, single blanks between words."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(_FOLD).split())


def shingles(flat: bytes, words: int = WORDS) -> np.ndarray:
    """A 64-bit hash of each run of words, in order."""
    return runs(flat, words)


def signatures(docs: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """One row of registers per document (uint32 digests of shingles), from arrays of its shingle hashes; none: zeros."""
    return _signed([np.unique(s, return_counts=True) for s in docs], registers)


def _signed(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """Signatures of (distinct shingles, counts).

    Documents run side by side, those of few shingles with more arrivals a round, as each needs about
    registers * ln(registers) of them; the arrivals themselves depend on shingle and weight alone.
    """
    out = np.zeros((len(sets), registers), dtype=np.uint32)
    sizes = np.array([len(s[0]) for s in sets], dtype=np.int64)
    for low, high, burst in ((1, 8, 128), (8, 64, 24), (64, 256, 4), (256, 1 << 62, 1)):
        own = np.flatnonzero((sizes >= low) & (sizes < high))
        if len(own):
            out[own] = _arrivals([sets[i] for i in own], registers, burst)
    return out


def _weights(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def _arrivals(sets: list[tuple[np.ndarray, np.ndarray]], registers: int, burst: int) -> np.ndarray:
    """Rounds of `burst` points a process. A process ends when its next point comes after its document's latest register."""
    elem = np.concatenate([s[0] for s in sets])
    weight = _weights(np.concatenate([s[1] for s in sets]))
    doc = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    best = np.full(len(sets) * registers, np.inf)
    first = np.zeros(len(sets) * registers, dtype=np.uint32)
    digest = (elem >> np.uint64(32)).astype(np.uint32)
    time, steps, done = np.zeros(len(elem)), np.arange(1, burst + 1, dtype=np.uint64), 0
    while len(elem):
        state = mix(elem[:, None] + (steps + np.uint64(done)) * ODD)
        done += burst
        gap = -np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[:, None]
        gap[:, 0] += time
        at = np.cumsum(gap, axis=1)
        slot = doc[:, None] * registers + (((mix(state ^ ODD) >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)).astype(np.int64)
        better = at < best[slot]
        s, t, g = slot[better], at[better], np.broadcast_to(digest[:, None], slot.shape)[better]
        np.minimum.at(best, s, t)
        won = best[s] == t
        first[s[won]] = g[won]
        time = at[:, -1]
        on = time < best.reshape(-1, registers).max(axis=1)[doc]
        elem, weight, doc, digest, time = elem[on], weight[on], doc[on], digest[on], time[on]
    return first.reshape(-1, registers)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * ODD), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key ^ (parts[:, :, r] + np.uint64((r + 1) * int(ODD) % (1 << 64))))
    return key.view(np.int64)


def bitmap(shingle_set: np.ndarray) -> bytes:
    """BITS bits, those set that some shingle of the set falls on."""
    on = np.zeros(BITS, dtype=bool)
    on[(shingle_set >> np.uint64(20)) % np.uint64(BITS)] = True
    return np.packbits(on).tobytes()


def fingerprint(flat: bytes) -> bytes | None:
    """A digest of the words, null without words."""
    return hashlib.blake2b(flat, digest_size=16).digest() if flat else None


def _sketched(d: DataFrame) -> DataFrame:
    """id, own, print, bands (one set, or two where a shingle repeats), size and mass (sum of weights) of the shingles and
    the bitmap of their set, of rows (id, own, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2, rows=128):
            flat = [normal(t) for t in batch.column(2).to_pylist()]
            prints = [fingerprint(x) for x in flat]
            sets = [np.unique(shingles(x), return_counts=True) for x in flat]
            again = [i for i, (x, n) in enumerate(sets) if n.sum() > len(x)]
            keys = [list(k) for k in band_keys(_signed(sets))]
            if again:
                plain = band_keys(_signed([(sets[i][0], np.ones_like(sets[i][1])) for i in again]))
                for i, k in zip(again, plain):
                    keys[i] = list(dict.fromkeys(keys[i] + list(k)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array([k if p else None for k, p in zip(keys, prints)], pa.list_(pa.int64())),
                 pa.array([len(x) for x, _ in sets], pa.int32()), pa.array([float(_weights(n).sum()) for _, n in sets], pa.float64()), pa.array([bitmap(x) if p else None for (x, _), p in zip(sets, prints)], pa.binary())],
                names=["id", "own", "print", "bands", "size", "mass", "bits"],
            )

    return d.mapInArrow(run, f"id {dict(d.dtypes)['id']}, own bigint, print binary, bands array<bigint>, size int, mass double, bits binary")


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) without those that are proven to be under SIMILARITY.

    Each bit that only one of two bitmaps has stands for a shingle at least that the other set lacks, which bounds the
    number of common shingles from above; and if shares u and v of two texts' weights are not common, their probability
    Jaccard similarity is (1 - u)(1 - v) / (1 - uv) at most. So no similar pair is left out.
    """
    a, b = (nodes.select(F.col("node").alias(k), F.col("size").alias(f"n{k}"), F.col("mass").alias(f"m{k}"), F.col("bits").alias(f"s{k}")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m, n = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
                p, q = (batch.column(k).to_numpy() for k in (4, 5))
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for k in (6, 7))
                left, right = (np.bitwise_count(v).sum(axis=1, dtype=np.int64) for v in (x & ~y, y & ~x))
                most, u, v = np.minimum(m - left, n - right), np.minimum(1, left / p), np.minimum(1, right / q)
                weighed = ((p > m) | (q > n)) & ((1 - u) * (1 - v) >= SIMILARITY * (1 - u * v) - 1e-9)
                yield batch.select([0, 1]).filter(pa.array((most >= SIMILARITY * (m + n - most)) | weighed))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ma", "mb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


SETS = "node bigint, set binary, counts binary"


def _sets(asked: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, set, counts): the sorted shingle hashes of the whole texts of the asked nodes, and how often each comes (empty: once each).

    Only texts whose hash may be among the asked ones move.
    """
    rows = nodes.join(asked, "node", "left_semi").select("node", F.col("id").alias("_i"), F.col("own").alias("_o"))
    may, _ = split_by(docs, F.col("own"), rows.select("_o"))
    texts = may.join(rows, (F.col("own") == F.col("_o")) & F.col("id").eqNullSafe(F.col("_i"))).select("node", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1, rows=128):
            sets = [np.unique(shingles(normal(t)), return_counts=True) for t in batch.column(1).to_pylist()]
            counts = [n.astype(np.uint32).tobytes() if n.sum() > len(n) else b"" for _, n in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x, _ in sets], pa.binary()), pa.array(counts, pa.binary())], names=["node", "set", "counts"])

    return texts.mapInArrow(cut, SETS).dropDuplicates(["node"])


def probability_jaccard(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray) -> float:
    """Of sorted distinct elements x, y with weights p, q: over common d, 1 / sum over e of max(p(e) / p(d), q(e) / q(d))."""
    every = np.union1d(x, y)
    a, b = np.zeros(len(every)), np.zeros(len(every))
    a[np.searchsorted(every, x)], b[np.searchsorted(every, y)] = p, q
    order = np.argsort(np.where(b > 0, a / np.where(b > 0, b, 1), np.inf), kind="stable")
    a, b = a[order], b[order]  # by a / b: of an element, those before it count with b, it and those after it with a
    before, after = np.cumsum(b) - b, np.cumsum(a[::-1])[::-1]
    both = (a > 0) & (b > 0)
    return float((1 / (after[both] / a[both] + before[both] / b[both])).sum())


def _read(elements: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    return np.frombuffer(elements, np.uint64), _weights(np.frombuffer(counts, np.uint32)) if counts else None


def similar(x: np.ndarray, p: np.ndarray | None, y: np.ndarray, q: np.ndarray | None) -> bool:
    """Whether the sets x, y, or their weights p, q (None: one each), have a similarity of SIMILARITY or more."""
    least = min(len(x), len(y))
    both = len(np.intersect1d(x, y, assume_unique=True)) if least else 0
    if 5 * both >= 4 * (len(x) + len(y) - both):
        return least > 0
    if (p is None and q is None) or not both:
        return False
    p, q = (np.ones(len(e)) if w is None else w for e, w in ((x, p), (y, q)))
    return probability_jaccard(x, p, y, q) >= SIMILARITY


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The similar ones of the pairs (a, b), by their shingles."""
    of = lambda k: sets.select(F.col("node").alias(k), F.col("set").alias(f"s{k}"), F.col("counts").alias(f"c{k}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(*_read(x.as_py(), n.as_py()), *_read(y.as_py(), m.as_py())) for x, n, y, m in zip(*(batch.column(k) for k in range(2, 6)))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "ca", "sb", "cb").mapInArrow(compare, "a bigint, b bigint")


def _asked(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _centres(large: DataFrame) -> DataFrame:
    """(bucket, centre), stored: of each large bucket (bucket, node, n) the member that shares most buckets with others.

    Sums and largest values are formed inside tasks first, and the centres are stored before the rows meet them, so that
    a large bucket is no task's own.
    """
    shares = large.groupBy("node").agg(F.sum("n").alias("shares"))
    best = large.join(shares, "node").groupBy("bucket").agg(F.max(F.struct("shares", F.col("node").alias("centre"))).alias("m"))
    return stored(best.select("bucket", "m.centre"), "centres")


def _frequent(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(centre, elements, times), stored: the shingles that some of a centre's members, about SAMPLE, have in common."""
    n = members.groupBy("centre").agg(F.count("*").alias("n"))
    some = members.join(n, "centre").filter(F.pmod(F.xxhash64("node", "centre"), F.col("n")) < SAMPLE).select("centre", "node")
    own = some.unionByName(members.select("centre", F.col("centre").alias("node")).distinct()).join(sets.select("node", "set"), "node").select("centre", "set")

    def count(table: pa.Table) -> pa.Table:
        e, n = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]), return_counts=True)
        e, n = e[n > 1], n[n > 1].astype(np.int64)
        return pa.table({"centre": table.column("centre").slice(0, 1), "elements": pa.array([e.tobytes()], pa.binary()), "times": pa.array([n.tobytes()], pa.binary())})

    return stored(own.groupBy("centre").applyInArrow(count, "centre bigint, elements binary, times binary"), "frequent")


def _prefixes(d: DataFrame) -> DataFrame:
    """The first part of each member's shingles, of rows (centre, node, comp, set, counts, elements, times).

    In the order of one centre shingles come by their times among its sampled members, the rarest first, and by hash. Of
    two similar texts, what comes before their first common shingle is a fifth of the shingles of each, or of the weight,
    at most. u and w are the shares of shingles and of weight that come before a row's shingle e.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 3):
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for x, c, o, n in zip(*(batch.column(k) for k in (3, 4, 5, 6))):
                (x, w), o, n = _read(x.as_py(), c.as_py()), np.frombuffer(o.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int64)
                at = np.minimum(np.searchsorted(o, x), max(0, len(o) - 1))
                by = np.argsort(np.where(o[at] == x, n[at], 0) if len(o) else np.zeros(len(x)), kind="stable")
                u = np.arange(len(x)) / len(x)
                v = u if w is None else (np.cumsum(w[by]) - w[by]) / w.sum()
                first = np.minimum(u, v) <= 1 - SIMILARITY + 1e-9
                for col, values in zip(cols, (x[by].view(np.int64), u, v, np.full(len(x), w is not None))):
                    col.append(values[first])
            take = pa.array(np.repeat(np.arange(batch.num_rows), [len(e) for e in cols[0]]))
            size = pa.array(np.repeat([len(x.as_py()) // 8 for x in batch.column(3)], [len(e) for e in cols[0]]), pa.int32())
            e, u, v, again = (pa.array(np.concatenate(c)) for c in cols)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(3)), e, size, u, v, again], names=["centre", "node", "comp", "e", "size", "u", "w", "again"])

    return d.mapInArrow(run, "centre bigint, node bigint, comp bigint, e bigint, size int, u double, w double, again boolean")


def _rest(large: DataFrame, centres: DataFrame, nodes: DataFrame, comps: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Links (a, b) between members of large buckets that are still in different classes; None if there are no such members.

    Members of one centre meet where their prefixes share a shingle, if what comes before it lets them be similar and they
    are not of one class; those of the class that has most members there don't meet each other. Texts that stand off their
    group have more before its common shingles than that, so they don't meet the group, but only what shares their own.
    """
    d = large.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = stored(d.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket"), "mixed")
    members = stored(d.join(mixed, "bucket", "left_semi").join(centres, "bucket").select("centre", "node", "comp").distinct(), "members")
    if not members.limit(1).count():
        drop(mixed, members)
        return None
    asked = members.select("node").unionByName(members.select(F.col("centre").alias("node"))).distinct()
    sets = stored(_sets(asked, nodes, docs), "sets")
    frequent = _frequent(members, sets)
    own = members.join(sets, "node").join(frequent, "centre").select("centre", "node", "comp", "set", "counts", "elements", "times")
    rows = stored(_prefixes(own), "prefixes")
    by = rows.groupBy("centre", "e", "comp").agg(F.count("*").alias("n")).groupBy("centre", "e").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("comps"))
    main = stored(by.filter("comps > 1").select("centre", "e", F.col("m.comp").alias("main")), "main")
    met = stored(rows.join(main, ["centre", "e"]), "met")
    x, y = (met.select("centre", "e", "main", *[F.col(c).alias(f"{c}{k}") for c in ("node", "comp", "size", "u", "w", "again")]) for k in "xy")
    common = "least(sizex * (1 - ux), sizey * (1 - uy))"
    by_set = f"5 * {common} >= 4 * (sizex + sizey - {common}) - 1e-6"
    by_weight = f"(againx OR againy) AND (1 - wx) * (1 - wy) >= {SIMILARITY} * (1 - wx * wy) - 1e-9"
    pairs = x.filter("compx <> main").join(y.drop("main"), ["centre", "e"]).filter(f"compx <> compy AND (compy = main OR nodex < nodey) AND ({by_set} OR {by_weight})")
    pairs = pairs.select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).distinct()
    possible = stored(_possible(pairs, nodes), "rest-possible")
    links = stored(_verified(possible, sets), "rest")
    drop(mixed, members, sets, frequent, rows, main, met, possible)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (a, b): comp is the least node that links lead to.

    Rounds of taking the least label among neighbours and of following labels, each written to the shared folder; the
    number of rounds grows with the logarithm of the longest chain.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hooked = labels.select("node", "comp").join(near, "node").select("node", "comp", F.least("comp", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("on"))
        new = stored(hooked.join(jump, "to", "left").select("node", F.least("to", F.coalesce("on", "to")).alias("comp"), F.col("comp").alias("old")), "labels")
        moved = new.filter("comp <> old").limit(1).count()
        drop(labels)
        labels = new
        if not moved:
            return labels


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (id, own, text): the stored rows (id, own, print), and (print, first) with the least (id, own) of the print's class."""
    sketch = stored(_sketched(docs), "sketch")
    firsts = sketch.filter("print IS NOT NULL").dropDuplicates(["print"])
    nodes = stored(firsts.select(F.monotonically_increasing_id().alias("node"), "print", "bands", "size", "mass", "bits", "id", "own"), "nodes")
    rows = stored(sketch.select("id", "own", "print"), "rows")
    drop(sketch)
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = stored(banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    buckets = stored(banded.join(sizes, "bucket"), "buckets")
    drop(sizes)
    small, large = buckets.filter(F.col("n") <= SMALL), buckets.filter(F.col("n") > SMALL)
    x, y = small.select("bucket", F.col("node").alias("a")), small.select("bucket", F.col("node").alias("b"))
    pairs = x.join(y, "bucket").filter("a < b").select("a", "b").distinct()
    if any_large := bool(large.limit(1).count()):
        centres = _centres(large)
        star = large.join(centres, "bucket").filter("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        pairs = pairs.unionByName(star).distinct()
    possible = stored(_possible(pairs, nodes), "possible")
    links = stored(_verified(possible, _sets(_asked(possible), nodes, docs)), "links")
    drop(possible)
    comps = components(links)
    if any_large and (rest := _rest(large, centres, nodes, comps.select("node", "comp"), docs)) is not None:
        if rest.limit(1).count():
            old, comps = comps, components(links.unionByName(rest))
            drop(old)
        drop(rest)
    of = stored(nodes.select("node", "print").join(comps.select("node", "comp"), "node", "left").select("print", F.coalesce("comp", "node").alias("comp")), "of")
    drop(nodes, buckets, links, comps)
    least = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "own")).alias("first")
    by_print = rows.filter("print IS NOT NULL").groupBy("print").agg(least).join(of, "print")
    by_comp = by_print.groupBy("comp").agg(F.min("first").alias("first"))
    named = stored(of.join(by_comp, "comp").select("print", "first.id", "first.own"), "named")
    drop(of)
    return rows, named.select("print", F.struct("id", "own").alias("first"))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, own, text); own is a hash of the text as it is."""
    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("own"), F.col(f"`{text}`").alias("text"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and class_id (the least doc_id of the class) per row; both as they came, so a null id stays null.

    Texts with equal words form one class, whatever their case and punctuation; null texts and texts without words are
    classes of their own. Classes are the connected components of verified links.
    """
    rows, named = _classified(_rows(docs, doc_id, text))
    with_words = rows.join(named, "print").select(F.col("id").alias("doc_id"), F.col("first.id").alias("class_id"))
    return with_words.unionByName(rows.filter("print IS NULL").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id")))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, that of the least doc_id (null last; ties: by a hash of the text), with the columns it came with.

    Rows that share this id and this text count once. Rows without words stay as they are. Only texts of rows that may go
    or may be repeated move.
    """
    rows, named = _classified(_rows(docs, doc_id, text))
    own = rows.filter("print IS NOT NULL").groupBy("id", "own", "print").agg(F.count("*").alias("n")).join(named, "print")
    first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("own") == F.col("first.own"))
    special = stored(own.select(F.col("id").alias("_i"), F.col("own").alias("_o"), first.alias("stays"), "n").filter("NOT stays OR n > 1"), "special")
    key = lambda i, o: F.xxhash64(F.coalesce(F.col(i).cast("string"), F.lit("")), F.col(o))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("own"))
    may, sure = split_by(d, key("id", "own"), special.select(key("_i", "_o").alias("k")))
    asked = may.join(special, (F.col("own") == F.col("_o")) & F.col("id").eqNullSafe(F.col("_i")), "left")
    once = asked.filter("stays").select("row", "id", "own").dropDuplicates(["id", "own"])
    return sure.select("row.*").unionByName(asked.filter("stays IS NULL").select("row.*")).unionByName(once.select("row.*"))
