"""Secret scans with multipart credential linking, by DataFrame and SQL functions alone.

Strong spans (long assigned values, access keys, long hexadecimal runs) stand by themselves. Weak candidates
(short assigned values, bare 40-character keys) are reported only when an access identifier or an endpoint lies within
`reach` code points of them inside the same scope, a block of text between blank lines; without a `reach`, anywhere in
the scope. Candidates and parts meet in an interval join: on (row, scope) with the span of a scope's parts, reduced before
it to their first end and last start; or, within a reach, on (row, scope, bin), where a part covers each bin within its
reach and a candidate its own one or two, so a bin holds as many parts as fit into its characters and no pair is made
beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the strong kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 and more: the run after the first AKIA is taken whole
HEX = r"[0-9a-f]{16,}"

# Weak candidates and the parts that complement them.
# ASSIGN does not take names such as secret_access_key, so their values are weak candidates at any length from 6.
WEAK_ASSIGN = r"""(?i:secret[_-]?(?:access[_-]?)?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|(?i:password|passwd|pwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,11}(?![A-Za-z0-9+/_.=-])"""
WEAK_KEY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])"
IDENTIFIER = r"""AKIA[A-Z0-9]{14,}|(?i:access_?key(?:_?id)?|client_?id|account(?:_?id)?|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = r"""(?i:https?|postgres|mysql|mongodb|redis|ftp)://[^\s"'<>]{4,}|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,}"""
SCOPE_BREAK = r"\n[\x20\x09\r]*\n"

KINDS = ("assign", "access", "hex", "linked")


def _starts(hits: str, pieces: str) -> Column:
    """Code point starts of the hits between the pieces: prefix sums, in chunks of the root of their number."""
    n = f"size({hits})"
    c = f"cast(greatest(8, ceil(sqrt({n}))) as int)"
    return F.expr(f"""
      CASE WHEN coalesce({n}, 0) < 1 THEN cast(array() as array<bigint>) ELSE flatten(transform(aggregate(
        sequence(0, cast(({n} - 1) div {c} as int)), cast(array() as array<struct<base: bigint, out: array<bigint>>>),
        (acc, j) -> concat(acc, array(aggregate(
          zip_with(slice({pieces}, j * {c} + 1, least({c}, {n} - j * {c})), slice({hits}, j * {c} + 1, {c}), (p, h) -> struct(length(p) AS a, coalesce(length(h), 0) AS b)),
          named_struct('base', coalesce(get(acc, j - 1).base, 0L), 'out', cast(array() as array<bigint>)),
          (s, x) -> named_struct('base', s.base + x.a + x.b, 'out', concat(s.out, array(s.base + x.a)))))))
        , s -> s.out)) END""")


def _found(df: DataFrame, text: str, name: str, pattern: str) -> DataFrame:
    """df with {name}_h (matches, leftmost and non-overlapping) and {name}_s (their starts)."""
    df = df.withColumn(f"{name}_h", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn(f"{name}_p", F.when(F.size(f"{name}_h") > 0, F.split(text, pattern)))
    return df.withColumn(f"{name}_s", _starts(f"{name}_h", f"{name}_p")).drop(f"{name}_p")


def _spans(name: str, kind: int, offset: str = "0L", keep: str = "true") -> str:
    return f"""filter(zip_with({name}_s, {name}_h, (s, h) -> struct(s + {offset} AS start, {kind} AS k, s + {offset} + length(h) AS end, h AS h)), x -> {keep})"""


def _links(docs: DataFrame, reach: int | None) -> DataFrame:
    """(_key, start, end) of every weak candidate with a complementary part in reach, from rows (_key, _t); equal rows count once."""
    weak, part = f"{WEAK_ASSIGN}|{WEAK_KEY}", f"{IDENTIFIER}|{ENDPOINT}"
    d = docs.filter(F.col("_t").rlike(weak) & F.col("_t").rlike(part))
    d = d.withColumn("_b", F.split("_t", SCOPE_BREAK))
    d = d.withColumn("_x_h", F.regexp_extract_all("_t", F.lit(SCOPE_BREAK), F.lit(0))).withColumn("_x_s", _starts("_x_h", "_b"))
    d = d.withColumn("_o", F.expr("concat(array(0L), zip_with(_x_s, _x_h, (s, h) -> s + length(h)))"))
    d = d.select("_key", F.posexplode(F.arrays_zip("_b", "_o")).alias("scope", "z"))
    d = d.select("_key", "scope", F.col("z._o").alias("o"), F.col("z._b").alias("_t"))
    d = _found(_found(d, "_t", "w", weak), "_t", "p", part)
    d = d.withColumn("both", F.expr(f"concat({_spans('w', 1, 'o')}, {_spans('p', 0, 'o')})")).filter("size(w_h) > 0 AND size(p_h) > 0")
    d = d.select("_key", "scope", F.explode("both").alias("x")).select("_key", "scope", "x.start", "x.end", "x.k").distinct()  # equal rows make their pairs once
    secrets, parts = d.filter("k = 1").select("_key", "scope", "start", "end"), d.filter("k = 0").select("_key", "scope", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    if reach is None:  # of a scope's parts the one that ends first and the one that begins last reach all candidates that any of them does
        parts = parts.groupBy("_key", "scope").agg(F.min("p_end").alias("p_end"), F.max("p_start").alias("p_start"))
        return secrets.join(parts, ["_key", "scope"]).filter("p_start >= end OR start >= p_end").select("_key", "start", "end")
    secrets = secrets.withColumn("bin", F.explode(F.array_distinct(F.array(F.expr(f"start div {reach}"), F.expr(f"end div {reach}")))))
    parts = parts.withColumn("bin", F.explode(F.expr(f"sequence((p_start - {reach}) div {reach} - 1, (p_end + {reach}) div {reach})")))
    near = (F.col("p_start") - F.col("end") <= reach) & (F.col("start") - F.col("p_end") <= reach)
    apart = (F.col("p_start") >= F.col("end")) | (F.col("start") >= F.col("p_end"))
    return secrets.join(parts, ["_key", "scope", "bin"]).filter(near & apart).select("_key", "start", "end").distinct()


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int | None = 256) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_linked and `spans` (array of start, end, kind, strong).

    Null text counts as empty and has no span; repeated rows get the same spans, each once. Offsets are code points of
    the whole text, ends exclusive. Linked candidates are matched to their rows by id and a digest of the text.
    """
    base = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    base = base.withColumn("_key", F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("")), F.md5(F.col("_t").cast("binary"))))
    d = base
    for name, pattern in (("a", ASSIGN), ("c", ACCESS), ("h", HEX)):
        d = _found(d, "_t", name, pattern)
    value = F.when(F.size("a_h") > 0, F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(2)))
    d = d.withColumn("a_h", F.when(F.size("a_h") > 0, F.arrays_zip(F.col("a_h").alias("h"), value.alias("v"))))
    d = d.withColumn("_a", F.expr("transform(filter(zip_with(a_s, a_h, (s, h) -> struct(s AS start, s + length(h.h) AS end, length(h.v) AS n)), x -> x.n >= 12), x -> struct(x.start AS start, 0 AS k, x.end AS end))"))
    d = d.withColumn("_a", F.expr("coalesce(_a, cast(array() as array<struct<start: bigint, k: int, end: bigint>>))"))
    plain = "x -> struct(x.start AS start, x.k AS k, x.end AS end)"
    d = d.withColumn("_c", F.expr(f"transform({_spans('c', 1)}, {plain})")).withColumn("_h", F.expr(f"transform({_spans('h', 2)}, {plain})"))
    d = d.select("_id", "_key", F.size("_a").cast("long").alias("n_assign"), F.size("_c").cast("long").alias("n_access"), F.size("_h").cast("long").alias("n_hex"), F.array_sort(F.concat("_a", "_c", "_h")).alias("_base"))
    linked = _links(base, reach).groupBy("_key").agg(F.collect_set(F.struct("start", F.lit(3).alias("k"), "end")).alias("_l"))
    d = d.join(linked, "_key", "left").withColumn("_l", F.expr("coalesce(_l, cast(array() as array<struct<start: bigint, k: int, end: bigint>>))"))
    return d.select(
        F.col("_id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.size("_l").cast("long").alias("n_linked"),
        F.col("_base").alias("base_spans"), F.array_sort(F.concat("_base", "_l")).alias("spans"),
    )


def joined(spans: str) -> Column:
    """Spans as kind:start:end, by start and then kind, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(get(array({kinds}), x.k), ':', x.start, ':', x.end)), ',')")
