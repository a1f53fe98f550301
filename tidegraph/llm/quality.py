"""Quality rules: a threshold table compiled into one projection of built-in functions.

Words are runs of characters other than space, tab and the line breaks up to carriage return.
All measures are Columns (higher-order functions inside a row), so nothing is shuffled and a
hot source or a hot text costs no more than its own rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Frequent function words, by language.
STOP_WORDS = {
    "en": "the be to of and a in that have it for on with as at by is was are from this or an he she they we you not",
    "fr": "le la les de des du et un une en que qui dans pour pas sur est au aux il elle ce se par ou",
    "de": "der die das und in zu den von mit ist ein eine im für auf des dem nicht sich auch als an es",
    "es": "el la los las de del y en que un una por con para no se su es al lo como",
}


@dataclass(frozen=True)
class Rule:
    """A document fails if the measure lies outside [low, high]; documents under min_words words are not asked."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0
    langs: tuple[str, ...] = ()


RULES = (
    Rule("word_length", "mean_word_chars", low=1.5, high=200.0, min_words=10),
    Rule("symbols", "symbol_ratio", high=0.05),
    Rule("shouting", "bang_ratio", high=0.5, min_words=10),
    Rule("stop_words", "stop_word_ratio", low=0.01, min_words=50, langs=tuple(STOP_WORDS)),
    Rule("repeated_lines", "dup_line_ratio", high=0.7, min_words=30),
    Rule("bullets", "bullet_line_ratio", high=0.9, min_words=50),
    Rule("ellipsis", "ellipsis_line_ratio", high=0.5, min_words=50),
)


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.col(text), SPACE), "")


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


def measures(docs: DataFrame, text: str = "text", lang: str | None = "lang", window: int = 5) -> DataFrame:
    """`row` (all columns of docs, packed so that no name can clash) and `q`, a struct of measures; no exchange.

    n_repeat_words counts the words inside `window`-word windows that occur twice or more: windows are hashed
    (64 bit, within one text), and only texts that have a repeated hash sort theirs to find the positions.
    Null text counts as empty.
    """
    d = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"),
        (F.lower(F.col(f"`{lang}`")) if lang else F.lit(None).cast("string")).alias("_lang"),
    )
    d = d.withColumn("_w", _words("_t")).withColumn("_n", F.size("_w").cast("long"))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    at = ", ".join(f"get(_h, i + {k})" for k in range(window))
    d = d.withColumn("_g", F.expr(f"CASE WHEN _n < {window} THEN array() ELSE transform(sequence(0, cast(_n as int) - {window}), i -> xxhash64({at})) END"))
    d = d.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn(
        "_s",
        F.expr("CASE WHEN size(array_distinct(_g)) = size(_g) THEN NULL ELSE array_sort(transform(_g, (h, i) -> struct(h, i))) END"),
    )
    d = d.withColumn(
        "_p",
        F.expr("array_sort(transform(filter(_s, (x, j) -> get(_s, j - 1).h <=> x.h OR get(_s, j + 1).h <=> x.h), x -> x.i))"),
    )
    covered = F.expr(
        f"coalesce(aggregate(transform(_p, (x, j) -> least({window}, coalesce(get(_p, j + 1) - x, {window}))), 0L, (a, x) -> a + x), 0L)"
    )
    gone = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    lines = lambda pattern: F.size(F.filter("_lines", lambda x: x.rlike(pattern)))
    d = d.select(
        "row",
        F.struct(
            F.col("_n").alias("n_words"),
            F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            gone(SYMBOLS).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            covered.alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            gone("!").cast("long").alias("n_bangs"),
            F.size(F.filter("_w", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
            lines(r"^[\x20\x09]*[-*•]").cast("long").alias("n_bullet_lines"),
            lines(r"(\.\.\.|…)[\x20\x09-\x0D]*$").cast("long").alias("n_ellipsis_lines"),
            F.col("_lang").alias("lang"),
        ).alias("q"),
    )
    return d


RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "bang_ratio": ("n_bangs", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"),
}


def _fails(rule: Rule) -> Column:
    value = _ratio(*(f"q.{x}" for x in RATIOS[rule.measure])) if rule.measure in RATIOS else F.col(f"q.{rule.measure}")
    out = F.lit(False)
    if rule.low is not None:
        out = out | (value < rule.low)
    if rule.high is not None:
        out = out | (value > rule.high)
    asked = F.col("q.n_words") >= rule.min_words
    if rule.langs:
        asked = asked & F.coalesce(F.col("q.lang").isin(*rule.langs), F.lit(False))
    return asked & out


def quality(docs: DataFrame, text: str = "text", lang: str | None = "lang", rules: tuple[Rule, ...] = RULES, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """`row` (a document's own columns), `q` (measures), `base_failed`, `failed_rules` (names, in table order) and `kept`.

    Null or empty text has no word, so it fails the base rule. Repeated rows are judged alike, each on its own.
    A rule with languages is asked only where the language column names one of them; null asks none.
    """
    d = measures(docs, text, lang)
    base = (F.col("q.n_words") < min_words) | (100 * F.col("q.n_repeat_words") > max_repeat_percent * F.col("q.n_words"))
    failed = F.array_compact(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    return d.withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, **how) -> DataFrame:
    """The rows that pass, with the columns they came with.

    A filter is pushed below deterministic projections, which would write the measures' nested expressions out again at
    each use; the row number, which changes nothing, keeps it above them.
    """
    judged = quality(docs, **how).withColumn("at", F.monotonically_increasing_id())
    return judged.filter("kept AND at >= 0").select("row.*")
