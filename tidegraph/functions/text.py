"""Text functions as Columns: names, shingles, tokens, dates of facts, summaries, density."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words that full-text queries leave out.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
SUMMARY_CHARS = 500


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _once(x: Column, f) -> Column:
    """f of x, which is evaluated once however often f names it, also in a lambda."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def normalised(name: Column | str) -> Column:
    """Lower case, white space collapsed, ends stripped."""
    return F.trim(F.regexp_replace(F.lower(_c(name)), r"\s+", " "))


def fuzzy(name: Column | str) -> Column:
    """normalised(), with everything but letters a-z, digits and apostrophes as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalised(name), r"[^a-z0-9' ]", " "), r"\s+", " "))


def entropy(name: Column | str) -> Column:
    """Shannon entropy (bits) of the characters without blanks; 0 for an empty name."""

    def of(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        parts = F.transform(F.array_distinct(chars), lambda c: (n - F.size(F.array_remove(chars, c))) / n)
        return F.when(n <= 0, 0.0).otherwise(-F.aggregate(parts, F.lit(0.0), lambda a, p: a + p * F.log2(p)))

    return _once(F.filter(F.split(F.replace(_c(name), F.lit(" "), F.lit("")), ""), lambda x: x != ""), of)


def telling(name: Column | str) -> Column:
    """Whether a name says enough to be matched loosely: six characters or two words, and an entropy of 1.5 or more."""
    short = (F.length(_c(name)) < 6) & (F.size(F.split(_c(name), " ")) < 2)
    return ~short & (entropy(name) >= 1.5)


def shingles(name: Column | str) -> Column:
    """The set of 3-character shingles without blanks; a single character is its own, two characters give none."""

    def of(s: Column) -> Column:
        n = F.length(s)
        empty = F.array().cast("array<string>")
        return F.when(n == 0, empty).when(n == 1, F.array(s)).when(n == 2, empty).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(s, i, F.lit(3)))))

    return _once(F.replace(_c(name), F.lit(" "), F.lit("")), of)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """1 for two empty sets, 0 for one."""
    a, b = _c(a), _c(b)
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def minhash(parts: Column | str, permutations: int = 32) -> Column:
    """The least seeded hash of the parts for each of the permutations."""
    return F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), lambda s: F.array_min(F.transform(_c(parts), lambda x: F.xxhash64(s, x))))


def bands(signature: Column | str, size: int = 4, permutations: int = 32) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(permutations // size - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice(_c(signature), i * size + 1, size)).alias("key")))


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def words(text: Column | str) -> Column:
    return F.array_distinct(F.split(F.lower(F.trim(_c(text))), r"\s+"))


def truncated(text: Column | str, limit: int = SUMMARY_CHARS) -> Column:
    """At most `limit` characters, cut after the last whole sentence if there is one."""
    t = _c(text)
    head = F.substring(t, 1, limit)
    cut = F.regexp_extract(head, r"^(?s)(.*[.!?])(?:\s|$)", 1)
    return F.when(F.coalesce(t, F.lit("")) == "", t).when(F.length(t) <= limit, t).when(cut != "", F.trim(cut)).otherwise(F.rtrim(head))


def cleaned(text: Column | str) -> Column:
    """Without zero-width and control characters (tab and line breaks stay)."""
    return F.regexp_replace(_c(text), "[\\u200b-\\u200d\\ufeff\\u2060\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")


def estimated_tokens(text: Column | str) -> Column:
    return F.floor(F.length(F.coalesce(_c(text), F.lit(""))) / 4).cast("bigint")


def date_range(valid: Column | str, invalid: Column | str) -> Column:
    """`start - end` of a fact, an unknown start and an open end in words."""
    show = lambda c, other: F.coalesce(F.date_format(_c(c), "yyyy-MM-dd HH:mm:ss"), F.lit(other))
    return F.concat(show(valid, "date unknown"), F.lit(" - "), show(invalid, "present"))


def cap_density(text: Column | str) -> Column:
    """Capitalised words per word, without those that start a sentence, are all capitals or have one character."""
    w = F.filter(F.split(F.coalesce(_c(text), F.lit("")), r"\s+"), lambda x: x != "")
    bare = lambda x: F.regexp_replace(x, r"[^A-Za-z]", "")
    named = F.filter(F.transform(w, lambda x, i: F.struct(bare(x).alias("b"), ((i > 0) & ~F.coalesce(F.get(w, i - 1), F.lit("")).rlike(r"[.!?]$")).alias("inside"))), lambda y: y.inside & y.b.rlike("^[A-Z][A-Za-z]+$") & (F.upper(y.b) != y.b))
    return F.when(F.size(w) == 0, 0.0).otherwise(F.size(named) / F.size(w).cast("double"))


def parsed_time(text: Column | str) -> Column:
    """ISO time or null."""
    return F.try_to_timestamp(F.regexp_replace(_c(text), "Z$", "+00:00"))


def relevance(reply: Column | str) -> Column:
    """The first number of one to three digits in a reply, as a share of 100 within 0 and 1."""
    return F.least(F.greatest(F.regexp_extract(_c(reply), r"\b(\d{1,3})\b", 1).try_cast("double") / 100, F.lit(0.0)), F.lit(1.0))


def query_terms(query: str, limit: int = 128) -> list[str]:
    """Distinct terms of a query on the driver, without stop words; none if it is too long."""
    import re

    found = [w for w in re.split(r"[^\w]+|_", query.lower()) if w and w not in STOP_WORDS]
    return [] if len(query.split()) >= limit else list(dict.fromkeys(found))


def escaped(c: Column | str) -> Column:
    """A full-text query with a backslash before every operator sign, and before the letters of OR, NOT and AND."""
    return F.regexp_replace(c, r'([+\-&|!(){}\[\]^"~*?:\\/ORNTAD])', r"\\$1")


def utc(c: Column | str, zone: str = "UTC") -> Column:
    """A time without a zone, taken as local to `zone`, in UTC."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col(c) if isinstance(c, str) else c)


def iso_json(c: Column | str) -> Column:
    """A struct as JSON, every time in it, however deep, in ISO form."""
    form = "yyyy-MM-dd'T'HH:mm:ss"
    return F.to_json(c, {"timestampFormat": f"{form}XXX", "timestampNTZFormat": form})


def composed(messages: Column | str) -> Column:
    """A query from messages (role_type, role, content), one a line."""
    c = F.col(messages) if isinstance(messages, str) else messages
    part = lambda x: F.concat(F.coalesce(x.role_type, F.lit("")), F.lit("("), F.coalesce(x.role, F.lit("")), F.lit("): "), x.content, F.lit("\n"))
    return F.array_join(F.transform(c, part), "")
