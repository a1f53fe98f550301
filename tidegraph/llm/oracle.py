"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def op1_sql() -> str:
    ratios = {
        "word_length": ("word_chars", "n_words"),
        "symbols": ("n_symbols", "word_chars"),
        "shouting": ("n_bangs", "n_words"),
        "stop_words": ("n_stop", "n_words"),
        "repeated_lines": ("n_dup_lines", "n_lines"),
        "bullets": ("n_bullet", "n_lines"),
        "ellipsis": ("n_ellipsis", "n_lines"),
    }
    fails = []
    for r in RULES:
        a, b = ratios[r.name]
        v = f"coalesce({a}::DOUBLE / nullif({b}, 0), 0.0)"
        t = " OR ".join(([f"{v} < {r.low}"] if r.low is not None else []) + ([f"{v} > {r.high}"] if r.high is not None else []))
        lang = f" AND coalesce(lower(lang) IN ({_quoted(r.langs)}), false)" if r.langs else ""
        fails.append(f"(n_words >= {r.min_words}{lang} AND ({t}))")
    stop = _quoted(sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
a AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i:i+4])) AS g,
             unnest(range(1, len(w) - 3)) AS i FROM a WHERE len(w) >= 5),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
k AS (SELECT rid, count(DISTINCT i + o) AS n FROM r, range(0, 5) AS o(o) GROUP BY rid),
m AS (SELECT doc_id, lang, len(w) AS n_words, length(regexp_replace(t, '{space}+', '', 'g')) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words,
             len(lines) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_bangs,
             len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop,
             len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{{2022}}]'))) AS n_bullet,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) AS n_ellipsis
      FROM a LEFT JOIN k USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(fails)}) AS kept
FROM f"""


def op5_sql() -> str:
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({fold.format("text")}, {word}), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({fold.format("text")}, {word}) AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, k, g FROM (
         SELECT item_id, least(10, len(w)) AS k, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
       FROM d, ks WHERE len(w) >= k),
h AS (SELECT rid, i, k, item_id FROM dw JOIN bw USING (k, g)),
n AS (SELECT rid, count(DISTINCT i + o) AS n_hit FROM h, range(0, 10) AS o(o) WHERE o < k GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)"""


ORACLE = {
    "op1_quality_rules": op1_sql(),
    "op5_decontamination": op5_sql(),
    "op10_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f""",
}
