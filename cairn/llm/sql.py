"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from .quality import ALPHA, CAPITALS, DELTA, LADDERS, SYMBOLS

WORDS = r"[^\x20\x09-\x0D]+"

#: Links by counting shared shingles; components by all that a document reaches.
NGRAM_JACCARD = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{CAPITALS}', '{CAPITALS.lower()}'), '{WORDS}') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s GROUP BY x.doc_id, y.doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach AS (
  SELECT a AS doc_id, a AS root FROM links
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id
), roots AS (
  SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(root, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN roots r ON r.doc_id = d.doc_id
"""

NUMERATORS = {"symbols": "n_symbols", "capitals": "n_capitals", "repeats": "n_repeat_words", "copied_lines": "n_dup_lines"}
DENOMINATORS = {"symbols": "word_chars", "capitals": "word_chars", "repeats": "n_words", "copied_lines": "n_words"}


def rules_sql(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """Base counts, cutoffs by exact binomial sums, and the verdict."""
    ladder = ", ".join(f"('{rule}', {t})" for rule, cutoffs in LADDERS.items() for t in cutoffs)
    rated = " UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, '{r}' AS rule, {NUMERATORS[r]} AS a, greatest({DENOMINATORS[r]}, 1) AS b FROM scored" for r in LADDERS)
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents
), split AS MATERIALIZED (
  SELECT doc_id, stratum, text, regexp_extract_all(text, '{WORDS}') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS lines
  FROM texts
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS k
  FROM split, unnest(range(1, len(w) - 1)) AS t(i)
), spots AS (
  SELECT DISTINCT doc_id, i + d AS p FROM windows, (VALUES (0), (1), (2)) AS o(d) WHERE k > 1
), repeats AS (
  SELECT doc_id, count(*) AS n FROM spots GROUP BY doc_id
), counted AS (
  SELECT s.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN repeats r ON r.doc_id = s.doc_id
), scored AS MATERIALIZED (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
), rated AS MATERIALIZED ({rated}
), ladder(rule, cutoff) AS (VALUES {ladder}
), held AS (
  SELECT stratum, l.rule, l.cutoff, count(*) AS n, count(*) FILTER (WHERE 1000 * a > l.cutoff * b) AS k
  FROM rated r JOIN labels USING (doc_id) JOIN ladder l ON l.rule = r.rule
  WHERE quality = 1 AND NOT base_failed GROUP BY stratum, l.rule, l.cutoff
), tails AS (
  SELECT stratum, rule, cutoff, CASE WHEN max(k) >= max(n) * {alpha} THEN 1.0 ELSE sum(
    exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({alpha}) + (n - i) * ln(1 - {alpha}))) END AS tail
  FROM held, unnest(range(0, k + 1)) AS t(i) GROUP BY stratum, rule, cutoff
), tested AS (
  SELECT stratum, rule, cutoff, tail <= {delta} / ((SELECT count(DISTINCT stratum) FROM tails) * {len(LADDERS)}) AS passed FROM tails
), stops AS (
  SELECT stratum, rule, max(cutoff) FILTER (WHERE NOT passed) AS stop FROM tested GROUP BY stratum, rule
), chosen AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM tested JOIN stops USING (stratum, rule)
  WHERE stop IS NULL OR cutoff > stop GROUP BY stratum, rule
), bad AS (
  SELECT DISTINCT doc_id FROM rated JOIN chosen USING (stratum, rule) WHERE 1000 * a > cutoff * b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM scored
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_risk_controlled_rules": rules_sql(), "op6_ngram_jaccard_join": NGRAM_JACCARD}
