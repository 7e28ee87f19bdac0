"""The queries that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

from gridfield.llm import licenses, quality

_WORDS = r"[\x20\x09-\x0D]+"


def _words(text: str, gaps: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{gaps}'), lambda x: x <> '')"


#: A window goes if its words start earlier; each covered word goes once.  Rows of one doc_id, or of none, are in order of a hash.
SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, substr(md5(coalesce(text, '')), 1, 15) AS told, {_words("coalesce(text, '')", _WORDS)} AS w FROM documents),
g AS (SELECT row, doc_id, told, s, array_to_string(w[s : s + 19], ' ') AS gram FROM d, unnest(range(1, len(w) - 18)) AS u(s)),
later AS (SELECT row, s FROM g QUALIFY row_number() OVER (PARTITION BY gram ORDER BY doc_id NULLS LAST, told, row, s) > 1),
gone AS (SELECT DISTINCT row, s + k AS pos FROM later, unnest(range(0, 20)) AS u(k)),
word AS (SELECT row, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT row, string_agg(x, ' ' ORDER BY pos) AS text, count(*) AS n FROM word ANTI JOIN gone USING (row, pos) GROUP BY row)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.row = kept.row
"""


def _license_sql() -> str:
    values = ", ".join(f"({k}, '{text}', '{label}', {str(k < len(licenses.PHRASES)).lower()})" for k, (text, label) in enumerate(licenses.PHRASES + licenses.TEXTS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_words(f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')", licenses.GAPS)} AS w FROM documents),
t AS (SELECT number, label, phrase, string_split(text, ' ') AS w, CASE WHEN phrase THEN 2 ELSE 3 END AS k FROM (VALUES {values}) AS v(number, text, label, phrase)),
places AS (SELECT number, label, phrase, k, len(w) - k + 1 AS total, greatest(4, (len(w) - k + 1) // 8) AS reach, place, array_to_string(w[place + 1 : place + k], ' ') AS gram FROM t, unnest(range(0, len(w) - k + 1)) AS u(place)),
grams AS (SELECT row, k, p, array_to_string(w[p + 1 : p + k], ' ') AS gram FROM (SELECT row, w, unnest([2, 3]) AS k FROM d), unnest(range(0, len(w) - k + 1)) AS u(p)),
votes AS (SELECT DISTINCT row, number, label, phrase, total, reach, p - place AS diagonal, place FROM grams JOIN places USING (k, gram)),
diagonals AS (SELECT DISTINCT row, number, phrase, reach, diagonal FROM votes),
breaks AS (SELECT *, CASE WHEN phrase OR diagonal - lag(diagonal, 1, -1073741824) OVER (PARTITION BY row, number ORDER BY diagonal) > reach THEN 1 ELSE 0 END AS fresh FROM diagonals),
numbered AS (SELECT row, number, diagonal, sum(fresh) OVER (PARTITION BY row, number ORDER BY diagonal) AS span FROM breaks),
spans AS (SELECT row, number, label, phrase, min(diagonal) AS start, count(DISTINCT place) / total AS share FROM votes JOIN numbered USING (row, number, diagonal) GROUP BY row, number, label, phrase, total, span),
found AS (SELECT * FROM spans WHERE CASE WHEN phrase THEN share = 1 ELSE share >= {licenses.COVER} END)
SELECT any_value(d.doc_id) AS doc_id, any_value(len(w))::BIGINT AS n_words, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase)::BIGINT AS first_word, max(start) FILTER (phrase)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0)::DOUBLE AS score
FROM d LEFT JOIN found USING (row) GROUP BY row
"""


def _quality_sql() -> str:
    rules = list(quality.GRIDS)
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0::DOUBLE END"
    metric = dict(zip(rules, (share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_capitals", "word_chars"), share("n_marks", "n_words") + " / 5"), strict=True))
    left = lambda pattern: f"length(regexp_replace(text, '{pattern}', '', 'g'))"
    over = ", ".join(f"len(list_filter({list(quality.GRIDS[r])}::DOUBLE[], lambda c: {x} > c))" for r, x in metric.items())
    p = quality.RISK
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, {_words("text", _WORDS)} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
grams AS (SELECT row, i, array_to_string(w[i : i + 2], ' ') AS gram FROM s, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT row, i FROM grams QUALIFY count(*) OVER (PARTITION BY row, gram) > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM twice, unnest([0, 1, 2]) AS u(k) GROUP BY row),
c AS (SELECT row, doc_id, stratum, len(w)::BIGINT AS n_words, {left(_WORDS)} AS word_chars, {left("[^#*$%&|<>]+")} AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, {left("[^A-Z]+")} AS n_capitals, {left("[^!]+")} AS n_marks FROM s LEFT JOIN covered USING (row)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {quality.STEPS} - greatest({over}) AS rejected_from FROM c),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT coalesce('=' || stratum, '') AS key, rejected_from FROM m JOIN good USING (doc_id) WHERE NOT base_failed),
tested AS (SELECT key, step, count(*) AS n, count(*) FILTER (rejected_from <= step) AS k FROM held, unnest(range(0, {quality.STEPS})) AS u(step) GROUP BY ALL),
tail AS (SELECT key, step, CASE WHEN any_value(k) > any_value(n) * {p} THEN 1 ELSE sum(exp(lgamma(n + 1) - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END - CASE WHEN j = n THEN 0 ELSE lgamma(n - j + 1) END + j * ln({p}) + (n - j) * ln(1 - {p}))) END AS chance
  FROM tested, unnest(range(0, CASE WHEN k > n * {p} THEN 1 ELSE k + 1 END)) AS u(j) GROUP BY ALL),
judged AS (SELECT *, sum(CASE WHEN chance <= {quality.LEVEL} / (SELECT count(DISTINCT key) FROM held) THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY step) AS failed FROM tail),
best AS (SELECT key, max(step) AS step FROM judged WHERE failed = 0 GROUP BY key)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rejected_from > step, true) AS kept
FROM m LEFT JOIN best ON coalesce('=' || stratum, '') = best.key
"""


ORACLES = {"op2_license_scan": _license_sql(), "op3_substring_dedup": SUBSTRINGS, "op10_risk_controlled_quality": _quality_sql()}
