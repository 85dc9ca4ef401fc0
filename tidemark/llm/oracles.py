"""Reference SQL of the queries that SQL can express, in DuckDB's dialect.

Patterns, phrases, rules and thresholds are stated here again, apart from the operators.
"""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"

OP3_SOURCE_MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size,
    md5('17:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM sized GROUP BY source),
ordered AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS held,
    sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_weight FROM sources),
level AS (
  SELECT max((total - held)::DOUBLE / open_weight) FILTER (WHERE weight * ((total - held)::DOUBLE / open_weight) <= 3 * source_size) AS level FROM ordered),
targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR weight * level > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE weight * level END AS target
  FROM sources, level),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, round(p.target - p.whole * p.source_size)::BIGINT AS extra,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, extra - before)))::BIGINT AS taken FROM placed"""

# Kinds in the order in which equal starts are listed: pattern, group, least length of it.
_SECRETS = [
    ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    ("forge_token", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("cloud_key", "AIza[A-Za-z0-9_-]{35,}", 0, 1),
    ("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("bearer", r"[bB]earer\x20+[A-Za-z0-9._~+/-]{20,}", 0, 1),
    ("url_login", r"://[A-Za-z0-9._~-]{1,64}:[^\x20\x09-\x0D/@:]{4,128}@", 0, 1),
]


def _secret_hits() -> str:
    """Places of every kind from the pieces between its matches."""
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(_SECRETS):
        parts.append(f"""
  SELECT r, {rank} AS rank, '{kind}' AS kind, len(part) >= {least} AS ok,
    (sum(len(gap)) OVER w + sum(len(hit)) OVER w - len(hit))::BIGINT AS start, (sum(len(gap)) OVER w + sum(len(hit)) OVER w)::BIGINT AS stop
  FROM (SELECT r, unnest(hits) AS hit, unnest(parts) AS part, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS i
    FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {group}) AS parts,
      string_split_regex(text, '{pattern}') AS gaps FROM docs)) WINDOW w AS (PARTITION BY r ORDER BY i)""")
    return " UNION ALL ".join(parts)


OP5_SECRET_SCAN = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({_secret_hits()}),
found AS (SELECT *, kind || ':' || start || ':' || stop AS span FROM hits WHERE ok),
joined AS (
  SELECT r, count(*) FILTER (WHERE rank = 0)::BIGINT AS n_assign, count(*) FILTER (WHERE rank = 1)::BIGINT AS n_access,
    count(*) FILTER (WHERE rank = 2)::BIGINT AS n_hex, string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base,
    string_agg(span, ',' ORDER BY start, rank) AS spans FROM found GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN joined USING (r)"""

OP6_QUALITY_RULES = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS lines FROM documents),
places AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM places) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals
  FROM docs LEFT JOIN covered USING (r)),
ledger AS (
  SELECT *, ((n_words < 50)::INTEGER + 2 * (100 * n_repeat_words > 50 * n_words)::INTEGER + 4 * (10 * n_symbols > 3 * n_words)::INTEGER
    + 8 * (word_chars < 2 * n_words)::INTEGER + 16 * (word_chars > 20 * n_words)::INTEGER + 32 * (2 * n_dup_lines > n_lines)::INTEGER
    + 64 * (2 * n_capitals > word_chars)::INTEGER)::INTEGER AS failures FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM ledger"""

# Number, text, label, whether it is a phrase of the base scan.
_TEMPLATES = [
    ("mit license", "mit", True), ("apache license", "apache", True), ("general public license", "gpl", True),
    ("licensed under cc by nc 4 0", "cc-by-nc", False), ("licensed under cc by 4 0", "cc-by", False), ("licensed under cc by sa 4 0", "cc-by-sa", False),
    ("creative commons attribution noncommercial 4 0 international", "cc-by-nc", False),
    ("licensed under the apache license version 2 0", "apache-2", False), ("released under the mit license", "mit-notice", False),
    ("this work is licensed under the gnu general public license version 3", "gpl-3", False),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text", False),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text", False),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", False),
    ("all rights reserved", "reserved", False),
]
_TEMPLATE_ROWS = ", ".join(f"({i}, '{text}', '{label}', {str(base).lower()})" for i, (text, label, base) in enumerate(_TEMPLATES))

OP7_LICENSE_SCAN = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pairs AS (SELECT r, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM docs)),
templates AS (SELECT t, label, base, string_split(body, ' ') AS w FROM (VALUES {_TEMPLATE_ROWS}) v(t, body, label, base)),
places AS (SELECT t, label, base, len(w) - 1 AS size, i - 1 AS place, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM templates)),
votes AS (
  SELECT r, t, label, base, size, pos - place AS diagonal, list(place) AS agreed, min(pos) AS first_pos
  FROM pairs JOIN places USING (a, b) GROUP BY ALL),
phrases AS (SELECT r, label, base, diagonal AS start, 1.0::DOUBLE AS covered FROM votes WHERE base AND len(agreed) = size),
merged AS (
  SELECT r, label, base, first_pos, len(list_distinct(flatten(list(agreed) OVER w))) / size AS covered FROM votes WHERE NOT base
  WINDOW w AS (PARTITION BY r, t ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND 6 FOLLOWING)),
spans AS (
  SELECT * FROM phrases UNION ALL
  SELECT r, label, base, first_pos AS start, covered::DOUBLE AS covered FROM merged WHERE covered >= 0.75),
found AS (
  SELECT r, count(*) FILTER (WHERE base)::BIGINT AS n_base, min(start) FILTER (WHERE base)::BIGINT AS first_word, max(start) FILTER (WHERE base)::BIGINT AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(covered) AS score FROM spans GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM docs LEFT JOIN found USING (r)"""

_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11_BENCHMARK_DECONTAMINATION = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(10, len(w))::BIGINT AS k FROM items WHERE len(w) > 0))),
places AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows))),
hits AS (SELECT r, i, k, item FROM places JOIN windows USING (k, win)),
words AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
found AS (SELECT r, count(DISTINCT item)::BIGINT AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(docs.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""

OP12_SOURCE_DIVERGENCE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN (SELECT lang, term FROM kept) USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
grid AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * s.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (s.total + 5 * s.v) AS q
  FROM kept k JOIN totals t USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
listed AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN apart USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM grid WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM listed)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""

OP13_PHRASE_COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), {_CAPITALS}), '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
counts AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
frequent AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND n >= 30),
cuts AS (
  SELECT f.lang, f.phrase, f.a, c, x.n AS l, y.n AS r, (2000000::HUGEINT * f.a) // (x.n + y.n) AS score
  FROM (SELECT *, unnest(range(1, k)) AS c FROM frequent) f
  JOIN counts x ON x.lang = f.lang AND x.phrase = array_to_string(f.w[1:c], ' ') JOIN counts y ON y.lang = f.lang AND y.phrase = array_to_string(f.w[c + 1:], ' ')),
best AS (SELECT lang, phrase, a, l, r, score::BIGINT AS score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_parts AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, a AS around
  FROM (SELECT lang, w, a, s, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM frequent WHERE k > 2))),
longest AS (SELECT lang, phrase, max(around) AS around FROM inner_parts GROUP BY ALL),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM best LEFT JOIN longest USING (lang, phrase) WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

ORACLES = {
    "op11_benchmark_decontamination": OP11_BENCHMARK_DECONTAMINATION,
    "op12_source_divergence": OP12_SOURCE_DIVERGENCE,
    "op13_phrase_collocations": OP13_PHRASE_COLLOCATIONS,
    "op3_source_mixing": OP3_SOURCE_MIXING,
    "op5_secret_scan": OP5_SECRET_SCAN,
    "op6_quality_rules": OP6_QUALITY_RULES,
    "op7_license_scan": OP7_LICENSE_SCAN,
}
