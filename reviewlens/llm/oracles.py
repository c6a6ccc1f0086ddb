"""SQL for DuckDB that must give the rows of the queries which SQL can express."""

from __future__ import annotations

from reviewlens.llm.pfair import BLOCK_BYTES, SLOTS, UNITS
from reviewlens.llm.risk_rules import LEVEL, RATE, RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (
  SELECT doc_id, {_SPLIT.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_ >= 75 * (na.n + nb.n - both_)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

_LADDER = ", ".join(f"('{rule}', CAST({cutoff} AS DOUBLE))" for rule, (_, ladder) in RULES.items() for cutoff in ladder)
_VALUES = " UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, '{rule}' AS rule, {measure} AS value FROM m" for rule, (measure, _) in RULES.items())
_SHARE = RATE / len(RULES)

RISK_RULES = f"""WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, {_SPLIT.format(text="coalesce(text, '')")} AS ws FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS window_ FROM places),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, window_) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
lines AS (SELECT doc_id, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup FROM (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w)),
m AS (SELECT w.doc_id, stratum, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars,
  len(t) - len(translate(t, '#*$%&|<>', '')) AS n_symbols, n_dup AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, n_lines,
  len(ws) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(ws) AS base_failed
  FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
v AS ({_VALUES}),
good AS (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1),
ladder AS (SELECT * FROM (VALUES {_LADDER}) AS x(rule, cutoff)),
tests AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (value > cutoff) AS k
  FROM v JOIN ladder USING (rule) JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY 1, 2, 3),
tails AS (SELECT *, CASE WHEN k < n * {_SHARE} THEN list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}) + (n - i) * ln(1 - {_SHARE})))) ELSE 1 END AS p FROM tests),
chosen AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tails
  WHERE p <= {LEVEL} / ((SELECT count(DISTINCT stratum) FROM tests) * (SELECT count(*) FROM ladder)) GROUP BY 1, 2),
rejected AS (SELECT DISTINCT doc_id FROM v JOIN chosen USING (stratum, rule) WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept FROM m"""

MIXTURE = f"""WITH RECURSIVE src AS (
  SELECT source, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS bytes FROM documents GROUP BY 1),
weighed AS (SELECT *, pow(CAST(bytes AS DOUBLE), 0.7) AS weight, greatest({BLOCK_BYTES}, CAST(ceil(sum(bytes) OVER () / {SLOTS}) AS BIGINT)) AS size FROM src),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS place, CAST(ceil(bytes / size) AS BIGINT) AS n,
  greatest(1, CAST(round(weight / max(weight) OVER () * {UNITS}) AS BIGINT)) AS units FROM weighed),
lists AS (SELECT list(units ORDER BY place) AS units, list(n ORDER BY place) AS n, CAST(sum(units) AS BIGINT) AS w, CAST(sum(n) AS BIGINT) AS slots FROM s),
steps(slot, done, k, time) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(n, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM lists
  UNION ALL
  SELECT slot + 1, list_transform(range(1, len(done) + 1), lambda j: done[j] + CAST(j = best AS BIGINT)), best, ends FROM (
    SELECT slot, done, ends, list_min(list_transform(list_filter(range(1, len(done) + 1), lambda j: done[j] < n[j]), lambda j: {{
      'late': CAST((done[j] * w) // units[j] >= ends AS INT), 'deadline': ((done[j] + 1) * w + units[j] - 1) // units[j], 'place': j}})).place AS best
    FROM (SELECT steps.*, lists.*, time + w / list_sum(list_transform(range(1, len(done) + 1), lambda j: CASE WHEN done[j] < n[j] THEN units[j] ELSE 0 END)) AS ends
      FROM steps, lists WHERE slot + 1 < slots))),
taken AS (SELECT k AS place, list(slot ORDER BY slot) AS slots FROM steps WHERE k > 0 GROUP BY 1),
plan AS (SELECT source, n, slots FROM s JOIN taken USING (place)),
docs AS (SELECT doc_id, source, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
placed AS (SELECT doc_id, plan.source, h, h % n AS block, slots[h % n + 1] AS slot FROM docs JOIN plan ON docs.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, source, block, slot, row_number() OVER (ORDER BY slot, h, doc_id) - 1 AS position FROM placed"""

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

SHARED_SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
n AS (SELECT count(*) AS N, CAST(sum(len(ts)) AS BIGINT) AS L FROM d WHERE len(ts) > 0),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY 1, 2),
w AS (SELECT t, CAST(floor(1000 * ln((2 * N + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, n GROUP BY t, N),
s AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ts) * N) // L)))) AS BIGINT) AS score
  FROM i JOIN p USING (t) JOIN w USING (t) JOIN d USING (r), n GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN d USING (r) WHERE score > 0)
WHERE rank <= 10"""

HARD_NEGATIVES = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
