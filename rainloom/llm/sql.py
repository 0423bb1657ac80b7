"""SQL of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from .common import UPPER
from .line_dedup import MIN_SITES
from .mixing import SEED, WEIGHTS
from .quality import MAX_HOST_RATE, PRIOR

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT r, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c) AS n FROM g WHERE c IS NOT NULL),
p AS (SELECT DISTINCT r, i + k AS i FROM f, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
n AS (SELECT r, count(*) AS n FROM p GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (
  SELECT d.r, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l ON l.r = d.r LEFT JOIN n ON n.r = d.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed) AS DOUBLE) AS k FROM b GROUP BY source),
t AS (SELECT sum(n) AS n, sum(k) / sum(n) AS m, CAST(count(*) AS DOUBLE) AS c FROM h),
v AS (SELECT t.m, sum(h.n * (h.k / h.n - t.m) * (h.k / h.n - t.m)) / any_value(t.n) - t.m * (1 - t.m) * any_value(t.c) / any_value(t.n) AS between_hosts FROM h, t GROUP BY t.m),
q AS (SELECT m, CASE WHEN between_hosts <= 0 THEN {PRIOR[1]!r} ELSE least({PRIOR[1]!r}, greatest({PRIOR[0]!r}, m * (1 - m) / between_hosts - 1)) END AS s FROM v),
x AS (SELECT source, (k + m * s) / (n + s) > {MAX_HOST_RATE} AS host_rejected FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_rejected AS kept, host_rejected
FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source
"""

OP7 = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) AS s FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, s AS text_sha256
FROM d WINDOW w AS (PARTITION BY s)
"""

OP10 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INT)] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
c AS (
  SELECT *, CASE WHEN size < 128 THEN size ELSE (length(bin(size)) - 7) * 64 + (size >> (length(bin(size)) - 7)) END AS class,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % CAST(greatest(1, ceil(sqrt((SELECT count(*) FROM documents) / 1000.0))) AS BIGINT) AS deal
  FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, deal, size, doc_id) AS rank FROM c),
e AS (
  SELECT r.*, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS expected,
    CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(r.source, '?')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(floor(rank * expected + u) - floor((rank - 1) * expected + u) AS BIGINT) AS copies FROM e)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM k
"""

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
w AS (
  SELECT line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line
  HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) >= {MIN_SITES}),
c AS (
  SELECT r, count(*) FILTER (WHERE regexp_matches(l.line, '[^\x20\x09-\x0D]')) AS n_lines, count(w.line) AS n_removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE w.line IS NULL), '') AS text
  FROM l LEFT JOIN w ON l.line = w.line GROUP BY r)
SELECT doc_id, n_lines, n_removed, sha256(c.text) AS text_sha256 FROM d JOIN c ON c.r = d.r
"""

SQL = {"op8_line_dedup": OP8, "op2_quality_rules": OP2, "op7_exact_dedup": OP7, "op10_mixing": OP10}
