"""DuckDB SQL for the corpus queries that SQL can express."""

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(LOW(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(LOW(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
       FROM i, LATERAL (SELECT unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS p) WHERE len(w) > 0),
ln AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
       FROM d, ln, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS p) WHERE len(w) >= n),
hit AS (SELECT doc_id, n, p, win FROM dw SEMI JOIN iw USING (n, win)),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM hit JOIN iw USING (n, win)) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
""".replace("LOW(coalesce(text, ''))", _LOW.format("coalesce(text, '')"))

OP10 = r"""
WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT *, LOW(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS key FROM l),
g AS (SELECT key, max(doc_id) AS m FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, g.key IS NOT NULL AND doc_id <> m AS lost FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id
""".replace("LOW(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))", _LOW.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"))


def op3(stop_words: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{w}'" for x in stop_words for w in dict.fromkeys((x, x.capitalize())))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 2], ' ') AS k FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 2)) AS p) WHERE len(w) >= 3),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
  len(list_filter(w, lambda x: x IN ({listed}))) AS n_stop, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha
  FROM d JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, greatest(n_words, 1)::DOUBLE AS n FROM m),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  concat_ws(',', CASE WHEN n_words < 50 THEN 'length' END, CASE WHEN 100 * n_repeat_words / n > 50 THEN 'repeats' END, CASE WHEN word_chars / n < 2.5 OR word_chars / n > 12 THEN 'word_length' END,
    CASE WHEN n_symbols / n > 0.1::DOUBLE THEN 'symbols' END, CASE WHEN n_stop / n < 0.02::DOUBLE THEN 'stop_words' END, CASE WHEN n_dup_lines / greatest(n_lines, 1)::DOUBLE > 0.5::DOUBLE THEN 'dup_lines' END,
    CASE WHEN n_alpha / n < 0.7::DOUBLE THEN 'alphabetic' END) AS failed_rules FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f
"""


OP7 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, p, md5(substring(h, 2 * p - 1, 200)) AS k FROM d, LATERAL (SELECT unnest(generate_series(1, n - 99)) AS p) WHERE n >= 100),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
edge AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM late),
span AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM edge),
gone AS (SELECT doc_id, s, min(p) AS a, max(p) + 100 AS b FROM span GROUP BY doc_id, s),
keep AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS k FROM gone),
cut AS (SELECT doc_id, string_agg(substring(h, (2 * k - 1)::BIGINT, (2 * (a - k))::BIGINT), '' ORDER BY a) || substring(any_value(h), (2 * max(b) - 1)::BIGINT) AS h, sum(b - a) AS removed, count(*) AS spans
  FROM keep JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(cut.h, d.h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS k FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 19)) AS p) WHERE len(w) >= 20),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
edge AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM late),
span AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM edge),
gone AS (SELECT doc_id, s, min(p) AS a, max(p) + 20 AS b FROM span GROUP BY doc_id, s),
keep AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS k FROM gone),
cut AS (SELECT doc_id, flatten(list(w[k:a - 1] ORDER BY a)) || any_value(w)[max(b):] AS w, sum(b - a) AS removed, count(*) AS spans FROM keep JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(array_to_string(coalesce(cut.w, d.w), ' ')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
