"""DuckDB SQL for the catalog's queries, put together from a few shared pieces."""

from __future__ import annotations

_U = "\\x{{{}}}".format
_WHITE = r"\x09-\x0D\x1C-\x20" + "".join(_U(x) for x in ("85", "A0", "1680")) + _U("2000") + "-" + _U("200A") + "".join(_U(x) for x in ("2028", "2029", "202F", "205F", "3000"))


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')"


def stamp(s: str) -> str:
    w = f"trunc({s})::BIGINT"
    return f"printf('%02d:%02d:%02d,%03d', {w} // 3600, {w} % 3600 // 60, {w} % 60, trunc(({s} - {w}) * 1000)::INTEGER)"


def seconds(t: str) -> str:
    """Well-formed h:m:s or m:s."""
    p = f"string_split({t}, ':')"
    d = lambda i: f"try_cast({p}[{i}] AS BIGINT)"
    f = lambda i: f"CASE WHEN regexp_full_match({p}[{i}], '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN {p}[{i}]::DOUBLE END"
    return f"CASE len({p}) WHEN 3 THEN {d(1)} * 3600 + {d(2)} * 60 + {f(3)} WHEN 2 THEN {d(1)} * 60 + {f(2)} ELSE 0 END"


CONV = """
conv AS (SELECT conv_id AS media_id, turn AS idx, role, text, length(coalesce(text, '')) * 66 AS dur,
  coalesce(sum(length(coalesce(text, '')) * 66) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms
  FROM conversations),
seg AS (SELECT media_id, idx, role, text, start_ms / 1000.0::DOUBLE AS s, (start_ms + dur) / 1000.0::DOUBLE AS e FROM conv)"""
LINE = """
line AS (SELECT doc_id AS media_id, (generate_subscripts(l, 1) - 1)::BIGINT AS idx, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
seg AS (SELECT media_id, idx, idx * 2.0::DOUBLE AS s, idx * 2.0::DOUBLE + 1.5::DOUBLE AS e, text FROM line)"""
EVENT = """
seg AS (SELECT user_id AS media_id, event_id AS idx, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6::DOUBLE AS s, value, event_type, event_type || props AS text FROM events)"""
SILENCE = EVENT + """,
sil AS (SELECT media_id, idx, s, s + value AS e FROM seg WHERE event_type = 'error'),
media AS (SELECT DISTINCT media_id, 2592000.0::DOUBLE AS duration FROM seg)"""
WORDS = """
wl AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS l FROM documents),
w AS (SELECT doc_id AS media_id, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS word FROM wl),
word AS (SELECT media_id, (n // 150)::INTEGER AS seg_index, (n % 150)::INTEGER AS pos, word, (n * 400) / 1000.0::DOUBLE AS s, (n * 400 + 350) / 1000.0::DOUBLE AS e FROM w)"""
FREQUENT = f"""
k AS (SELECT *, {strip("coalesce(text, '')")} AS key FROM seg),
c AS (SELECT *, count(*) OVER (PARTITION BY media_id, key) AS n, count(*) OVER (PARTITION BY media_id) AS total FROM k),
f AS (SELECT *, key <> '' AND n > 5 AND n > 0.15::DOUBLE * total AS frequent FROM c)"""


def near(source: str, thr: str) -> str:
    """Rows of ``source`` (media_id, idx, s, n) that the fold keeps, as ``kept``."""
    return f"""
o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY s, idx) AS rn FROM {source}),
walk AS (SELECT media_id, rn, idx AS held, s AS hs, n AS hn, NULL::BIGINT AS done FROM o WHERE rn = 1
  UNION ALL
  SELECT o.media_id, o.rn,
    CASE WHEN abs(o.s - hs) < {thr} AND o.n <= hn THEN held ELSE o.idx END,
    CASE WHEN abs(o.s - hs) < {thr} AND o.n <= hn THEN hs ELSE o.s END,
    CASE WHEN abs(o.s - hs) < {thr} AND o.n <= hn THEN hn ELSE o.n END,
    CASE WHEN abs(o.s - hs) < {thr} THEN NULL ELSE held END
  FROM walk JOIN o ON o.media_id = walk.media_id AND o.rn = walk.rn + 1),
kept AS (SELECT media_id, done AS idx FROM walk WHERE done IS NOT NULL
  UNION ALL SELECT media_id, held FROM (SELECT *, max(rn) OVER (PARTITION BY media_id) AS last FROM walk) WHERE rn = last)"""


_CUE = f"chr(10) || {stamp('s')} || ' --> ' || {stamp('e')} || chr(10) || {strip('text')} || chr(10) || chr(10)"
SRT = f"""
pos AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY idx) AS i FROM seg),
file AS (SELECT media_id, string_agg(i::VARCHAR || {_CUE}, '' ORDER BY i) AS content FROM pos GROUP BY media_id)"""
_SRT_ODD = "chr(10) || chr(10) || array_to_string(['7', '00:00:01,000 -->  00:00:02,000', 'two blanks', '', '', '', '8', '00:00:03,000 --> 00:00:04,000 X1:10 X2:20', 'placed', '', '9', '00:00:05,000 --> 00:00:06,000', '', '10', 'no time', 'x', ''], chr(10))"
_VTT_ODD = "array_to_string(['', '', '', 'NOTE as a cue', '00:01:00.000 --> 00:01:01.000', 'kept', '', 'NOTE', '00:02:00.000 --> 00:02:01.000', 'gone', '', ' 00:03:00.000 --> 00:03:01.000' || chr(9) || 'line:0', 'tab'], chr(10))"
_VTT_TIME = lambda x: f"replace({stamp(x)}, ',', '.')"
VTT = f"""
cue AS (SELECT media_id, idx, CASE WHEN idx % 7 = 3 THEN {_VTT_TIME('s')} || ' --> x1:00' WHEN idx % 7 = 5 THEN 'no time here'
    ELSE {_VTT_TIME('s')} || ' --> ' || {_VTT_TIME('e')} || ' align:start position:0%' END || chr(10) || text AS block FROM seg),
file AS (SELECT media_id, 'WEBVTT' || chr(10) || chr(10) || 'NOTE made here' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY idx) || {_VTT_ODD} AS content FROM cue GROUP BY media_id)"""
_BLOCKS = f"""
b AS (SELECT media_id, generate_subscripts(l, 1) AS pos, unnest(l) AS block FROM (SELECT media_id, string_split_regex({strip('content')}, '%s') AS l FROM file)),
l AS (SELECT media_id, pos, string_split(%s, chr(10)) AS l FROM b)"""
MERGED = f"""
u AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY idx) - 1 AS i FROM seg WHERE role = 'user'),
a AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY idx) - 1 AS i FROM seg WHERE role = 'assistant'),
m AS (SELECT coalesce(u.media_id, a.media_id) AS media_id, coalesce(u.i, a.i)::BIGINT AS idx, coalesce(u.s, a.s) AS s, coalesce(u.e, a.e) AS e,
  concat_ws(chr(10), nullif({strip('a.text')}, ''), nullif({strip('u.text')}, '')) AS text FROM u FULL JOIN a ON u.media_id = a.media_id AND u.i = a.i)"""
PACK = """
flag AS (SELECT *, CASE WHEN suffix(word, '。') OR suffix(word, '？') OR suffix(word, '！') OR suffix(word, '，') OR suffix(word, '.') OR suffix(word, '!') OR suffix(word, '?')
  OR suffix(word, ',') OR suffix(word, 'ครับ') OR suffix(word, 'ค่ะ') THEN 1 ELSE 0 END AS closes FROM word),
walk AS (SELECT media_id, seg_index, pos, 1 AS n, 0 AS line FROM flag WHERE pos = 0
  UNION ALL
  SELECT f.media_id, f.seg_index, f.pos, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN line + 1 ELSE line END
  FROM (SELECT walk.*, walk.n >= 12 OR (walk.n >= 5 AND g.closes = 1) AS cut FROM walk JOIN flag g USING (media_id, seg_index, pos)) q
  JOIN flag f ON f.media_id = q.media_id AND f.seg_index = q.seg_index AND f.pos = q.pos + 1)"""
BATCHED = """
bt AS (SELECT *, (idx // 15)::BIGINT AS batch_no, (idx % 15)::INTEGER AS local_id FROM seg),
lists AS (SELECT media_id, batch_no, list(text ORDER BY local_id) AS t FROM bt GROUP BY ALL),
ctx AS (SELECT media_id, batch_no, nullif(lag(array_to_string(t[-3:], chr(10))) OVER (PARTITION BY media_id ORDER BY batch_no), '') AS context FROM lists)"""
NATURAL_TARGET = "CASE WHEN ascii(right(source, 1)) % 2 = 0 THEN 'de' ELSE 'Simplified Chinese' END"

ORACLE = {
    "q01_format_ts": f"SELECT event_id, {stamp('value * 60')} AS stamp FROM events",
    "q02_parse_ts_roundtrip": f"""WITH t AS (SELECT event_id, {stamp('value * 60')} AS stamp FROM events)
SELECT event_id, {seconds("replace(stamp, ',', '.')")}::DOUBLE AS srt_seconds, {seconds("replace(stamp[4:], ',', '.')")}::DOUBLE AS short_seconds,
  (CASE WHEN event_id % 2 = 0 THEN 0 END)::DOUBLE AS wrong_seconds FROM t""",
    "q03_srt_render": f"WITH {CONV}, {SRT} SELECT media_id, content FROM file",
    "q04_srt_parse": f"""WITH {CONV}, {SRT.replace("'' ORDER BY i) AS content", f"'' ORDER BY i) || {_SRT_ODD} AS content")}, {_BLOCKS % ("\\n\\n+", strip("block"))},
t AS (SELECT media_id, pos, string_split(l[2], ' --> ') AS t, array_to_string(l[3:], chr(10)) AS text FROM l WHERE len(l) >= 3 AND contains(l[2], '-->'))
SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY pos) - 1)::BIGINT AS idx, {seconds("replace(t[1], ',', '.')")}::DOUBLE AS "start", {seconds("replace(t[2], ',', '.')")}::DOUBLE AS "end", text FROM t""",
    "q05_vtt_parse": f"""WITH {CONV}, {VTT}, {_BLOCKS % ("\\n\\n", "block")},
k AS (SELECT media_id, pos, l, list_position(list_transform(l, lambda x: contains(x, '-->')), true) AS tl FROM l WHERE {strip("l[1]")} <> 'WEBVTT' AND NOT starts_with(l[1], 'NOTE')),
t AS (SELECT media_id, pos, string_split(l[tl], ' --> ') AS t, {strip("array_to_string(l[tl + 1:], chr(10))")} AS text FROM k WHERE tl > 0),
r AS (SELECT media_id, pos, {seconds("t[1]")}::DOUBLE AS s, {seconds("string_split(t[2], ' ')[1]")}::DOUBLE AS e, text FROM t WHERE len(t) = 2)
SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY pos) - 1)::BIGINT AS idx, s AS "start", e AS "end", text FROM r WHERE s IS NOT NULL AND e IS NOT NULL""",
    "q06_bilingual_merge": f"""WITH {CONV}, {MERGED} SELECT media_id, idx, s AS "start", e AS "end", text, {stamp('s')} AS start_stamp FROM m""",
    "q07_freq_outlier": f"WITH {LINE}, {FREQUENT} SELECT media_id, idx, text FROM f WHERE NOT frequent",
    "q08_run_collapse": f"""WITH {LINE}, k AS (SELECT *, {strip("coalesce(text, '')")} AS key FROM seg),
r AS (SELECT *, lag(key) OVER (PARTITION BY media_id ORDER BY idx) AS before FROM k) SELECT media_id, idx, text FROM r WHERE key IS DISTINCT FROM before""",
    "q09_filter_full": f"""WITH {LINE}, {FREQUENT},
r AS (SELECT *, lag(key) OVER (PARTITION BY media_id ORDER BY idx) AS before FROM f WHERE key <> '' AND NOT frequent)
SELECT media_id, idx, text FROM r WHERE key IS DISTINCT FROM before""",
    "q10_near_dup": f"""WITH RECURSIVE {EVENT}, x AS (SELECT media_id, idx, s, length({strip('text')}) AS n FROM seg), {near('x', '14400.0::DOUBLE')} SELECT media_id, idx, s AS "start", text FROM seg JOIN kept USING (media_id, idx)""",
    "q11_gap_complement": f"""WITH {SILENCE},
g AS (SELECT media_id, lag(e, 1, 0.0::DOUBLE) OVER w AS a, s AS b, row_number() OVER w AS rn FROM sil WINDOW w AS (PARTITION BY media_id ORDER BY s, idx)),
lastend AS (SELECT media_id, arg_max(e, {{'s': s, 'i': idx}}) AS a FROM sil GROUP BY media_id),
gaps AS (SELECT media_id, a, b FROM g WHERE b > a AND NOT (rn = 1 AND b < 0.1::DOUBLE)
  UNION ALL SELECT media_id, coalesce(a, 0), duration FROM media LEFT JOIN lastend USING (media_id) WHERE duration > coalesce(a, 0)),
p AS (SELECT media_id, greatest(0, trunc(a * 1000)::BIGINT - 200)::BIGINT AS start_ms, least(trunc(duration * 1000)::BIGINT, trunc(b * 1000)::BIGINT + 200)::BIGINT AS end_ms FROM gaps JOIN media USING (media_id))
SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms) - 1)::INTEGER AS seg_index, start_ms, end_ms FROM p WHERE end_ms > start_ms""",
    "q12_fixed_windows": """WITH s AS (SELECT doc_id AS media_id, 0::BIGINT AS a, n_chars * 100 AS b FROM documents),
w AS (SELECT media_id, a, b, unnest(generate_series(a, b - 1, 50000)) AS ws FROM s WHERE b > a)
SELECT media_id, ws AS w_start, least(ws + 60000, b) AS w_end FROM w WHERE least(ws + 60000, b) - ws >= 5000 OR ws = a""",
    "q13_split_long": """WITH s AS (SELECT doc_id AS media_id, doc_id * 1000 AS a, doc_id * 1000 + n_chars * 100 AS b FROM documents),
w AS (SELECT media_id, a, b, unnest(CASE WHEN b - a <= 59000 THEN [a] ELSE generate_series(a, b - 1, 49000) END) AS ws FROM s),
x AS (SELECT media_id, a, ws, CASE WHEN b - a <= 59000 THEN b ELSE least(ws + 59000, b) END AS we FROM w)
SELECT media_id, ws AS w_start, we AS w_end FROM x WHERE we - ws >= 5000 OR ws = a""",
    "q14_equal_split": """WITH f AS (SELECT doc_id AS media_id, n_chars * 20000 AS size, n_chars / 15.0::DOUBLE AS duration FROM documents),
n AS (SELECT *, CASE WHEN size <= 24 * 1048576.0::DOUBLE THEN 1 ELSE ceil(size / 1048576.0::DOUBLE / 20) END::BIGINT AS n_parts FROM f),
p AS (SELECT *, unnest(generate_series(0, n_parts - 1)) AS part FROM n)
SELECT media_id, part, n_parts, part * (duration / n_parts) AS part_start, duration / n_parts AS part_seconds FROM p""",
    "q15_batches": f"WITH {LINE}, {BATCHED} SELECT media_id, idx, batch_no, local_id FROM bt",
    "q16_context": f"WITH {LINE}, {BATCHED} SELECT media_id, batch_no, context FROM ctx",
    "q17_request_json": f"""WITH {LINE}, {BATCHED} SELECT l.media_id, l.batch_no, context IS NOT NULL AS has_context, context, len(t)::INTEGER AS n_segments, len(t) - 1 AS last_id, t[1] AS first_text, t[-1] AS last_text FROM lists l JOIN ctx USING (media_id, batch_no)""",
    "q18_realign_fallback": f"""WITH {LINE}, {BATCHED} SELECT media_id, idx, s AS "start", e AS "end", local_id % 5 <> 3 AS from_batch,
CASE WHEN local_id % 5 <> 3 THEN '[x] ' || text WHEN local_id % 10 = 3 AND {strip('text')} <> '' THEN '(' || text || ')' ELSE text END AS text FROM bt""",
    "q19_word_pack": f"""WITH RECURSIVE {WORDS}, {PACK}
SELECT media_id, seg_index, line, arg_min(s, pos) AS "start", CASE WHEN arg_max(e, pos) <= arg_min(s, pos) THEN arg_min(s, pos) + 2.0 ELSE arg_max(e, pos) END AS "end", string_agg(word, ' ' ORDER BY pos) AS text, count(*)::INTEGER AS n_words
FROM walk JOIN word USING (media_id, seg_index, pos) GROUP BY media_id, seg_index, line""",
    "q20_offset_prefix": f"""WITH {CONV} SELECT media_id, idx, coalesce(sum(dur) OVER (PARTITION BY media_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ms,
(0.5::DOUBLE + coalesce(sum(dur) OVER (PARTITION BY media_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT / 1000.0::DOUBLE) AS "start" FROM conv""",
    "q21_pick_subtitle": f"""WITH c AS (SELECT source, lang AS code, min(doc_id) AS pos FROM documents GROUP BY ALL),
t AS (SELECT *, {NATURAL_TARGET} AS target FROM c),
r AS (SELECT *, CASE WHEN contains(lower(code), lower(target)) OR (contains(target, 'Chinese') AND code IN ('zh-Hans', 'zh-CN', 'zh-SG', 'zh-Hans-CN')) THEN 0 WHEN code IN ('en', 'en-US', 'ja', 'ko') THEN 1 ELSE 2 END AS tier,
  coalesce(list_position(['en', 'en-US', 'ja', 'ko'], code), 0) AS prio FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tier, CASE WHEN tier = 1 THEN prio ELSE 0 END, pos) AS rn FROM r)
SELECT source AS media_id, code, tier::INTEGER AS tier, CASE WHEN contains(target, 'Chinese') THEN code IN ('zh-Hans', 'zh-CN', 'zh-SG', 'zh-Hans-CN', 'zh') ELSE contains(lower(code), lower(target)) END AS skip FROM p WHERE rn = 1""",
    "q22_sanitize_title": f"""SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^\\p{{L}}\\p{{Nd}}\\x{{B2}}\\x{{B3}}\\x{{B9}}\\x{{2070}}\\x{{2074}}-\\x{{2079}}\\x{{2080}}-\\x{{2089}}\\x{{2460}}-\\x{{2468}} ]', '', 'g'), '[{_WHITE}]+$', '') AS title FROM pages""",
    "q23_positional_zip": f"""WITH {EVENT}, media AS (SELECT DISTINCT media_id, 2592000.0::DOUBLE AS duration FROM seg),
a AS (SELECT media_id, s, row_number() OVER (PARTITION BY media_id ORDER BY idx) - 1 AS n FROM seg WHERE event_type = 'error'),
z AS (SELECT media_id, s AS e, row_number() OVER (PARTITION BY media_id ORDER BY idx) - 1 AS n FROM seg WHERE event_type = 'signup'),
k AS (SELECT media_id, na, coalesce(nz, 0) AS nz FROM (SELECT media_id, count(*) AS na FROM a GROUP BY 1) LEFT JOIN (SELECT media_id, count(*) AS nz FROM z GROUP BY 1) USING (media_id)),
z2 AS (SELECT media_id, e, n FROM z UNION ALL SELECT media_id, duration, nz FROM k JOIN media USING (media_id) WHERE na > nz)
SELECT media_id, n::INTEGER AS pos, s AS s_start, e AS s_end FROM a JOIN z2 USING (media_id, n)""",
    "q24_coalesce_config": """WITH p AS (SELECT event_id, (props::JSON ->> 'k')::INTEGER AS k, event_type FROM events)
SELECT event_id, coalesce(nullif(CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN 'env' END, ''), nullif(CASE WHEN k % 2 = 0 THEN 'file' ELSE '' END, ''), 'default') AS setting,
CASE event_type WHEN 'view' THEN 'th-TH' WHEN 'click' THEN 'ja-JP' WHEN 'signup' THEN 'zh-CN' ELSE 'en-US' END AS code FROM p""",
    "q25_first_existing": """WITH f AS (SELECT 'm' || (page_id % 40) AS key, 'm' || (page_id % 40) || '/' || page_id || ['.mp3', '.m4a', '.wav', '.opus', '.webm', '.txt'][page_id * 7 % 6 + 1] AS path, page_id * 7 % 6 AS rank, page_id % 3 AS length FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, path) AS rn FROM f WHERE rank < 5 AND length > 0) SELECT key, path, rank::INTEGER AS rank FROM r WHERE rn = 1""",
    "q26_percent_parse": """SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 2 THEN 'x%' ELSE (event_id % 101)::VARCHAR || '.' || (event_id % 10)::VARCHAR || '%' END AS percent_text,
CASE WHEN event_id % 5 IN (0, 1) THEN ((event_id % 101)::VARCHAR || '.' || (event_id % 10)::VARCHAR)::DOUBLE END AS percent,
CASE event_id % 5 WHEN 3 THEN 0.0 WHEN 4 THEN NULL ELSE ((event_id % 60)::VARCHAR || '.' || (event_id % 10)::VARCHAR)::DOUBLE END AS duration FROM events""",
    "q27_asr_json_flatten": f"""WITH {WORDS} SELECT media_id, seg_index, pos, word, s AS "start", e AS "end" FROM word""",
    "q29_silence_log": f"""WITH {EVENT}, n AS (SELECT media_id, idx, event_id_ms, event_type FROM (SELECT media_id, idx, (idx % 100000) AS event_id_ms, event_type FROM seg)),
a AS (SELECT media_id, event_id_ms + 0.5::DOUBLE AS s, row_number() OVER (PARTITION BY media_id ORDER BY idx) - 1 AS n FROM n WHERE event_type = 'error'),
z AS (SELECT media_id, event_id_ms + 0.25::DOUBLE AS e, row_number() OVER (PARTITION BY media_id ORDER BY idx) - 1 AS n FROM n WHERE event_type = 'view'),
k AS (SELECT media_id, na, coalesce(nz, 0) AS nz FROM (SELECT media_id, count(*) AS na FROM a GROUP BY 1) LEFT JOIN (SELECT media_id, count(*) AS nz FROM z GROUP BY 1) USING (media_id)),
z2 AS (SELECT media_id, e, n FROM z UNION ALL SELECT media_id, 3723.5, nz FROM k WHERE na > nz)
SELECT media_id, n::INTEGER AS pos, s AS s_start, e AS s_end FROM a JOIN z2 USING (media_id, n)""",
}

ORACLE["q28_end_to_end"] = f"""WITH RECURSIVE {CONV},
total AS (SELECT media_id, max(start_ms + dur) AS b FROM conv GROUP BY 1),
win AS (SELECT media_id, b, unnest(generate_series(0, b - 1, 10000)) AS ws FROM total WHERE b > 0),
w AS (SELECT media_id, ws, least(ws + 20000, b) AS we, row_number() OVER (PARTITION BY media_id ORDER BY ws) - 1 AS seg_index FROM win WHERE least(ws + 20000, b) - ws >= 5000 OR ws = 0),
hit AS (SELECT w.media_id, w.seg_index, c.start_ms, c.dur, c.text, ws FROM w JOIN conv c ON c.media_id = w.media_id AND c.start_ms >= ws AND c.start_ms < we),
got AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY ws / 1000.0::DOUBLE + (start_ms - ws) / 1000.0::DOUBLE, seg_index, start_ms) - 1 AS idx,
  ws / 1000.0::DOUBLE + (start_ms - ws) / 1000.0::DOUBLE AS s, ws / 1000.0::DOUBLE + (start_ms - ws + dur) / 1000.0::DOUBLE AS e, text FROM hit),
x AS (SELECT media_id, idx, s, length({strip('text')}) AS n FROM got), {near('x', '1.0::DOUBLE')},
seg2 AS (SELECT got.* FROM got JOIN kept USING (media_id, idx)),
k2 AS (SELECT *, {strip('text')} AS key FROM seg2),
c2 AS (SELECT *, count(*) OVER (PARTITION BY media_id, key) AS n, count(*) OVER (PARTITION BY media_id) AS tot FROM k2),
r2 AS (SELECT *, lag(key) OVER (PARTITION BY media_id ORDER BY idx) AS before FROM c2 WHERE key <> '' AND NOT (n > 5 AND n > 0.15::DOUBLE * tot)),
f2 AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY idx) - 1 AS idx, s, e, text FROM r2 WHERE key IS DISTINCT FROM before),
tr AS (SELECT *, CASE WHEN idx % 15 % 5 <> 3 THEN '[x] ' || text WHEN length(text) % 2 = 1 THEN {strip("'(' || text || ')'")} ELSE text END AS t FROM f2)
SELECT media_id, idx, s AS "start", e AS "end", concat_ws(chr(10), nullif({strip('t')}, ''), nullif({strip('text')}, '')) AS text FROM tr"""

ORACLE["q30_standard_path"] = f"""WITH {CONV},
media AS (SELECT media_id, max(start_ms + dur) / 1000.0::DOUBLE AS duration, max(start_ms + dur) * 4000 AS size FROM conv GROUP BY 1 HAVING max(start_ms + dur) > 0),
n AS (SELECT *, CASE WHEN size <= 24 * 1048576.0::DOUBLE THEN 1 ELSE ceil(size / 1048576.0::DOUBLE / 20) END::BIGINT AS n_parts FROM media),
p AS (SELECT media_id, part, part * (duration / n_parts) AS a, duration / n_parts AS sec FROM (SELECT *, unnest(generate_series(0, n_parts - 1)) AS part FROM n)),
o AS (SELECT *, coalesce(sum(trunc(sec * 1000)::BIGINT) OVER (PARTITION BY media_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM p),
hit AS (SELECT o.media_id, part, start_ms, dur, text, off / 1000.0::DOUBLE + (start_ms / 1000.0::DOUBLE - a) AS s, off / 1000.0::DOUBLE + ((start_ms + dur) / 1000.0::DOUBLE - a) AS e
  FROM o JOIN conv c ON c.media_id = o.media_id AND c.start_ms >= a * 1000 AND c.start_ms < (a + sec) * 1000),
seg2 AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY part, start_ms, dur, text) AS idx, {strip("coalesce(text, '')")} AS key FROM hit),
c2 AS (SELECT *, count(*) OVER (PARTITION BY media_id, key) AS n, count(*) OVER (PARTITION BY media_id) AS tot FROM seg2),
r2 AS (SELECT *, lag(key) OVER (PARTITION BY media_id ORDER BY idx) AS before FROM c2 WHERE key <> '' AND NOT (n > 5 AND n > 0.15::DOUBLE * tot))
SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY idx) - 1)::BIGINT AS idx, s AS "start", e AS "end", text FROM r2 WHERE key IS DISTINCT FROM before"""

ORACLE["q31_no_speech"] = f"""WITH {LINE}, {FREQUENT},
r AS (SELECT *, lag(key) OVER (PARTITION BY media_id ORDER BY idx) AS before FROM f WHERE key <> '' AND NOT frequent AND coalesce(CASE WHEN idx % 13 < 12 THEN (idx % 13) / 10.0::DOUBLE END, 0) <= 0.9::DOUBLE)
SELECT media_id, idx, text FROM r WHERE key IS DISTINCT FROM before"""

ORACLE["q32_retries"] = f"""WITH {LINE}, {BATCHED},
k AS (SELECT media_id, batch_no, count(*) AS n, count(*) FILTER (WHERE local_id % 5 <> 3) AS answered FROM bt WHERE text IS NOT NULL GROUP BY ALL)
SELECT media_id, batch_no, CASE WHEN n = 1 THEN 1 ELSE 3 END::INTEGER AS attempts, NULL::VARCHAR AS error, answered, answered = n AS complete FROM k"""

ORACLE["q33_dispatch"] = f"""SELECT * FROM ({ORACLE["q05_vtt_parse"]}) WHERE media_id % 3 = 0 UNION ALL SELECT * FROM ({ORACLE["q04_srt_parse"]}) WHERE media_id % 3 <> 0"""

ORACLE["q34_spoken_lines"] = f"""WITH {CONV}
SELECT media_id, idx::INTEGER AS seg_index, 0 AS pos, CASE WHEN idx % 2 = 1 THEN s ELSE 0.5::DOUBLE + s END AS "start", CASE WHEN idx % 2 = 1 THEN e ELSE 0.5::DOUBLE + s + 2.0::DOUBLE END AS "end",
  CASE WHEN idx % 2 = 1 THEN {strip("coalesce(text, '') || '  end '")} ELSE 'w' || idx || ' b.' END AS text FROM seg"""
