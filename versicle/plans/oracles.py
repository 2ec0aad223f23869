"""DuckDB SQL of the registered queries that SQL can express."""

from ..functions import titles

HELD = "\ue000"

_SENTENCES = rf"""
h AS (SELECT doc_id, source, lang, regexp_replace(text, '\b(Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|Mme|Mlle)\.', '\1{HELD}', 'g') AS t FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, source, lang, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS pos FROM (
  SELECT doc_id, source, lang, regexp_extract_all(t, '[.!? \t\n\r\f]*[^.!? \t\n\r\f][^.!?]*(?:[.!?]+["'']?|\z)') AS ms FROM h)),
c AS (SELECT *, ltrim(m, '.!? ' || chr(9) || chr(10) || chr(12) || chr(13)) AS core, sum(length(m)) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM m),
s AS (SELECT doc_id, source, lang, pos, CAST(upto - length(core) AS BIGINT) AS char_start,
  CAST(upto - length(core) + length(rtrim(core, ' ' || chr(9) || chr(10) || chr(12) || chr(13))) AS BIGINT) AS char_end,
  replace(rtrim(core, ' ' || chr(9) || chr(10) || chr(12) || chr(13)), '{HELD}', '.') AS text FROM c)
"""

_EVENTS = """
e AS (
  SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
    CAST(floor((epoch_ms(ts) - min(epoch_ms(ts)) OVER (PARTITION BY user_id)) / 60000) AS BIGINT) AS start_ms,
    CAST(floor(coalesce(value, 0.0) * 20) AS BIGINT) AS len
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
), tl AS (SELECT user_id, event_id, event_type, pos, start_ms, start_ms + len AS end_ms FROM e)
"""

_HMS = lambda c: f"printf('%02d:%02d:%02d.%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"

_REASONS = titles.SECTIONS  # fixed values, kept there
_QUOTE = lambda x: "'" + x.replace("'", "''") + "'"
_TITLES = [
    "Chapter", "Contents of", "Dramatis Personae", "All Rights Reserved", "Half Title", "Dedication", "Epigraph", "Books by", "Timeline", "Appendix",
    "About the Author", "Colophon", "Glossary", "Footnotes", "Preview", "Contentsof", "Part", "Notes", "Prologue", "TOC", "Act",
]
_ESC = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

SQL: dict[str, str] = {
    "sentence_spans": f"WITH {_SENTENCES} SELECT doc_id, pos, char_start, char_end, text FROM s",
    "sentence_ids": f"WITH {_SENTENCES} SELECT source, doc_id, pos, printf('mo_s_%04d', row_number() OVER (PARTITION BY source ORDER BY doc_id, pos)) AS element_id, char_start, char_end FROM s",
    "word_tokens": r"""
SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (
  SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\s\x{2014}\x{2013}]+'), lambda x: x <> '') AS w FROM conversations)""",
    "word_norm": r"""
SELECT norm, count(*) AS n FROM (
  SELECT regexp_replace(lower(w), '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g') AS norm FROM (
    SELECT unnest(regexp_split_to_array(text, '[\s\x{2014}\x{2013}]+')) AS w FROM conversations)) WHERE norm <> '' GROUP BY norm""",
    "section_reasons": "WITH t AS (SELECT p_partkey, p_size, ["
    + ", ".join(map(_QUOTE, _TITLES))
    + f"""][p_partkey % {len(_TITLES)} + 1] || ' ' || p_name AS title,
  CASE WHEN p_size % 7 = 0 THEN '''' || p_name || ''' - ' || p_brand ELSE p_type END AS preview,
  CASE WHEN p_size % 11 = 0 THEN ['toc', 'copyright-page', 'cover', 'text'][p_partkey % 4 + 1] ELSE '' END AS g FROM part)
SELECT p_partkey, title, CASE WHEN contains(g, 'toc') THEN 'detected front-matter TOC' WHEN contains(g, 'copyright') THEN 'detected front-matter Copyright'
  WHEN contains(g, 'cover') THEN 'detected OPF guide/landmark ''cover''' """
    + " ".join(rf"WHEN regexp_matches(lower(title), '\b({p})\b') THEN {_QUOTE(r)}" for p, r in _REASONS)
    + r""" WHEN regexp_matches(title || ' ' || preview, '[‘''"](?s:.{5,})[’''"]\s*[—-]') OR regexp_matches(lower(preview), '\bepigraph\b') THEN 'detected front-matter Epigraph'
  WHEN regexp_matches(lower(preview), '\bdramatis personae\b') THEN 'detected front-matter Dramatis Personae' END AS reason FROM t""",
    "timeline_continuous": f"""WITH {_EVENTS}
SELECT user_id, pos, printf('par_%04d', pos) AS par_id, CASE WHEN pos = 1 THEN 0 ELSE greatest(start_ms, lag(end_ms) OVER w) END AS clip_start,
  greatest(end_ms, coalesce(lead(start_ms) OVER w, end_ms)) AS clip_end FROM tl WINDOW w AS (PARTITION BY user_id ORDER BY pos)""",
    "clip_faults": f"""WITH {_EVENTS}, f AS (
  SELECT user_id, pos, CASE WHEN start_ms < 0 OR end_ms - 30 < 0 THEN 'negative' WHEN end_ms - 30 < start_ms THEN 'backward'
    WHEN start_ms < lag(start_ms) OVER (PARTITION BY user_id ORDER BY pos) THEN 'order' END AS fault FROM tl)
SELECT * FROM f WHERE fault IS NOT NULL""",
    "timeline_clamp": f"""WITH RECURSIVE {_EVENTS}, d AS (SELECT user_id, max(start_ms) + 100 AS duration FROM tl GROUP BY user_id),
r AS (
  SELECT user_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS start_ms, CAST(0 AS BIGINT) AS end_ms FROM d
  UNION ALL
  SELECT user_id, pos, a AS start_ms, CASE WHEN duration > a AND b > duration THEN duration ELSE b END AS end_ms FROM (
    SELECT user_id, pos, duration, a, CASE WHEN e > a THEN e ELSE a + 50 END AS b FROM (
      SELECT r.user_id, tl.pos, d.duration, greatest(tl.start_ms, r.end_ms) AS a, tl.end_ms AS e
      FROM r JOIN tl ON tl.user_id = r.user_id AND tl.pos = r.pos + 1 JOIN d ON d.user_id = r.user_id)))
SELECT * FROM r WHERE pos > 0""",
    "timeline_validate": f"""WITH {_EVENTS}, x AS (
  SELECT *, lag(start_ms) OVER w AS ps, lag(end_ms) OVER w AS pe, row_number() OVER (PARTITION BY user_id, event_id % 5000 ORDER BY pos) AS nth
  FROM tl WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, pos, unnest(list_filter([CASE WHEN nth > 1 THEN 2 END, CASE WHEN event_id % 97 = 0 OR event_type IS NULL THEN 3 END,
  CASE WHEN start_ms < 0 OR end_ms < 0 THEN 5 END, CASE WHEN end_ms <= start_ms THEN 6 END, CASE WHEN start_ms < ps THEN 7 END,
  CASE WHEN start_ms < pe THEN 8 END], lambda v: v IS NOT NULL)) AS rule_no FROM x""",
    "gap_interpolate": f"""WITH {_EVENTS}, i AS (
  SELECT user_id, pos, event_type <> 'error' AS timed, start_ms / 1000 AS s, greatest(end_ms / 1000, start_ms / 1000 + 0.05::DOUBLE) AS e,
    greatest(event_id % 40, 1) AS chars, max(end_ms) OVER (PARTITION BY user_id) / 1000 AS duration FROM tl
), g AS (
  SELECT *, sum(timed::INT) OVER w AS run, coalesce(last_value(CASE WHEN timed THEN e END IGNORE NULLS) OVER w, 0) AS lft,
    first_value(CASE WHEN timed THEN s END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rgt
  FROM i WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
), h AS (
  SELECT *, count(*) OVER r AS size, sum(chars) OVER r AS total, row_number() OVER (PARTITION BY user_id, run, timed ORDER BY pos) AS nth
  FROM g WINDOW r AS (PARTITION BY user_id, run, timed)
), k AS (
  SELECT *, greatest(chars / CAST(total AS DOUBLE) * greatest(size * 0.05::DOUBLE, coalesce(rgt, CASE WHEN duration > lft THEN duration ELSE lft + 2.0 * size END) - lft), 0.05::DOUBLE) AS share FROM h
), l AS (
  SELECT *, sum(CASE WHEN nth = 1 THEN lft + share ELSE share END) OVER (PARTITION BY user_id, run, timed ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM k
)
SELECT user_id, pos, CAST(round_even((CASE WHEN timed THEN s ELSE coalesce(lag(upto) OVER (PARTITION BY user_id, run, timed ORDER BY pos), lft) END) * 1000, 0) AS BIGINT) AS start_ms,
  CAST(round_even((CASE WHEN timed THEN e ELSE upto END) * 1000, 0) AS BIGINT) AS end_ms FROM l""",
    "durations_rollup": f"""WITH {_EVENTS}, c AS (
  SELECT user_id % 10 AS book_id, user_id, max(end_ms) AS duration_ms, count(*) AS par_count FROM tl GROUP BY ALL
), r AS (
  SELECT book_id, user_id, duration_ms, par_count FROM c
  UNION ALL SELECT book_id, CAST(-1 AS BIGINT), CAST(sum(duration_ms) AS BIGINT), CAST(sum(par_count) AS BIGINT) FROM c GROUP BY book_id)
SELECT *, {_HMS("duration_ms")} AS clock FROM r""",
    "last_clip_end": f"WITH {_EVENTS} SELECT user_id, arg_max(end_ms, pos) AS duration_ms FROM tl GROUP BY user_id",
    "clocks": f"""WITH {_EVENTS}
SELECT event_id, printf('%d.%03ds', start_ms // 1000, start_ms % 1000) AS smil, {_HMS("start_ms * 61")} AS hms, start_ms * 61 AS parsed_ms, start_ms AS smil_ms FROM tl WHERE start_ms >= 0""",
    "positional_map": """
WITH c AS (SELECT n_regionkey AS book_id, n_nationkey AS chapter_pos, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rank FROM nation),
u AS (SELECT s_suppkey % 5 AS book_id, s_suppkey AS unit_pos, row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey) AS rank FROM supplier)
SELECT CAST(coalesce(c.book_id, u.book_id) AS BIGINT) AS book_id, coalesce(c.rank, u.rank) AS rank, CAST(coalesce(chapter_pos, -1) AS BIGINT) AS chapter_pos, CAST(coalesce(unit_pos, -1) AS BIGINT) AS unit_pos FROM c FULL JOIN u ON c.book_id = u.book_id AND c.rank = u.rank""",
    "manual_map": """
WITH c AS (SELECT n_regionkey AS book_id, n_nationkey AS p, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i,
  count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)
SELECT a.book_id, a.i AS chapter_index, b.i AS unit_index, a.p AS chapter_pos, b.p AS unit_pos FROM c a JOIN c b ON a.book_id = b.book_id AND a.i + b.i = a.n - 1""",
    "span_overlap": f"""WITH {_SENTENCES}, g AS (
  SELECT doc_id, generate_subscripts(ls, 1) - 1 AS seg_pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
), z AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY seg_pos) AS upto FROM g),
y AS (SELECT doc_id, seg_pos, upto - length(line) - 1 AS a, upto - 1 AS b FROM z)
SELECT y.doc_id, seg_pos, 's' || pos AS element_id, CAST(greatest(a, char_start) - a AS BIGINT) AS "from", CAST(least(b, char_end) - a AS BIGINT) AS "to",
  row_number() OVER (PARTITION BY y.doc_id, pos ORDER BY seg_pos) = 1 AS is_first
FROM y JOIN s ON y.doc_id = s.doc_id AND greatest(a, char_start) < least(b, char_end)""",
    "skip_filter": "SELECT CAST(doc_id AS VARCHAR) AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "id_checks": "SELECT 'en' AS lang, doc_id AS element_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500 AND lang = 'en')",
    "id_collisions": """
WITH d AS (SELECT event_id % 4 AS book_id, CASE WHEN event_id % 3 = 0 THEN printf('mo_s_%04d', event_id) ELSE 'x' || event_id END AS element_id FROM events)
SELECT DISTINCT * FROM d WHERE element_id LIKE 'mo\\_s\\_%' ESCAPE '\\' OR (book_id, element_id) IN (SELECT (o_orderkey % 4, 'x' || o_orderkey) FROM orders)""",
    "element_ids": """
WITH e AS (SELECT p_partkey, ['mo_s_', 'mo_s_00', 'x_s_', 'mo_s_-'][p_partkey % 4 + 1] || p_partkey AS element_id FROM part)
SELECT *, regexp_full_match(element_id, 'mo_s_[0-9]{4,}') AS valid, CASE WHEN regexp_full_match(element_id, 'mo_s_[0-9]{4,}') THEN CAST(substr(element_id, 6) AS BIGINT) ELSE -1 END AS number FROM e""",
    "probe_json": """
WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL)
SELECT event_id, 0 AS chap_pos, 'Chapter 1' AS title, 0.0::DOUBLE AS start_s, k + 0.25::DOUBLE AS end_s FROM k WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 0, 'Part ' || (event_id % 10), k / 1000, (k + 500) / 1000 FROM k WHERE event_id % 3 <> 0
UNION ALL SELECT event_id, 1, 'Chapter 2', k + 0.5::DOUBLE, k + 9.0::DOUBLE FROM k WHERE event_id % 3 <> 0""",
    "audio_units": """
WITH e AS (SELECT '/audio/file_' || (event_id % 2000) || '.m4b' AS path, event_id AS unit_pos, 1.0::DOUBLE AS start_s, CAST(user_id % 3 AS DOUBLE) AS end_s, event_type AS title FROM events),
g AS (SELECT * FROM e WHERE end_s > start_s)
SELECT * FROM g UNION ALL SELECT DISTINCT path, 0, 0.0::DOUBLE, 42.5::DOUBLE, regexp_extract(path, 'file_[0-9]+') FROM e WHERE path NOT IN (SELECT path FROM g)""",
    "alignment_json": f"""WITH {_EVENTS}
SELECT user_id, 'c' || (pos % 3) AS spine_item_id, printf('mo_s_%04d', event_id) AS element_id, event_type AS text, start_ms, end_ms, event_id % 8 / 8 AS confidence, 4 AS char_end FROM tl""",
    "mime_lookup": """
SELECT p_partkey, ['audio/mpeg', 'audio/mp4', 'audio/ogg', 'audio/wav', 'audio/mpeg', 'audio/mpeg', 'audio/mp4', 'audio/mp4'][p_partkey % 8 + 1] AS media_type FROM part""",
    "unique_ids": """
WITH p AS (SELECT p_partkey % 7 AS book_id, p_partkey AS pos, 'a/' || p_brand || '.mp3' AS path, regexp_replace(p_brand, '[^A-Za-z0-9_-]', '_', 'g') AS base FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id, base ORDER BY pos) - 1 AS k FROM p)
SELECT book_id, pos, path, CASE WHEN k = 0 THEN base ELSE base || '_' || k END AS item_id, 'audio/mpeg' AS media_type FROM n""",
    "first_distinct": "SELECT p_size, p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY p_size, p_brand",
    "best_file": """
WITH p AS (SELECT p_partkey % 50 AS book_id, 'c' || (p_size % 5) || '.xhtml' AS name, p_partkey % 5 AS d FROM part)
SELECT book_id, name, arg_min(['EPUB/', 'OEBPS/', 'OPS/', 'other/deep/', ''][k + 1] || name, [1, 2, 3, 4, 0][k + 1]) AS path FROM (
  SELECT a.book_id, a.name, b.d AS k FROM (SELECT DISTINCT book_id, name FROM p) a JOIN p b ON a.book_id = b.book_id AND a.name = b.name) GROUP BY book_id, name""",
    "block_groups": f"""WITH {_EVENTS}, g AS (
  SELECT user_id, '/p[' || (event_id % 5) || ']' AS block_xpath, min(pos) AS first_pos, CAST(count(*) AS INT) AS n FROM tl GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_pos) AS block_rank FROM g""",
    "block_checks": f"""WITH {_EVENTS}, a AS (SELECT DISTINCT user_id, '/p[' || (event_id % 5) || ']' AS block_xpath FROM tl),
b AS (SELECT user_id, '/p[' || (event_id % 4) || ']' AS block_xpath, count(*) AS n FROM events GROUP BY ALL)
SELECT a.user_id, a.block_xpath, coalesce(b.n, 0) AS n FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.block_xpath = b.block_xpath WHERE coalesce(b.n, 0) <> 1""",
    "svg_items": "SELECT page_id, CASE WHEN page_id % 4 = 0 OR contains(lower(html), '<svg') THEN 'scripted svg' ELSE 'scripted' END AS properties FROM pages",
    "paths": r"SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS basename, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[^A-Za-z0-9_-]', '_', 'g') AS slug, trim(split_part(url || '#part', '#', 1)) AS path FROM pages",
    "total_chars": f"WITH {_SENTENCES} SELECT lang, count(*) AS n_sentences, count(DISTINCT doc_id) AS n_chapters, CAST(sum(char_end - char_start) AS BIGINT) AS n_chars FROM s GROUP BY lang",
    "previews": f"WITH {_SENTENCES} SELECT doc_id, string_agg(text, ' ' ORDER BY pos) AS preview FROM s WHERE pos < 3 GROUP BY doc_id",
    "readable_durations": f"""WITH {_EVENTS}
SELECT event_id, CASE WHEN start_ms = 0 THEN '< 1ms' WHEN start_ms < 60 THEN printf('%d.00s', start_ms) WHEN start_ms < 3600 THEN printf('%dm %d.0s', start_ms // 60, start_ms % 60)
  ELSE printf('%dh %dm %ds', start_ms // 3600, start_ms // 60 % 60, start_ms % 60) END AS text FROM tl""",
    "playlists": f"""WITH {_EVENTS}, c AS (
  SELECT user_id, event_id, pos, CASE WHEN pos = 1 THEN 0 ELSE greatest(start_ms, lag(end_ms) OVER w) END AS a, greatest(end_ms, coalesce(lead(start_ms) OVER w, end_ms)) AS b
  FROM tl WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<smil xmlns="http://www.w3.org/ns/SMIL" xmlns:epub="http://www.idpf.org/2007/ops" version="3.0"><body><seq epub:textref="text/a&amp;b.xhtml">' || chr(10)
  || string_agg(printf('<par id="par_%04d"><text src="text/a&amp;b.xhtml#mo_s_%04d"/><audio src="audio/a.mp3" clipBegin="%d.%03ds" clipEnd="%d.%03ds"/></par>', pos, event_id, a // 1000, a % 1000, b // 1000, b % 1000), chr(10) ORDER BY pos)
  || chr(10) || '</seq></body></smil>' || chr(10) AS smil FROM c GROUP BY user_id""",
    "wrapped_segments": f"""WITH {_SENTENCES}, g AS (
  SELECT doc_id, generate_subscripts(ls, 1) - 1 AS seg_pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
), z AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY seg_pos) AS upto FROM g),
y AS (SELECT doc_id, seg_pos, line, CAST(upto - length(line) - 1 AS BIGINT) AS a, CAST(upto - 1 AS BIGINT) AS b FROM z),
o AS (SELECT y.doc_id, seg_pos, line, pos, greatest(a, char_start) - a AS f, least(b, char_end) - a AS t, row_number() OVER (PARTITION BY y.doc_id, pos ORDER BY seg_pos) AS nth
  FROM y JOIN s ON y.doc_id = s.doc_id AND greatest(a, char_start) < least(b, char_end)),
q AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY doc_id, seg_pos ORDER BY f), 0) AS u FROM o),
r AS (SELECT doc_id, seg_pos, max(t) AS t, string_agg(substr(line, u + 1, f - u) || CASE WHEN nth = 1 THEN '<span id="s' || pos || '">' ELSE '<span class="mo-continue">' END
  || substr(line, f + 1, t - f) || '</span>', '' ORDER BY f) AS made FROM q GROUP BY ALL)
SELECT y.doc_id, y.seg_pos, coalesce(made || substr(line, r.t + 1), line) AS markup FROM y LEFT JOIN r ON y.doc_id = r.doc_id AND y.seg_pos = r.seg_pos""",
    "chapter_titles": r"""WITH t AS (SELECT page_id, html, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS a, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS b FROM pages)
SELECT page_id, trim(replace(replace(replace(replace(CASE WHEN trim(a) <> '' THEN a ELSE b END, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS title FROM t""",
    "title_numbers": """WITH p AS (SELECT p_partkey, p_partkey % 6 + 1 AS h, p_partkey // 6 % 8 + 1 AS n FROM part)
SELECT p_partkey, ['Ch.', 'Chapter', 'PT', 'Bk.', '', 'Scene'][h] || ' ' || ['Twenty-One', 'XIV', '3', 'first', '2nd', 'iii', 'Forty Two', 'x'][n] AS title,
  ltrim(['chapter', 'chapter', 'part', 'book', '', 'scene'][h] || ' ' || ['21', '14', '3', '1', '2', '3', '42', '10'][n]) AS normal FROM p""",
    "rewritten_documents": f"""WITH {_SENTENCES}, x AS (SELECT d.doc_id, d.text, pos, char_start AS a, char_end AS b, coalesce(lag(char_end) OVER (PARTITION BY d.doc_id ORDER BY pos), 0) AS u
  FROM documents d JOIN s ON d.doc_id = s.doc_id),
r AS (SELECT doc_id, max(b) AS upto, string_agg({_ESC("substr(text, u + 1, a - u)")} || '<span id="s' || pos || '">' || {_ESC("substr(text, a + 1, b - a)")} || '</span>', '' ORDER BY pos) AS made FROM x GROUP BY doc_id)
SELECT d.doc_id, '<p>' || coalesce(made, '') || {_ESC("substr(text, coalesce(upto, 0) + 1)")} || '</p>' AS markup, CAST(NULL AS VARCHAR) AS fault FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id""",
    "chapter_playlists": f"""WITH {_EVENTS}, c AS (
  SELECT user_id, event_id, pos, CASE WHEN pos = 1 THEN 0 ELSE greatest(start_ms, lag(end_ms) OVER w) END AS a, greatest(end_ms, coalesce(lead(start_ms) OVER w, end_ms)) AS b
  FROM tl WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
g AS (SELECT user_id, CAST(max(b) AS BIGINT) AS duration_ms, count(*) AS par_count,
  string_agg(printf('<par id="par_%04d"><text src="u%d.xhtml#mo_s_%04d"/><audio src="../audio/u%d.mp3" clipBegin="%d.%03ds" clipEnd="%d.%03ds"/></par>', pos, user_id, event_id, user_id, a // 1000, a % 1000, b // 1000, b % 1000), chr(10) ORDER BY pos) AS pars
  FROM c GROUP BY user_id)
SELECT user_id % 10 AS book_id, user_id AS chapter_pos, 'u' || user_id AS chapter_id, 'OEBPS/text/u' || user_id || '.smil' AS smil_path, 'OEBPS/text/u' || user_id || '.xhtml' AS text_path,
  'OEBPS/audio/u' || user_id || '.mp3' AS audio_path, duration_ms, par_count, {_HMS("duration_ms")} AS clock,
  '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<smil xmlns="http://www.w3.org/ns/SMIL" xmlns:epub="http://www.idpf.org/2007/ops" version="3.0"><body><seq epub:textref="u' || user_id || '.xhtml">' || chr(10)
  || pars || chr(10) || '</seq></body></smil>' || chr(10) AS smil FROM g""",
    "relative_paths": """WITH p AS (SELECT p_partkey, p_partkey % 4 + 1 AS i, p_partkey % 5 + 1 AS j, replace(p_brand, '#', '-') AS n FROM part)
SELECT p_partkey, ['a/b/', 'a/', '', 'a/d/e/'][i] || n AS path, ['a/b', 'a', '', 'a/d/f', 'z'][j] AS folder,
  [['', 'b/', 'a/b/', '../../b/', '../a/b/'], ['../', '', 'a/', '../../', '../a/'], ['../../', '../', '', '../../../', '../'], ['../d/e/', 'd/e/', 'a/d/e/', '../e/', '../a/d/e/']][i][j] || n AS relative FROM p""",
    "reading_order": """WITH p AS (SELECT *, p_partkey % 50 AS book_id, p_partkey AS k FROM part),
m AS (SELECT book_id, 'i' || p_size AS id, max(k) AS k FROM p GROUP BY ALL),
i AS (SELECT book_id, id, 't/' || k || ['.xhtml', '.html', '.css', '.HTML', '.ncx'][k % 5 + 1] AS href, ['application/xhtml+xml', 'text/css', 'Text/HTML'][k // 5 % 3 + 1] AS media_type FROM m)
SELECT p.book_id, i.id, p.k AS ref_pos, href, media_type FROM p JOIN i ON p.book_id = i.book_id AND i.id = 'i' || (p.k // 50 % 60)
WHERE lower(media_type) IN ('application/xhtml+xml', 'text/html') OR lower(href) LIKE '%.html' OR lower(href) LIKE '%.xhtml'""",
    "spine_labels": """WITH n AS (SELECT p_partkey % 20 AS book_id, ['text/p', 'p'][p_partkey // 20 % 2 + 1] || (p_size % 40) || '.xhtml' AS target, CASE WHEN p_partkey % 3 = 2 THEN 'guide' ELSE 'toc' END AS kind,
  arg_max(CASE WHEN p_partkey % 7 <> 0 THEN p_name ELSE '' END, p_partkey) AS label FROM part GROUP BY ALL),
s AS (SELECT CAST(page_id % 20 AS BIGINT) AS book_id, page_id AS spine_pos, 'p' || (page_id % 30) || '.xhtml' AS base FROM pages),
l AS (SELECT s.*, kind, arg_min(label, CASE WHEN target = base THEN 1 ELSE 0 END) FILTER (label <> '') AS label FROM s JOIN n ON n.book_id = s.book_id AND target IN (base, 'text/' || base) GROUP BY ALL)
SELECT s.spine_pos, s.book_id, coalesce(t.label, '-') AS label, coalesce(g.label, '-') AS guide_type FROM s
LEFT JOIN l t ON t.spine_pos = s.spine_pos AND t.kind = 'toc' LEFT JOIN l g ON g.spine_pos = s.spine_pos AND g.kind = 'guide'""",
    "audio_formats": """SELECT p_partkey, coalesce([NULL, NULL, NULL, '.m4b', '.aaxc', '.aax', '.mp3'][p_partkey % 7 + 1], ['.mp3', '.mp3', '.m4b', '.aaxc', '.aax', NULL, NULL, NULL][p_partkey % 8 + 1],
  ['.mp3', '.m4b', '.aaxc', NULL, '.m4b'][p_partkey // 8 % 5 + 1], '-') AS format FROM part""",
    "dead_links": """WITH l AS (SELECT DISTINCT p_partkey % 40 AS book_id, 't' || p_size || '.xhtml' AS src FROM part),
f AS (SELECT DISTINCT s_suppkey % 40 AS book_id, 't' || (s_suppkey % 50) || '.xhtml' AS src FROM supplier), t AS (SELECT DISTINCT s_suppkey % 40 AS book_id FROM supplier WHERE s_suppkey % 2 = 0)
SELECT CAST(l.book_id AS BIGINT) AS book_id, l.src, CASE WHEN t.book_id IS NULL THEN '-' ELSE 'titlepage.xhtml' END AS new_src FROM l ANTI JOIN f ON l.book_id = f.book_id AND l.src = f.src LEFT JOIN t ON t.book_id = l.book_id""",
    "overlay_links": """WITH p AS (SELECT *, p_partkey // 20 AS book_id, p_partkey AS k FROM part),
i AS (SELECT book_id, 'c' || (k % 50) AS item_id, ['x/', 'y/'][k % 2 + 1] AS dir, 'p' || (p_size % 17) AS name FROM p WHERE k % 3 <> 2),
m AS (SELECT p.book_id, 's' || k AS smil_id, item_id, CASE WHEN item_id = 'c' || p_size THEN 0 WHEN dir = 'x/' AND name = 'p' || (k % 17) THEN 1 WHEN name = 'p' || (k % 17) THEN 2 END AS r FROM p JOIN i ON p.book_id = i.book_id)
SELECT book_id, smil_id, arg_min(item_id, (r, item_id)) AS item_id FROM m WHERE r IS NOT NULL GROUP BY book_id, smil_id""",
    "active_styles": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN '.-epub-media-overlay-active {}' ELSE CASE WHEN p_partkey % 4 = 3 THEN 'p {} /* ' || p_name || ' */' || chr(10) || chr(10) ELSE '' END
  || '.-epub-media-overlay-active {' || chr(10) || '  background-color: #ffe58a;' || chr(10) || '}' || chr(10) END AS css FROM part""",
    "chapters_with_text": f"WITH {_SENTENCES} SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM s)",
}
