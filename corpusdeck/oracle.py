"""DuckDB SQL of the corpus queries, over the same tables."""

from __future__ import annotations

from . import dims
from .operators.assets import STOPWORDS

#: White space as a SQL string, and pieces that several statements share.
WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES = "string_split(regexp_replace(regexp_replace({0}, '\\r\\n', chr(10), 'g'), '\\r', chr(10), 'g'), chr(10))"


def _strip(x: str) -> str:
    return f"trim({x}, {WS})"


def _lines(x: str) -> str:
    return LINES.format(x)


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(low: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({low}, {_quote(p)})" for p in phrases) + ")"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')"


def _bare_lines(x: str) -> str:
    """A text's lines without list markers, blank ones dropped."""
    return f"list_filter(list_transform({_lines(x)}, lambda l: {_strip(f'regexp_replace(l, {_quote(dims.LIST_MARKER)}, {_quote('')})')}), lambda l: l <> '')"


def _dedupe(items: str, most: int | None = None) -> str:
    clean = f"list_filter(list_transform({items}, lambda d: {_strip('d')}), lambda d: d <> '')"
    kept = f"list_filter({clean}, lambda d, i: list_position(list_transform({clean}, lambda e: lower(e)), lower(d)) = i)"
    return f"({kept})[1:{most}]" if most else kept


def _sentences(x: str) -> str:
    cut = f"string_split(regexp_replace({x}, '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {_strip('s')}), lambda s: length(s) > 3)"


# Documents and turns as units, their plain text and sentences.
UNITS = "units AS (SELECT doc_id, 0 AS unit_id, coalesce(source, '') AS title, coalesce(text, '') AS text FROM documents)"
TURNS = "units AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS unit_id, coalesce(role, '') AS title, coalesce(text, '') AS text FROM conversations)"
TEXTS = (
    f"blocks AS (SELECT *, {_bare_lines('text')} AS body FROM units), "
    "texts AS (SELECT *, array_to_string(list_concat(CASE WHEN title = '' THEN [] ELSE [title] END, body), ' ') AS plain FROM blocks), "
    f"sents AS (SELECT *, {_sentences('plain')} AS ss FROM texts)"
)
BLOCKS = (
    "listed AS (SELECT doc_id, unit_id, title <> '' AS has_title, list_concat(CASE WHEN title = '' THEN [] ELSE [title] END, body) AS items FROM blocks), "
    "block_rows AS (SELECT doc_id, unit_id, has_title, generate_subscripts(items, 1) - 1 AS ord, unnest(items) AS text FROM listed), "
    "unit_blocks AS (SELECT doc_id, unit_id, ord, text, has_title AND ord = 0 AS is_heading, CASE WHEN has_title AND ord = 0 THEN 0 ELSE 1 END AS bullet_level FROM block_rows)"
)


def _exploded(source: str, column: str, keep: str = "doc_id") -> str:
    return f"SELECT {keep}, generate_subscripts({column}, 1) - 1 AS ord, unnest({column}) AS x FROM {source}"


ORACLE: dict[str, str] = {}

ORACLE["a1_read_corpus"] = """
WITH m AS (SELECT doc_id, source, CASE WHEN regexp_matches(coalesce(text, ''), '(?m)^[ \\t]*#{1,6}[ \\t]+') THEN coalesce(text, '')
  ELSE '## ' || coalesce(source, '') || chr(10) || chr(10) || coalesce(text, '') END AS markdown FROM documents)
SELECT doc_id, source AS source_name, CAST(length(markdown) AS INTEGER) AS n_chars, md5(markdown) AS digest FROM m
"""
ORACLE["a4_extraction_gate"] = """
WITH m AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '(?m)^[ \\t]*#{1,6}[ \\t]+') THEN coalesce(text, '')
  ELSE '## ' || coalesce(source, '') || chr(10) || chr(10) || coalesce(text, '') END AS markdown FROM documents),
b AS (SELECT doc_id, CAST(length(trim(regexp_replace(regexp_replace(markdown, '(?i)page [0-9]+', '', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS INTEGER) AS body_chars FROM m)
SELECT doc_id, body_chars, body_chars >= 120 AS accepted FROM b
"""
ORACLE["a5_new_documents"] = "SELECT min(doc_id) AS doc_id, substr(sha256(coalesce(text, '')), 1, 32) AS content_key FROM documents GROUP BY 2"
ORACLE["a5_ingest_stream"] = ORACLE["a5_new_documents"]
ORACLE["a8_list_decks"] = """
SELECT source AS user_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id DESC, CAST(doc_id AS VARCHAR) DESC) AS INTEGER) AS rank,
  CAST(doc_id AS VARCHAR) AS deck_id, lang AS title FROM documents
"""
ORACLE["a7_a9_deck_store"] = """
WITH left_over AS (SELECT source AS user_id, doc_id, CASE WHEN doc_id % 9 = 0 THEN lang || ' again' ELSE lang END AS title FROM documents WHERE source IS NOT NULL AND (doc_id % 3 <> 0 OR doc_id % 9 = 0) AND doc_id % 5 <> 0)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY doc_id DESC) AS INTEGER) AS rank, CAST(doc_id AS VARCHAR) AS deck_id, title FROM left_over
"""
ORACLE["b1_explode_lines"] = f"SELECT doc_id, CAST(ord AS INTEGER) AS line_no, CAST(length(x) AS INTEGER) AS n_chars FROM ({_exploded(f'(SELECT doc_id, {_lines("coalesce(text, {})".format(_quote("")))} AS ls FROM documents)', 'ls')})"
ORACLE["b9_chunk_words"] = f"""
WITH {UNITS}, w AS (SELECT doc_id, text, {_words('text')} AS ws FROM units),
p AS (SELECT doc_id, len(ws) AS n, text LIKE '[TABLE DATA]%' OR contains(text, ' | ') OR len(ws) <= 180 AS whole FROM w),
c AS (SELECT doc_id, unnest(CASE WHEN whole THEN [{{'i': 0, 'n': n}}] ELSE list_transform(range(CAST(ceil(n / 180.0) AS BIGINT)), lambda i: {{'i': i, 'n': least(180, n - 180 * i)}}) END) AS x FROM p)
SELECT doc_id, CAST(x.i AS INTEGER) AS piece_no, CAST(x.n AS INTEGER) AS n_words FROM c
"""
ORACLE["b18_unit_blocks"] = f"""
WITH {TURNS}, {TEXTS}, {BLOCKS}
SELECT doc_id, unit_id, CAST(ord AS INTEGER) AS ord, 's' || unit_id || '_tb_' || ord AS block_id, is_heading, CAST(length(text) AS INTEGER) AS n_chars FROM unit_blocks
"""
ORACLE["b19_unit_text"] = f"""
WITH {TURNS}, {TEXTS}
SELECT doc_id, unit_id, md5(array_to_string(list_concat(CASE WHEN title = '' THEN [] ELSE ['## ' || title] END, list_transform(body, lambda l: '- ' || l)), chr(10))) AS digest FROM texts
"""
ORACLE["b19_full_unit_text"] = f"""
WITH {TURNS}, {TEXTS} SELECT doc_id, unit_id, md5(array_to_string(list_concat(CASE WHEN title = '' THEN [] ELSE ['## ' || title] END,
  list_transform(body, lambda l, i: CASE (i - 1) % 3 WHEN 0 THEN l WHEN 1 THEN '- ' || l ELSE '  - ' || l END),
  CASE WHEN unit_id % 3 = 0 THEN ['[TABLE DATA]', 'what | ' || title, 'lines | ' || len(body), 'turn | ' || unit_id] ELSE [] END,
  CASE WHEN unit_id % 2 = 0 THEN ['[Speaker Notes: said by ' || title || ']'] ELSE [] END), chr(10))) AS digest FROM texts
"""
ORACLE["b17_pipe_tables"] = f"""
WITH r AS (SELECT doc_id, list_filter(list_transform({_lines("coalesce(text, '')")}, lambda l: {_strip('l')}),
    lambda l: length(l) - length(replace(l, '|', '')) >= 2 AND NOT regexp_full_match(l, '[|\\s:-]+')) AS rs FROM documents),
c AS (SELECT doc_id, list_transform(rs, lambda l: list_transform(string_split(trim(l, '|'), '|'), lambda v: {_strip('v')})) AS cs FROM r WHERE len(rs) >= 2)
SELECT doc_id, CAST(len(cs) AS INTEGER) AS n_rows, CAST(list_max(list_transform(cs, lambda r: len(r))) AS INTEGER) AS n_cols,
  CAST(len(list_filter(flatten(cs), lambda v: v <> '')) AS BIGINT) AS n_filled FROM c
"""
ORACLE["b12_chapter_regroup"] = f"""
WITH ls AS (SELECT doc_id, {_lines("coalesce(text, '')")} AS ls FROM documents), l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS page, unnest(ls) AS line FROM ls),
h AS (SELECT *, CASE WHEN page % 17 = 16 THEN 'Chapter ' || ((page // 17) % 3 + 1) END AS own FROM l),
n AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Introduction') AS chapter FROM h),
c AS (SELECT doc_id, chapter, {_words("string_agg(line, ' ' ORDER BY page)")} AS ws FROM n GROUP BY ALL),
p AS (SELECT doc_id, chapter, ws, unnest(range(CAST(greatest(1, ceil(len(ws) / 150.0)) AS BIGINT))) AS i FROM c)
SELECT doc_id, chapter, CAST(i + 1 AS INTEGER) AS part, chapter || ' — Part ' || (i + 1) AS title, md5(CASE WHEN len(ws) = 0 THEN '(Visual Content)' ELSE array_to_string(ws[150 * i + 1:150 * i + 150], ' ') END) AS digest FROM p
"""
_SPANS = (
    "tagged AS (SELECT page_id // 3 AS doc_id, CAST(page_id % 3 AS INTEGER) AS page, regexp_extract_all(coalesce(html, ''), '<(h1|p|li|b|footer|a)( [^>]*)?>([^<]*)', 1) AS tags, "
    "regexp_extract_all(coalesce(html, ''), '<(h1|p|li|b|footer|a)( [^>]*)?>([^<]*)', 3) AS texts FROM pages), "
    "els AS (SELECT doc_id, page, CAST(generate_subscripts(tags, 1) - 1 AS INTEGER) AS block, unnest(tags) AS tag, unnest(texts) AS t FROM tagged), "
    "spans AS (SELECT doc_id, page, block, tag, CASE WHEN tag = 'li' THEN '• ' || t ELSE t END AS text, CASE tag WHEN 'h1' THEN 24.0::DOUBLE WHEN 'b' THEN 13.0::DOUBLE WHEN 'p' THEN 12.0::DOUBLE WHEN 'footer' THEN 8.0::DOUBLE ELSE 10.0::DOUBLE END AS size, "
    "tag = 'b' AS is_bold, CASE WHEN block % 2 = 0 THEN 20.0::DOUBLE ELSE 320.0::DOUBLE END AS x0, CASE WHEN block % 2 = 0 THEN 20.0::DOUBLE ELSE 320.0::DOUBLE END + least(560.0::DOUBLE, length(t) * 2.0::DOUBLE) AS x1, (block // 2) * 14.3::DOUBLE AS y0 FROM els)"
)
_HEADED = f"{_SPANS}, meds AS (SELECT doc_id, page, list_sort(list(size))[len(list(size)) // 2 + 1] AS median FROM spans GROUP BY ALL), headed AS (SELECT s.*, median, size >= median * 1.25::DOUBLE OR (is_bold AND size >= median * 1.05::DOUBLE) AS is_heading FROM spans s JOIN meds USING (doc_id, page))"
ORACLE["b13_infer_headings"] = f"WITH {_HEADED} SELECT doc_id, page, block, median, is_heading FROM headed"
ORACLE["b13_page_titles"] = f"WITH {_HEADED} SELECT doc_id, page, md5(arg_min(text, block)) AS title FROM headed WHERE is_heading AND length(text) < 120 GROUP BY doc_id, page"
_COLUMNS = (
    f"{_SPANS}, sided AS (SELECT *, x1 - x0 > 372.0::DOUBLE AS wide, (x0 + x1) / 2 < 300.0::DOUBLE AS lefts FROM spans), "
    "per AS (SELECT doc_id, page, count(*) FILTER (NOT wide AND lefts) AS l, count(*) FILTER (NOT wide AND NOT lefts) AS r, count(*) FILTER (wide) AS w FROM sided GROUP BY ALL), "
    "cols AS (SELECT doc_id, page, CASE WHEN l + r >= 4 AND l >= 2 AND r >= 2 AND w <= (l + r) / 2.0 THEN 2 ELSE 1 END AS n FROM per)"
)
ORACLE["b14_detect_columns"] = f"WITH {_COLUMNS} SELECT doc_id, page, n AS columns FROM cols"
ORACLE["b15_reading_order"] = f"""
WITH {_COLUMNS}, placed AS (SELECT s.*, CASE WHEN n = 2 AND NOT wide AND NOT lefts THEN 1 ELSE 0 END AS side FROM sided s JOIN cols USING (doc_id, page))
SELECT doc_id, page, block, side AS "column", CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY side, round(y0, 1), x0) - 1 AS INTEGER) AS reading_order FROM placed
"""
ORACLE["b16_multi_column_docs"] = f"WITH {_COLUMNS} SELECT doc_id, count(*) FILTER (n = 2) >= greatest(1, count(*) // 2) AS multi_column FROM cols WHERE page < 4 GROUP BY doc_id"
ORACLE["b20_flag_blocks"] = f"""
WITH {_SPANS}, f AS (SELECT doc_id, page AS unit_id, block AS ord, size, text, (tag = 'h1' AND page % 2 = 0) OR (row_number() OVER (PARTITION BY doc_id, page ORDER BY block) = 1 AND size >= 20) AS is_heading FROM spans)
SELECT doc_id, unit_id, ord, is_heading, CASE WHEN NOT is_heading THEN 0 WHEN size >= 16 THEN 2 ELSE 3 END AS heading_level, CAST(regexp_matches(text, '^\\s*[•◦▪‣·*-]\\s') AS INTEGER) AS bullet_level FROM f
"""
ORACLE["c1_dedupe_assets"] = "SELECT source AS doc_id, min(doc_id) AS ord, sha256(coalesce(text, '')) AS sha256 FROM documents GROUP BY source, sha256(coalesce(text, ''))"
ORACLE["c7_primary_image"] = """
WITH a AS (SELECT source AS doc_id, doc_id % 60 AS unit_id, doc_id AS ord, lang AS format, CASE WHEN doc_id % 3 <> 0 THEN coalesce(text, '') END AS content FROM documents),
p AS (SELECT doc_id, unit_id, list(format ORDER BY ord) AS formats, min(ord) FILTER (content <> '') AS place, arg_min(format, ord) FILTER (content <> '') AS format, arg_min(content, ord) FILTER (content <> '') AS content FROM a GROUP BY ALL),
r AS (SELECT 'src' || (page_id % 20) AS doc_id, page_id % 90 AS unit_id, max(html) AS content FROM (SELECT page_id, html, octet_length(encode(html)) AS n FROM pages) GROUP BY ALL),
b AS (SELECT coalesce(p.doc_id, r.doc_id) AS doc_id, coalesce(p.unit_id, r.unit_id) AS unit_id, coalesce(formats, []) AS fs, place, format, p.content AS content, r.content AS page, place IS NULL AND r.content IS NOT NULL AS stands
  FROM p FULL JOIN r ON p.doc_id IS NOT DISTINCT FROM r.doc_id AND p.unit_id = r.unit_id)
SELECT doc_id, unit_id, CAST(len(fs) + CAST(stands AS INTEGER) AS INTEGER) AS n_images, array_to_string(CASE WHEN stands THEN list_append(fs, 'html') ELSE fs END, ',') AS formats,
  CASE WHEN stands THEN -1 ELSE place END AS place, CASE WHEN stands THEN 'html' ELSE format END AS format, sha256(CASE WHEN stands THEN page ELSE content END) AS sha256 FROM b
"""
ORACLE["d4_sentences"] = f"WITH {UNITS}, {TEXTS} SELECT doc_id, CAST(ord AS INTEGER) AS ord, md5(x) AS digest FROM ({_exploded('sents', 'ss')})"
ORACLE["e1_main_topics"] = f"""
WITH units AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS unit_id, CASE WHEN turn % 2 = 0 THEN '' ELSE coalesce(role, '') END AS title, coalesce(text, '') AS text FROM conversations), {TEXTS}
SELECT doc_id, unit_id, coalesce(CASE WHEN trim(title) <> '' AND NOT regexp_full_match(trim(title), '(?i)slide\\s+[0-9]+') THEN trim(title) END, substr(body[1], 1, 80), 'Untitled Slide') AS topic FROM texts
"""


def _holding(items: str, phrases: list[str]) -> str:
    return f"list_filter({items}, lambda s: {_any('lower(s)', phrases)})"


_KINDS = []
for _kind, _phrases in dims.SIGNAL_PHRASES.items():
    _found = _holding("ss", _phrases)
    if _kind in ("advantage", "disadvantage"):
        _found = f"list_concat({_found}, {_holding('body', _phrases)})"
    _KINDS.append(f"SELECT doc_id, '{_kind}' AS kind, {_dedupe(_found, dims.SIGNAL_CAPS[_kind])} AS v FROM sents")
ORACLE["e2_e15_phrase_signals"] = f"WITH {UNITS}, {TEXTS}, k AS ({' UNION ALL '.join(_KINDS)}) SELECT doc_id, kind, CAST(ord AS INTEGER) AS ord, md5(x) AS digest FROM ({_exploded('k', 'v', 'doc_id, kind')})"


def _phrase(low: str, phrases: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({low}, {_quote(p)}) THEN {_quote(p)}" for p in phrases) + " END"


def _sides(phrases: list[str], most: int) -> str:
    """Rows (doc_id, ord, l, r, p) of sentences cut at their phrase."""
    return f"""
SELECT doc_id, ord, substr(l, 1, {most}) AS l, substr(r, 1, {most}) AS r, p FROM (
  SELECT doc_id, ord, p, rtrim({_strip("substr(x, 1, place - 1)")}, ',;') AS l, ltrim({_strip("substr(x, place + length(p))")}, ',;') AS r FROM (
    SELECT *, instr(lower(x), p) AS place FROM (SELECT doc_id, ord, x, {_phrase('lower(x)', phrases)} AS p FROM ({_exploded('sents', 'ss')})) WHERE p IS NOT NULL)) WHERE l <> '' AND r <> ''"""


ORACLE["e9_comparisons"] = f"""
WITH {UNITS}, {TEXTS}, c AS ({_sides(dims.COMPARISON_PHRASES, 100)}), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS o FROM c)
SELECT doc_id, CAST(o AS INTEGER) AS ord, l AS left_side, r AS right_side, p AS aspect FROM n WHERE o < 6
"""
ORACLE["e10_causes"] = f"""
WITH {UNITS}, {TEXTS}, c AS (SELECT doc_id, ord, 0 AS k, r AS cause, l AS effect FROM ({_sides(dims.CAUSE_PHRASES, 150)}) UNION ALL SELECT doc_id, ord, 1, l, r FROM ({_sides(dims.EFFECT_PHRASES, 150)})),
f AS (SELECT *, min(ord * 2 + k) OVER (PARTITION BY doc_id, cause, effect) AS first FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, k) - 1 AS o FROM f WHERE k = 0 OR first = ord * 2 + k)
SELECT doc_id, CAST(o AS INTEGER) AS ord, cause, effect FROM n WHERE o < 6
"""
_WHOLE = _strip("plain")
_STEPS = _dedupe(
    f"list_concat(CASE WHEN regexp_matches({_WHOLE}, {_quote(dims.STEP)}) AND length({_WHOLE}) > 4 THEN [regexp_replace({_WHOLE}, {_quote(dims.STEP)}, '')] ELSE [] END, list_filter(body, lambda b: regexp_matches(b, {_quote(dims.STEP)})))",
    10,
)
ORACLE["e14_steps"] = f"WITH {UNITS}, {TEXTS}, k AS (SELECT doc_id, {_STEPS} AS v FROM sents) SELECT doc_id, CAST(ord AS INTEGER) AS ord, x AS step FROM ({_exploded('k', 'v')})"
_ASKS = (
    f"(x LIKE '%?' OR (coalesce(regexp_extract(lower(x), '[a-z'']+'), '') IN ({', '.join(_quote(w) for w in dims.QUESTION_WORDS)}) AND len({_words('x')}) < 15))"
)
ORACLE["e18_faqs"] = f"""
WITH {UNITS}, {TEXTS}, s AS ({_exploded('sents', 'ss')}), q AS (SELECT *, {_ASKS} AS asks, lead(x, 1, '') OVER (PARTITION BY doc_id ORDER BY ord) AS answer FROM s),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - row_number() OVER (PARTITION BY doc_id, asks ORDER BY ord) AS run FROM q),
i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, asks, run ORDER BY ord) AS place FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS o FROM i WHERE asks AND place % 2 = 1)
SELECT doc_id, CAST(o AS INTEGER) AS ord, md5(x) AS question, md5(answer) AS answer FROM n WHERE o < 6
"""
ORACLE["e20_complexity_signals"] = f"""
WITH {UNITS}, {TEXTS}, w AS (SELECT *, regexp_extract_all(lower(plain), '[a-z'']+') AS ws FROM sents),
n AS (SELECT doc_id, greatest(len(ws), 1) AS total, len(list_distinct(ws)) AS kinds, len(ss) AS n, len(list_filter(ws, lambda x: x IN ({', '.join(_quote(t) for t in dims.TECHNICAL_TERMS)}))) AS tech,
  len(body) + CASE WHEN title <> '' THEN 1 ELSE 0 END AS elements, CASE WHEN title <> '' THEN 1 ELSE 0 END AS heads FROM w)
SELECT doc_id, round_even(CAST(kinds AS DOUBLE) / total, 4) AS vocab_richness, round_even(CASE WHEN n > 0 THEN CAST(total AS DOUBLE) / n ELSE 0.0 END, 2) AS avg_sent_length,
  round_even(tech / (total / 100.0::DOUBLE), 2) AS technical_density, CAST(elements AS INTEGER) AS element_count, CAST(total AS INTEGER) AS total_words, CAST(n AS INTEGER) AS sentence_count, CAST(elements > heads AS INTEGER) AS max_bullet_depth FROM n
"""
_HITS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS rank, {_quote(intent)} AS intent, {' + '.join(f'CAST(contains(low, {_quote(k)}) AS INTEGER)' for k in keys)} AS hits, {max(1.0, 0.3 * len(keys))!r}::DOUBLE AS full_ FROM lows"
    for i, (intent, keys) in enumerate(dims.INTENT_KEYWORDS.items())
)
_LOWS = "lows AS (SELECT doc_id, lower(plain) AS low FROM sents)"
ORACLE["f1_intent_keywords"] = f"WITH {UNITS}, {TEXTS}, {_LOWS}, h AS ({_HITS}) SELECT doc_id, intent, CAST(hits AS INTEGER) AS hits, least(1.0::DOUBLE, hits / full_) AS score FROM h WHERE hits > 0"
_BLOCK_WORDS = f"len({_words('text')}) <= 8"
ORACLE["f4_repeated_texts"] = f"WITH {UNITS}, {TEXTS}, {BLOCKS} SELECT doc_id, lower({_strip('text')}) AS text, count(*) AS n FROM unit_blocks WHERE {_BLOCK_WORDS} AND text <> '' GROUP BY ALL HAVING count(*) >= 3"
ORACLE["f4_corpus_boilerplate"] = f"WITH {UNITS}, {TEXTS}, {BLOCKS} SELECT lower({_strip('text')}) AS text, count(DISTINCT doc_id) AS n_docs FROM unit_blocks WHERE {_BLOCK_WORDS} AND text <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3"
ORACLE["f9_layout_class"] = f"""
WITH {TURNS}, t AS (SELECT *, lower(text) AS low, len(list_filter(list_transform({_lines('text')}, lambda l: {_strip('l')}), lambda l: length(l) - length(replace(l, '|', '')) >= 2 AND NOT regexp_full_match(l, '[|\\s:-]+'))) AS rows FROM units)
SELECT doc_id, unit_id, CASE WHEN regexp_matches(low, {_quote(dims.LAYOUT_FLOW)}) THEN 'FLOWCHART' WHEN rows >= 2 OR regexp_matches(low, {_quote(dims.LAYOUT_TABLE)}) THEN 'TABLE'
  WHEN regexp_matches(low, {_quote(dims.LAYOUT_METRIC)}) THEN 'METRIC' ELSE 'MINIMAL_TEXT' END AS layout_type FROM t
"""
_TAG = "CASE " + " ".join(f"WHEN {_any('lower(text)', keys)} THEN {_quote(name)}" for name, keys in dims.TOPIC_KEYWORDS) + f" ELSE {_quote(dims.TOPIC_DEFAULT)} END"
ORACLE["f13_topic_tag"] = f"WITH {UNITS} SELECT {_TAG} AS topic_tag, count(*) AS n FROM units GROUP BY 1"
ORACLE["p3_balanced_pages"] = f"""
WITH {TURNS}, {TEXTS}, {BLOCKS}, l AS (SELECT doc_id, unit_id, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY doc_id, unit_id) AS n FROM unit_blocks WHERE NOT is_heading WINDOW w AS (PARTITION BY doc_id, unit_id ORDER BY ord)),
b AS (SELECT *, CAST(ceil(n / 5.0) AS BIGINT) AS pages FROM l), e AS (SELECT *, n // pages AS base, n % pages AS extra FROM b)
SELECT doc_id, unit_id, CAST(CASE WHEN place < extra * (base + 1) THEN place // (base + 1) ELSE extra + (place - extra * (base + 1)) // base END AS INTEGER) AS page, count(*) AS n FROM e GROUP BY ALL
"""
ORACLE["r1_keyword_top_k"] = f"""
WITH {TURNS}, c AS (SELECT doc_id, unit_id AS chunk_id, unnest(list_distinct({_words('lower(text)')})) AS w FROM units),
q AS (SELECT item_id AS query_id, unnest(list_distinct({_words("lower(coalesce(text, ''))")})) AS w FROM benchmark),
s AS (SELECT query_id, doc_id, chunk_id, count(*) AS overlap FROM q JOIN c USING (w) GROUP BY ALL),
a AS (SELECT b.item_id AS query_id, u.doc_id, u.unit_id AS chunk_id, coalesce(s.overlap, 0) AS overlap FROM benchmark b CROSS JOIN units u LEFT JOIN s ON s.query_id = b.item_id AND s.doc_id = u.doc_id AND s.chunk_id = u.unit_id),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id, chunk_id) AS INTEGER) AS rank FROM a)
SELECT query_id, rank, doc_id, chunk_id, overlap FROM n WHERE rank <= 3
"""
ORACLE["r3_join_vectors"] = "SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS unit_id, CAST(len(embedding) AS INTEGER) AS n_dims FROM conversations JOIN embeddings ON conv_id = vec_id"
ORACLE["s5_stage_metrics"] = "SELECT event_type AS stage, count(*) AS n, round(avg(value), 4) AS mean_seconds, max(value) AS max_seconds FROM events GROUP BY 1"
ORACLE["s6_latest_status"] = "SELECT user_id AS run, event_type AS stage, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"

ORACLE["s6_run_status"] = """
WITH e AS (SELECT user_id AS run, CASE WHEN user_id % 7 <> 0 THEN 'team' || (user_id % 5) ELSE 'anonymous' END AS owner, event_type AS stage, ts, event_id, value FROM events),
k AS (SELECT stage, row_number() OVER (ORDER BY stage) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT stage FROM e)),
a AS (SELECT run, count(*) AS n_events, round(sum(value), 3) AS seconds, round(max(place) / max(n)::DOUBLE, 6) AS progress FROM e JOIN k USING (stage) GROUP BY run),
l AS (SELECT run, owner, stage, event_id FROM e QUALIFY row_number() OVER (PARTITION BY run ORDER BY ts DESC, event_id DESC, stage DESC) = 1)
SELECT run, owner, stage, event_id, n_events, seconds, progress FROM l JOIN a USING (run) WHERE owner <> 'team3'
"""
ORACLE["s6_live_status"] = ORACLE["s6_run_status"]

# Sections of conversations: a turn's lines under its role's heading.
_HEAD = "regexp_extract(t, '^(#{{1,6}})[ \\t]+(.*)$', {0})"
_JUNK_WORDS = f"list_filter(list_transform({_words('h')}, lambda w: lower(trim(w, ':;,.'))), lambda w: w <> '')"
_JUNK = (
    "(h = '' OR (regexp_matches(h, '[=+\\-/*:]$') AND contains(h, '=')) OR length(regexp_replace(h, '[^\\p{L}]', '', 'g')) < greatest(3.0, length(h) * 0.4) "
    f"OR (len({_JUNK_WORDS}) >= 2 AND len(list_distinct({_JUNK_WORDS})) = 1) OR len({_JUNK_WORDS}) > 12)"
)
_CONVERSATIONS = "docs AS (SELECT conv_id AS doc_id, string_agg('## ' || coalesce(role, '') || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id)"
_BODY = _strip("coalesce(string_agg(CASE WHEN level > 0 THEN h ELSE line END, chr(10) ORDER BY no) FILTER (NOT opens), '')")
_SECTIONS = (
    f"ls AS (SELECT doc_id, {_lines('markdown')} AS ls FROM docs), l AS (SELECT doc_id, generate_subscripts(ls, 1) AS no, unnest(ls) AS line FROM ls), "
    f"m AS (SELECT *, {_strip('line')} AS t FROM l), k AS (SELECT *, length({_HEAD.format(1)}) AS level, {_strip(_HEAD.format(2))} AS h FROM m), "
    f"o AS (SELECT *, level BETWEEN 1 AND 2 AND NOT {_JUNK} AS opens FROM k), "
    "g AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY no) AS part FROM o), "
    f"s AS (SELECT doc_id, part, coalesce(max(h) FILTER (opens), '') AS title, coalesce(max(level) FILTER (opens), 0) AS level, {_BODY} AS text FROM g GROUP BY doc_id, part), "
    "sections AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS section_id FROM s WHERE title <> '' OR text <> '')"
)
ORACLE["b2_split_sections"] = f"WITH {_CONVERSATIONS}, {_SECTIONS} SELECT doc_id, section_id, title, CAST(level AS INTEGER) AS level, md5(text) AS digest FROM sections"
ORACLE["b4_inherit_titles"] = f"""
WITH {_CONVERSATIONS}, {_SECTIONS}, r AS (SELECT *, CASE WHEN title <> '' AND NOT regexp_full_match(title, '(?i)(page|section|slide)\\s*[0-9]+') THEN title END AS own FROM sections),
i AS (SELECT *, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), title) AS named FROM r)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_sections, CAST(count(DISTINCT named) AS INTEGER) AS n_titles FROM i GROUP BY doc_id
"""
ORACLE["b3_junk_headings"] = f"""
WITH ls AS (SELECT doc_id, {_lines("coalesce(text, '')")} AS ls FROM documents), l AS (SELECT doc_id, trim(unnest(ls), ' ') AS h FROM ls)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST({_JUNK} AS INTEGER)) AS BIGINT) AS n_junk FROM l GROUP BY doc_id
"""
# Slides of turns, with their scores.
_QUANTITY = dims.QUANTITY
_SLIDES = (
    f"{TURNS}, t AS (SELECT *, lower(text) AS low, list_filter(list_transform({_lines('text')}, lambda l: {_strip('l')}), lambda l: l <> '') AS own, {_sentences('text')} AS ss FROM units), "
    "u AS (SELECT *, len(list_filter(own, lambda l: length(l) - length(replace(l, '|', '')) >= 2 AND NOT regexp_full_match(l, '[|\\s:-]+'))) AS rows, "
    f"regexp_extract(text, {_quote(_QUANTITY)}, 2) AS number, regexp_extract(text, {_quote(_QUANTITY)}, 1) AS currency, regexp_extract(text, {_quote(_QUANTITY)}, 3) AS unit FROM t), "
    f"v AS (SELECT *, CASE WHEN regexp_matches(low, {_quote(dims.LAYOUT_FLOW)}) THEN 'FLOWCHART' WHEN rows >= 2 THEN 'TABLE' WHEN regexp_matches(low, {_quote(dims.LAYOUT_TABLE)}) THEN 'MINIMAL_TEXT' "
    f"WHEN regexp_matches(low, {_quote(dims.LAYOUT_METRIC)}) AND number <> '' THEN 'METRIC' ELSE 'MINIMAL_TEXT' END AS layout_type FROM u), "
    "slides AS (SELECT doc_id, unit_id AS slide_ix, layout_type, CASE WHEN title = '' THEN 'Overview' ELSE title END AS title, CASE WHEN len(own) > 1 THEN own ELSE ss END AS bullets, "
    "CASE WHEN layout_type = 'METRIC' THEN substr(currency || number || CASE WHEN unit IN ('', '%') THEN unit ELSE ' ' || unit END, 1, 16) END AS metric_value FROM v)"
)
ORACLE["f10_structure_slides"] = f"WITH {_SLIDES} SELECT doc_id, slide_ix, layout_type, CAST(len(bullets) AS INTEGER) AS n_bullets, metric_value FROM slides"
ORACLE["a10_deck_payload"] = f"WITH {_SLIDES} SELECT doc_id, slide_ix, layout_type, title FROM slides"
ORACLE["a10_payload_fields"] = f"""
WITH {_SLIDES} SELECT s.doc_id, s.slide_ix, 18 AS n_fields, s.slide_ix AS index, s.layout_type, s.title, 'Review key details carefully.' AS takeaway, s.metric_value, 'router' AS visual_source, 'false' AS continued,
  CASE WHEN s.slide_ix % 3 = 0 THEN 'true' ELSE 'false' END AS has_image, NULL AS question, CAST(len(s.bullets) AS INTEGER) AS n_bullets, md5(u.text) AS source_text FROM slides s JOIN units u ON u.doc_id = s.doc_id AND u.unit_id = s.slide_ix
"""
_DENSITY = "CASE WHEN conv_id % 4 = 0 THEN 'low' WHEN conv_id % 4 = 1 THEN 'heavy' ELSE 'medium' END"
_NUMBERS_OF = ", ".join("CASE density " + " ".join(f"WHEN '{name}' THEN {numbers[i]}" for name, numbers in dims.PROFILES.items()) + f" END AS {field}" for i, field in enumerate(dims.PROFILE_FIELDS))
ORACLE["p1_density_profiles"] = f"SELECT doc_id, {_NUMBERS_OF} FROM (SELECT DISTINCT conv_id AS doc_id, {_DENSITY} AS density FROM conversations)"
ORACLE["s5_stage_outcomes"] = """
WITH e AS (SELECT event_type AS stage, value, CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 13 = 0 THEN 'skipped' WHEN event_id % 5 = 0 THEN 'running' WHEN event_id % 17 <> 0 THEN 'ok' ELSE 'unknown' END AS status FROM events)
SELECT stage, status, count(*) AS n, round(avg(value), 4) AS mean_seconds, max(value) AS max_seconds FROM e GROUP BY ALL
"""
ORACLE["s5_run_progress"] = """
WITH k AS (SELECT stage, row_number() OVER (ORDER BY stage) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT event_type AS stage FROM events))
SELECT user_id AS run, round(max(place) / max(n)::DOUBLE, 6) AS progress FROM events JOIN k ON event_type = stage GROUP BY user_id
"""
ORACLE["p14_quiz_batches"] = f"""
WITH {_SLIDES}, p AS (SELECT doc_id, slide_ix // 3 AS batch, slide_ix, CASE WHEN len(bullets) = 0 THEN title || chr(10) ELSE title || chr(10) || array_to_string(bullets, chr(10)) END AS part FROM slides)
SELECT doc_id, CAST(batch AS BIGINT) AS batch, count(*) AS n_slides, CAST(length(string_agg(part, chr(10) || chr(10) ORDER BY slide_ix)) AS INTEGER) AS n_chars FROM p GROUP BY doc_id, batch
"""
ORACLE["p15_interleave"] = f"WITH {_SLIDES} SELECT s.doc_id, s.slide_ix, d.lang AS question FROM slides s LEFT JOIN documents d ON d.doc_id = s.doc_id AND s.slide_ix = 1"
_SCORES = (
    f"{_SLIDES}, w AS (SELECT *, {_words('array_to_string(bullets, chr(32))')} AS ws, len(bullets) AS n, len({_words('title')}) AS t FROM slides), "
    "x AS (SELECT *, len(ws) AS c, CAST(list_sum(list_transform(ws, lambda q: length(q))) AS DOUBLE) / len(ws) AS a FROM w), "
    "parts AS (SELECT doc_id, slide_ix, "
    "round_even(CASE WHEN c BETWEEN 20 AND 80 THEN 20.0::DOUBLE WHEN c < 20 THEN 20.0::DOUBLE * (c / 20::DOUBLE) WHEN c <= 100 THEN greatest(0.0::DOUBLE, 20.0::DOUBLE * (1 - (c - 80) / 20::DOUBLE)) ELSE 5.0::DOUBLE END, 1) AS text_density, "
    "round_even(CASE WHEN n BETWEEN 2 AND 4 THEN 20.0::DOUBLE WHEN n = 5 THEN 16.0::DOUBLE WHEN n = 1 THEN 10.0::DOUBLE ELSE least(20.0::DOUBLE, greatest(4.0::DOUBLE, 20.0::DOUBLE - (CAST(n AS INTEGER) - 4) * 3.0::DOUBLE)) END, 1) AS bullet_count, "
    "round_even(CASE WHEN t BETWEEN 3 AND 8 THEN 15.0::DOUBLE WHEN t < 3 THEN 15.0::DOUBLE * (t / 3::DOUBLE) ELSE greatest(3.0::DOUBLE, 15.0::DOUBLE * (1 - (t - 8) / 4::DOUBLE)) END, 1) AS title_quality, "
    "15.0::DOUBLE AS has_takeaway, "
    "round_even(CASE WHEN c = 0 THEN 0.0::DOUBLE WHEN a < 6.5 THEN 15.0::DOUBLE WHEN a < 8.5 THEN greatest(0.0::DOUBLE, 15.0::DOUBLE * (1 - (a - 6.5::DOUBLE) / 2)) ELSE 4.0::DOUBLE END, 1) AS readability, "
    "CASE WHEN layout_type = 'MINIMAL_TEXT' THEN 0.0::DOUBLE ELSE 10.0::DOUBLE END AS visual_bonus FROM x), "
    "scores AS (SELECT *, CAST(round_even(least(100.0::DOUBLE, 0.0::DOUBLE + text_density + bullet_count + title_quality + has_takeaway + readability + visual_bonus), 0) AS INTEGER) AS score FROM parts)"
)
_PLAIN_BONUS = "CASE WHEN layout_type = 'MINIMAL_TEXT' THEN 0.0::DOUBLE ELSE 10.0::DOUBLE END AS visual_bonus"
_IMAGE_BONUS = "least(15.0::DOUBLE, CASE WHEN layout_type = 'MINIMAL_TEXT' THEN 0.0::DOUBLE ELSE 10.0::DOUBLE END + CASE WHEN slide_ix % 3 = 0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END) AS visual_bonus"
ORACLE["s4_run_summary"] = f"""
WITH {_SCORES}, sl AS (SELECT CAST(doc_id AS VARCHAR) AS run, count(*) AS n, CAST(round_even(avg(score), 0) AS INTEGER) AS score FROM scores GROUP BY doc_id),
qu AS (SELECT CAST(doc_id % 90 AS VARCHAR) AS run, count(*) AS n FROM documents WHERE contains(text, '?') GROUP BY 1),
de AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS run, {_DENSITY} AS density FROM conversations),
ev AS (SELECT CAST(user_id AS VARCHAR) AS run, event_type AS stage, ts, event_id, value, CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 13 = 0 THEN 'skipped' WHEN event_id % 5 = 0 THEN 'running' WHEN event_id % 17 <> 0 THEN 'ok' END AS status FROM events),
en AS (SELECT *, row_number() OVER (PARTITION BY run, stage ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY run, stage ORDER BY ts DESC, event_id DESC) AS z, sum(value) OVER (PARTITION BY run, stage) AS seconds FROM ev WHERE status IN ('ok', 'failed', 'skipped')),
st AS (SELECT f.run, f.stage, f.ts, f.event_id, l.status, l.event_id AS last, f.seconds FROM en f JOIN en l ON f.run = l.run AND f.stage = l.stage AND f.a = 1 AND l.z = 1),
sg AS (SELECT run, string_agg(stage || ':' || status || ':event ' || last, '|' ORDER BY ts, event_id) AS stages, sum(seconds) AS seconds FROM st GROUP BY run),
ru AS (SELECT run FROM sl UNION SELECT run FROM qu UNION SELECT run FROM de UNION SELECT run FROM sg)
SELECT run, coalesce(sl.n, 0) AS slide_count, coalesce(qu.n, 0) AS quiz_count, coalesce(sl.score, 0) AS overall_score, coalesce(density, 'medium') AS density_profile, round_even(coalesce(seconds, 0), 2) AS total_seconds, coalesce(stages, '') AS stages
FROM ru LEFT JOIN sl USING (run) LEFT JOIN qu USING (run) LEFT JOIN de USING (run) LEFT JOIN sg USING (run)
"""
ORACLE["s1_score_with_images"] = f"WITH {_SCORES.replace(_PLAIN_BONUS, _IMAGE_BONUS)} SELECT * FROM scores"
ORACLE["s1_score_slides"] = f"WITH {_SCORES} SELECT * FROM scores"
ORACLE["s2_score_decks"] = f"WITH {_SCORES} SELECT doc_id, CAST(round_even(avg(score), 0) AS INTEGER) AS overall_score, count(*) AS n_slides FROM scores GROUP BY doc_id"
ORACLE["s3_score_breakdown"] = f"""
WITH {_SCORES}, long AS (UNPIVOT (SELECT text_density, bullet_count, title_quality, has_takeaway, readability, visual_bonus FROM scores) ON COLUMNS(*) INTO NAME part VALUE value)
SELECT part, count(*) AS n, round(avg(value), 4) AS mean FROM long GROUP BY part
"""

# Counts of signals, intents and complexity of documents.
_ORDINAL = "\\b(" + "|".join(dims.ORDINAL_WORDS) + ")\\b"


def _around(pattern: str, before: int, after: int, clean) -> str:
    """What stands around each match of a pattern in plain, in order; gaps and matches add up to the text."""
    gaps, hits = f"regexp_split_to_array(plain, {_quote(pattern)})", f"regexp_extract_all(plain, {_quote(pattern)})"
    start = f"CAST(list_sum(list_transform({gaps}[1:i + 1], lambda g: length(g))) + coalesce(list_sum(list_transform({hits}[1:i], lambda g: length(g))), 0) AS BIGINT)"
    low = f"greatest({start} - {before}, 0)"
    piece = f"substr(plain, {low} + 1, {start} + length({hits}[i + 1]) + {after} - {low})"
    return f"CASE WHEN regexp_matches(plain, {_quote(pattern)}) THEN list_transform(range(len({hits})), lambda i: {clean(piece)}) ELSE [] END"


_NUMBERS = _dedupe(_around(dims.NUMBER, 30, 30, lambda x: f"regexp_replace({_strip(x)}, '^\\S+\\s', '')"), 12)
_CHRONOLOGY = _dedupe(
    f"list_concat({_around(dims.DATE, 10, 60, lambda x: f'substr({_strip(x)}, 1, 120)')}, list_transform(list_filter(ss, lambda s: regexp_matches(lower(s), {_quote(_ORDINAL)})), lambda s: substr(s, 1, 150)))", 10
)
_CONCEPT = _dedupe(
    f"list_concat(CASE WHEN length({_strip('title')}) > 1 THEN list_filter(list_transform(regexp_split_to_array(title, '[:\\-–|/]'), lambda p: {_strip('p')}), lambda p: length(p) > 1) ELSE [] END, "
    "regexp_extract_all(title, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+'))",
    10,
)
_WORDSET = "list_distinct(regexp_extract_all(lower({0}), '[a-z'']+'))"


def _alike(a: str, b: str) -> str:
    n = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {n} / (len({a}) + len({b}) - {n})::DOUBLE END"


_SUPPORTING = _dedupe(
    f"list_transform(list_filter(body, lambda t: length(t) >= 5 AND NOT regexp_full_match(t, '[0-9\\s.,%$\\-]+') AND len(list_filter(concept, lambda c: {_alike(_WORDSET.format('t'), _WORDSET.format('c'))} > 0.7)) = 0), lambda t: substr(t, 1, 120))", 8
)
_FORMULA = _dedupe(
    f"list_concat(list_filter(list_transform(regexp_extract_all(plain, {_quote(dims.FORMULA)}), lambda x: {_strip('x')}), lambda x: length(x) BETWEEN 4 AND 200), "
    f"list_transform(regexp_extract_all(plain, {_quote(dims.FORMULA_WORD)}, 1), lambda x: substr({_strip('x')}, 1, 150)))",
    8,
)
_DEFINED = f"list_filter(list_concat(CASE WHEN title = '' THEN [] ELSE [title] END, body), lambda b: regexp_matches(b, {_quote(dims.COLON_DEFINITION)}))"
_TERM = _strip("regexp_extract(b, " + _quote(dims.COLON_DEFINITION) + ", 1)")
# Terms of a unit: the last phrase of each, and colon forms of the others.
_TERMS = (
    f"dp AS (SELECT doc_id, unit_id, generate_subscripts(hs, 1) AS i, unnest(hs) AS h FROM (SELECT doc_id, unit_id, regexp_extract_all(plain, {_quote(dims.DEFINITION)}) AS hs FROM sents)), "
    f"dt AS (SELECT doc_id, unit_id, i, {_strip(f'regexp_extract(h, {_quote(dims.DEFINITION)}, 1)')} AS term, {_strip(f'regexp_extract(h, {_quote(dims.DEFINITION)}, 2)')} AS definition FROM dp), "
    f"dq AS (SELECT doc_id, unit_id, i, {_strip(f'regexp_replace(term, {_quote(chr(40) + chr(63) + chr(105) + chr(41) + str())}' + ' || ' + _quote('\\s+(a|an|the)\\s*$') + f', {_quote(str())})')} AS term, substr(definition, 1, 300) AS definition FROM dt WHERE length(term) >= 3 AND length(definition) >= 5), "
    "dl AS (SELECT doc_id, unit_id, term, arg_max(definition, i) AS definition FROM dq GROUP BY ALL), "
    f"dc AS (SELECT doc_id, unit_id, i, {_TERM} AS term, substr({_strip('regexp_extract(b, ' + _quote(dims.COLON_DEFINITION) + ', 2)')}, 1, 300) AS definition FROM (SELECT doc_id, unit_id, generate_subscripts(ds, 1) AS i, unnest(ds) AS b FROM (SELECT doc_id, unit_id, {_DEFINED} AS ds FROM sents))), "
    "df AS (SELECT doc_id, unit_id, term, arg_min(definition, i) AS definition FROM dc GROUP BY ALL), "
    "terms AS (SELECT * FROM dl UNION ALL SELECT * FROM df ANTI JOIN dl USING (doc_id, unit_id, term))"
)
_SIG = (
    f"sig AS (SELECT doc_id, unit_id, title, body, {_STEPS} AS step, {_dedupe(_holding('ss', dims.SIGNAL_PHRASES['process']), 6)} AS process, {_CHRONOLOGY} AS chronology, {_NUMBERS} AS number, {_FORMULA} AS formula, {_CONCEPT} AS concept FROM sents), "
    f"signals AS (SELECT *, {_SUPPORTING} AS supporting FROM sig)"
)
ORACLE["e3_key_concepts"] = f"""
WITH units AS (SELECT doc_id, 0 AS unit_id, concat_ws(': ', source, lang) AS title, coalesce(text, '') AS text FROM documents), {TEXTS}, c AS (SELECT doc_id, {_CONCEPT} AS cs FROM sents)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, x AS concept FROM ({_exploded('c', 'cs')})
"""
ORACLE["e4_supporting_concepts"] = f"WITH {TURNS}, {TEXTS}, {_SIG} SELECT doc_id, unit_id, CAST(ord AS INTEGER) AS ord, x AS concept FROM ({_exploded('signals', 'supporting', 'doc_id, unit_id')})"
for _name, _column, _alias in (("e7_numbers", "number", "number"), ("e11_chronology", "chronology", "item"), ("e16_formulas", "formula", "formula")):
    ORACLE[_name] = f"WITH {UNITS}, {TEXTS}, {_SIG} SELECT doc_id, CAST(ord AS INTEGER) AS ord, x AS {_alias} FROM ({_exploded('signals', _column)})"
ORACLE["e17_lists"] = f"WITH {UNITS}, {TEXTS} SELECT doc_id, CAST(0 AS INTEGER) AS ord, CAST(len(body) AS INTEGER) AS n, md5(array_to_string(body, chr(10))) AS digest FROM texts WHERE len(body) >= 2"
ORACLE["e5_glossary"] = f"WITH {UNITS}, {TEXTS}, {_TERMS} SELECT term, count(*) AS n_docs, arg_min(definition, doc_id) AS definition FROM terms GROUP BY term"
_FAQS = "WITH " + ORACLE["e18_faqs"].split("WITH ", 1)[1].rsplit("SELECT", 1)[0] + "SELECT doc_id, least(count(*), 6) AS n FROM n GROUP BY doc_id"
_COMPARED = f"WITH {UNITS}, {TEXTS} SELECT doc_id, least(count(*), 6) AS n FROM ({_sides(dims.COMPARISON_PHRASES, 100)}) GROUP BY doc_id"
_COUNTS = (
    f"{UNITS}, {TEXTS}, {_TERMS}, counts AS (SELECT s.doc_id, lower(plain) AS low, len({_STEPS}) AS n_step, len({_CHRONOLOGY}) AS n_chronology, len({_NUMBERS}) AS n_number, "
    "coalesce(d.n, 0) AS n_definition, CAST(len(body) >= 2 AS INTEGER) AS n_list, "
    f"len({_dedupe(_holding('ss', dims.SIGNAL_PHRASES['process']), 6)}) AS n_process, len({_dedupe(_holding('ss', dims.SIGNAL_PHRASES['example']), 6)}) AS n_example, "
    f"coalesce(c.n, 0) AS n_comparison, coalesce(f.n, 0) AS n_faq FROM sents s LEFT JOIN ({_COMPARED}) c ON c.doc_id = s.doc_id LEFT JOIN ({_FAQS}) f ON f.doc_id = s.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id) d ON d.doc_id = s.doc_id)"
)
# Documents have no tables, equations, diagrams or charts, and no bullet deeper than one.
_RULES: dict[str, str] = {}
for _intent, _what, _least, _value in dims.INTENT_BONUS:
    if _what in dims.SIGNAL_PHRASES or _what in ("step", "chronology", "comparison", "definition", "number", "faq"):
        _RULES[_intent] = f"CASE WHEN n_{_what} >= {_least} THEN {_value} ELSE 0.0 END::DOUBLE"
    elif _what == "list_or_steps":
        _RULES[_intent] = f"CASE WHEN n_list > 0 OR n_step >= 3 THEN {_value} ELSE 0.0 END::DOUBLE"
_SCORED = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS o, {_quote(intent)} AS intent, round_even(least(1.0::DOUBLE, ({' + '.join(f'CAST(contains(low, {_quote(k)}) AS INTEGER)' for k in keys)}) / {max(1.0, 0.3 * len(keys))!r}::DOUBLE) * 0.6::DOUBLE "
    f"+ {_RULES.get(intent, '0.0::DOUBLE')} * 0.4::DOUBLE, 4) AS score FROM counts"
    for i, (intent, keys) in enumerate(dims.INTENT_KEYWORDS.items())
)
_INTENTS = (
    f"{_COUNTS}, scored AS ({_SCORED}), best AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) AS INTEGER) AS rank FROM scored WHERE score >= 0.2), "
    "intents AS (SELECT doc_id, rank, intent, score FROM best WHERE rank <= 4 UNION ALL SELECT doc_id, 1, 'General', 0.1 FROM units WHERE doc_id NOT IN (SELECT doc_id FROM best))"
)
ORACLE["f2_structural_bonus"] = f"WITH {_COUNTS}, b AS ({' UNION ALL '.join(f'SELECT doc_id, {_quote(i)} AS intent, {e} AS bonus FROM counts' for i, e in _RULES.items())}) SELECT doc_id, intent, bonus FROM b WHERE bonus > 0"
ORACLE["f3_classify_units"] = f"WITH {_INTENTS} SELECT doc_id, rank, intent, score FROM intents"
ORACLE["flagship_intents_by_language"] = f"WITH {_INTENTS} SELECT lang, intent, count(DISTINCT doc_id) AS n_docs FROM intents JOIN documents USING (doc_id) WHERE rank = 1 GROUP BY ALL"
ORACLE["f7_complexity"] = f"""
WITH e AS ({ORACLE['e20_complexity_signals']}), r AS (SELECT doc_id, least(2.0::DOUBLE, vocab_richness * 2.5::DOUBLE) + least(2.0::DOUBLE, avg_sent_length / 25.0::DOUBLE * 2.0::DOUBLE)
  + least(2.5::DOUBLE, technical_density / 5.0::DOUBLE * 2.5::DOUBLE) + least(2.0::DOUBLE, element_count * 0.1::DOUBLE) + least(1.5::DOUBLE, max_bullet_depth * 0.5::DOUBLE) AS raw_score FROM e),
s AS (SELECT doc_id, round_even(greatest(0.0::DOUBLE, least(10.0::DOUBLE, raw_score)), 1) AS complexity FROM r)
SELECT doc_id, complexity, CASE WHEN complexity <= 2.5 THEN 'Introductory' WHEN complexity <= 5.5 THEN 'Intermediate' WHEN complexity <= 8.0 THEN 'Advanced' ELSE 'Expert' END AS level FROM s
"""
ORACLE["d2_truncate"] = """
WITH s AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents),
c AS (SELECT *, substr(t, 1, 120) AS cut FROM s), p AS (SELECT *, instr(reverse(cut), ' ') AS back FROM c)
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(CASE WHEN back > 0 AND length(cut) - back > 72 THEN substr(cut, 1, length(cut) - back) ELSE cut END, ' ,;:.-') || '…' END AS short FROM p
"""
ORACLE["a6_drop_placeholder_lines"] = f"""
WITH l AS (SELECT doc_id, list_filter({_lines("coalesce(text, '')")}, lambda l: NOT regexp_matches({_strip('l')}, '(?i)^!\\[[^\\]]*\\]\\([^)]*\\)$|^[A-Za-z0-9_.-]+\\.(png|jpe?g|gif|bmp|svg)$')) AS ls FROM documents)
SELECT doc_id, md5(regexp_replace(array_to_string(ls, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS digest FROM l
"""
_PAGE = (
    "pages_body AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?s)<script>.*?</script>|<style>.*?</style>|<nav>.*?</nav>|<div class=\"ad\">.*?</div>|<!--.*?-->', ' ', 'g') AS body FROM pages), "
    "pages_parts AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(body, '(?s)<p>(.*?)(?:</p>|<br>)', 1), lambda x: "
    "trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))), lambda x: x <> '') AS ps FROM pages_body)"
)
ORACLE["a2_page_blocks"] = f"WITH {_PAGE} SELECT page_id, CAST(len(ps) AS BIGINT) AS n_blocks, CAST(list_sum(list_transform(ps, lambda p: length(p))) AS BIGINT) AS n_chars FROM pages_parts WHERE len(ps) > 0"
# A title that is no heading is a line of the body.
_TITLE = "trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(body, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
ORACLE["b7_sections_to_units"] = f"""
WITH {_PAGE}, h AS (SELECT page_id, {_TITLE} AS h FROM pages_body)
SELECT page_id AS doc_id, 0 AS unit_id, 1 AS slide, CAST(len(ps) + CAST({_JUNK} AS INTEGER) AS INTEGER) AS n_lines FROM pages_parts JOIN h USING (page_id)
"""

def _listed(items: str, select: str, most: int) -> str:
    """Rows (doc_id, ord, x) of one signal of documents, or of the first of two that has some."""
    return f"WITH {UNITS}, {TEXTS}, {_SIG}, k AS (SELECT doc_id, ({items})[1:{most}] AS v FROM signals), r AS ({_exploded('k', 'v', 'doc_id, len(v) AS n, v')}) SELECT doc_id, CAST(ord AS INTEGER) AS ord, {select} FROM r"


_STEPPED = "CASE WHEN len(step) > 0 THEN step ELSE process END"
_LABEL = _strip(f"regexp_replace(x, {_quote(dims.FLOW_PREFIX)}, '')")
_SHORT = f"CASE WHEN len({_words(_LABEL)}) > 8 THEN array_to_string({_words(_LABEL)}[1:7], ' ') || '…' ELSE {_LABEL} END"
ORACLE["h3_flow_nodes"] = _listed(
    "CASE WHEN len(step) > 0 THEN step[1:8] WHEN len(process) > 0 THEN process[1:8] ELSE concept[1:6] END",
    f"{_SHORT} AS label, CASE WHEN ord = 0 THEN 'start' WHEN ord = n - 1 THEN 'end' WHEN {_any(f'lower({_SHORT})', dims.FLOW_DECISIONS)} THEN 'decision' ELSE 'process' END AS kind", 8,
)
ORACLE["h8_decision_rows"] = _listed(_STEPPED, "substr(x, 1, 40) AS step, CASE WHEN ord = 0 THEN 'Valid?' ELSE 'Complete?' END AS condition, coalesce(substr(v[ord + 2], 1, 40), 'Continue') AS yes_path", 10) + " WHERE ord < 6"
ORACLE["h13_cycle"] = _listed("CASE WHEN len(process) > 0 THEN process ELSE step END", "substr(x, 1, 40) AS label, CAST((ord + 1) % n AS INTEGER) AS next_ord", 8)
ORACLE["h16_checklist"] = _listed(_STEPPED, f"substr(x, 1, 60) AS item, {_any('lower(x)', dims.CHECKLIST_ACTIONS)} AS is_action", 12)
ORACLE["h7_matrix_cells"] = f"""
WITH {UNITS}, {TEXTS}, {_SIG}, c AS (SELECT doc_id, unnest([{{'r': 0, 'c': 0, 'v': concept[1]}}, {{'r': 0, 'c': 1, 'v': concept[2]}}, {{'r': 1, 'c': 0, 'v': supporting[1]}}, {{'r': 1, 'c': 1, 'v': supporting[2]}}]) AS x FROM signals WHERE len(concept) > 0)
SELECT doc_id, CAST(x.r AS INTEGER) AS row, CAST(x.c AS INTEGER) AS col, coalesce(x.v, '—') AS value FROM c
"""
def _alone(x: str) -> str:
    return f"(regexp_full_match({x}, '[0-9]+') OR regexp_matches({x}, {_quote(dims.DECORATIVE)}))"


_PARTS = f"list_filter(list_transform(regexp_split_to_array(t, '[|–—]'), lambda p: {_strip('p')}), lambda p: p <> '')"
_BAD_PART = f"NOT ({_alone('p')} OR lower(p) IN ({', '.join(map(_quote, dims.DECORATIVE_PARTS))}))"
# Chunks of turns. The turns hold no table marks at a line's start, so paragraphs are runs of lines between
# blank ones and list runs; the list state goes on until a blank line.
_ITEM = "^[ \\t]*([-*+•]|[0-9]+[.)])[ \\t]+"
_CHUNKS = (
    f"{TURNS}, tx AS (SELECT doc_id, unit_id, title, CASE WHEN {_strip('text')} = '' THEN title ELSE text END AS text FROM units), "
    f"ls AS (SELECT doc_id, unit_id, title, {_lines('text')} AS ls FROM tx), l AS (SELECT doc_id, unit_id, title, generate_subscripts(ls, 1) AS no, {_strip('unnest(ls)')} AS t FROM ls), "
    f"f AS (SELECT *, t = '' AS blank, regexp_matches(t, {_quote(_ITEM)}) AS item, t LIKE '## %' AS head FROM l), "
    # A blank-separated run; inside it everything after the first item is the list.
    "r AS (SELECT *, sum(CAST(blank AS INTEGER)) OVER (PARTITION BY doc_id, unit_id ORDER BY no) AS run FROM f), "
    "i AS (SELECT *, max(CAST(item AS INTEGER)) OVER (PARTITION BY doc_id, unit_id, run ORDER BY no) AS listed FROM r WHERE NOT blank), "
    "h AS (SELECT *, CASE WHEN listed = 0 THEN sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id, unit_id, run ORDER BY no) ELSE 1000000 END AS part FROM i), "
    "p AS (SELECT doc_id, unit_id, title, run, part, min(no) AS first, string_agg(CASE WHEN listed = 1 AND item THEN chr(10) ELSE ' ' END || "
    f"CASE WHEN item THEN {_strip(f'regexp_replace(t, {_quote(_ITEM)}, {_quote(str())})')} WHEN head AND listed = 0 THEN {_strip('substr(t, 4)')} ELSE t END, '' ORDER BY no) AS body FROM h GROUP BY ALL), "
    f"w AS (SELECT doc_id, unit_id, title, first, {_strip('body')} AS para, {_words('body')} AS ws FROM p WHERE {_strip('body')} <> ''), "
    "c AS (SELECT doc_id, unit_id, title, first, unnest(CASE WHEN para LIKE '[TABLE DATA]%' OR contains(para, ' | ') OR len(ws) <= 180 THEN [{'i': 0, 't': para}] "
    "ELSE list_transform(range(CAST(ceil(len(ws) / 180.0) AS BIGINT)), lambda i: {'i': i, 't': array_to_string(ws[180 * i + 1:180 * i + 180], ' ')}) END) AS x FROM w), "
    "chunks AS (SELECT doc_id, unit_id, title, x.t AS text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY unit_id, first, x.i) - 1 AS INTEGER) AS chunk_id FROM c)"
)
ORACLE["b10_chunk_corpus"] = f"WITH {_CHUNKS} SELECT doc_id, chunk_id, unit_id, md5(text) AS digest FROM chunks"
ORACLE["r2_chunk_counts"] = f"WITH {_CHUNKS} SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id"
ORACLE["b11_merge_chunks"] = f"""
WITH {_CHUNKS}, m AS (SELECT doc_id, title, min(chunk_id) AS first, string_agg(text, chr(10) ORDER BY chunk_id) AS text FROM chunks GROUP BY doc_id, title)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS chunk_id, title, CAST(length(text) AS INTEGER) AS n_chars FROM m
"""
_STOP = f"({', '.join(map(_quote, STOPWORDS))})"
_TOKENS = f"list_filter(list_distinct(regexp_extract_all(lower({{0}}), '[a-z0-9]+')), lambda w: length(w) > 3 AND w NOT IN {_STOP})"
ORACLE["c3_anchor_assets"] = f"""
WITH {TURNS}, sec AS (SELECT doc_id, unit_id AS section_id, string_split(text, chr(10))[1] AS title, text FROM units),
ass AS (SELECT doc_id, unit_id AS asset_ix, unit_id - 1 AS unit_index, title AS t, text AS b FROM units),
e AS (SELECT a.doc_id, asset_ix, min(section_id) AS hit FROM ass a JOIN sec s ON a.doc_id = s.doc_id AND lower(trim(a.t, ' ')) = lower(trim(s.title, ' ')) WHERE trim(a.t, ' ') <> '' GROUP BY ALL),
st AS (SELECT doc_id, section_id, {_TOKENS.format("title || ' ' || text")} AS w FROM sec), at_ AS (SELECT doc_id, asset_ix, {_TOKENS.format("b")} AS w FROM ass),
o AS (SELECT a.doc_id, asset_ix, section_id, CAST(len(list_intersect(a.w, s.w)) AS DOUBLE) / least(len(a.w), len(s.w)) AS overlap FROM at_ a JOIN st s ON a.doc_id = s.doc_id WHERE len(a.w) > 0 AND len(s.w) > 0),
k AS (SELECT * FROM o WHERE overlap >= 0.25 QUALIFY row_number() OVER (PARTITION BY doc_id, asset_ix ORDER BY overlap DESC, section_id) = 1)
SELECT a.doc_id, a.asset_ix, coalesce(e.hit, k.section_id, p.section_id, 0) AS section_id, CASE WHEN e.hit IS NOT NULL THEN 1 WHEN k.section_id IS NOT NULL THEN 2 ELSE 3 END AS tier
FROM ass a LEFT JOIN e USING (doc_id, asset_ix) LEFT JOIN k USING (doc_id, asset_ix) LEFT JOIN sec p ON p.doc_id = a.doc_id AND p.section_id = a.unit_index
"""
_PREDICATE = "CASE " + " ".join(f"WHEN {_any('lower(x)', verbs)} THEN {_quote(name)}" for name, verbs in dims.LINK_VERBS) + " ELSE 'UNKNOWN' END"
ORACLE["e19_relationships"] = f"""
WITH units AS (SELECT doc_id, 0 AS unit_id, concat_ws(': ', source, lang) AS title, coalesce(text, '') AS text FROM documents), {TEXTS}, c AS (SELECT *, {_CONCEPT} AS cs FROM sents), s AS ({_exploded('c', 'ss', 'doc_id, cs')}),
h AS (SELECT *, list_filter(cs, lambda w: contains(lower(x), lower(w))) AS here FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS o, {_PREDICATE} AS predicate FROM h WHERE len(here) >= 2)
SELECT doc_id, CAST(o AS INTEGER) AS ord, here[1] AS subject, predicate, here[2] AS object, CASE WHEN predicate = 'UNKNOWN' THEN 0.3 ELSE 0.7 END::DOUBLE AS confidence FROM n WHERE o < 10
"""
_LENGTHS = "SELECT doc_id, CAST(length(coalesce(text, '')) % 260 AS INTEGER) AS width, CAST(length(coalesce(text, '')) % 170 + 40 AS INTEGER) AS height FROM documents"
ORACLE["c2_small_assets"] = f"SELECT *, CASE WHEN width < 120 AND height < 120 THEN 'icon' ELSE 'figure' END AS kind FROM ({_LENGTHS}) WHERE width >= 100 AND height >= 100"
ORACLE["c4_attach_assets"] = f"""
WITH anchored AS ({ORACLE["c3_anchor_assets"]}), per AS (SELECT doc_id, section_id AS unit_id, string_agg(CAST(asset_ix AS VARCHAR), ',' ORDER BY asset_ix) AS images, min(asset_ix) AS image FROM anchored GROUP BY ALL)
SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS unit_id, images, image FROM conversations LEFT JOIN per ON per.doc_id = conv_id AND per.unit_id = turn
"""
ORACLE["c5_attach_descriptions"] = """
SELECT doc_id, md5(coalesce(text, '') || CASE WHEN regexp_matches(coalesce(source, ''), '[05]$') THEN chr(10) || chr(10) || '[Extracted OCR & Image Diagram Content:' || chr(10) || 'an image of ' || source || ']' ELSE '' END) AS digest FROM documents
"""
ORACLE["c6_needs_ocr"] = f"""
WITH p AS (SELECT source AS doc_id, doc_id AS page, CAST(len({_words("coalesce(text, '')")}) AS INTEGER) AS n_words FROM documents)
SELECT doc_id, page, n_words FROM p WHERE (page % 3 = 0 AND page % 2 > 0) OR n_words < 30
"""
ORACLE["p16_parse_replies"] = """
WITH r AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS unit_id, turn % 4 = 3 AS broken, ['b) yes', 'none', 'Answer: D', ''][conv_id % 4 + 1] AS said,
  CASE turn % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'Metric' ELSE role END AS layout FROM conversations WHERE role IS NOT NULL)
SELECT doc_id, unit_id, CASE WHEN NOT broken THEN '{"layout_type": "' || layout || '", "correct": "' || said || '"}' END AS json,
  CASE WHEN broken THEN NULL WHEN upper(layout) IN ('TABLE', 'METRIC') THEN upper(layout) ELSE 'MINIMAL_TEXT' END AS layout_type,
  CASE WHEN broken OR regexp_extract(upper(said), '[A-D]') = '' THEN 'A' ELSE regexp_extract(upper(said), '[A-D]') END AS answer FROM r
"""
