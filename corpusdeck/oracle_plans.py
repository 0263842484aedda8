"""DuckDB SQL of plans and enhancements, over lessons made of conversation turns.

A lesson's key is conversation x 1,000,000 + turn, so the statements about documents apply to it.
"""

from __future__ import annotations

from . import dims
from .oracle import _CONVERSATIONS, _INTENTS, _QUANTITY, _SECTIONS, _SLIDES,  _PARTS, _SIG, _TERMS, _WORDSET, _alike, _alone, _any, _BAD_PART, _dedupe, _holding, _quote, _sentences, _sides, _strip, _words, BLOCKS, ORACLE as _DOCUMENTS, UNITS

ORACLE: dict[str, str] = {}


def _part(begin: int, n: int) -> str:
    return f"array_to_string(ws[{begin}:{begin + n - 1}], ' ')"


#: A turn's text as a lesson: steps, a comparison, a consequence, a definition, two sentences in one line, a figure and a footer, all from the turn's own words.
LESSONS = (
    f"spoken AS (SELECT conv_id * 1000000 + turn AS doc_id, turn, conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS ws FROM conversations), "
    f"units AS (SELECT doc_id, 0 AS unit_id, concat(upper(substr(ws[1], 1, 1)), substr(ws[1], 2), ' ', {_part(2, 1)}, ': ', role) AS title, "
    f"array_to_string([text, 'Step 1: check ' || {_part(1, 3)}, 'Step 2: ' || {_part(4, 3)}, 'Step 3: verify ' || {_part(7, 3)}, {_part(1, 4)} || ' unlike ' || {_part(5, 4)} || '.', "
    f"{_part(2, 4)} || ' because ' || {_part(6, 4)} || '.', 'Lesson ' || role || ': ' || {_part(3, 8)} || '.', "
    f"{_part(1, 9)} || '. Second sentence of ' || {_part(10, 9)} || '.', 'In ' || CAST(1990 + turn AS VARCHAR) || ' it grew by ' || CAST(turn AS VARCHAR) || '% with ' || {_part(1, 12)} || '.', "
    "'Slide ' || CAST(turn + 1 AS VARCHAR) || ' of ' || CAST(conv_id AS VARCHAR)], chr(10)) AS text FROM spoken)"
)
_SMALL = {k: _dedupe(f"list_concat({_holding('ss', p)}, {_holding('body', p)})" if k in ("advantage", "disadvantage") else _holding("ss", p), dims.SIGNAL_CAPS[k]) for k, p in dims.SIGNAL_PHRASES.items()}
_has = lambda intent: f"list_contains(names, {_quote(intent)})"
_holds = lambda *phrases: _any("low", list(phrases))
_FLOW = f"((len(step) >= 3 OR len(process) >= 1) AND {_has('Workflow')})"
_OPPORTUNITIES = {
    "Flowchart": _FLOW,
    "Timeline": f"len(chronology) >= 2 OR {_has('Timeline')}",
    "Comparison Table": f"len(comparison) > 0 OR (len(advantage) > 0 AND len(disadvantage) > 0) OR {_has('Comparison')}",
    "KPI Cards": f"len(number) >= 2 OR {_has('Statistics')}",
    "Icon Grid": "len(concept) BETWEEN 3 AND 6",
    "SmartArt": "len(concept) BETWEEN 3 AND 6",
    "Cycle Diagram": f"{_has('Cycle')} OR {_holds('loop', 'cycle', 'repeat', 'circular')}",
    "Process Diagram": f"len(step) >= 2 AND NOT {_FLOW}",
    "Checklist": f"(len(step) >= 3 OR {_has('Checklist')}) AND {_holds('task', 'check', 'verify', 'ensure', 'action')}",
    "Pyramid": f"{_has('Hierarchy')} OR {_holds('pyramid', 'hierarchy', 'tier', 'level', 'foundation')}",
    "Decision Tree": _holds("if ", "else", "decision", "choice", "branch", "condition"),
    "Image with Caption": "false",
    "Matrix": f"{_has('Table')} OR (len(comparison) >= 2 AND len(concept) >= 4)",
    "Roadmap": f"{_has('Timeline')} AND {_holds('phase', 'release', 'q1', 'q2', 'q3', 'q4', 'roadmap', 'milestone')}",
}
_KINDS = "list_filter([" + ", ".join(f"CASE WHEN {_OPPORTUNITIES[k]} THEN {{'kind': {_quote(k)}, 'c': {v!r}::DOUBLE, 'o': {i}}} END" for i, (k, v) in enumerate(dims.OPPORTUNITIES.items())) + "], lambda x: x IS NOT NULL)"
#: Records of lessons: signals, intents, complexity and visuals by key.
RECORDS = (
    f"{_INTENTS.replace(UNITS, LESSONS)}, {_SIG}, "
    f"small AS (SELECT doc_id, plain, {', '.join(f'{v} AS {k}' for k, v in _SMALL.items() if k != 'process')} FROM sents), "
    f"compared AS (SELECT doc_id, list({{'l': l, 'r': r, 'p': p}} ORDER BY ord) AS cs FROM ({_sides(dims.COMPARISON_PHRASES, 100)}) GROUP BY doc_id), "
    "named AS (SELECT doc_id, list(intent ORDER BY rank) AS names FROM intents GROUP BY doc_id), "
    "placed AS (SELECT term, doc_id, definition, coalesce((SELECT min(q.i) FROM dq q WHERE q.doc_id = t.doc_id AND q.term = t.term), 1000000 + (SELECT min(c.i) FROM dc c WHERE c.doc_id = t.doc_id AND c.term = t.term)) AS place FROM terms t), "
    "defined AS (SELECT doc_id, list({'term': term, 'definition': definition} ORDER BY place) AS ds FROM placed GROUP BY doc_id), "
    "records AS (SELECT g.*, m.* EXCLUDE (doc_id, plain), lower(plain) AS low, coalesce(cs[1:6], []) AS comparison, names, coalesce(ds, []) AS definition FROM signals g JOIN small m USING (doc_id) JOIN named USING (doc_id) LEFT JOIN compared USING (doc_id) LEFT JOIN defined USING (doc_id)), "
    f"seen AS (SELECT doc_id, list_sort(list_transform({_KINDS}, lambda x: {{'minus': -x.c, 'o': x.o, 'kind': x.kind}})) AS visuals FROM records)"
)
# Priorities by the fold: a redundant block is no earlier High block for the next ones.
_REPEATED = "n <= 8 AND low <> ''"
PRIORITIES = (
    f"{BLOCKS}, t AS (SELECT b.doc_id, b.ord, is_heading, {_strip('b.text')} AS t, lower({_strip('b.text')}) AS low, len({_words('b.text')}) AS n, {_WORDSET.format('b.text')} AS ws, g.concept, list_transform(g.definition, lambda d: d.term) AS ts FROM unit_blocks b JOIN records g ON g.doc_id = b.doc_id), "
    f"again AS (SELECT doc_id // 1000000 AS conv, low FROM t WHERE {_REPEATED} GROUP BY ALL HAVING count(*) >= 3), "
    f"r AS (SELECT t.*, a.conv IS NOT NULL AND NOT is_heading AS rep, {_alone('t')} OR (len({_PARTS}) >= 2 AND len(list_filter({_PARTS}, lambda p: {_BAD_PART})) = 0) AS deco, "
    "is_heading OR len(list_filter(concept, lambda c: contains(t.low, lower(c)))) > 0 OR len(list_filter(ts, lambda c: contains(t.low, lower(c)))) > 0 AS high "
    "FROM t LEFT JOIN again a ON a.conv = t.doc_id // 1000000 AND a.low = t.low), "
    "fold AS (SELECT doc_id, -1 AS ord, CAST([] AS VARCHAR[][]) AS highs, false AS red FROM units UNION ALL "
    "SELECT r.doc_id, r.ord, CASE WHEN r.high AND NOT r.rep AND NOT r.deco AND NOT (r.n >= 4 AND len(list_filter(f.highs, lambda h: "
    f"{_alike('h', 'r.ws')} > 0.8)) > 0) THEN list_append(f.highs, r.ws) ELSE f.highs END, r.n >= 4 AND NOT r.rep AND NOT r.deco AND len(list_filter(f.highs, lambda h: {_alike('h', 'r.ws')} > 0.8)) > 0 "
    "FROM fold f JOIN r ON r.doc_id = f.doc_id AND r.ord = f.ord + 1), "
    f"priorities AS (SELECT r.*, CASE WHEN red THEN 'Redundant' WHEN rep THEN 'Repeated' WHEN deco THEN 'Decorative' WHEN high THEN 'High' WHEN {_any('r.low', dims.FILLER_PHRASES)} OR n > 45 THEN 'Low' ELSE 'Medium' END AS priority "
    "FROM r JOIN fold ON fold.doc_id = r.doc_id AND fold.ord = r.ord)"
)


def _sees(*kinds: str) -> str:
    return "(" + " OR ".join(f"list_contains(kinds, {_quote(k)})" for k in kinds) + ")"


def _meets(items: str) -> str:
    return f"len(list_filter({items}, lambda x: contains(p.low, lower(x)) OR contains(lower(x), p.low))) > 0"


_FIRST = _strip("string_split(regexp_replace(t, '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))[1]")
_SUMMARY = f"CASE WHEN len({_words(_FIRST)}) > 12 THEN array_to_string({_words(_FIRST)}[1:10], ' ') || '...' ELSE {_FIRST} END"
ACTIONS = (
    "judged AS (SELECT p.doc_id, p.ord, p.t, p.n, p.priority, s.step, s.process, s.chronology, CASE "
    "WHEN p.low IN (lower(s.title), '## ' || lower(s.title)) THEN 'KEEP' "
    f"WHEN ({_any('p.low', dims.FOOTER_WORDS)} AND regexp_matches(p.t, {_quote(dims.FOOTER_NUMBER)})) OR ({_any('p.low', dims.LEGAL_PHRASES)} AND p.n < 10) OR p.priority = 'Decorative' THEN 'REMOVE' "
    "WHEN p.priority IN ('Redundant', 'Repeated') THEN 'REMOVE' "
    f"WHEN {_sees('Flowchart', 'Process Diagram')} AND {_meets('list_concat(s.step, s.process)')} THEN 'MOVE_TO_VISUAL' "
    f"WHEN {_sees('Timeline', 'Roadmap')} AND {_meets('s.chronology')} THEN 'MOVE_TO_VISUAL' "
    f"WHEN {_sees('KPI Cards')} AND len(list_filter(s.number, lambda x: contains(p.t, x))) > 0 THEN CASE WHEN p.n > 15 THEN 'MOVE_TO_NOTES' ELSE 'MOVE_TO_VISUAL' END "
    f"WHEN {_sees('Comparison Table')} AND ({_meets('list_concat(s.advantage, s.disadvantage)')} OR len(list_filter(s.comparison, lambda c: contains(p.low, lower(c.l)) OR contains(p.low, lower(c.r)))) > 0) THEN 'MOVE_TO_VISUAL' "
    f"WHEN {_sees('Checklist')} AND {_meets('s.step')} AND {_any('p.low', dims.TASK_WORDS)} THEN 'MOVE_TO_VISUAL' "
    "WHEN p.priority = 'Low' THEN 'MOVE_TO_NOTES' WHEN p.priority = 'Medium' AND p.n > 12 THEN 'SUMMARIZE' ELSE 'KEEP' END AS action "
    "FROM priorities p JOIN records s ON s.doc_id = p.doc_id JOIN (SELECT doc_id, list_transform(visuals, lambda v: v.kind) AS kinds FROM seen) k ON k.doc_id = p.doc_id), "
    f"actions AS (SELECT *, CASE action WHEN 'KEEP' THEN t WHEN 'SUMMARIZE' THEN {_SUMMARY} END AS remaining, CASE action WHEN 'MOVE_TO_NOTES' THEN t WHEN 'SUMMARIZE' THEN 'Original detail: ' || t END AS note FROM judged), "
    "texts_of AS (SELECT doc_id, coalesce(list(remaining ORDER BY ord) FILTER (remaining IS NOT NULL), []) AS remaining, coalesce(list(note ORDER BY ord) FILTER (note IS NOT NULL), []) AS moved, CAST(sum(n + 1) AS BIGINT) AS n_words FROM actions GROUP BY doc_id), "
    "planned AS (SELECT x.*, CASE WHEN len(moved) > 0 THEN 'Additional slide detail offloaded to notes:' || chr(10) || array_to_string(list_transform(moved, lambda m: '- ' || m), chr(10)) || chr(10) ELSE '' END "
    "|| 'Focus learning objective: ' || coalesce(objective[1], '') AS notes FROM texts_of x JOIN records USING (doc_id))"
)
# Rounded as the binary number it is: 0.885 is a little more than that, 0.855 a little less.
_SCALE = "18014398509481984"
_RAW = "least(greatest(0.4::DOUBLE, 0.75::DOUBLE + coalesce(-visuals[1].minus, 0.0::DOUBLE) * 0.15::DOUBLE - CASE WHEN n_words < 10 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 0.98::DOUBLE)"
TRUST = f"trust AS (SELECT doc_id, ((CAST(({_RAW}) * {_SCALE}::DOUBLE AS BIGINT) * 100 + {int(_SCALE) // 2}) // {_SCALE}) / 100::DOUBLE AS confidence FROM planned JOIN seen USING (doc_id))"
WHOLE = f"WITH RECURSIVE {RECORDS}, {PRIORITIES}, {ACTIONS}, {TRUST}"
_KEYS = "doc_id // 1000000 AS doc_id, CAST(doc_id % 1000000 AS INTEGER) AS unit_id"

ORACLE["f6_lesson_opportunities"] = f"WITH {RECORDS}, v AS (SELECT doc_id, generate_subscripts(visuals, 1) AS rank, unnest(visuals) AS x FROM seen) SELECT {_KEYS}, CAST(rank AS INTEGER) AS rank, x.kind AS kind, -x.minus AS confidence FROM v"
ORACLE["f5_lesson_priorities"] = f"WITH RECURSIVE {RECORDS}, {PRIORITIES} SELECT {_KEYS}, CAST(ord AS INTEGER) AS ord, priority FROM priorities"
ORACLE["g1_lesson_actions"] = f"{WHOLE} SELECT {_KEYS}, CAST(ord AS INTEGER) AS ord, priority, action FROM actions"
ORACLE["g2_lesson_summaries"] = f"{WHOLE} SELECT {_KEYS}, CAST(ord AS INTEGER) AS ord, remaining FROM actions WHERE remaining IS NOT NULL"
ORACLE["g3_lesson_notes"] = f"{WHOLE} SELECT {_KEYS}, md5(notes) AS digest, CAST(length(notes) AS INTEGER) AS n_chars FROM planned"
ORACLE["g5_lesson_confidence"] = f"{WHOLE} SELECT {_KEYS}, confidence FROM trust"


def _field(label: str, items: str, most: int, separator: str) -> str:
    return f"CASE WHEN len({items}) > 0 THEN {_quote(label + ': ')} || array_to_string(({items})[1:{most}], {_quote(separator)}) END"


_LISTS = {label: _field(label, column, most, separator) for label, column, most, separator in dims.CONTEXT_LISTS}
_DEFINED = "array_to_string(list_transform(definition[1:3], lambda d: d.term || ': ' || d.definition), '; ')"
_FIELDS = [
    "CASE WHEN topic <> '' THEN 'Main topic: ' || topic END",
    "CASE WHEN objective[1] <> '' THEN 'Learning objective: ' || objective[1] END",
    _field("Key concepts", "concept", 6, ", "),
    f"CASE WHEN len(definition) > 0 THEN 'Definitions: ' || {_DEFINED} END",
    *_LISTS.values(),
    "'Complexity level: ' || level",
    _field("Content type", "names", 3, ", "),
    "CASE WHEN len(remaining) > 0 THEN 'Slide content: ' || substr(array_to_string(remaining[1:4], ' '), 1, 400) END",
    "CASE WHEN notes <> '' THEN 'Speaker notes excerpt: ' || substr(notes, 1, 300) END",
]
_TOPIC = f"coalesce(CASE WHEN {_strip('title')} <> '' AND NOT regexp_full_match({_strip('title')}, '(?i)slide\\s+[0-9]+') THEN {_strip('title')} END, substr(body[1], 1, 80), 'Untitled Slide')"
_CONTEXT_LEVELS = f"levels AS ({_DOCUMENTS['f7_complexity'].replace(UNITS, LESSONS)})"
_CONTEXT = (
    f"{_CONTEXT_LEVELS}, all_of AS (SELECT *, {_TOPIC} AS topic FROM records JOIN levels USING (doc_id) JOIN planned USING (doc_id)), "
    f"told AS (SELECT doc_id, list_filter([{', '.join(_FIELDS)}], lambda x: x IS NOT NULL) AS fields FROM all_of)"
)
ORACLE["p12_enhancement_context"] = f"{WHOLE}, {_CONTEXT} SELECT {_KEYS}, md5(array_to_string(fields, chr(10))) AS digest, CAST(len(fields) AS INTEGER) AS n_fields FROM told"
ORACLE["p11_enhancement_eligible"] = f"""
WITH asked AS (SELECT source AS doc_id, doc_id AS slide_ix, coalesce(lang, '') AS title, text FROM documents WHERE NOT contains(coalesce(text, ''), '?') AND {_strip("coalesce(text, '')")} <> ''),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY slide_ix, title, text) AS INTEGER) AS rank FROM asked WHERE coalesce(right(doc_id, 1), '') NOT IN ('1', '4', '7', '3'))
SELECT doc_id, slide_ix, rank, md5(text) AS digest FROM n WHERE rank <= {dims.MOST_ENHANCED}
"""
_ANSWERED = (
    f"said AS (SELECT conv_id * 1000000 + turn AS doc_id, coalesce(role, '') AS role, {_sentences("coalesce(text, '')")} AS s FROM conversations WHERE turn % 2 = 0), "
    "answered AS (SELECT doc_id, max(CAST(len(s) > 0 AS INTEGER) + CAST(len(s) > 3 AS INTEGER) + CAST(len(list_filter(s, lambda x: x LIKE '%?')) > 0 AS INTEGER) + CAST(len(s) > 1 AS INTEGER) "
    "+ CAST(len(s) > 5 AS INTEGER) + CAST(len(s) > 3 AS INTEGER) + CAST(role <> '' AS INTEGER) + CAST(len(s) > 8 AS INTEGER)) AS n FROM said GROUP BY doc_id)"
)
_RICH = " + ".join(f"CAST({x} AS INTEGER)" for x in (*(f"len({c}) > 0" for c in ("concept", "definition", "step", "formula", "number", "fact", "remaining")), "notes <> ''"))
ORACLE["p13_enhancement_confidence"] = f"""
{WHOLE}, {_ANSWERED}, rich AS (SELECT doc_id, least(0.4::DOUBLE, ({_RICH}) * 0.05::DOUBLE) AS richness, coalesce(n, 0) AS n, least(0.1::DOUBLE, confidence * 0.1::DOUBLE) AS bonus
  FROM records JOIN planned USING (doc_id) JOIN trust USING (doc_id) LEFT JOIN answered USING (doc_id))
SELECT {_KEYS}, round_even(richness, 2) AS richness, CAST(n AS INTEGER) AS n_answers, round_even(bonus, 4) AS plan_bonus, round_even(least(1.0::DOUBLE, richness + n / 11::DOUBLE * 0.6::DOUBLE + bonus), 3) AS confidence FROM rich
"""

# The same statements over turns as they are, and over documents, whose key is their own.
TURNS = "units AS (SELECT conv_id * 1000000 + turn AS doc_id, 0 AS unit_id, coalesce(role, '') AS title, coalesce(text, '') AS text FROM conversations)"


def _turns(sql: str) -> str:
    return sql.replace(LESSONS, TURNS)


def _documents(sql: str) -> str:
    return sql.replace(LESSONS, UNITS).replace(_KEYS, "doc_id")


# Texts repeat within a document, where units of a conversation repeat within the conversation.
_OF_DOCUMENTS = PRIORITIES.replace("doc_id // 1000000 AS conv", "doc_id AS conv").replace("t.doc_id // 1000000", "t.doc_id")
ORACLE["f5_priorities"] = _documents(f"WITH RECURSIVE {RECORDS}, {_OF_DOCUMENTS} SELECT doc_id, priority, count(*) AS n FROM priorities GROUP BY ALL")
ORACLE["f6_opportunities"] = _documents(ORACLE["f6_lesson_opportunities"])
for _name, _from in (("g1_text_actions", "g1_lesson_actions"), ("g2_summaries", "g2_lesson_summaries"), ("g3_speaker_notes", "g3_lesson_notes")):
    ORACLE[_name] = _turns(ORACLE[_from])
_WORDS_OF = f"{BLOCKS}, planned AS (SELECT doc_id, CAST(sum(len({_words('text')}) + 1) AS BIGINT) AS n_words FROM unit_blocks GROUP BY doc_id)"
ORACLE["g5_plan_confidence"] = _documents(f"WITH {RECORDS}, {_WORDS_OF}, {TRUST} SELECT {_KEYS}, confidence FROM trust")
_SIZES = ", ".join(f"CAST(len({k}) AS INTEGER) AS n_{k}" for k in (*dims.SIGNAL_PHRASES, "number", "chronology", "step", "formula", "concept", "supporting", "comparison", "definition"))
_EXTRAS = (
    f"said AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS slide_ix, {_sentences("coalesce(text, '')")} AS ss FROM conversations), "
    "folded AS (SELECT doc_id, slide_ix, list_filter(['Example: ' || ss[1], 'In practice: ' || ss[2], 'Recall: ' || list_filter(ss, lambda x: x LIKE '%?')[1]], lambda x: x IS NOT NULL) AS xs FROM said), "
    "at_ AS (SELECT doc_id, slide_ix, CAST(generate_subscripts(xs, 1) - 1 AS INTEGER) AS ord, unnest(xs) AS extra FROM folded)"
)
ORACLE["p9_fold_extras"] = f"WITH {_EXTRAS} SELECT doc_id, slide_ix, ord, extra FROM at_ WHERE ord < 3"
ORACLE["p9_extras_per_deck"] = f"WITH {_EXTRAS} SELECT doc_id, slide_ix, ord, extra FROM at_ WHERE ord < CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN 3 ELSE 1 END"
_CAUSES = _DOCUMENTS["e10_causes"].split("WITH ", 1)[1]
_COUNTED = {k: f"len({k})" for k in (*dims.SIGNAL_PHRASES, "number", "chronology", "step", "formula", "concept", "supporting", "comparison", "definition")}
# Documents are titled by their source alone, so they have one concept and no relationships; their bullets are one list.
ORACLE["e_signal_counts"] = _documents(
    f"WITH {RECORDS}, causes AS (SELECT doc_id, count(*) AS n FROM ({_DOCUMENTS['e10_causes']}) GROUP BY doc_id), faqs AS (SELECT doc_id, count(*) AS n FROM ({_DOCUMENTS['e18_faqs']}) GROUP BY doc_id) "
    f"SELECT {_KEYS}, {', '.join(f'CAST({v} AS INTEGER) AS n_{k}' for k, v in _COUNTED.items())}, CAST(coalesce(causes.n, 0) AS INTEGER) AS n_cause, CAST(coalesce(faqs.n, 0) AS INTEGER) AS n_faq, "
    "CAST(len(body) >= 2 AS INTEGER) AS n_list, 0 AS n_relationship FROM records LEFT JOIN causes USING (doc_id) LEFT JOIN faqs USING (doc_id)"
)
_RECORD_NUMBERS = (
    f"WITH RECURSIVE {RECORDS}, {PRIORITIES}, {_CONTEXT_LEVELS}, counted AS (SELECT doc_id, count(*) AS n_rows, CAST(sum(n + 1) AS BIGINT) AS n_words FROM priorities GROUP BY doc_id) "
    f"SELECT {_KEYS}, {_TOPIC} AS topic, level, names[1] AS primary_intent, CAST(n_rows AS INTEGER) AS n_rows, CAST(len(visuals) AS INTEGER) AS n_visuals, CAST(n_words AS INTEGER) AS n_words, CAST(n_rows AS INTEGER) AS n_blocks, "
    "CAST(least(8, len(fact) + len(example) + len(number)) AS INTEGER) AS n_details FROM records JOIN levels USING (doc_id) JOIN seen USING (doc_id) JOIN counted USING (doc_id)"
)
ORACLE["f8_unit_intelligence"] = _turns(_RECORD_NUMBERS)
_BEHIND = "CASE b.kind " + " ".join(f"WHEN {_quote(k)} THEN {'list_concat(' + ', '.join(v) + ')' if len(v) > 1 else v[0] if v else '[]'}" for k, (_, v) in dims.BUILT.items()) + " ELSE [] END"
_BUILT = f"list_filter(list_transform(visuals, lambda v: v.kind), lambda k: k NOT IN ({', '.join(map(_quote, dims.UNBUILT))}))[1:5]"
_VISUAL_ACTIONS = (
    f"WITH RECURSIVE {RECORDS}, {PRIORITIES}, built AS (SELECT doc_id, {_BUILT} AS ks FROM seen), b AS (SELECT doc_id, generate_subscripts(ks, 1) AS rank, unnest(ks) AS kind FROM built), "
    f"texts_behind AS (SELECT b.doc_id, b.rank, b.kind, list_transform({_BEHIND}, lambda x: lower(x)) AS xs FROM b JOIN records USING (doc_id)), "
    "hits AS (SELECT t.doc_id, t.rank, t.kind, p.ord FROM texts_behind t JOIN priorities p ON p.doc_id = t.doc_id AND len(list_filter(t.xs, lambda x: contains(p.low, x))) > 0)"
)
_SHOWN = "CASE kind WHEN 'Pyramid' THEN 'SmartArt' ELSE kind END"
ORACLE["g7_visual_actions"] = _turns(
    f"{_VISUAL_ACTIONS}, counted AS (SELECT b.doc_id, b.rank, b.kind, count(h.ord) AS n FROM b LEFT JOIN hits h ON h.doc_id = b.doc_id AND h.rank = b.rank GROUP BY ALL) "
    f"SELECT {_KEYS}, CAST(rank AS INTEGER) AS rank, {_SHOWN} AS kind, 'REPLACE_TEXT_WITH_VISUAL' AS action, CAST(n AS INTEGER) AS n_blocks FROM counted "
    f"UNION ALL SELECT {_KEYS}, CAST(len(ks) + 1 AS INTEGER), 'AI Image', 'ADD_AI_IMAGE', CAST(least(2, n) AS INTEGER) FROM built JOIN (SELECT doc_id, count(*) AS n FROM priorities GROUP BY doc_id) USING (doc_id)"
)
ORACLE["g6_source_blocks"] = _turns(f"{_VISUAL_ACTIONS} SELECT {_KEYS}, {_SHOWN} AS kind, 's' || CAST(doc_id % 1000000 AS VARCHAR) || '_tb_' || ord AS block_id FROM hits")


def _ordered(items: str) -> str:
    """Distinct items in the order of their first places."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


_MAPPED = "list_append(list_transform(visuals, lambda v: CASE v.kind " + " ".join(f"WHEN {_quote(k)} THEN {_quote(v)}" for k, (v, _) in dims.BUILT.items()) + " END), 'AI Image')"
_CHOSEN = f"chosen AS (SELECT doc_id, visuals, list_concat(first_ones[1:5], CASE WHEN len(number) > 0 THEN ['Graph'] ELSE [] END, ['AI Image', 'Mind Map']) AS every FROM (SELECT doc_id, visuals, {_ordered('mapped')} AS first_ones FROM (SELECT doc_id, visuals, {_MAPPED} AS mapped FROM seen)) JOIN records USING (doc_id)), picked AS (SELECT doc_id, visuals, {_ordered('every')} AS ks FROM chosen)"
ORACLE["h1_select_visuals"] = _documents(f"WITH {RECORDS}, {_CHOSEN} SELECT {_KEYS}, CAST(generate_subscripts(ks, 1) AS INTEGER) AS rank, unnest(ks) AS kind FROM picked")
ORACLE["h2_visual_density"] = _documents(
    f"WITH {RECORDS}, {_CHOSEN}, {_WORDS_OF}, {TRUST} SELECT {_KEYS}, round_even(least(1.0::DOUBLE, least(len(ks) * 0.15::DOUBLE, 0.75::DOUBLE) + least(len(visuals) * 0.05::DOUBLE, 0.2::DOUBLE) + 0.0::DOUBLE), 3) AS density, "
    "round_even(least(0.98::DOUBLE, confidence * 0.5::DOUBLE + least(len(ks) / (len(visuals) + 2)::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE + CASE WHEN n_words > 50 THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END), 3) AS confidence "
    "FROM picked JOIN trust USING (doc_id) JOIN planned USING (doc_id)"
)
for _name, _from in (("e9_lesson_comparisons", "e9_comparisons"), ("e10_lesson_causes", "e10_causes")):
    ORACLE[_name] = _DOCUMENTS[_from].replace(UNITS, LESSONS).replace("SELECT doc_id, CAST(o AS INTEGER)", f"SELECT {_KEYS}, CAST(o AS INTEGER)")
# Sections merge one after the other, so their fold is a recursion along a document.
_JOINS = f"i.named <> '' AND lower({_strip('i.named')}) = lower({_strip('m.title')}) AND length(m.text) + length({_strip('i.text')}) <= {dims.MERGED_CHARS}"
_MERGED = (
    f"WITH RECURSIVE {_CONVERSATIONS}, {_SECTIONS}, own_titles AS (SELECT *, CASE WHEN title <> '' AND NOT regexp_full_match(title, '(?i)(page|section|slide)\\s*[0-9]+') THEN title END AS own FROM sections), "
    "i AS (SELECT *, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), title) AS named FROM own_titles), "
    "folded AS (SELECT doc_id, section_id, 0 AS out_id, named AS title, level, text FROM i WHERE section_id = 0 UNION ALL "
    f"SELECT i.doc_id, i.section_id, m.out_id + CASE WHEN {_JOINS} THEN 0 ELSE 1 END, CASE WHEN {_JOINS} THEN m.title ELSE i.named END, CASE WHEN {_JOINS} THEN m.level ELSE i.level END, "
    f"CASE WHEN {_JOINS} THEN CASE WHEN {_strip('i.text')} = '' THEN m.text ELSE {_strip(f"m.text || chr(10) || {_strip('i.text')}")} END ELSE i.text END FROM folded m JOIN i ON i.doc_id = m.doc_id AND i.section_id = m.section_id + 1), "
    "merged AS (SELECT doc_id, CAST(out_id AS INTEGER) AS section_id, arg_max(title, section_id) AS title, CAST(arg_max(level, section_id) AS INTEGER) AS level, arg_max(text, section_id) AS text FROM folded GROUP BY doc_id, out_id)"
)
ORACLE["b5_merge_repeated_titles"] = f"{_MERGED} SELECT doc_id, section_id, title, CAST(length(text) AS INTEGER) AS n_chars FROM merged"
ORACLE["b6_section_outline"] = f"{_MERGED} SELECT doc_id, CAST(count(*) AS INTEGER) AS n_sections, string_agg(level || ':' || title, '|' ORDER BY section_id) AS outline FROM merged GROUP BY doc_id"
_BARE = "trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_SAME = "(k = s.b OR (length(k) <= length(s.b) AND length(k) >= 4 AND contains(' ' || s.b || ' ', ' ' || k || ' ')) OR (length(s.b) < length(k) AND length(s.b) >= 4 AND contains(' ' || k || ' ', ' ' || s.b || ' ')))"
_NEW = f"s.b <> '' AND len(list_filter(f.kept, lambda k: {_SAME})) = 0"
ORACLE["d3_drop_restatements"] = f"""
WITH RECURSIVE said AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS unit_id, {_sentences("coalesce(text, '')")} AS ss FROM conversations), l AS (SELECT doc_id, unit_id, generate_subscripts(ss, 1) AS n, unnest(ss) AS x FROM said),
s AS (SELECT *, {_BARE} AS b FROM l), f AS (SELECT doc_id, unit_id, 0 AS n, CAST([] AS VARCHAR[]) AS kept, NULL::VARCHAR AS bullet FROM said UNION ALL
  SELECT s.doc_id, s.unit_id, s.n, CASE WHEN {_NEW} THEN list_append(f.kept, s.b) ELSE f.kept END, CASE WHEN {_NEW} THEN s.x END FROM f JOIN s ON s.doc_id = f.doc_id AND s.unit_id = f.unit_id AND s.n = f.n + 1)
SELECT doc_id, unit_id, CAST(row_number() OVER (PARTITION BY doc_id, unit_id ORDER BY n) - 1 AS INTEGER) AS ord, bullet FROM f WHERE bullet IS NOT NULL
"""
ORACLE["d7_quantities"] = f"WITH {_SLIDES} SELECT doc_id, unit_id, CASE WHEN number = '' THEN '' ELSE {_strip('currency')} || number || CASE WHEN unit IN ('', '%') THEN unit ELSE ' ' || unit END END AS quantity FROM u"
ORACLE["p4_title_restatements"] = f"""
WITH {_SLIDES}, bared AS (SELECT *, {_strip("regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g')")} AS t FROM slides)
SELECT doc_id, slide_ix, CAST(len(bullets) AS INTEGER) AS n_bullets, CAST(len(list_filter(list_transform(bullets, lambda b: {_strip("regexp_replace(lower(b), '[^a-z0-9 ]', '', 'g')")}),
  lambda a: NOT (a <> '' AND t <> '' AND (a = t OR (length(a) >= 8 AND contains(t, a)))))) AS INTEGER) AS n_kept FROM bared
"""
