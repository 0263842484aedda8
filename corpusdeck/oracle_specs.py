"""DuckDB SQL of visual specifications, over documents and over lessons made of conversation turns."""

from __future__ import annotations

from . import dims
from .oracle import _SHORT, _any, _quote, _strip, _words
from .oracle_plans import _CONTEXT_LEVELS, _KEYS, _TOPIC, RECORDS, _documents

ORACLE: dict[str, str] = {}

_ALL = f"WITH {RECORDS}, {_CONTEXT_LEVELS}, spec AS (SELECT r.*, {_TOPIC} AS topic, level, coalesce(objective[1], '') AS aim FROM records r JOIN levels USING (doc_id))"


def _add(name: str, sql: str, lesson: str | None = None) -> None:
    """The statement over documents and, under another name, over lessons."""
    ORACLE[name] = _documents(sql)
    if lesson:
        ORACLE[lesson] = sql


def _one_of(*lists: tuple[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN len({x}) > 0 THEN {x}[1:{n}]" for x, n in lists) + " ELSE [] END"


def _cut(text: str, beyond: int, keep: int) -> str:
    return f"CASE WHEN len({_words(text)}) > {beyond} THEN array_to_string({_words(text)}[1:{keep}], ' ') || '…' ELSE {text} END"


def _most(low: str, cues: dict[str, list[str]], default: str) -> str:
    """The name with the most cues, ties to the first."""
    score = {k: " + ".join(f"CAST(contains({low}, {_quote(c)}) AS INTEGER)" for c in cs) for k, cs in cues.items()}
    best = f"greatest({', '.join(score.values())})"
    return f"CASE WHEN {best} = 0 THEN {_quote(default)} " + " ".join(f"WHEN ({s}) = {best} THEN {_quote(k)}" for k, s in score.items()) + " END"


# -- flows --
_NODES = (
    f"{_ALL}, labelled AS (SELECT doc_id, list_transform({_one_of(('step', 8), ('process', 8), ('concept', 6))}, lambda x: {_SHORT}) AS labels FROM spec), "
    "noded AS (SELECT doc_id, labels, len(labels) AS n, list_transform(labels, lambda l, i: CASE WHEN i = 1 THEN 'start' WHEN i = len(labels) THEN 'end' WHEN "
    f"{_any('lower(l)', dims.FLOW_DECISIONS)} THEN 'decision' ELSE 'process' END) AS kinds FROM labelled), "
    "follows AS (SELECT doc_id, n, kinds, unnest(range(greatest(n - 1, 0))) AS s FROM noded), "
    "edges AS (SELECT doc_id, s AS source_ord, s + 1 AS target_ord, CASE kinds[s + 1] WHEN 'decision' THEN 'Yes' ELSE '' END AS label, 0 AS last FROM follows "
    "UNION ALL SELECT doc_id, list_position(kinds, 'decision') - 1, n - 1, 'No', 1 FROM noded WHERE n >= 3 AND list_contains(kinds, 'decision'))"
)
_add("h3_flow_edges", f"{_NODES} SELECT {_KEYS}, CAST(source_ord AS INTEGER) AS source_ord, CAST(target_ord AS INTEGER) AS target_ord, label FROM edges", "h3_lesson_edges")
_PLAIN = "substr(regexp_replace(labels[i + 1], '[\\[\\]{}()\"|]', '', 'g'), 1, 48)"
_BOXED = f"CASE WHEN {_PLAIN} = '' THEN 'Step' ELSE {_PLAIN} END"
_SHAPE = f"'  N' || i || CASE WHEN kinds[i + 1] = 'decision' THEN '{{' || ({_BOXED}) || '}}' WHEN kinds[i + 1] IN ('start', 'end') THEN '([' || ({_BOXED}) || '])' ELSE '[' || ({_BOXED}) || ']' END"
_ARROWS = "lined AS (SELECT doc_id, list('  N' || source_ord || CASE WHEN label = '' THEN ' --> ' ELSE ' -->|' || label || '| ' END || 'N' || target_ord ORDER BY last, source_ord) AS arrows FROM edges GROUP BY doc_id)"
_add(
    "h4_flow_text",
    f"{_NODES}, {_ARROWS} SELECT {_KEYS}, array_to_string(list_concat([CASE WHEN n <= 4 THEN 'graph LR' ELSE 'graph TB' END], list_transform(range(n), lambda i: {_SHAPE}), coalesce(arrows, [])), chr(10)) AS diagram FROM noded LEFT JOIN lined USING (doc_id) WHERE n > 0",
    "h4_lesson_flow_text",
)

# -- timelines --
_FOUND = f"regexp_extract(x, {_quote(dims.EVENT_DATE)}, 1)"
_add(
    "h5_timeline",
    f"{_ALL}, l AS (SELECT doc_id, {_one_of(('chronology', 10), ('step', 8), ('process', 6))} AS xs FROM spec), r AS (SELECT doc_id, generate_subscripts(xs, 1) AS i, unnest(xs) AS x FROM l), "
    f"f AS (SELECT *, {_FOUND} AS found FROM r), g AS (SELECT *, CASE WHEN found = '' THEN {_strip('x')} ELSE trim(replace(x, found, ''), ' -:—|') END AS rest FROM f), "
    f"d AS (SELECT *, CASE WHEN rest = '' THEN {_strip('x')} ELSE rest END AS description FROM g), t AS (SELECT *, {_strip("regexp_split_to_array(description, '[.!?;]')[1]")} AS head FROM d), u AS (SELECT *, {_cut('head', 6, 5)} AS title FROM t) "
    f"SELECT {_KEYS}, CAST(i - 1 AS INTEGER) AS ord, CASE WHEN found = '' THEN 'Phase ' || i ELSE found END AS date, CASE WHEN title = '' THEN 'Event ' || i ELSE title END AS title, description, {_any('lower(x)', dims.MILESTONES)} AS milestone FROM u",
    "h5_lesson_timeline",
)

# -- tables --
_TABLE = (
    f"{_ALL}, tabled AS (SELECT doc_id, CASE WHEN len(comparison) > 0 THEN 'Aspect|Option A|Option B' WHEN len(advantage) + len(disadvantage) > 0 THEN '#|Advantages (Pros)|Disadvantages (Cons)' ELSE 'Concept|Description|Relevance' END AS headers, "
    "CASE WHEN len(comparison) > 0 THEN list_transform(comparison, lambda c: substr(c.p, 1, 40) || '|' || substr(c.l, 1, 50) || '|' || substr(c.r, 1, 50)) "
    "WHEN len(advantage) + len(disadvantage) > 0 THEN list_transform(range(greatest(len(advantage), len(disadvantage))), lambda i: (i + 1) || '|' || coalesce(substr(advantage[i + 1], 1, 60), '—') || '|' || coalesce(substr(disadvantage[i + 1], 1, 60), '—')) "
    "ELSE list_transform(concept[1:6], lambda c: c || '|' || coalesce(substr(list_filter(definition, lambda d: d.term = c)[1].definition, 1, 60), '—') || '|' || level) END AS rows_ FROM spec)"
)
_add("h6_comparison_rows", f"{_TABLE} SELECT {_KEYS}, CAST(generate_subscripts(rows_, 1) - 1 AS INTEGER) AS ord, headers, unnest(rows_) AS cells FROM tabled", "h6_lesson_tables")
_ROLES = (
    "list_concat([{'id': 'role_0', 't': topic, 'd': 'Leadership', 'p': '—'}], list_transform(concept[1:4], lambda c, i: {'id': 'role_1_' || (i - 1), 't': c, 'd': 'Core', 'p': 'role_0'}), "
    "list_transform(supporting[1:4], lambda c, i: {'id': 'role_2_' || (i - 1), 't': c, 'd': 'Support', 'p': 'role_1_' || ((i - 1) % greatest(len(concept), 1))}))"
)
_add("h9_org_rows", f"{_ALL}, o AS (SELECT doc_id, {_ROLES} AS rs FROM spec), r AS (SELECT doc_id, generate_subscripts(rs, 1) - 1 AS ord, unnest(rs) AS x FROM o) SELECT {_KEYS}, CAST(ord AS INTEGER) AS ord, x.id AS role_id, substr(x.t, 1, 40) AS title, x.d AS department, x.p AS reports_to FROM r")

# -- figures --
_GRAPH_TEXT = "lower(concat_ws(' ', topic, aim, array_to_string(concept, ' '), array_to_string(number, ' '), array_to_string(chronology, ' ')))"
_add(
    "h10_graph_series",
    f"{_ALL}, g AS (SELECT doc_id, number[1:10] AS ns, {_GRAPH_TEXT} AS low FROM spec), k AS (SELECT *, {_most('low', dims.CHART_CUES, 'bar')} AS chart FROM g), r AS (SELECT doc_id, chart, generate_subscripts(ns, 1) - 1 AS ord, unnest(ns) AS x FROM k) "
    f"SELECT {_KEYS}, CAST(ord AS INTEGER) AS ord, CAST(regexp_replace(list_last(regexp_extract_all(x, {_quote(dims.CHART_NUMBER)}, 1)), '[,%\\s]', '', 'g') AS DOUBLE) AS value, chart FROM r WHERE regexp_matches(x, '[0-9]')",
    "h10_lesson_graphs",
)
_RAW = _strip(f"regexp_extract(x, {_quote(dims.KPI_NUMBER)}, 1)")
_LABEL = f"substr(trim(regexp_replace(trim(regexp_replace(x, {_quote(dims.KPI_NUMBER)}, '', 'g'), ' -:—|'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), 1, 40)"
_add(
    "h11_kpi_metrics",
    f"{_ALL}, k AS (SELECT doc_id, list_filter(number[1:8], lambda x: regexp_matches(x, {_quote(dims.KPI_NUMBER)})) AS ns FROM spec), r AS (SELECT doc_id, generate_subscripts(ns, 1) - 1 AS ord, unnest(ns) AS x FROM k), "
    f"m AS (SELECT *, {_RAW} AS raw, {_LABEL} AS label FROM r), v AS (SELECT *, {_strip(f'regexp_replace(raw, {_quote(dims.KPI_UNIT)}, {_quote("")}, {_quote("g")})')} AS value, regexp_extract(raw, {_quote(dims.KPI_UNIT)}, 1) AS own FROM m) "
    f"SELECT {_KEYS}, CAST(ord AS INTEGER) AS ord, CASE WHEN value = '' THEN raw ELSE value END AS value, CASE WHEN own <> '' THEN own ELSE regexp_extract(x, {_quote(dims.KPI_UNIT)}, 1) END AS unit, CASE WHEN label = '' THEN 'Metric' ELSE label END AS label, "
    f"CASE WHEN {_any('lower(x)', dims.TREND_UP)} THEN 'up' WHEN {_any('lower(x)', dims.TREND_DOWN)} THEN 'down' ELSE 'neutral' END AS trend, substr(x, 1, 80) AS description FROM v",
    "h11_lesson_metrics",
)

# -- lists --
_BY_INTENT = "list_filter(list_transform(names, lambda n: CASE n " + " ".join(f"WHEN {_quote(k)} THEN {_quote(v)}" for k, v in dims.SMARTART_INTENTS.items()) + " END), lambda k: k IS NOT NULL)[1]"
_ART_TEXT = "lower(concat_ws(' ', topic, aim, array_to_string(concept, ' '), array_to_string(process, ' ')))"
_add(
    "h12_smartart",
    f"{_ALL}, a AS (SELECT *, {_ART_TEXT} AS cue FROM spec), k AS (SELECT *, coalesce({_BY_INTENT}, {_most('cue', dims.SMARTART_CUES, 'Relationship')}) AS kind FROM a), "
    f"i AS (SELECT doc_id, kind, CASE WHEN kind = 'Hierarchy' THEN list_concat([topic], concept)[1:6] WHEN kind = 'Cycle' THEN {_one_of(('process', 8), ('step', 8), ('concept', 8))} "
    f"WHEN kind IN ('Process', 'Chevron') THEN {_one_of(('step', 8), ('process', 8), ('concept', 8))} ELSE {_one_of(('concept', 8), ('supporting', 8))} END AS xs FROM k), "
    f"r AS (SELECT doc_id, kind, generate_subscripts(xs, 1) - 1 AS ord, unnest(xs) AS x FROM i) SELECT {_KEYS}, kind, CAST(ord AS INTEGER) AS ord, substr(x, 1, 40) AS label FROM r",
    "h12_lesson_smartart",
)
_add(
    "h13_hierarchy",
    f"{_ALL}, h AS (SELECT doc_id, list_concat([{{'l': topic, 'v': 0, 'c': array_to_string(concept[1:4], '|')}}], list_transform(concept[1:4], lambda c: {{'l': c, 'v': 1, 'c': array_to_string(supporting[1:2], '|')}})) AS hs FROM spec), "
    f"r AS (SELECT doc_id, generate_subscripts(hs, 1) - 1 AS ord, unnest(hs) AS x FROM h) SELECT {_KEYS}, CAST(ord AS INTEGER) AS ord, x.l AS label, CAST(x.v AS INTEGER) AS level, x.c AS children FROM r",
)
_DEALT = "list_filter(supporting, lambda s, j: (j - 1) % len(concept) = i - 1)[1:3]"
_DETAILS = "(list_concat(fact, example, number)[1:8])[1:2]"
_add(
    "h14_mindmap",
    f"{_ALL}, m AS (SELECT doc_id, list_transform(concept[1:8], lambda c, i: {{'n': substr(c, 1, 50), 'c': (CASE WHEN i = 1 THEN list_concat({_DEALT}, {_DETAILS}) ELSE {_DEALT} END)[1:4]}}) AS bs FROM spec), "
    f"r AS (SELECT doc_id, generate_subscripts(bs, 1) - 1 AS branch, unnest(bs) AS x FROM m) SELECT {_KEYS}, CAST(branch AS INTEGER) AS branch, x.n AS name, array_to_string(list_transform(x.c, lambda t: substr(t, 1, 50)), '|') AS children FROM r",
)
_ICON = "CASE " + " ".join(f"WHEN contains(lower(x), {_quote(k)}) THEN {_quote(name)}" for name, keys in dims.ICONS for k in keys) + f" ELSE {_quote(dims.ICON_DEFAULT)} END"
_PLACE = f"[{', '.join(map(_quote, dims.ICON_PLACES))}][ord % {len(dims.ICON_PLACES)} + 1]"
_add(
    "h15_icon_items",
    f"{_ALL}, i AS (SELECT doc_id, definition, {_one_of(('concept', 9), ('supporting', 6))} AS xs FROM spec), r AS (SELECT doc_id, definition AS ds, generate_subscripts(xs, 1) - 1 AS ord, unnest(xs) AS x FROM i), "
    "k AS (SELECT *, list_filter(ds, lambda d: d.term = x)[1].definition AS known FROM r) "
    f"SELECT {_KEYS}, CAST(ord AS INTEGER) AS ord, substr(x, 1, 50) AS concept, {_ICON} AS icon, {_PLACE} AS place, substr(CASE WHEN known <> '' THEN known ELSE 'Key educational concept: ' || lower(x) || '.' END, 1, 100) AS explanation FROM k",
    "h15_lesson_icons",
)
_STYLE = "CASE level " + " ".join(f"WHEN {_quote(k)} THEN {_quote(v)}" for k, v in dims.IMAGE_STYLES.items()) + " END"
_ANGLE = "CASE " + " ".join(f"WHEN {' OR '.join(f'list_contains(names, {_quote(k)})' for k in kinds)} THEN {_quote(text)}" for kinds, text in dims.IMAGE_ANGLES if kinds) + f" ELSE {_quote(dims.IMAGE_ANGLES[-1][1])} END"
_few, _some, _many = map(_quote, dims.IMAGE_COMPOSITIONS)
_add(
    "h17_image_prompts",
    f"{_ALL} SELECT {_KEYS}, substr('An educational visual representation of ' || topic || '.' || CASE WHEN len(concept) > 0 THEN ' Illustrating the core concepts: ' || array_to_string(concept[1:3], ', ') || '.' ELSE '' END, 1, 300) AS subject, {_STYLE} AS style, "
    f"CASE WHEN len(concept) <= 1 THEN {_few} WHEN len(concept) <= 3 THEN {_some} ELSE {_many} END AS composition, {_ANGLE} AS angle, "
    "substr(CASE WHEN aim <> '' THEN 'To visually reinforce: ' || aim ELSE 'To help students build a mental model of ' || topic || '.' END, 1, 120) AS objective FROM spec",
    "h17_lesson_prompts",
)
