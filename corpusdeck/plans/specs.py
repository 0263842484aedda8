"""Visual specifications as row sets: nothing is invented, a unit without source rows has no rows.

Every function takes the records of classify.unit_intelligence and makes a unit's rows from its own row alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.rows import exploded, inlined
from ..functions.text import contains_any, let, round_even, squeeze, strip, words

KEYS = ["doc_id", "unit_id"]
TEXTS = "array<string>"


def _none() -> Column:
    return F.array().cast(TEXTS)


def _first(*lists: tuple[str, int]) -> Column:
    """The first of the lists that isn't empty, cut to its number of items."""
    return F.coalesce(*[F.when(F.size(name) > 0, F.slice(name, 1, most)) for name, most in lists], _none())


def _rows(intel: DataFrame, items: Column, *more: str) -> DataFrame:
    return exploded(intel, items, *KEYS, *more)


def _cut_words(text: Column, beyond: int, keep: int) -> Column:
    return let(words(text), lambda w: F.when(F.size(w) > beyond, F.concat(F.array_join(F.slice(w, 1, keep), " "), F.lit("…"))).otherwise(text))


def _score(low: Column, cues: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [low.contains(c).cast("int") for c in cues])


def _best(low: Column, cues: dict[str, list[str]], default: str) -> Column:
    """The name with the most cues in a lower-case text, ties to the first; the default if there are none."""
    scored = F.array(*[F.struct((-_score(low, c)).alias("minus"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, c) in enumerate(cues.items())])
    return let(F.array_min(scored), lambda b: F.when(b["minus"] < 0, b["k"]).otherwise(default))


def _objective() -> Column:
    return F.coalesce(F.get("objective", F.lit(0)), F.lit(""))


# -- flows --


def flow_labels() -> Column:
    """Labels of a unit's flow: steps, else processes, else concepts, without step prefixes; of over eight words seven and an ellipsis."""
    return F.transform(_first(("step", 8), ("process", 8), ("concept", 6)), lambda x: _cut_words(strip(F.regexp_replace(x, dims.FLOW_PREFIX, "")), 8, 7))


def _node_kinds(labels: Column) -> Column:
    last = F.size(labels) - 1
    return F.transform(labels, lambda x, i: F.struct(x.alias("label"), F.when(i == 0, "start").when(i == last, "end").when(contains_any(F.lower(x), dims.FLOW_DECISIONS), "decision").otherwise("process").alias("kind")))


def flow_nodes(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, ord, label, kind): nodes of a unit's flow."""
    rows = _rows(intel.withColumn("_labels", flow_labels()), _node_kinds(F.col("_labels")))
    return rows.select(*KEYS, "ord", "x.label", "x.kind")


def _edges(nodes: Column) -> Column:
    """(source_ord, target_ord, label): each node to the next (Yes from decisions), and one No edge from the first decision to the last node."""
    follow = F.transform(F.slice(nodes, F.lit(1), F.greatest(F.size(nodes) - 1, F.lit(0))), lambda x, i: F.struct(i.alias("source_ord"), (i + 1).alias("target_ord"), F.when(x["kind"] == "decision", "Yes").otherwise("").alias("label")))
    first = F.array_position(F.transform(nodes, lambda x: x["kind"]), F.lit("decision")).cast("int") - 1
    no = F.array(F.struct(first.alias("source_ord"), (F.size(nodes) - 1).alias("target_ord"), F.lit("No").alias("label")))
    return F.when((F.size(nodes) >= 3) & (first >= 0), F.concat(follow, no)).otherwise(follow)


def _with_nodes(intel: DataFrame) -> DataFrame:
    return intel.withColumn("_labels", flow_labels()).withColumn("_nodes", _node_kinds(F.col("_labels")))


def flow_edges(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, source_ord, target_ord, label) of a unit's flow."""
    return inlined(_with_nodes(intel), _edges(F.col("_nodes")), *KEYS, key="source_ord")


def _box(label: Column, limit: int) -> Column:
    return let(F.substring(F.regexp_replace(label, r'[\[\]{}()"|]', ""), 1, limit), lambda x: F.when(x == "", "Step").otherwise(x))


def diagram_of(nodes: Column) -> Column:
    """Diagram text of an array of nodes: its direction, its nodes in shapes and its edges."""

    def shape(x: Column, i: Column) -> Column:
        name, label = F.concat(F.lit("  N"), i.cast("string")), _box(x["label"], 48)
        return F.when(x["kind"] == "decision", F.concat(name, F.lit("{"), label, F.lit("}"))).when(x["kind"].isin("start", "end"), F.concat(name, F.lit("(["), label, F.lit("])"))).otherwise(F.concat(name, F.lit("["), label, F.lit("]")))

    def line(e: Column) -> Column:
        arrow = F.when(e["label"] == "", " --> ").otherwise(F.concat(F.lit(" -->|"), e["label"], F.lit("| ")))
        return F.concat(F.lit("  N"), e["source_ord"].cast("string"), arrow, F.lit("N"), e["target_ord"].cast("string"))

    head = F.array(F.when(F.size(nodes) <= 4, F.lit("graph LR")).otherwise(F.lit("graph TB")))
    return F.array_join(F.concat(head, F.transform(nodes, shape), F.transform(_edges(nodes), line)), "\n")


def chain_text(labels: Column, letter: str, limit: int, direction: str) -> Column:
    """Diagram text of labels in a row."""
    return F.concat(F.lit(f"graph {direction}\n  "), F.array_join(F.transform(labels, lambda x, i: F.concat(F.lit(letter), i.cast("string"), F.lit("["), _box(x, limit), F.lit("]"))), " --> "))


def flow_text(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, diagram): one diagram text per unit with a flow."""
    one = F.when(F.size("_nodes") > 0, F.array(diagram_of(F.col("_nodes")))).otherwise(_none())
    return exploded(_with_nodes(intel), one, *KEYS, value="diagram").drop("ord")


# -- timelines --


def _events() -> Column:
    def event(x: Column, i: Column) -> Column:
        def by(found: Column) -> Column:
            date = F.when(found == "", F.concat(F.lit("Phase "), (i + 1).cast("string"))).otherwise(found)
            rest = F.when(found == "", strip(x)).otherwise(F.btrim(F.replace(x, found, F.lit("")), F.lit(" -:—|")))
            return F.struct(date.alias("date"), F.when(rest == "", strip(x)).otherwise(rest).alias("description"), contains_any(F.lower(x), dims.MILESTONES).alias("milestone"))

        def titled(e: Column) -> Column:
            title = _cut_words(strip(F.element_at(F.split(e["description"], "[.!?;]"), 1)), 6, 5)
            return F.struct(e["date"], F.when(title == "", F.concat(F.lit("Event "), (i + 1).cast("string"))).otherwise(title).alias("title"), e["description"], e["milestone"])

        return let(let(F.regexp_extract(x, dims.EVENT_DATE, 1), by), titled)

    return F.transform(_first(("chronology", 10), ("step", 8), ("process", 6)), event)


def timeline_titles() -> Column:
    return F.transform(_events(), lambda e: e["title"])


def timeline_events(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, ord, date, title, description, milestone): chronology, else steps, else processes, with their date or phase."""
    return _rows(intel, _events()).select(*KEYS, "ord", "x.*")


# -- tables --


def table_of() -> Column:
    """(headers, rows) of a unit's comparison table: its own table, else its comparisons, else pros beside cons, else concepts with their definitions."""
    kind = "struct<headers:array<string>,rows:array<array<string>>>"
    texts = lambda *xs: F.array(*[F.lit(x) for x in xs])
    compared = F.transform("comparison", lambda c: F.array(F.substring(c["aspect"], 1, 40), F.substring(c["left"], 1, 50), F.substring(c["right"], 1, 50)))
    n = F.greatest(F.size("advantage"), F.size("disadvantage"))
    side = lambda name, i: F.coalesce(F.substring(F.get(name, i), 1, 60), F.lit("—"))
    sides = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array((i + 1).cast("string"), side("advantage", i), side("disadvantage", i)))
    meaning = lambda c: F.get(F.filter("definition", lambda d: d["term"] == c), F.lit(0))["definition"]
    concepts = F.transform(F.slice("concept", 1, 6), lambda c: F.array(c, F.coalesce(F.substring(meaning(c), 1, 60), F.lit("—")), F.col("level")))
    return (
        F.when(F.size("tables") > 0, F.get("tables", F.lit(0)))
        .when(F.size("comparison") > 0, F.struct(texts("Aspect", "Option A", "Option B").alias("headers"), compared.alias("rows")).cast(kind))
        .when(n > 0, F.struct(texts("#", "Advantages (Pros)", "Disadvantages (Cons)").alias("headers"), sides.alias("rows")).cast(kind))
        .when(F.size("concept") > 0, F.struct(texts("Concept", "Description", "Relevance").alias("headers"), concepts.alias("rows")).cast(kind))
    )


def comparison_rows(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, ord, headers, cells): the rows of a unit's comparison table, see table_of."""
    return exploded(intel.withColumn("_table", table_of()), "_table.rows", *KEYS, F.col("_table.headers").alias("headers"), value="cells")


def matrix_cells(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, row, col, value): two key concepts over two supporting ones; — where one is missing, no rows without key concepts."""
    cell = lambda name, i: F.coalesce(F.get(name, F.lit(i)), F.lit("—"))
    cells = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), cell(name, c).alias("value")) for r, name in enumerate(("concept", "supporting")) for c in range(2)])
    return inlined(intel, F.when(F.size("concept") > 0, cells), *KEYS, key="row")


def decision_rows(intel: DataFrame, most: int = 6) -> DataFrame:
    """(doc_id, unit_id, ord, step, condition, yes_path): each step (or process) and the one after it."""
    rows = _rows(intel.withColumn("_steps", _first(("step", 10), ("process", 10))), F.slice("_steps", 1, most), "_steps")
    return rows.select(
        *KEYS, "ord", F.substring("x", 1, 40).alias("step"), F.when(F.col("ord") == 0, "Valid?").otherwise("Complete?").alias("condition"), F.coalesce(F.substring(F.get("_steps", F.col("ord") + 1), 1, 40), F.lit("Continue")).alias("yes_path")
    )


def org_rows(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, ord, role_id, title, department, reports_to): the topic, up to four key concepts below it, and up to four supporting ones dealt to those."""
    n = F.greatest(F.size("concept"), F.lit(1))
    role = lambda i, key, title, department, parent: F.struct(key.alias("role_id"), F.substring(title, 1, 40).alias("title"), F.lit(department).alias("department"), parent.alias("reports_to"))
    name = lambda level, i: F.concat(F.lit(f"role_{level}_"), i.cast("string"))
    root = F.array(role(None, F.lit("role_0"), F.col("topic"), "Leadership", F.lit("—")))
    second = F.transform(F.slice("concept", 1, 4), lambda x, i: role(i, name(1, i), x, "Core", F.lit("role_0")))
    third = F.transform(F.slice("supporting", 1, 4), lambda x, i: role(i, name(2, i), x, "Support", name(1, i % n)))
    return _rows(intel, F.concat(root, second, third)).select(*KEYS, "ord", "x.*")


# -- figures --


def graph_series(intel: DataFrame, most: int = 10) -> DataFrame:
    """(doc_id, unit_id, ord, value, chart): the last number of each numeric signal, and the unit's chart kind by its cues."""
    low = F.lower(F.concat_ws(" ", "topic", _objective(), F.array_join("concept", " "), F.array_join("number", " "), F.array_join("chronology", " ")))
    rows = _rows(intel.withColumn("chart", let(low, lambda t: _best(t, dims.CHART_CUES, "bar"))), F.slice("number", 1, most), "chart")
    last = F.element_at(F.regexp_extract_all("x", F.lit(dims.CHART_NUMBER), F.lit(1)), -1)
    return rows.where(F.col("x").rlike("[0-9]")).select(*KEYS, "ord", F.regexp_replace(last, r"[,%\s]", "").cast("double").alias("value"), "chart")


def kpi_pairs(most: int = 8) -> Column:
    """(value, unit, label, trend, description) of a unit's numeric signals."""

    def metric(x: Column) -> Column:
        def by(raw: Column) -> Column:
            own = F.regexp_extract(raw, dims.KPI_UNIT, 1)
            unit = F.when(own != "", own).otherwise(F.regexp_extract(x, dims.KPI_UNIT, 1))
            value, low = strip(F.regexp_replace(raw, dims.KPI_UNIT, "")), F.lower(x)
            label = F.substring(squeeze(F.btrim(F.regexp_replace(x, dims.KPI_NUMBER, ""), F.lit(" -:—|"))), 1, 40)
            trend = F.when(contains_any(low, dims.TREND_UP), "up").when(contains_any(low, dims.TREND_DOWN), "down").otherwise("neutral")
            return F.struct(F.when(value == "", raw).otherwise(value).alias("value"), unit.alias("unit"), F.when(label == "", "Metric").otherwise(label).alias("label"), trend.alias("trend"), F.substring(x, 1, 80).alias("description"))

        return let(strip(F.regexp_extract(x, dims.KPI_NUMBER, 1)), by)

    return F.transform(F.filter(F.slice("number", 1, most), lambda x: x.rlike(dims.KPI_NUMBER)), metric)


def _longest_key(text: Column, points: Column, least: int, most: int) -> Column:
    """The last of points with a word of least characters or more that a lower-case text holds, cut to most characters; words are tried in order."""
    pairs = F.flatten(F.transform(points, lambda p: F.transform(F.filter(words(F.lower(p)), lambda w: F.length(w) >= least), lambda w: F.struct(w.alias("w"), F.substring(p, 1, most).alias("p")))))
    keys = F.array_distinct(F.transform(pairs, lambda x: x["w"]))
    hit = F.get(F.filter(keys, lambda w: text.contains(w)), F.lit(0))
    return let(hit, lambda w: F.when(w.isNotNull(), F.element_at(F.filter(pairs, lambda x: x["w"] == w), -1)["p"]))


def kpi_metrics(intel: DataFrame, enhancements: DataFrame | None = None) -> DataFrame:
    """(doc_id, unit_id, ord, value, unit, label, trend, description); a label that shares a word with a revision point of
    enhancements (doc_id, unit_id, revision_points) names it."""
    rows = _rows(intel, kpi_pairs()).select(*KEYS, "ord", "x.*")
    if enhancements is None:
        return rows
    told = rows.join(enhancements.select(*KEYS, "revision_points"), KEYS, "left")
    point = let(F.lower("label"), lambda low: _longest_key(low, F.coalesce("revision_points", _none()), 5, 40))
    return told.withColumn("label", let(point, lambda p: F.when(p.isNotNull(), F.substring(F.concat(F.col("label"), F.lit(" ("), p, F.lit(")")), 1, 60)).otherwise(F.col("label")))).drop("revision_points")


# -- lists --


def icon_concepts() -> Column:
    return F.transform(_first(("concept", 9), ("supporting", 6)), lambda x: F.substring(x, 1, 50))


def icon_items(intel: DataFrame, enhancements: DataFrame | None = None) -> DataFrame:
    """(doc_id, unit_id, ord, concept, icon, place, explanation): key concepts, else supporting ones, with the icon of their first keyword;
    explained by their definition, else by an example of enhancements (doc_id, unit_id, examples) that shares a long word, else by a template."""
    base = intel if enhancements is None else intel.join(enhancements.select(*KEYS, F.col("examples").alias("_examples")), KEYS, "left")
    examples = F.coalesce("_examples", _none()) if enhancements is not None else _none()
    rows = _rows(base.withColumn("_examples", examples), _first(("concept", 9), ("supporting", 6)), "definition", "_examples")
    low = F.lower("x")
    icon = F.coalesce(*[F.when(low.contains(k), F.lit(name)) for name, keys in dims.ICONS for k in keys], F.lit(dims.ICON_DEFAULT))
    known = F.get(F.filter("definition", lambda d: d["term"] == F.col("x")), F.lit(0))["definition"]
    shown = _longest_key(low, F.col("_examples"), 6, 80)
    text = F.coalesce(F.when(known != "", known), F.concat(F.lit("Example: "), shown), F.concat(F.lit("Key educational concept: "), low, F.lit(".")))
    place = F.element_at(F.array(*[F.lit(p) for p in dims.ICON_PLACES]), F.col("ord") % len(dims.ICON_PLACES) + 1)
    return rows.select(*KEYS, "ord", F.substring("x", 1, 50).alias("concept"), icon.alias("icon"), place.alias("place"), F.substring(text, 1, 100).alias("explanation"))


def checklist_items(intel: DataFrame, most: int = 12) -> DataFrame:
    """(doc_id, unit_id, ord, item, is_action): steps, else processes, 60 characters of each."""
    rows = _rows(intel, _first(("step", most), ("process", most)))
    return rows.select(*KEYS, "ord", F.substring("x", 1, 60).alias("item"), contains_any(F.lower("x"), dims.CHECKLIST_ACTIONS).alias("is_action"))


def smartart_elements(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, kind, ord, label): the kind by the first intent that has one, else by its cues, and up to eight labels."""
    names = F.transform("intents", lambda x: x["intent"])
    by_intent = F.get(F.filter(F.transform(names, lambda n: F.element_at(F.create_map(*[F.lit(v) for kv in dims.SMARTART_INTENTS.items() for v in kv]), n)), lambda k: k.isNotNull()), F.lit(0))
    low = F.lower(F.concat_ws(" ", "topic", _objective(), F.array_join("concept", " "), F.array_join("process", " ")))
    kind = F.coalesce(by_intent, let(low, lambda t: _best(t, dims.SMARTART_CUES, "Relationship")))
    typed = intel.withColumn("kind", kind)
    items = (
        F.when(F.col("kind") == "Hierarchy", F.slice(F.concat(F.array("topic"), "concept"), 1, 6))
        .when(F.col("kind") == "Cycle", _first(("process", 8), ("step", 8), ("concept", 8)))
        .when(F.col("kind").isin("Process", "Chevron"), _first(("step", 8), ("process", 8), ("concept", 8)))
        .otherwise(_first(("concept", 8), ("supporting", 8)))
    )
    return _rows(typed, items, "kind").select(*KEYS, "kind", "ord", F.substring("x", 1, 40).alias("label"))


def hierarchy_rows(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, ord, label, level, children): the topic over up to four key concepts, each over the first two supporting ones."""
    two = F.slice("supporting", 1, 2)
    root = F.array(F.struct(F.col("topic").alias("label"), F.lit(0).alias("level"), F.slice("concept", 1, 4).alias("children")))
    return _rows(intel, F.concat(root, F.transform(F.slice("concept", 1, 4), lambda x: F.struct(x.alias("label"), F.lit(1).alias("level"), two.alias("children"))))).select(*KEYS, "ord", "x.*")


def cycle_rows(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, ord, label, next_ord): processes, else steps, in a closed loop."""
    rows = _rows(intel.withColumn("_items", _first(("process", 8), ("step", 8))), F.col("_items"), "_items")
    return rows.select(*KEYS, "ord", F.substring("x", 1, 40).alias("label"), ((F.col("ord") + 1) % F.size("_items")).alias("next_ord"))


def mindmap_branches(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, branch, name, children): up to eight key concepts; supporting ones are dealt round robin, three to each at most,
    the first branch takes two details too, and four children are the most."""
    n = F.size("concept")
    dealt = lambda i: F.slice(F.filter("supporting", lambda x, j: j % n == i), 1, 3)
    details = F.slice(F.col("hierarchy.level_4_details"), 1, 2)
    children = lambda i: F.slice(F.when(i == 0, F.concat(dealt(i), details)).otherwise(dealt(i)), 1, 4)
    branches = F.transform(F.slice("concept", 1, 8), lambda x, i: F.struct(F.substring(x, 1, 50).alias("name"), F.transform(children(i), lambda c: F.substring(c, 1, 50)).alias("children")))
    return _rows(intel, branches).select(*KEYS, F.col("ord").alias("branch"), "x.*")


def image_prompts(intel: DataFrame, enhancements: DataFrame | None = None) -> DataFrame:
    """(doc_id, unit_id, subject, style, composition, angle, objective): a picture's description in words.

    The style follows the unit's level, the composition its number of concepts, the angle its intents; the first
    analogy of enhancements (doc_id, unit_id, analogies) enters the subject.
    """
    base = intel if enhancements is None else intel.join(enhancements.select(*KEYS, F.get("analogies", F.lit(0)).alias("_analogy")), KEYS, "left")
    analogy = F.col("_analogy") if enhancements is not None else F.lit(None).cast("string")
    topic, n = F.col("topic"), F.size("concept")
    subject = F.concat(
        F.lit("An educational visual representation of "), topic, F.lit("."),
        F.when(n > 0, F.concat(F.lit(" Illustrating the core concepts: "), F.array_join(F.slice("concept", 1, 3), ", "), F.lit("."))).otherwise(""),
        F.coalesce(F.concat(F.lit(" Visual metaphor inspired by: "), F.substring(analogy, 1, 120), F.lit(".")), F.lit("")),
    )
    style = F.element_at(F.create_map(*[F.lit(v) for kv in dims.IMAGE_STYLES.items() for v in kv]), F.col("level"))
    few, some, many = dims.IMAGE_COMPOSITIONS
    angle = F.coalesce(*[F.when(F.exists("intents", lambda x: x["intent"].isin(*kinds)), F.lit(text)) for kinds, text in dims.IMAGE_ANGLES if kinds], F.lit(dims.IMAGE_ANGLES[-1][1]))
    objective = F.when(_objective() != "", F.concat(F.lit("To visually reinforce: "), _objective())).otherwise(F.concat(F.lit("To help students build a mental model of "), topic, F.lit(".")))
    return base.select(
        *KEYS, F.substring(subject, 1, 300).alias("subject"), style.alias("style"), F.when(n <= 1, few).when(n <= 3, some).otherwise(many).alias("composition"), angle.alias("angle"), F.substring(objective, 1, 120).alias("objective")
    )


# -- selection --


def _selected(intel: DataFrame, enhancements: DataFrame | None, most: int) -> DataFrame:
    """intel plus _chosen: visuals of the opportunities by confidence (most of them), then an icon grid for examples, a checklist for
    revision points and a graph for numbers, each kind once."""
    base = intel
    if enhancements is not None:
        some = lambda c: F.size(F.coalesce(c, _none())) > 0
        base = intel.join(enhancements.select(*KEYS, some("examples").alias("_ex"), some("revision_points").alias("_rev")), KEYS, "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if enhancements is not None else F.lit(False)
    mapping = F.create_map(*[F.lit(v) for k, (visual, _) in dims.BUILT.items() for v in (k, visual)])
    # A plan's actions repeat the opportunities, and one picture, which fills the list if it is short.
    known = F.slice(F.array_distinct(F.concat(F.transform("visuals", lambda v: F.element_at(mapping, v["kind"])), F.array(F.lit("AI Image")))), 1, most)
    extra = lambda on, kind: F.when(on, F.array(F.lit(kind))).otherwise(_none())
    more = F.concat(known, extra(flag("_ex"), "Icon Grid"), extra(flag("_rev"), "Checklist"), extra(F.size("number") > 0, "Graph"))
    return base.withColumn("_chosen", F.array_distinct(F.concat(more)))


def select_visuals(intel: DataFrame, enhancements: DataFrame | None = None, most: int = 5) -> DataFrame:
    """(doc_id, unit_id, rank, kind): the visuals chosen for each unit, see _selected, and a picture and a mind map at the end."""
    whole = F.array_distinct(F.concat("_chosen", F.array(F.lit("AI Image"), F.lit("Mind Map"))))
    rows = exploded(_selected(intel, enhancements, most), whole, *KEYS, pos="pos", value="kind")
    return rows.select(*KEYS, (F.col("pos") + 1).alias("rank"), "kind")


def visual_density(intel: DataFrame, enhancements: DataFrame | None = None, most: int = 5) -> DataFrame:
    """(doc_id, unit_id, density, confidence): 0.15 a visual up to 0.75, 0.05 an opportunity up to 0.2, 0.05 for pictures that are there;
    half the plan's confidence, 0.4 for visuals against opportunities, and up to 0.1 for the length."""
    from .transform import confidence_of

    n = F.size(F.array_distinct(F.concat("_chosen", F.array(F.lit("AI Image"), F.lit("Mind Map")))))
    m = F.size("visuals")
    density = F.least(n * 0.15, F.lit(0.75)) + F.least(m * 0.05, F.lit(0.2)) + F.when(F.col("has_visuals"), 0.05).otherwise(0.0)
    confidence = confidence_of() * 0.5 + F.least(n / (m + 2), F.lit(1.0)) * 0.4 + F.when(F.col("n_words") > 50, 0.1).otherwise(0.05)
    return _selected(intel, enhancements, most).select(*KEYS, round_even(F.least(density, F.lit(1.0)), 3).alias("density"), round_even(F.least(confidence, F.lit(0.98)), 3).alias("confidence"))
