"""Intents, repeated blocks, priorities, opportunities, complexity and layouts of units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.rows import exploded, inlined
from ..functions.text import contains_any, let, lines, normalise, round_even, sentences, strip, words
from .chunks import pipe_table
from .signals import KINDS, add_signals, complexity_columns, holds_one, known_of, overlap, topic_of, with_items, with_sentences, word_set


def _hits(keys: list[str]) -> Column:
    """How many of the keywords a unit's text holds, from the columns of with_sentences."""
    return F.size(known_of(keys))


def intent_keyword_scores(units: DataFrame) -> DataFrame:
    """(doc_id, unit_id, intent, hits, score) for intents with a keyword in the unit's text: hits over 30 % of the list, 1 at most.

    The lists are literals, so no join and no shuffle: one narrow projection tests all of them.
    """
    text = with_sentences(units)
    found = [
        F.struct(F.lit(i).alias("rank"), F.lit(intent).alias("intent"), _hits(keys).alias("hits"), F.lit(max(1.0, 0.3 * len(keys))).alias("full"))
        for i, (intent, keys) in enumerate(dims.INTENT_KEYWORDS.items())
    ]
    rows = exploded(text, F.filter(F.array(*found), lambda x: x["hits"] > 0), "doc_id", "unit_id")
    return rows.select("doc_id", "unit_id", "x.rank", "x.intent", "x.hits", F.least(F.lit(1.0), F.col("x.hits") / F.col("x.full")).alias("score"))


def _bonus(intent: str) -> Column:
    """The structural bonus of an intent, from the columns of add_signals."""
    parts = []
    for name, what, least, value in dims.INTENT_BONUS:
        if name != intent:
            continue
        if what == "n_tables":
            count = F.size("tables")
        elif what == "n_equations":
            count = F.size("equations")
        elif what in ("n_diagrams", "n_charts"):
            count = F.col(what)
        elif what == "max_bullet_depth":
            count = F.coalesce(F.array_max(F.transform("_items", lambda b: b["bullet_level"])), F.lit(0))
        elif what == "list_or_steps":
            count = ((F.size("list") > 0) | (F.size("step") >= 3)).cast("int")
        else:
            count = F.size(what)
        parts.append(F.when(count >= least, F.lit(value)).otherwise(0.0))
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts)) if parts else F.lit(0.0)


def intent_structural_bonus(units: DataFrame) -> DataFrame:
    """(doc_id, unit_id, rank, intent, bonus) for intents with a bonus from a unit's signals, tables, equations, diagrams, charts and bullet depth."""
    rules = [F.struct(F.lit(i).alias("rank"), F.lit(intent).alias("intent"), _bonus(intent).alias("bonus")) for i, intent in enumerate(dims.INTENT_KEYWORDS)]
    rows = exploded(add_signals(units), F.filter(F.array(*rules), lambda x: x["bonus"] > 0), "doc_id", "unit_id")
    return rows.select("doc_id", "unit_id", "x.rank", "x.intent", "x.bonus")


def add_intents(signals: DataFrame) -> DataFrame:
    """The columns of add_signals plus _intents: an array of (minus, order, intent), the best first; minus is the negative score.

    A score is 0.6 x keywords + 0.4 x structure, to four places; ties keep the order of the intents.
    """
    counted = signals.withColumn("_lowered", F.col("_low_text"))
    scored = []
    for i, (intent, keys) in enumerate(dims.INTENT_KEYWORDS.items()):
        keyword = F.least(F.lit(1.0), _hits(keys) / F.lit(max(1.0, 0.3 * len(keys))))
        scored.append(F.struct((-round_even(keyword * 0.6 + _bonus(intent) * 0.4, 4)).alias("minus"), F.lit(i).alias("order"), F.lit(intent).alias("intent")))
    counted = counted.withColumn("_intents", F.slice(F.array_sort(F.filter(F.array(*scored), lambda x: -x["minus"] >= dims.INTENT_LEAST)), 1, dims.INTENT_MOST))
    general = F.array(F.struct(F.lit(-0.1).alias("minus"), F.lit(99).alias("order"), F.lit("General").alias("intent")))
    return counted.withColumn("_intents", F.when(F.size("_intents") > 0, F.col("_intents")).otherwise(general))


def classify_units(units: DataFrame) -> DataFrame:
    """(doc_id, unit_id, rank, intent, score): up to INTENT_MOST intents of INTENT_LEAST or more, else General with 0.1.

    All of it is one projection per unit: scores in an array, sorted and cut there.
    """
    rows = exploded(add_intents(add_signals(units)), "_intents", "doc_id", "unit_id", pos="pos")
    return rows.select("doc_id", "unit_id", (F.col("pos") + 1).alias("rank"), "x.intent", (-F.col("x.minus")).alias("score"))


def repeated_texts(blocks: DataFrame, least: int = 3, most_words: int = 8) -> DataFrame:
    """(doc_id, text, n): short block texts that a document holds least times or more."""
    text = F.lower(strip(F.col("text")))
    return blocks.select("doc_id", text.alias("text")).where((F.size(words(F.col("text"))) <= most_words) & (F.col("text") != "")).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def corpus_boilerplate(blocks: DataFrame, least_docs: int = 3, most_words: int = 8) -> DataFrame:
    """(text, n_docs): short block texts in least_docs documents or more."""
    text = F.lower(strip(F.col("text")))
    rows = blocks.select("doc_id", text.alias("text")).where((F.size(words(F.col("text"))) <= most_words) & (F.col("text") != "")).distinct()
    return rows.groupBy("text").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= least_docs)


def is_decorative(text: Column) -> Column:
    """Whether a text is a page or slide number, a date, an address, a legal line, or several of them between bars and dashes."""

    def alone(t: Column) -> Column:
        return t.rlike(r"^[0-9]+$") | t.rlike(dims.DECORATIVE)

    parts = F.filter(F.transform(F.split(text, "[|–—]"), strip), lambda p: p != "")
    return alone(text) | (text.rlike("[|–—]") & let(parts, lambda ps: (F.size(ps) >= 2) & F.forall(ps, lambda p: alone(p) | F.lower(p).isin(*dims.DECORATIVE_PARTS))))


def add_priorities(signals: DataFrame, repeated: Column) -> DataFrame:
    """The columns of add_signals plus _priorities: an array of (text, is_heading, bullet_level, priority, reason, n_words) per block.

    Arrays that each block is held against are bound first: a column of their own would be merged into the
    lambda and made anew for each block. The first rule that holds decides: Repeated (a short text in the array repeated, no heading), Decorative,
    Redundant (four words or more, over 0.8 alike to an earlier High block), High (headings, large type, bold
    up to 15 words, a key concept or defined term inside), Low (deep bullets, filler, over 45 words), Medium.
    """

    def judged(b: Column, concepts: Column, terms: Column, again: Column, fillers: Column) -> Column:
        def by(t: Column) -> Column:
            low, n = F.lower(t), F.size(words(t))
            big = F.coalesce(b["font_size"], F.lit(0.0)) >= 20
            reason = (
                F.when(F.array_contains(again, low) & ~b["is_heading"], "repeated")
                .when(is_decorative(t), "decorative")
                .when(b["is_heading"] | (b["heading_level"] > 0), "heading")
                .when(big, "large type")
                .when(b["is_bold"] & (n <= 15), "bold")
                .when(F.exists(concepts, lambda c: low.contains(c)), "key concept")
                .when(F.exists(terms, lambda c: low.contains(c)), "defined term")
                .when(b["bullet_level"] >= 2, "deep bullet")
                .when(holds_one(low, fillers), "filler")
                .when(n > 45, "dense")
                .otherwise("body")
            )
            return F.struct(t.alias("text"), b["is_heading"].alias("is_heading"), b["bullet_level"].alias("bullet_level"), reason.alias("reason"), n.alias("n_words"), word_set(t).alias("words"))

        return let(strip(b["text"]), by)

    concepts, terms = F.transform("concept", F.lower), F.transform("definition", lambda d: F.lower(d["term"]))
    blocks = let(F.struct(concepts.alias("c"), terms.alias("t"), repeated.alias("r"), known_of(dims.FILLER_PHRASES).alias("f")), lambda k: F.transform("_items", lambda b: judged(b, k["c"], k["t"], k["r"], k["f"])))
    found = signals.withColumn("_judged", F.filter(blocks, lambda b: b["text"] != ""))
    high = ["heading", "large type", "bold", "key concept", "defined term"]

    def fold(acc: Column, b: Column) -> Column:
        again = (b["n_words"] >= 4) & ~b["reason"].isin("repeated", "decorative") & F.exists(acc["high"], lambda w: (F.size(w) > 0.8 * F.size(b["words"])) & (F.size(b["words"]) > 0.8 * F.size(w)) & (overlap(w, b["words"]) > 0.8))
        return let(
            again,
            lambda r: F.struct(
                F.when(~r & b["reason"].isin(*high), F.concat(acc["high"], F.array(b["words"]))).otherwise(acc["high"]).alias("high"),
                F.when(r, F.concat(acc["out"], F.array(acc["i"]))).otherwise(acc["out"]).alias("out"),
                (acc["i"] + 1).alias("i"),
            ),
        )

    zero = F.struct(F.array().cast("array<array<string>>").alias("high"), F.array().cast("array<int>").alias("out"), F.lit(0).alias("i"))
    redundant = F.aggregate("_judged", zero, fold, lambda acc: acc["out"])

    def final(b: Column, i: Column, redundant: Column) -> Column:
        again = F.array_contains(redundant, i)
        priority = (
            F.when(again, "Redundant")
            .when(b["reason"] == "repeated", "Repeated")
            .when(b["reason"] == "decorative", "Decorative")
            .when(b["reason"].isin(*high), "High")
            .when(b["reason"] == "body", "Medium")
            .otherwise("Low")
        )
        return F.struct(b["text"], b["is_heading"], b["bullet_level"], priority.alias("priority"), F.when(again, "redundant").otherwise(b["reason"]).alias("reason"), b["n_words"])

    return found.withColumn("_priorities", let(redundant, lambda r: F.transform("_judged", lambda b, i: final(b, i, r)))).drop("_judged")


def with_repeated(units: DataFrame) -> DataFrame:
    """units plus _repeated: the short texts that the unit's document holds three times or more."""
    rows = exploded(with_items(units), "_items", "doc_id").select("doc_id", F.col("x.text").alias("text"))
    per = repeated_texts(rows).groupBy("doc_id").agg(F.collect_set("text").alias("_repeated"))
    joined = units.join(per, "doc_id", "left")
    return joined.withColumn("_repeated", F.coalesce("_repeated", F.array().cast("array<string>")))


def prioritise_blocks(units: DataFrame) -> DataFrame:
    """(doc_id, unit_id, ord, block_id, text, is_heading, bullet_level, priority, reason, n_words): a row per block, see add_priorities."""
    known = add_priorities(add_signals(with_repeated(units)), F.col("_repeated"))
    named = F.transform("_priorities", lambda b, i: F.struct(i.alias("ord"), F.concat(F.lit("s"), F.col("unit_id").cast("string"), F.lit("_tb_"), i.cast("string")).alias("block_id"), *[b[c].alias(c) for c in ("text", "is_heading", "bullet_level", "priority", "reason", "n_words")]))
    return inlined(known, named, "doc_id", "unit_id", key="ord")


def add_opportunities(intents: DataFrame) -> DataFrame:
    """The columns of add_intents plus _visuals: an array of (minus, order, kind), the most confident first."""
    # Notes count for signals and intents, but not for the words that call for a visual.
    low = F.lower(F.array_join(F.transform("_items", lambda b: b["text"]), " "))
    names = F.transform("_intents", lambda x: x["intent"])

    def has(intent: str) -> Column:
        return F.array_contains(names, intent)

    def holds(kind: str) -> Column:
        phrases = dims.VISUAL_PHRASES[kind]
        return F.when(F.col("notes") == "", F.size(known_of(phrases)) > 0).otherwise(let(low, lambda t: contains_any(t, phrases)))

    n = {k: F.size(k) for k in ("step", "process", "chronology", "comparison", "advantage", "disadvantage", "number", "concept")}
    flow = ((n["step"] >= 3) | (n["process"] >= 1)) & has("Workflow")
    rules = {
        "Flowchart": flow,
        "Timeline": (n["chronology"] >= 2) | has("Timeline"),
        "Comparison Table": (n["comparison"] > 0) | ((n["advantage"] > 0) & (n["disadvantage"] > 0)) | has("Comparison"),
        "KPI Cards": (n["number"] >= 2) | has("Statistics"),
        "Icon Grid": n["concept"].between(3, 6),
        "SmartArt": n["concept"].between(3, 6),
        "Cycle Diagram": has("Cycle") | holds("Cycle Diagram"),
        "Process Diagram": (n["step"] >= 2) & ~flow,
        "Checklist": ((n["step"] >= 3) | has("Checklist")) & holds("Checklist"),
        "Pyramid": has("Hierarchy") | holds("Pyramid"),
        "Decision Tree": holds("Decision Tree"),
        "Image with Caption": F.col("n_images") > 0,
        "Matrix": has("Table") | ((n["comparison"] >= 2) & (n["concept"] >= 4)),
        "Roadmap": has("Timeline") & holds("Roadmap"),
    }
    found = [F.when(rules[k], F.struct(F.lit(-v).alias("minus"), F.lit(i).alias("order"), F.lit(k).alias("kind"))) for i, (k, v) in enumerate(dims.OPPORTUNITIES.items())]
    return intents.withColumn("_visuals", F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull())))


def visual_opportunities(units: DataFrame) -> DataFrame:
    """(doc_id, unit_id, rank, kind, confidence): visuals that a unit's signals and intents call for, best first; one projection."""
    rows = exploded(add_opportunities(add_intents(add_signals(units))), "_visuals", "doc_id", "unit_id", pos="pos")
    return rows.select("doc_id", "unit_id", (F.col("pos") + 1).alias("rank"), "x.kind", (-F.col("x.minus")).alias("confidence"))


def complexity_of() -> tuple[Column, Column]:
    """Score and level from the columns of complexity_columns: five capped parts summed, to one place."""
    raw = (
        F.least(F.lit(2.0), F.col("vocab_richness") * 2.5)
        + F.least(F.lit(2.0), F.col("avg_sent_length") / 25.0 * 2.0)
        + F.least(F.lit(2.5), F.col("technical_density") / 5.0 * 2.5)
        + F.least(F.lit(2.0), F.col("special_elements") + F.col("element_count") * 0.1)
        + F.least(F.lit(1.5), F.col("max_bullet_depth") * 0.5)
    )
    score = round_even(F.greatest(F.lit(0.0), F.least(F.lit(10.0), raw)), 1)
    return score, F.when(score <= 2.5, "Introductory").when(score <= 5.5, "Intermediate").when(score <= 8.0, "Advanced").otherwise("Expert")


def complexity_score(units: DataFrame) -> DataFrame:
    """(doc_id, unit_id, complexity, level), see complexity_of."""
    score, level = complexity_of()
    return complexity_columns(with_sentences(units)).select("doc_id", "unit_id", score.alias("complexity"), level.alias("level"))


def unit_intelligence(units: DataFrame, across_units: bool = True) -> DataFrame:
    """One record per unit: topic, signals, complexity, intents, blocks with priorities, visuals, hierarchy and counts.

    Only the texts that repeat in a document are joined (across_units; without them no block is Repeated and
    nothing is shuffled); everything else is one projection.
    """
    nothing = F.array().cast("array<string>")
    s = add_opportunities(add_intents(add_signals(with_repeated(units) if across_units else units.withColumn("_repeated", nothing))))
    s = complexity_columns(add_priorities(s, F.col("_repeated")))
    score, level = complexity_of()
    topic = topic_of(F.col("title"), F.col("_items"))
    details = F.slice(F.concat("fact", "example", "number"), 1, 8)
    hierarchy = F.struct(topic.alias("level_1_topic"), F.col("concept").alias("level_2_key_concepts"), F.col("supporting").alias("level_3_supporting"), details.alias("level_4_details"))
    lines_ = F.transform("_items", lambda b: F.concat(F.when(b["is_heading"], "## ").otherwise(F.concat(F.repeat(F.lit("  "), b["bullet_level"]), F.lit("- "))), b["text"]))
    title = F.when(F.coalesce("title", F.lit("")) == "", F.concat(F.lit("Slide "), (F.col("unit_id") + 1).cast("string"))).otherwise(F.col("title"))
    return s.select(
        "doc_id", "unit_id", title.alias("title"), F.col("title").alias("own_title"), (strip(F.coalesce("text", F.lit(""))) != "").alias("has_text"), topic.alias("topic"), *KINDS, score.alias("complexity"), level.alias("level"),
        F.transform("_intents", lambda x: F.struct(x["intent"].alias("intent"), (-x["minus"]).alias("score"))).alias("intents"), F.get("_intents", F.lit(0))["intent"].alias("primary_intent"),
        F.col("_priorities").alias("blocks"), F.transform("_visuals", lambda x: F.struct(x["kind"].alias("kind"), (-x["minus"]).alias("confidence"))).alias("visuals"),
        hierarchy.alias("hierarchy"), (F.col("n_images") + F.col("n_charts") + F.col("n_diagrams") > 0).alias("has_visuals"), F.col("_lowered").alias("low_text"), F.col("notes"), F.col("tables"),
        F.size(words(F.concat_ws("\n", F.array_join(lines_, "\n"), F.when(F.col("notes") != "", F.col("notes"))))).alias("n_words"), "sentence_count", F.size("_items").alias("n_blocks"),
    )


def layout_of(text: Column) -> Column:
    """FLOWCHART, TABLE, METRIC or MINIMAL_TEXT by the first cue found."""
    low = F.lower(text)
    return (
        F.when(low.rlike(dims.LAYOUT_FLOW), "FLOWCHART")
        .when(pipe_table(text).isNotNull() | low.rlike(dims.LAYOUT_TABLE), "TABLE")
        .when(low.rlike(dims.LAYOUT_METRIC), "METRIC")
        .otherwise("MINIMAL_TEXT")
    )


def layout_class(chunks: DataFrame) -> DataFrame:
    """chunks plus layout_type."""
    return chunks.withColumn("layout_type", layout_of(F.col("text")))


def quantity(text: Column) -> Column:
    """The first figure of a text without its markdown, with currency and unit; empty if there is none."""

    def made(t: Column) -> Column:
        number, unit = F.regexp_extract(t, dims.QUANTITY, 2), F.regexp_extract(t, dims.QUANTITY, 3)
        return F.when(number == "", "").otherwise(F.concat(strip(F.regexp_extract(t, dims.QUANTITY, 1)), number, F.when(unit.isin("", "%"), unit).otherwise(F.concat(F.lit(" "), unit))))

    return let(normalise(F.coalesce(text, F.lit(""))), made)


def structure_slides(chunks: DataFrame, max_chunks: int | None = None) -> DataFrame:
    """(doc_id, slide_ix, layout_type, title, bullets, takeaway, metric_value, table_rows): a slide per chunk.

    Bullets are the chunk's lines, or its sentences if it has one line. A TABLE without rows or a METRIC
    without a figure is MINIMAL_TEXT. max_chunks limits the chunks of a document on request only.
    """
    if max_chunks is not None:
        chunks = chunks.where(F.col("chunk_id") < max_chunks)
    text = F.col("text")
    own = F.filter(F.transform(lines(text), strip), lambda x: x != "")
    layout = layout_of(text)
    layout = F.when((layout == "TABLE") & pipe_table(text).isNull(), "MINIMAL_TEXT").when((layout == "METRIC") & (quantity(text) == ""), "MINIMAL_TEXT").otherwise(layout)
    return chunks.select(
        "doc_id",
        F.col("chunk_id").alias("slide_ix"),
        layout.alias("layout_type"),
        F.when(F.coalesce("title", F.lit("")) == "", "Overview").otherwise(F.col("title")).alias("title"),
        F.when(F.size(own) > 1, own).otherwise(sentences(text)).alias("bullets"),
        F.lit("Review key details carefully.").alias("takeaway"),
        F.when(layout == "METRIC", F.substring(quantity(text), 1, 16)).alias("metric_value"),
        F.when(layout == "TABLE", pipe_table(text)).alias("table_rows"),
    )


def topic_tag(units: DataFrame, title_col: str = "title") -> DataFrame:
    """units plus topic_tag: the first keyword group that the title touches, else the default."""
    low = F.lower(F.coalesce(F.col(title_col), F.lit("")))
    tag = F.coalesce(*[F.when(contains_any(low, keys), F.lit(name)) for name, keys in dims.TOPIC_KEYWORDS], F.lit(dims.TOPIC_DEFAULT))
    return units.withColumn("topic_tag", tag)


def intent_histogram(classified: DataFrame, docs: DataFrame) -> DataFrame:
    """(lang, intent, n_docs): documents by language and primary intent."""
    first = classified.where("rank = 1").select("doc_id", "intent")
    return first.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "intent").agg(F.count_distinct("doc_id").alias("n_docs"))

