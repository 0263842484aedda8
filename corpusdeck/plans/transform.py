"""Transformation plans: what to do with each block of a unit, and what it saves.

Every function takes the records of classify.unit_intelligence; a unit's plan comes from its own row alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.rows import exploded, inlined
from ..functions.text import contains_any, let, round_binary, strip, words

KEYS = ["doc_id", "unit_id"]


def _matches(low: Column, items: Column) -> Column:
    """Whether a lower-case text holds an item or lies in one, in any case."""
    return F.exists(items, lambda x: low.contains(F.lower(x)) | F.lower(x).contains(low))


def _has(kind: str) -> Column:
    return F.exists("visuals", lambda v: v["kind"] == kind)


def summarise(text: Column) -> Column:
    """The first sentence; beyond 12 words its first 10 and an ellipsis."""
    first = strip(F.element_at(F.split(text, dims.SENTENCE_END), 1))
    return let(words(first), lambda w: F.when(F.size(w) > 12, F.concat(F.array_join(F.slice(w, 1, 10), " "), F.lit("..."))).otherwise(first))


def with_actions(intel: DataFrame) -> DataFrame:
    """intel plus actions: (block, action, remaining, note) per block, by the first rule that holds."""

    def rules(b: Column) -> Column:
        def by(low: Column) -> Column:
            text, n = b["text"], b["n_words"]
            boiler = (
                (contains_any(low, dims.FOOTER_WORDS) & text.rlike(dims.FOOTER_NUMBER))
                | (contains_any(low, dims.LEGAL_PHRASES) & (n < 10))
                | (b["priority"] == "Decorative")
            )
            title = F.lower("title")
            sides = F.exists("comparison", lambda c: low.contains(F.lower(c["left"])) | low.contains(F.lower(c["right"])))
            action = (
                F.when(low.isin(title, F.concat(F.lit("## "), title)), "KEEP")
                .when(boiler, "REMOVE")
                .when(b["priority"].isin("Redundant", "Repeated"), "REMOVE")
                .when((_has("Flowchart") | _has("Process Diagram")) & _matches(low, F.concat("step", "process")), "MOVE_TO_VISUAL")
                .when((_has("Timeline") | _has("Roadmap")) & _matches(low, F.col("chronology")), "MOVE_TO_VISUAL")
                .when(_has("KPI Cards") & F.exists("number", lambda x: text.contains(x)), F.when(n > 15, "MOVE_TO_NOTES").otherwise("MOVE_TO_VISUAL"))
                .when(_has("Comparison Table") & (_matches(low, F.concat("advantage", "disadvantage")) | sides), "MOVE_TO_VISUAL")
                .when(_has("Checklist") & _matches(low, F.col("step")) & contains_any(low, dims.TASK_WORDS), "MOVE_TO_VISUAL")
                .when(b["priority"] == "Low", "MOVE_TO_NOTES")
                .when((b["priority"] == "Medium") & (n > 12), "SUMMARIZE")
                .otherwise("KEEP")
            )
            return F.struct(text.alias("text"), b["priority"].alias("priority"), action.alias("action"))

        return let(F.lower(b["text"]), by)

    def told(a: Column, i: Column) -> Column:
        remaining = F.when(a["action"] == "KEEP", a["text"]).when(a["action"] == "SUMMARIZE", summarise(a["text"]))
        note = F.when(a["action"] == "MOVE_TO_NOTES", a["text"]).when(a["action"] == "SUMMARIZE", F.concat(F.lit("Original detail: "), a["text"]))
        block_id = F.concat(F.lit("s"), F.col("unit_id").cast("string"), F.lit("_tb_"), i.cast("string"))
        return F.struct(i.alias("ord"), block_id.alias("block_id"), a["text"].alias("text"), a["priority"].alias("priority"), a["action"].alias("action"), remaining.alias("remaining"), note.alias("note"))

    return intel.withColumn("actions", F.transform(F.transform("blocks", rules), told))


def text_actions(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, ord, block_id, text, priority, action, remaining, note): KEEP, SUMMARIZE, REMOVE, MOVE_TO_VISUAL or MOVE_TO_NOTES per block.

    The title stays, boilerplate and repetition go; what a flow, timeline, metric cards, comparison table or
    checklist of the unit shows moves to it (long explanations of metrics to the notes); low blocks move to
    the notes, long medium ones are summarised, and the others stay.
    """
    return inlined(with_actions(intel), "actions", *KEYS, key="ord")


def summarise_blocks(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, ord, remaining): what stays on the slide, summaries in place of long blocks."""
    return text_actions(intel).where("remaining is not null").select(*KEYS, "ord", "remaining")


def remaining_of() -> Column:
    """What stays on the slide, from the columns of with_actions."""
    return F.filter(F.transform("actions", lambda a: a["remaining"]), lambda x: x.isNotNull())


def notes_of() -> Column:
    """The speaker notes, from the columns of with_actions: the unit's own, the blocks moved there, and its objective."""
    moved = F.filter(F.transform("actions", lambda a: a["note"]), lambda x: x.isNotNull())
    parts = F.concat(
        F.when(F.col("notes") != "", F.array(F.concat(F.lit("Original notes: "), F.col("notes")))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(moved) > 0, F.concat(F.array(F.lit("Additional slide detail offloaded to notes:")), F.transform(moved, lambda x: F.concat(F.lit("- "), x)))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("Focus learning objective: "), F.coalesce(F.get("objective", F.lit(0)), F.lit("")))),
    )
    return F.array_join(parts, "\n")


def speaker_notes(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, speaker_notes), see notes_of."""
    return with_actions(intel).select(*KEYS, notes_of().alias("speaker_notes"))


def plan_texts(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, remaining, speaker_notes): the texts of each unit's plan."""
    return with_actions(intel).select(*KEYS, remaining_of().alias("remaining"), notes_of().alias("speaker_notes"))


def _built(visuals: str = "visuals", most: int = 5) -> Column:
    """The unit's first most opportunities that have a builder."""
    return F.slice(F.filter(visuals, lambda v: ~v["kind"].isin(*dims.UNBUILT)), 1, most)


def _capped_words(items: Column, most: int) -> Column:
    return F.aggregate(items, F.lit(0), lambda n, x: n + F.least(F.lit(most), F.size(words(x))))


def compression_stats(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, original_words, target_words, ratio, readability): words before and after a plan, and what that gains.

    The target has the words that stay and, in part, those of the first visual (flow, timeline, table, cards or
    icons). A target at or above the original is 70 % of it; five is the least.
    """
    from .specs import flow_labels, icon_concepts, kpi_pairs, table_of, timeline_titles

    planned = with_actions(intel).withColumn("_built", _built())
    first = F.get("_built", F.lit(0))["kind"]
    table = table_of()
    spec = (
        F.when(first.isin("Flowchart", "Process Diagram"), _capped_words(flow_labels(), 3))
        .when(first.isin("Timeline"), _capped_words(timeline_titles(), 3))
        .when(first == "Comparison Table", _capped_words(table["headers"], 2) + _capped_words(F.flatten(table["rows"]), 3))
        .when(first == "KPI Cards", _capped_words(F.transform(kpi_pairs(), lambda m: m["value"]), 2) + _capped_words(F.transform(kpi_pairs(), lambda m: m["label"]), 3))
        .when(first == "Icon Grid", _capped_words(icon_concepts(), 3))
        .otherwise(0)
    )
    kept = F.aggregate(F.filter("actions", lambda a: a["remaining"].isNotNull()), F.lit(0), lambda n, a: n + F.size(words(a["remaining"])))
    counted = planned.select(*KEYS, F.col("n_words").cast("long").alias("original_words"), (kept + spec).cast("long").alias("count"), (F.size("_built") + 1).alias("n"))
    capped = F.when((F.col("original_words") > 0) & (F.col("count") >= F.col("original_words")), F.floor(F.col("original_words") * 0.7)).otherwise(F.col("count"))
    aimed = counted.withColumn("target_words", F.greatest(F.lit(5), capped).cast("long"))
    whole = aimed.withColumn("whole", F.when(F.col("original_words") > 0, F.col("target_words") / F.col("original_words")).otherwise(1.0))
    gain = F.bround(F.least(F.greatest(F.lit(5.0), (1.0 - F.col("whole")) * 100 * 0.75 + F.col("n") * 10), F.lit(95.0)), 1)
    return whole.select(*KEYS, "original_words", "target_words", F.bround("whole", 3).alias("ratio"), F.when(F.col("whole") == 1.0, F.lit(0.0)).otherwise(gain).alias("readability"))


def confidence_of() -> Column:
    """A plan's confidence: 0.75, more with a strong opportunity, less for units below ten words."""
    best = F.coalesce(F.array_max(F.transform("visuals", lambda v: v["confidence"])), F.lit(0.0))
    return round_binary(F.least(F.greatest(F.lit(0.4), 0.75 + best * 0.15 - F.when(F.col("n_words") < 10, 0.1).otherwise(0.0)), F.lit(0.98)))


def plan_confidence(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, confidence), see confidence_of."""
    return intel.select(*KEYS, confidence_of().alias("confidence"))


def visual_actions(intel: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, unit_id, rank, kind, action, block_ids): the best opportunities that have a builder and the blocks behind them, then one picture.

    A block is behind a visual if it holds, in any case, a text of one of the signals that the visual draws on;
    behind the picture are the first two blocks.
    """
    ids = F.transform("blocks", lambda b, i: F.struct(F.concat(F.lit("s"), F.col("unit_id").cast("string"), F.lit("_tb_"), i.cast("string")).alias("id"), F.lower(b["text"]).alias("low")))
    base = intel.withColumns({"_ids": ids, "_built": _built(most=most)})

    def behind(kind: Column) -> Column:
        texts = F.array().cast("array<string>")
        for name, (_, signals) in dims.BUILT.items():
            texts = F.when(kind == name, F.concat(*signals) if signals else F.array().cast("array<string>")).otherwise(texts)
        return let(F.transform(texts, F.lower), lambda ts: F.transform(F.filter("_ids", lambda b: F.exists(ts, lambda t: b["low"].contains(t))), lambda b: b["id"]))

    def shown(kind: Column) -> Column:
        return F.when(kind == "Pyramid", "SmartArt").otherwise(kind)

    visuals = F.transform("_built", lambda v, i: F.struct((i + 1).alias("rank"), shown(v["kind"]).alias("kind"), F.lit("REPLACE_TEXT_WITH_VISUAL").alias("action"), behind(v["kind"]).alias("block_ids")))
    picture = F.struct((F.size("_built") + 1).alias("rank"), F.lit("AI Image").alias("kind"), F.lit("ADD_AI_IMAGE").alias("action"), F.transform(F.slice("_ids", 1, 2), lambda b: b["id"]).alias("block_ids"))
    return inlined(base, F.concat(visuals, F.array(picture)), *KEYS, key="rank")


def source_block_ids(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, kind, block_id): a row per visual and block behind it."""
    rows = visual_actions(intel).where("kind <> 'AI Image'")
    return exploded(rows, "block_ids", *KEYS, "kind", value="block_id").drop("ord")
