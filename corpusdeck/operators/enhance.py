"""Enhancement of slides by a model: which slides are asked for, what the model is told, and how far its answers can be trusted.

The model itself is not here. Its requests are rows with a context, its answers a table that is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import round_even, strip
from ..plans.transform import confidence_of, notes_of, remaining_of, with_actions
from .decks import density_profiles

#: Text and list columns of a table of answers; filled ones count for the confidence (fixed values).
ANSWERS = [
    "improved_explanation", "simplified_explanation", "revision_points", "common_mistakes", "examples", "analogies", "real_world_applications",
    "interview_questions", "discussion_questions", "mnemonic", "learning_tips",
]


def slide_text(slides: DataFrame) -> Column:
    """A slide's own text where the table has one that is not blank, else its bullets, one per line."""
    bullets = F.array_join(F.coalesce("bullets", F.array().cast("array<string>")), "\n")
    if "text" not in slides.columns:
        return bullets
    return F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).otherwise(bullets)


def enhancement_eligible(slides: DataFrame, decks: DataFrame | None = None, most: int = dims.MOST_ENHANCED) -> DataFrame:
    """(doc_id, slide_ix, rank, title, text): the first most slides of each deck that have text and are no quiz.

    decks (doc_id, density) leaves out the decks whose profile takes no enhancements; a deck that it lacks, or
    an unknown density, has the default profile. The cap is applied before the exchange that brings a deck's
    slides together, so at most most of its slides per task travel; profiles meet the survivors.

    A null layout is no quiz; a null or blank text, or no bullets, is no text; slides with equal numbers are
    taken by title and text. Rows of a null doc_id are one deck. An empty table gives an empty table.
    """
    text = slide_text(slides)
    asked = slides.where(F.upper(F.coalesce("layout_type", F.lit(""))) != "QUIZ").select("doc_id", "slide_ix", F.coalesce("title", F.lit("")).alias("title"), text.alias("text")).where(strip(F.col("text")) != "")
    order = Window.partitionBy("doc_id").orderBy("slide_ix", "title", "text")
    first = asked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    if decks is not None:
        without = density_profiles(decks.select("doc_id", "density")).where(~F.col("enhanced")).select(F.col("doc_id").alias("_doc")).distinct()
        first = first.join(without, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_anti")
    return first.select("doc_id", "slide_ix", "rank", "title", "text")


def _listed(label: str, column: str, most: int, separator: str) -> Column:
    return F.when(F.size(column) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(column, 1, most), separator)))


def context_of(remaining: Column, notes: Column) -> Column:
    """What a model is told of a unit, as an array: a line per field that is not empty, each with its cap of items or characters."""
    parts = [F.when(F.col("topic") != "", F.concat(F.lit("Main topic: "), F.col("topic")))]
    parts += [F.when(F.get("objective", F.lit(0)) != "", F.concat(F.lit("Learning objective: "), F.get("objective", F.lit(0))))]
    parts += [_listed("Key concepts", "concept", 6, ", ")]
    defined = F.transform(F.slice("definition", 1, 3), lambda d: F.concat(d["term"], F.lit(": "), d["definition"]))
    parts += [F.when(F.size("definition") > 0, F.concat(F.lit("Definitions: "), F.array_join(defined, "; ")))]
    parts += [_listed(*x) for x in dims.CONTEXT_LISTS]
    parts += [F.when(F.col("level") != "", F.concat(F.lit("Complexity level: "), F.col("level")))]
    named = F.transform(F.slice("intents", 1, 3), lambda x: x["intent"])
    parts += [F.when(F.size("intents") > 0, F.concat(F.lit("Content type: "), F.array_join(named, ", ")))]
    parts += [F.when(F.size(remaining) > 0, F.concat(F.lit("Slide content: "), F.substring(F.array_join(F.slice(remaining, 1, 4), " "), 1, 400)))]
    parts += [F.when(notes != "", F.concat(F.lit("Speaker notes excerpt: "), F.substring(notes, 1, 300)))]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def enhancement_context(intel: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """(doc_id, unit_id, context, n_fields) of records of classify.unit_intelligence, see context_of.

    The plan's texts are worked out from the record itself or, where plans (doc_id, unit_id, remaining,
    speaker_notes) is given, taken from there; a unit that it lacks has none. A context is made from one row,
    so without plans nothing is shuffled. Null texts and empty lists are left out, field and all; a record without
    anything has an empty context.
    """
    if plans is None:
        planned = with_actions(intel).withColumns({"_remaining": remaining_of(), "_notes": notes_of()})
    else:
        told = plans.select(F.col("doc_id").alias("_doc"), F.col("unit_id").alias("_unit"), F.col("remaining").alias("_remaining"), F.col("speaker_notes").alias("_notes"))
        planned = intel.join(told, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("unit_id").eqNullSafe(F.col("_unit")), "left")
    fields = context_of(F.coalesce("_remaining", F.array().cast("array<string>")), F.coalesce("_notes", F.lit("")))
    out = planned.select("doc_id", "unit_id", fields.alias("_fields"))
    return out.select("doc_id", "unit_id", F.array_join("_fields", "\n").alias("context"), F.size("_fields").alias("n_fields"))


def answered(answers: DataFrame) -> Column:
    """How many of the columns ANSWERS are filled: texts that are not empty, lists with an item; columns that the table lacks are not."""
    kinds = dict(answers.dtypes)
    filled = [F.size(c) > 0 if kinds[c].startswith("array") else F.coalesce(F.col(c), F.lit("")) != "" for c in ANSWERS if c in kinds]
    return sum((F.coalesce(f, F.lit(False)).cast("int") for f in filled), F.lit(0))


def enhancement_confidence(intel: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, unit_id, richness, n_answers, plan_bonus, confidence) of every record, with or without answers.

    Eight kinds of source material count 0.05 each (0.4 at most), the filled columns of answers (doc_id,
    unit_id and any of ANSWERS) 0.6 in all, the plan's own confidence a tenth. A unit without a row of answers has none
    filled. Answers are counted and summed up per unit first, the best row of several, so that the join can't multiply
    records and carries one number per unit.
    """
    best = answers.select(F.col("doc_id").alias("_doc"), F.col("unit_id").alias("_unit"), answered(answers).alias("n")).groupBy("_doc", "_unit").agg(F.max("n").alias("n_answers"))
    sources = [F.size(c) > 0 for c in ("concept", "definition", "step", "formula", "number", "fact")]
    planned = with_actions(intel).withColumns({"_remaining": remaining_of(), "_notes": notes_of()})
    rich = [F.coalesce(s, F.lit(False)).cast("int") for s in [*sources, F.size("_remaining") > 0, F.coalesce("_notes", F.lit("")) != ""]]
    slim = planned.select("doc_id", "unit_id", F.least(F.lit(0.4), sum(rich, F.lit(0)) * 0.05).alias("richness"), F.least(F.lit(0.1), confidence_of() * 0.1).alias("plan_bonus"))
    joined = slim.join(best, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("unit_id").eqNullSafe(F.col("_unit")), "left")
    n = F.coalesce("n_answers", F.lit(0))
    total = F.least(F.lit(1.0), F.col("richness") + n / len(ANSWERS) * 0.6 + F.col("plan_bonus"))
    return joined.select("doc_id", "unit_id", round_even("richness", 2).alias("richness"), n.alias("n_answers"), round_even("plan_bonus", 4).alias("plan_bonus"), round_even(total, 3).alias("confidence"))
