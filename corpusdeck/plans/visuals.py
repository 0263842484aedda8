"""The visual that a unit's signals call for, and slides upgraded to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_label, drop_restatements, let, restates_any
from ..operators.classify import quantity
from .specs import KEYS, TEXTS, chain_text, diagram_of, flow_labels, _node_kinds

#: Aspects that only connect two sides (fixed values).
CONNECTORS = ["vs", "versus", "and", "or", "than", "whereas", ""]
FIELDS = "struct<layout_type:string,title:string,bullets:array<string>,takeaway:string,diagram:string,table_rows:array<array<string>>,metric_value:string,metric_label:string,metric_desc:string>"
LEAST_STEPS, LEAST_METRICS, LEAST_CONCEPTS = 3, 2, 3


def _labels(items: Column, limit: int) -> Column:
    return F.transform(items, lambda x: clean_label(x, limit))


def _plan(layout: str, title: Column, bullets: Column, takeaway: Column, **more: Column) -> Column:
    null = F.lit(None)
    kept = {"diagram": null.cast("string"), "table_rows": null.cast("array<array<string>>"), "metric_value": null.cast("string"), "metric_label": null.cast("string"), "metric_desc": null.cast("string")} | more
    return F.struct(F.lit(layout).alias("layout_type"), title.alias("title"), bullets.alias("bullets"), takeaway.alias("takeaway"), *[c.alias(n) for n, c in kept.items()]).cast(FIELDS)


def _compared(c: Column) -> Column:
    """(aspect, left, right) of a comparison whose sides are whole and short; null for others."""
    sides = F.struct(clean_label(c["left"], 40).alias("left"), clean_label(c["right"], 40).alias("right"), clean_label(c["aspect"], 40).alias("aspect"))

    def row(x: Column) -> Column:
        fit = (x["left"] != "") & (x["right"] != "") & (F.length(x["left"]) <= 38) & (F.length(x["right"]) <= 38)
        return F.when(fit, F.array(F.when(F.lower(x["aspect"]).isin(*CONNECTORS), "Aspect").otherwise(x["aspect"]), x["left"], x["right"]))

    return let(sides, row)


def plan_visual(intel: DataFrame) -> DataFrame:
    """(doc_id, unit_id, plan): for records of classify.unit_intelligence whose title is the unit's own, the first of a flow of three
    steps or processes, a flow of three dated items, a table of comparisons, a headline figure and a grid of three concepts; null for none."""
    own = F.coalesce("own_title", F.lit(""))
    objective = F.coalesce(F.get("objective", F.lit(0)), F.lit(""))

    def or_else(*texts: Column) -> Column:
        return F.coalesce(*[F.when(t != "", t) for t in texts[:-1]], texts[-1])

    def aim(text: str) -> Column:
        return or_else(objective, F.lit(text))

    steps = F.when(F.size("step") > 0, F.col("step")).otherwise(F.col("process"))
    some = intel.withColumn("_nodes", _node_kinds(flow_labels()))
    labels = F.filter(_labels(F.transform("_nodes", lambda x: x["label"]), 60), lambda x: x != "")
    some = some.withColumns(
        {
            "_flow": F.slice(F.when(F.size(labels) > 0, labels).otherwise(_labels(F.slice(steps, 1, 6), 60)), 1, 6),
            "_dates": _labels(F.slice("chronology", 1, 6), 60),
            "_rows": F.filter(F.transform(F.slice("comparison", 1, 6), _compared), lambda r: r.isNotNull()),
            "_value": quantity(F.get("number", F.lit(0))),
            "_cards": let(drop_restatements(_labels(F.col("concept"), 70)), lambda cs: F.filter(cs, lambda c: ~restates_any(c, F.array(own)))),
        }
    )
    headers = F.array(*[F.lit(x) for x in ("Aspect", "Option A", "Option B")])
    first = F.get("number", F.lit(0))
    plan = (
        F.when(F.size(steps) >= LEAST_STEPS, _plan("FLOWCHART", or_else(own, F.col("topic"), F.lit("Process")), F.col("_flow"), aim("Follow the steps in order."), diagram=diagram_of(F.col("_nodes"))))
        .when(F.size("chronology") >= LEAST_STEPS, _plan("FLOWCHART", or_else(own, F.lit("Timeline")), F.col("_dates"), aim("Events in chronological order."), diagram=chain_text(F.col("_dates"), "T", 32, "LR")))
        .when(F.size("_rows") > 0, _plan("TABLE", or_else(own, F.lit("Comparison")), F.array().cast(TEXTS), aim("Compare the options side by side."), table_rows=F.concat(F.array(headers), F.col("_rows"))))
        .when(
            (F.size("number") >= LEAST_METRICS) & (F.col("_value") != ""),
            _plan("METRIC", or_else(own, F.lit("Key Metric")), drop_restatements(_labels(F.slice("number", 2, 3), 80)), objective, metric_value=F.substring("_value", 1, 16), metric_label=or_else(own, F.col("topic"), F.lit("Metric")), metric_desc=clean_label(first, 120)),
        )
        .when(F.size("_cards") >= LEAST_CONCEPTS, _plan("CARD_GRID", or_else(own, F.col("topic"), F.lit("Key Concepts")), F.slice("_cards", 1, 4), objective))
    )
    return some.select(*KEYS, F.when(F.col("has_text"), plan).alias("plan"))


def enrich_slides(slides: DataFrame, plans: DataFrame) -> DataFrame:
    """slides (doc_id, slide_ix, layout_type, title, bullets, takeaway, metric_value, table_rows, ...) with a unit's plan in place of theirs
    where they have no structure of their own: plain text and card grids, flows without a diagram, metrics without a figure."""
    layout, value = F.upper(F.coalesce("layout_type", F.lit("MINIMAL_TEXT"))), F.lower(F.trim(F.coalesce("metric_value", F.lit(""))))
    drawn = F.col("diagram").isNotNull() if "diagram" in slides.columns else F.lit(False)
    weak = layout.isin("MINIMAL_TEXT", "CARD_GRID") | ((layout == "FLOWCHART") & ~drawn) | ((layout == "METRIC") & value.isin("", "key stat", "100%"))
    joined = slides.join(plans.select("doc_id", F.col("unit_id").alias("slide_ix"), "plan"), ["doc_id", "slide_ix"], "left")
    use = weak & F.col("plan").isNotNull()
    names = ["layout_type", "title", "bullets", "takeaway", "diagram", "table_rows", "metric_value", "metric_label", "metric_desc"]
    return joined.withColumns({n: F.when(use, F.col("plan")[n]).otherwise(F.col(n) if n in slides.columns else F.lit(None)) for n in names} | {"upgraded": F.coalesce(use, F.lit(False))}).drop("plan")
