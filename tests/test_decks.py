"""Profiles per deck, payloads, scores with images, and summaries of runs."""

import datetime as dt
import json

from pyspark.sql import functions as F

from corpusdeck import dims
from corpusdeck.operators import decks as D
from corpusdeck.sources import sinks as W

SLIDE = "doc_id long, slide_ix int, layout_type string, title string, bullets array<string>, takeaway string, table_rows array<array<string>>"


def slides(spark, docs=(1, 2, 3)):
    rows = []
    for doc in docs:
        rows += [(doc, 0, "MINIMAL_TEXT", "Title", [f"bullet number {i} of deck " + "word " * 30 for i in range(11)], "take", None)]
        rows += [(doc, 1, "TABLE", "T", ["lead"], "", [["h1", "h2"], *[[str(i), "x"] for i in range(13)]]), (doc, 2, "FLOWCHART", "F", [f"step {i}" for i in range(9)], "t", None), (doc, 3, "METRIC", "M", ["a", "b"], "t", None)]
    return spark.createDataFrame(rows, SLIDE)


def rows_of(df):
    return sorted((str(tuple(r)) for r in df.collect()))


def test_one_call_with_three_profiles_is_three_calls(spark):
    decks = spark.createDataFrame([(1, "LOW"), (2, "heavy"), (3, "no such"), (3, None)], "doc_id long, density string")
    extras = spark.createDataFrame([(d, 0, ["e"], [], ["r"], [" "], ["p", "q"]) for d in (1, 2, 3, 4)], "doc_id long, slide_ix int, examples array<string>, analogies array<string>, real_world_applications array<string>, common_mistakes array<string>, revision_points array<string>")
    whole, four = slides(spark, (1, 2, 3, 4)), {1: "low", 2: "heavy", 3: "medium", 4: "medium"}
    one = D.apply_density(whole, decks, extras)
    each = [D.apply_density(whole.where(F.col("doc_id") == d), density, extras) for d, density in four.items()]
    want = sorted(r for df in each for r in rows_of(df))
    assert rows_of(one) == want and one.columns == each[0].columns
    folded = {(x.doc_id, x.ord): x.extra for x in D.fold_extras(extras, decks).collect()}
    assert folded == {(2, 0): "Example: e", (2, 1): "In practice: r", (2, 2): "Recall: p", (3, 0): "Example: e", (4, 0): "Example: e"}


def test_slides_keep_columns_named_like_a_profiles_fields(spark):
    named = slides(spark, (1,)).withColumn("max_rows", F.lit("mine"))
    decks = spark.createDataFrame([(1, "low")], "doc_id long, density string")
    out, profile = D.with_profile(named, decks)
    assert out.select("max_rows").distinct().collect()[0][0] == "mine" and out.select(profile["max_rows"]).first()[0] == dims.PROFILES["low"][3]
    assert rows_of(D.apply_density(named, decks)) == rows_of(D.apply_density(slides(spark, (1,)), "low"))


def test_images_add_to_the_visual_bonus(spark):
    plain = {x.slide_ix: x for x in D.score_slides(slides(spark, (1,))).collect()}
    shown = {x.slide_ix: x for x in D.score_slides(slides(spark, (1,)).withColumn("has_image", F.col("slide_ix") != 2)).collect()}
    assert [shown[i].visual_bonus - plain[i].visual_bonus for i in range(4)] == [5.0, 5.0, 0.0, 5.0]
    assert max(x.visual_bonus for x in shown.values()) == 15.0 and shown[0].score == plain[0].score + 5
    null = D.score_slides(slides(spark, (1,)).withColumn("image", F.lit(None).cast("string"))).collect()
    assert {x.slide_ix: x.score for x in null} == {i: x.score for i, x in plain.items()}


def test_payloads_have_all_fields_with_defaults(spark):
    bare = spark.createDataFrame([(1, 4, None, None)], "doc_id long, slide_ix int, layout_type string, title string")
    got = json.loads(W.deck_payload(bare).first().payload)
    nothing = dict.fromkeys(W.OPTIONAL)
    assert got == {"index": 4, "layout_type": "MINIMAL_TEXT", "title": "Slide 5", "bullets": [], "takeaway": "", **nothing, "visual_source": "router", "continued": False, "has_image": False, "source_text": ""}
    assert len(got) == 18
    full = bare.select("doc_id", "slide_ix", F.lit("table").alias("layout_type"), F.lit("T").alias("title"), F.array(F.lit("b")).alias("bullets"), F.array(F.array(F.lit("c"))).alias("table_rows"), F.lit("img").alias("image"), F.lit(True).alias("continued"), F.lit("src").alias("text"), F.array(F.lit("x")).alias("options"))
    got = json.loads(W.deck_payload(full).first().payload)
    assert (got["layout_type"], got["table_rows"], got["has_image"], got["continued"], got["source_text"], got["options"]) == ("TABLE", [["c"]], True, True, "src", ["x"])


EVENT = "run long, stage string, ts timestamp, event_id long, status string, seconds double, detail string"


def test_summaries_of_runs_that_only_some_tables_know(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    events = [
        (1, "split", t(5), 5, "ok", 2.0, None), (1, "load", t(1), 1, "running", 9.0, None), (1, "load", t(2), 2, "failed", 1.005, "broke"), (1, "load", t(9), 9, "ok", 1.0, "again"),
        (2, "load", t(1), 3, "skipped", None, "not needed"), (3, "load", t(1), 4, "running", 1.0, None), (2, None, t(1), 6, "ok", 1.0, None),
    ]
    scores = spark.createDataFrame([(1, 80), (1, 81), (5, 50)], "doc_id long, score int")
    quizzes = spark.createDataFrame([(1,), (1,), (4,)], "doc_id long")
    decks = spark.createDataFrame([(1, "HEAVY"), (6, "unheard of")], "doc_id long, density string")
    table = spark.createDataFrame(events, EVENT)
    got = {x.run: x for x in D.run_summary(slides(spark, (1,)), quizzes, scores, table, decks).collect()}
    assert set(got) == {"1", "2", "4", "5", "6"}
    one = got["1"]
    assert (one.slide_count, one.quiz_count, one.overall_score, one.density_profile) == (4, 2, 80, "heavy")
    assert [tuple(s) for s in one.stages] == [("load", "ok", 2.0, "again"), ("split", "ok", 2.0, "")] and one.total_seconds == 4.0
    assert [tuple(s) for s in got["2"].stages] == [("load", "skipped", 0.0, "not needed")] and got["2"].slide_count == 0
    assert (got["4"].quiz_count, got["4"].stages, got["4"].overall_score, got["4"].density_profile) == (1, [], 0, "medium")
    empty = D.run_summary(slides(spark, (1,)).where("false"), quizzes.where("false"), scores.where("false"), table.where("false"))
    assert empty.count() == 0
    outcomes = {(x.stage, x.status): x.n for x in D.stage_outcomes(table).collect()}
    assert outcomes[("load", "running")] == 2 and outcomes[(None, "ok")] == 1


def test_one_exchange_for_a_summary(spark):
    """Counts of four tables meet in one exchange; the stages are brought to one row each before it."""
    args = slides(spark), spark.createDataFrame([(1,)], "doc_id long"), spark.createDataFrame([(1, 80)], "doc_id long, score int"), spark.createDataFrame([], EVENT)
    plan = D.run_summary(*args)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan
