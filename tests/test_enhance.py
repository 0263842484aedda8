"""Enhancements: who is eligible, what the model is told, and the confidence of its answers."""

from corpusdeck.operators import classify as K
from corpusdeck.operators import enhance as E
from corpusdeck.plans import transform as T

SLIDES = "doc_id long, slide_ix int, layout_type string, title string, bullets array<string>, text string"


def test_first_slides_with_text_that_are_no_quiz(spark):
    rows = [(1, i, "quiz" if i % 5 == 0 else None, f"t{i}", [f"b{i}"], None) for i in range(40)]
    rows += [(2, 0, "TABLE", None, None, None), (2, 1, "TABLE", "x", [], " \n"), (2, 2, "Quiz", "q", ["b"], "t"), (2, 3, "METRIC", None, ["bullet"], "own text"), (2, 4, "METRIC", "m", ["one", "two"], "")]
    rows += [(None, 0, "TABLE", "n", ["b"], None), (3, 1, "TABLE", "a", ["x"], None), (3, 1, "TABLE", "a", ["x"], None), (4, 0, "TABLE", "a", ["x"], None)]
    decks = spark.createDataFrame([(4, "LOW"), (2, "no such profile"), (None, "heavy"), (1, "medium")], "doc_id long, density string")
    slides = spark.createDataFrame(rows, SLIDES)
    got = {(x.doc_id, x.slide_ix, x.rank, x.text) for x in E.enhancement_eligible(slides, decks).collect()}
    first = [i for i in range(40) if i % 5][:12]
    want = {(1, i, r + 1, f"b{i}") for r, i in enumerate(first)} | {(2, 3, 1, "own text"), (2, 4, 2, "one\ntwo"), (None, 0, 1, "b"), (3, 1, 1, "x"), (3, 1, 2, "x")}
    assert got == want
    assert (4, 0, 1, "x") in {(x.doc_id, x.slide_ix, x.rank, x.text) for x in E.enhancement_eligible(slides).collect()}
    assert E.enhancement_eligible(slides, decks.unionByName(spark.createDataFrame([(None, "low")], "doc_id long, density string"))).where("doc_id is null").count() == 0
    assert E.enhancement_eligible(slides.where("false"), decks).count() == 0
    assert E.enhancement_eligible(slides.drop("text").where("doc_id = 2")).count() == 2


def test_the_cap_is_below_the_exchange(spark, tmp_path):
    spark.createDataFrame([(i % 3, i, "TABLE", "t", ["b"], None) for i in range(300)], SLIDES).write.parquet(f"{tmp_path}/slides")
    plan = E.enhancement_eligible(spark.read.parquet(f"{tmp_path}/slides"))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in below and "Partial" in below


UNITS = "doc_id long, unit_id int, title string, text string"
TEXT = (
    "Entropy is defined as the measure of disorder in a closed system.\nStep 1: check the valve\nStep 2: open the pipe\nStep 3: verify the flow\n"
    "The key benefit is speed. A second sentence follows here and it is quite a bit longer than the first one was.\nSlide 3 of the plan\nConfidential draft\nStudents learn to measure heat in 2021."
)


def records(spark, rows):
    return K.unit_intelligence(spark.createDataFrame(rows, UNITS))


def test_footers_go_and_first_sentences_stay(spark):
    got = {x.text: (x.action, x.remaining) for x in T.text_actions(records(spark, [(1, 0, "Heat: basics", TEXT)])).collect()}
    assert got["Slide 3 of the plan"] == ("REMOVE", None) and got["Confidential draft"] == ("REMOVE", None)
    plain = records(spark, [(1, 0, "Heat", "One two three. Four five six seven eight nine ten eleven twelve thirteen fourteen.\nA single sentence of more than twelve words that goes on and on without any end in sight.")])
    kept = {x.remaining for x in T.summarise_blocks(plain).collect()}
    assert kept == {"Heat", "One two three.", "A single sentence of more than twelve words that goes..."}


def test_context_has_its_fields_in_order_with_their_caps(spark):
    one = E.enhancement_context(records(spark, [(1, 0, "Heat: basics", TEXT)])).first()
    fields = dict(x.split(": ", 1) for x in one.context.split("\n") if ": " in x)
    assert list(fields)[:4] == ["Main topic", "Learning objective", "Key concepts", "Definitions"]
    assert fields["Main topic"] == "Heat: basics" and fields["Key concepts"] == "Heat, basics"
    assert fields["Definitions"].startswith("Heat: basics Entropy is defined as the measure of disorder")  # patterns run over the joined text
    assert fields["Steps"] == "Step 1: check the valve → Step 2: open the pipe → Step 3: verify the flow"
    long = records(spark, [(1, 0, "T", "\n".join(f"word{i} " * 11 for i in range(60)))])
    told = E.enhancement_context(long).first().context
    content = next(x for x in told.split("\n") if x.startswith("Slide content: "))
    assert len(content) == len("Slide content: ") + len(" ".join(["T", *(("word0 " * 11).strip().replace("0", str(i)) for i in range(3))])[:400])


def test_context_takes_plans_from_a_table(spark):
    intel = records(spark, [(1, 0, "A", "some words here"), (1, 1, "B", "other words here"), (2, 0, None, None)])
    plans = spark.createDataFrame([(1, 0, ["x" * 500, "y"], "n" * 400), (9, 9, ["no unit"], "")], "doc_id long, unit_id int, remaining array<string>, speaker_notes string")
    got = {(x.doc_id, x.unit_id): (x.context.split("\n"), x.n_fields) for x in E.enhancement_context(intel, plans).collect()}
    assert got[1, 0][0][-2:] == ["Slide content: " + "x" * 400, "Speaker notes excerpt: " + "n" * 300]
    assert not any(x.startswith(("Slide content", "Speaker")) for x in got[1, 1][0]) and len(got) == 3
    assert all(n == len(lines) for lines, n in got.values())
    own = {(x.doc_id, x.unit_id): x.context for x in E.enhancement_context(intel).collect()}
    same = {(x.doc_id, x.unit_id): x.context for x in E.enhancement_context(intel, T.plan_texts(intel)).collect()}
    assert own == same and "Speaker notes excerpt: Focus learning objective: " in own[1, 0]


def test_confidence_with_and_without_answers(spark):
    intel = records(spark, [(1, 0, "Heat: basics", TEXT), (1, 1, "Heat: basics", TEXT), (2, 0, "", "")])
    answers = spark.createDataFrame(
        [(1, 0, "text", ["a"], []), (1, 0, "", None, ["tip"]), (7, 7, "nobody", ["a"], ["b"])], "doc_id long, unit_id int, improved_explanation string, examples array<string>, learning_tips array<string>"
    )
    got = {(x.doc_id, x.unit_id): x for x in E.enhancement_confidence(intel, answers).collect()}
    assert len(got) == 3 and (got[1, 0].n_answers, got[1, 1].n_answers, got[2, 0].n_answers) == (2, 0, 0)
    for x in got.values():
        assert x.confidence == round(min(1.0, x.richness + x.n_answers / 11 * 0.6 + x.plan_bonus), 3)
    assert got[1, 0].richness > got[2, 0].richness >= 0.05  # notes always name the objective
    assert E.enhancement_confidence(intel.where("false"), answers).count() == 0


def test_plan_confidence_rounds_like_binary_numbers(spark):
    from pyspark.sql import functions as F

    from corpusdeck.functions.text import round_binary

    values = [0.885, 0.855, 0.8775, 0.4, 0.98, 0.65, 0.75 + 0.9 * 0.15, 0.75 + 0.7 * 0.15, 0.3333, 1.0]
    got = [x.r for x in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(round_binary(F.col("v")).alias("r")).collect()]
    assert got == [round(v, 2) for v in values]


def test_notes_call_for_no_visual(spark):
    rows = [(1, 0, "Title", "plain words here", ""), (2, 0, "Title", "plain words here", "or else in the notes"), (3, 0, "Title", "or else on the slide", "some notes")]
    out = K.visual_opportunities(spark.createDataFrame(rows, UNITS + ", notes string"))
    assert {x.doc_id for x in out.where("kind = 'Decision Tree'").collect()} == {3}
