"""Column expressions and small operators against their stated values."""

import pytest
from pyspark.sql import functions as F

from corpusdeck.functions import text as X
from corpusdeck.operators import chunks as C
from corpusdeck.operators import classify as K
from corpusdeck.operators import decks as D
from corpusdeck.operators import sections as S


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_normalise(spark):
    got = values(spark, ["**Cash** and __flow__", "cut **here", "Growth:* helps", "3*4 = 12", "a `code` tick \\", "_em_ *em*"], X.normalise)
    assert got == ["Cash and flow", "cut here", "Growth: helps", "3*4 = 12", "a code tick", "em em"]


def test_truncate(spark):
    long = "one two three four five six seven eight"
    got = values(spark, ["short", long], lambda c: X.truncate_on_word(c, 20))
    assert got[0] == "short" and got[1] == "one two three four…"


def test_restatements(spark):
    df = spark.createDataFrame([(["Cash flow matters", "cash flow matters!", "Cash flow", "Profit differs from cash"],)], "b array<string>")
    assert df.select(X.drop_restatements(F.col("b"))).first()[0] == ["Cash flow matters", "Profit differs from cash"]


def test_sentences(spark):
    assert values(spark, ["One is here. Two is there! Eh? Ok."], X.sentences)[0] == ["One is here.", "Two is there!"]


def test_quantity(spark):
    got = values(spark, ["costs $250,000 a year", "₹50,000", "rose 12.5% then", "took 5 years", "n/a", ""], K.quantity)
    assert got == ["$250,000", "₹50,000", "12.5%", "5 years", "", ""]


def test_junk_headings(spark):
    titles = ["Cash Flow", "", "No. of groups = k =", "|XA - XB| =", "Conclusion: Conclusion:", "a b c d e f g h i j k l m", "Émile à Paris"]
    assert values(spark, titles, X.is_junk_heading) == [False, True, True, True, True, True, False]


@pytest.mark.parametrize("size", [3, 4, 5, 6, 8])
def test_balanced_pages(spark, size):
    rows = [(n, i) for n in range(1, 25) for i in range(n)]
    got = {}
    for r in D.balanced_pages(spark.createDataFrame(rows, "n int, i int"), ["n"], ["i"], size).collect():
        got.setdefault(r.n, []).append((r.i, r.page))
    for n, places in got.items():
        pages = [p for _, p in sorted(places)]
        counts = [pages.count(p) for p in range(max(pages) + 1)]
        assert pages == sorted(pages) and len(counts) == -(-n // size) and max(counts) - min(counts) <= 1 and counts == sorted(counts, reverse=True)


MARKDOWN = "intro line\n## First\n- a\n- b\n### Deep\nbody\n## = + =\n# Second\n## page 2\ntext\n## Second\nmore"


def test_sections(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, ""), (3, None), (4, "## only")], "doc_id long, markdown string")
    plain = [(r.doc_id, r.section_id, r.title, r.level, r.text) for r in S.split_sections(docs, inherit=False, merge=False).orderBy("doc_id", "section_id").collect()]
    assert plain == [
        (1, 0, "", 0, "intro line"), (1, 1, "First", 2, "- a\n- b\nDeep\nbody\n= + ="), (1, 2, "Second", 1, ""), (1, 3, "page 2", 2, "text"), (1, 4, "Second", 2, "more"), (4, 0, "only", 2, ""),
    ]
    whole = [(r.title, r.text) for r in S.split_sections(docs).where("doc_id = 1").orderBy("section_id").collect()]
    assert whole == [("", "intro line"), ("First", "- a\n- b\nDeep\nbody\n= + ="), ("Second", "text\nmore")]


def test_merge_stops_at_its_bound(spark):
    markdown = "\n".join(f"## Topic\n{'x' * 700}" for _ in range(4))
    got = [len(r.text) for r in S.split_sections(spark.createDataFrame([(1, markdown)], "doc_id long, markdown string")).orderBy("section_id").collect()]
    assert got == [1401, 1401]


def test_paragraphs(spark):
    text = "## Head\nprose a\nprose b\n\n- one\n  goes on\n2. two\n\n[TABLE DATA]\na | b\n- c | d\n\nlast"
    units = spark.createDataFrame([(1, 0, "t", text), (2, 0, "t", "")], "doc_id long, unit_id int, title string, text string")
    got = [r.paragraph for r in C.split_paragraphs(units).orderBy("para_no").collect()]
    assert got == ["Head prose a prose b", "one goes on\ntwo", "[TABLE DATA]\na | b\n- c | d", "last"]


def test_chunks_keep_every_word(spark):
    text = " ".join(f"w{i}" for i in range(500))
    units = spark.createDataFrame([(1, 0, "t", text), (1, 1, "only title", " ")], "doc_id long, unit_id int, title string, text string")
    rows = C.chunk_corpus(units).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == [0, 1, 2, 3] and " ".join(r.text for r in rows[:3]) == text and rows[3].text == "only title"


def test_pipe_tables(spark):
    text = "lead\n| a | b | c |\n|---|---|---|\n| 1 | 2 |\nx vs y"
    docs = spark.createDataFrame([(1, text), (2, "| one | row |"), (3, None)], "doc_id long, text string")
    cells = {(r.row, r.col): r.value for r in C.parse_pipe_tables(docs).collect()}
    assert cells == {(0, 0): "a", (0, 1): "b", (0, 2): "c", (1, 0): "1", (1, 1): "2", (1, 2): ""}


def slides(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, slide_ix int, layout_type string, title string, bullets array<string>, table_rows array<array<string>>, takeaway string")


def test_density_loses_nothing(spark):
    rows = [(1, n, "MINIMAL_TEXT", f"Topic {n}", [f"point number {i} of many" for i in range(n)], None, "take this") for n in range(0, 20)]
    out = D.apply_density(slides(spark, *rows), "medium").collect()
    for n in range(0, 20):
        own = sorted((r.page, r.title, r.bullets, r.takeaway, r.continued) for r in out if r.slide_ix == n)
        assert sum(len(r[2]) for r in own) == n and [r[4] for r in own] == [p > 0 for p in range(len(own))]
        assert [bool(r[3]) for r in own] == [False] * (len(own) - 1) + [True]
        assert len(own) == 1 or [r[1] for r in own] == [f"Topic {n} ({p + 1}/{len(own)})" for p in range(len(own))]


def test_density_of_tables_and_metrics(spark):
    table = [["h1", "h2", "h3"]] + [[f"r{i}", "x", "y"] for i in range(9)]
    out = D.apply_density(slides(spark, (1, 0, "TABLE", "T", ["lead"], table, "t"), (1, 1, "METRIC", "M", ["one", "two"], None, "t"), (1, 2, "QUIZ", "Q", [], None, "t")), "low").collect()
    pages = sorted((r.page, r.table_rows) for r in out if r.slide_ix == 0)
    assert all(p[1][0] == table[0] for p in pages) and [len(p[1]) - 1 for p in pages] == [3, 3, 3] and sum((p[1][1:] for p in pages), []) == table[1:]
    assert [r.page for r in out if r.slide_ix == 1] == [0] and [r.page for r in out if r.slide_ix == 2] == [0]


def test_scores(spark):
    row = (1, 0, "FLOWCHART", "How cash moves", [" ".join(["word"] * 10)] * 4, None, "remember this")
    got = D.score_slides(slides(spark, row, (1, 1, None, "", [], None, None))).orderBy("slide_ix").collect()
    assert (got[0].text_density, got[0].bullet_count, got[0].title_quality, got[0].has_takeaway, got[0].readability, got[0].visual_bonus, got[0].score) == (20, 20, 15, 15, 15, 10, 95)
    assert got[1].bullet_count == 20 and D.score_slides(slides(spark, (1, 1, None, "", [], None, None)), strict_reference=True).first().bullet_count == 32


def test_quizzes(spark):
    deck = slides(spark, *[(1, i, "MINIMAL_TEXT", f"s{i}", ["b"], None, "") for i in range(8)])
    quizzes = spark.createDataFrame([(1, k, f"q{k}", list("ABCDE"), "A") for k in (1, 2, 3)], "doc_id long, quiz_no int, question string, options array<string>, correct string")
    inline = D.interleave_quizzes(deck, quizzes).orderBy("slide_ix").collect()
    assert len(inline) == 8 and [r.slide_ix for r in inline if r.quiz] == [3, 7] and all(len(r.quiz.options) == 4 for r in inline if r.quiz)
    apart = D.interleave_quizzes(deck, quizzes, inline=False).orderBy("slide_ix").collect()
    assert [r.layout_type for r in apart].count("QUIZ") == 2 and [r.slide_ix for r in apart if r.layout_type == "QUIZ"] == [4, 9]
    with pytest.raises(ValueError):
        D.interleave_quizzes(deck, quizzes, frequency=0)


def test_sentences_with_abbreviations(spark):
    got = values(spark, ["Total no. of items is 3.14 today. Dr. Smith spoke. J. Doe left! It was fig. 2. And it ended", "", "  One.  Two? three"], X.sentences_abbrev)
    assert got == [["Total no. of items is 3.14 today", "Dr. Smith spoke", "J. Doe left!", "It was fig. 2. And it ended"], [], ["One", "Two? three"]]


def test_labels(spark):
    texts = ["Definition: what it is", "Label: Cash Flows - Estimated inflows", "A very long label of many words here: body", "no label", "**Strategic Growth:** helps"]
    got = values(spark, texts, lambda c: X.split_label_body(c, F.lit("POINT 1")))
    assert [tuple(x) for x in got] == [("DEFINITION", "what it is"), ("CASH FLOWS", "Estimated inflows"), ("POINT 1", texts[2]), ("POINT 1", "no label"), ("STRATEGIC GROWTH", "helps")]


def test_missing_points_come_back(spark):
    source = "The first point has words. A second point is here. Third point stands here too. The last point comes now."
    df = spark.createDataFrame([(["The first point has words"], source), (["a b"], "Short one.")], "b array<string>, s string")
    got = [r[0] for r in df.select(X.restore_missing_points(F.col("b"), F.col("s"))).collect()]
    assert len(got[0]) == 4 and got[0][0] == "The first point has words" and got[1] == ["a b"]


def test_extras(spark):
    rows = [(1, 0, ["", "an example"], ["like water"], [], ["a trap"], ["recall it"])]
    extras = spark.createDataFrame(rows, "doc_id long, slide_ix int, examples array<string>, analogies array<string>, real_world_applications array<string>, common_mistakes array<string>, revision_points array<string>")
    assert [r.extra for r in D.fold_extras(extras, "heavy").orderBy("ord").collect()] == ["Example: an example", "Analogy: like water", "Watch out: a trap"]
    assert D.fold_extras(extras, "low").count() == 0 and D.fold_extras(extras).count() == 1
    slides = spark.createDataFrame([(1, 0, "MINIMAL_TEXT", "T", ["one point"], "", None)], "doc_id long, slide_ix int, layout_type string, title string, bullets array<string>, takeaway string, table_rows array<array<string>>")
    assert D.apply_density(slides, "medium", extras).first().bullets == ["one point", "Example: an example"]


def test_unit_text_with_indents_tables_and_notes(spark):
    from corpusdeck.operators import chunks as C

    block = lambda t, h, n: (t, h, 1 if h else 0, n, None, None)
    tables = [(["a", None], [["1", "2"], ["3", None]]), ([], [["no headers"]]), (None, [["none"]])]
    rows = [(1, 0, "T", "ignored", [block("Head", True, 0), block("one", False, 1), block("three", False, 3), block("plain", False, None), block("", False, 1)], tables, "note"), (1, 1, "", "x\n\n- y", None, None, None)]
    kind = "doc_id long, unit_id int, title string, text string, blocks array<struct<text:string,is_heading:boolean,heading_level:int,bullet_level:int,is_bold:boolean,font_size:double>>, tables array<struct<headers:array<string>,rows:array<array<string>>>>, notes string"
    units = spark.createDataFrame(rows, kind)
    got = {x.unit_id: x.full_text for x in C.unit_text(units).where("unit_id = 0").collect()}
    assert got[0].split("\n") == ["## Head", "- one", "    - three", "plain", "[TABLE DATA]", "a | ", "1 | 2", "3 | ", "[Speaker Notes: note]"]
    bare = {x.unit_id: x.full_text for x in C.unit_text(units.drop("blocks", "tables", "notes")).collect()}
    assert bare == {0: "## T\n- ignored", 1: "- x\n- y"}
