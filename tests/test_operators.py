"""Assets, layout, signals, plans, stored decks and ingest on fixtures."""

import time

import os

from pyspark.sql import functions as F

from corpusdeck.operators import assets as A
from corpusdeck.operators import layout as L
from corpusdeck.operators import signals as G
from corpusdeck.operators.classify import classify_units, intent_structural_bonus, prioritise_blocks, unit_intelligence, visual_opportunities
from corpusdeck.operators.decks import keyword_top_k
from corpusdeck.plans import specs as V
from corpusdeck.plans import transform as T
from corpusdeck.plans import visuals as P
from corpusdeck.sources import corpus as R
from corpusdeck.sources import sinks as W
from corpusdeck.streaming import ingest as I

UNIT = "doc_id long, unit_id int, title string, text string"
STEPS = "Step 1: collect the data\n- 2. check the total\nStep 3: verify it\nPhotosynthesis: the process plants use\nThis is a key fact. It rose because sales grew. Cats vs dogs is common.\nWhat is a cache? It stores 42% of pages since 1999."


def test_signals(spark):
    s = G.unit_signals(spark.createDataFrame([(1, 0, "Data Flow", STEPS)], UNIT)).first()
    assert s.step == ["Step 1: collect the data", "2. check the total", "Step 3: verify it"]
    assert ("Photosynthesis", "the process plants use") in [tuple(d) for d in s.definition] and ("What", "cache? It stores 42% of pages since 1999") in [tuple(d) for d in s.definition]
    assert ("Cats", "dogs is common.", "vs") in [tuple(c) for c in s.comparison]
    assert [(c.cause, c.effect) for c in s.cause if c.effect.endswith("It rose")] == [("sales grew.", "It rose")]
    assert [(q.question, q.answer) for q in s.faq] == [("What is a cache?", "It stores 42% of pages since 1999.")]
    assert any("42%" in n for n in s.number) and any("1999" in c for c in s.chronology) and s.concept == ["Data Flow"]
    assert any("key fact" in f for f in s.fact) and s.process


def test_relationships(spark):
    df = spark.createDataFrame([(["Rain causes floods here.", "Rain and floods.", "Only rain."], ["Rain", "floods"])], "s array<string>, c array<string>")
    got = df.select(G.relationships(F.col("s"), F.transform("s", F.lower), F.col("c"))).first()[0]
    assert [tuple(x) for x in got] == [("Rain", "CAUSES", "floods", 0.7), ("Rain", "UNKNOWN", "floods", 0.3)]


def test_intents_and_plans(spark):
    units = spark.createDataFrame([(1, 0, "Workflow", "workflow pipeline\n" + STEPS), (2, 0, "x", "nothing here at all")], UNIT)
    intents = {(r.doc_id, r.intent) for r in classify_units(units).collect()}
    assert (2, "General") in intents and (1, "Workflow") in intents
    assert visual_opportunities(units).where("doc_id = 1").orderBy("rank").first().kind == "Flowchart"
    records = unit_intelligence(units).cache()
    actions = {r.text: r.action for r in T.text_actions(records).where("doc_id = 1").collect()}
    assert actions["Workflow"] == "KEEP" and actions["Step 1: collect the data"] == "MOVE_TO_VISUAL"
    assert T.compression_stats(records).where("target_words > original_words and original_words > 5").count() == 0
    one = records.where("doc_id = 1")
    assert [r.kind for r in V.flow_nodes(one).orderBy("ord").collect()] == ["start", "decision", "end"] and V.flow_edges(one).count() == 3
    assert V.flow_text(one).first().diagram.startswith("graph LR\n  N0([collect the data])\n  N1{check the total}\n  N2([")
    assert V.checklist_items(records).where("is_action").count() >= 1 and V.mindmap_branches(records).count() > 0
    assert V.select_visuals(records).where("kind = 'Mind Map'").count() == 2
    assert V.org_rows(one).count() > 1 and V.smartart_elements(one).first().kind == "Process" and V.hierarchy_rows(one).first().level == 0
    assert [r.next_ord for r in V.decision_rows(one).selectExpr("ord + 1 as next_ord").collect()] == [1, 2, 3]
    picture = V.image_prompts(one).first()
    assert picture.subject.startswith("An educational visual representation of Workflow.") and picture.angle.startswith("Top-down")
    assert T.visual_actions(one).where("kind = 'AI Image'").count() == 1 and T.source_block_ids(one).where("kind = 'Flowchart'").count() >= 3
    assert T.speaker_notes(one).first().speaker_notes.endswith("Focus learning objective: ") and 0.4 <= T.plan_confidence(one).first().confidence <= 0.98
    density = V.visual_density(one).first()
    assert 0 < density.density <= 1 and 0 < density.confidence <= 0.98


def test_planned_visuals(spark):
    """An ordered procedure becomes a flow, statistics become a metric, and slides of their own structure stay."""
    texts = [
        (1, 0, "Onboarding", "- Step 1: create an account\n- Step 2: confirm the address\n- Step 3: choose a plan\n- Step 4: start"),
        (1, 1, "Adoption", "Usage rose by 47% this term.\nResponses came 2.3 million strong.\nRetention held at 88% overall."),
        (1, 2, "Nothing", "plain words only"),
    ]
    units = spark.createDataFrame(texts, UNIT)
    plans = P.plan_visual(unit_intelligence(units))
    got = {r.unit_id: r.plan for r in plans.collect()}
    assert got[0].layout_type == "FLOWCHART" and got[0].bullets[0] == "create an account" and "graph" in got[0].diagram
    assert got[1].layout_type == "METRIC" and got[1].metric_value == "47%" and got[2] is None
    rows = [(1, 0, "TABLE", "t", ["a"], "", None, [["a", "b"], ["c", "d"]]), (1, 1, "METRIC", "t", ["a"], "", "Key Stat", None), (1, 2, "MINIMAL_TEXT", "t", ["a"], "", None, None)]
    slides = spark.createDataFrame(rows, "doc_id long, slide_ix int, layout_type string, title string, bullets array<string>, takeaway string, metric_value string, table_rows array<array<string>>")
    out = {r.slide_ix: r for r in P.enrich_slides(slides, plans).collect()}
    assert not out[0].upgraded and out[1].metric_value == "47%" and out[1].upgraded and not out[2].upgraded


def test_more_signals(spark):
    """Bold and large blocks, tables, equations, formulas, lists and definitions."""
    blocks = [("Energy", True, 1, 0, False, None), ("Chlorophyll", False, 0, 1, True, None), ("Light is defined as radiation. Formula: a + b", False, 0, 1, False, None), ("42", False, 0, 2, False, None), ("E = mc", False, 0, 0, False, 24.0)]
    rows = [(1, 0, "Energy", "", blocks, [(["Name", "Size"], [["a", "1"], ["b", ""]])], ["x^2"], "see notes")]
    kind = "doc_id long, unit_id int, title string, text string, blocks array<struct<text:string,is_heading:boolean,heading_level:int,bullet_level:int,is_bold:boolean,font_size:double>>, tables array<struct<headers:array<string>,rows:array<array<string>>>>, equations array<string>, notes string"
    units = spark.createDataFrame(rows, kind)
    s = G.unit_signals(units).first()
    assert s.concept == ["Energy", "Chlorophyll", "E = mc"] and s.fact == ["Chlorophyll"] and [tuple(d) for d in s.definition][0][1] == "radiation"
    assert s.formula[0] == "x^2" and "a + b 42 E = mc see notes" in s.formula and s.list == [["Chlorophyll", "Light is defined as radiation. Formula: a + b", "42"], ["Name", "Size"], ["a", "b"], ["1"]]
    assert ("Name", "Size", "table comparison") in [tuple(c) for c in s.comparison] and "Light is defined as radiation. Formula: a + b" in s.supporting and "42" not in s.supporting
    bonus = {r.intent: r.bonus for r in intent_structural_bonus(units).collect()}
    assert bonus["Table"] == 0.8 and bonus["Formula"] == 0.9 and bonus["Hierarchy"] == 0.4 and bonus["Comparison"] == 0.6


def test_signals_are_linear_in_sentences(spark):
    def took(n):
        text = " ".join(f"It is important to check item {i} because the process causes change number {i}." for i in range(n))
        df = spark.createDataFrame([(1, 0, "t", text)], UNIT)
        began = time.time()
        G.signal_counts(G.unit_signals(df)).collect()
        return time.time() - began

    took(50)
    few, many = took(1500), took(6000)
    assert many < 5 * few + 1


def test_priorities(spark):
    lines = ["Footer text", "Footer text", "Footer text", "12", "plain body line", "please note that this is so", "Page 1 / 10 | Confidential", "a title of four words", "A title of four words!"]
    got = prioritise_blocks(spark.createDataFrame([(1, 0, "Title", "\n".join(lines))], UNIT))
    assert [r.priority for r in got.orderBy("ord").collect()] == ["High", "Repeated", "Repeated", "Repeated", "Decorative", "Medium", "Low", "Decorative", "High", "Redundant"]


def test_anchoring(spark):
    sections = spark.createDataFrame([(1, 0, "Overview", "general remarks"), (1, 1, "Budget", "quarterly budget figures spending"), (1, 2, "Plants", "chlorophyll absorbs sunlight energy")], "doc_id long, section_id int, title string, text string")
    assets = spark.createDataFrame([(1, 0, 0, "plants", ""), (1, 1, 0, "unnamed", "sunlight energy chlorophyll"), (1, 2, 1, "zzz", "qqq"), (1, 3, 9, "zzz", "qqq")], "doc_id long, asset_ix int, unit_index int, unit_title string, unit_text string")
    got = [(r.section_id, r.tier) for r in A.anchor_assets(sections, assets).orderBy("asset_ix").collect()]
    assert got == [(2, 1), (2, 2), (1, 3), (0, 3)]
    images = A.attach_assets(sections.withColumnRenamed("section_id", "unit_id"), A.anchor_assets(sections, assets)).where("unit_id = 2").first()
    assert images.images == [0, 1] and images.image == 0


def test_layout(spark):
    spans = spark.createDataFrame([(1, 0, i, s, b, t) for i, (s, b, t) in enumerate([(20.0, False, "Big"), (12.0, False, "a"), (12.0, False, "b"), (12.7, True, "Bold"), (10.0, False, "c")])], "doc_id long, page int, block int, size double, is_bold boolean, text string")
    assert [r.is_heading for r in L.infer_headings(spans).orderBy("block").collect()] == [True, False, False, True, False]
    assert L.page_titles(spans).first().title == "Big"
    rows = [(1, 0, 100.0, x, y, x + 40, y + 5, f"{x}-{y}") for x in (5.0, 55.0) for y in (30.0, 10.0)] + [(1, 0, 100.0, 5.0, 0.0, 95.0, 5.0, "wide")]
    blocks = spark.createDataFrame(rows, "doc_id long, page int, page_width double, x0 double, y0 double, x1 double, y1 double, text string")
    assert L.detect_columns(blocks).first().columns == 2 and L.multi_column_docs(blocks).first().multi_column
    assert [r.text for r in L.reading_order(blocks).orderBy("reading_order").collect()] == ["wide", "5.0-10.0", "5.0-30.0", "55.0-10.0", "55.0-30.0"]
    pages = spark.createDataFrame([(1, 0, None, "one two"), (1, 1, "Chapter 1 Start", "a b c"), (1, 2, None, "d e"), (1, 3, "Chapter 2", "f"), (1, 4, "Chapter 1 Start", "g")], "doc_id long, page int, heading string, text string")
    got = [(r.chapter, r.part, r.text) for r in L.chapter_regroup(pages, 4).orderBy("chapter", "part").collect()]
    assert got == [("Chapter 1 Start", 1, "a b c d"), ("Chapter 1 Start", 2, "e g"), ("Chapter 2", 1, "f"), ("Introduction", 1, "one two")]


def test_retrieval_fills_up(spark):
    chunks = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "a"), (2, 0, "B a"), (3, 0, "z")], "doc_id long, chunk_id int, text string")
    queries = spark.createDataFrame([(1, "A b"), (2, "nothing"), (3, None)], "query_id long, text string")
    got = {}
    for r in keyword_top_k(chunks, queries).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.chunk_id, r.overlap))
    assert got == {1: [(1, 0, 2), (2, 0, 2), (1, 1, 1)], 2: [(1, 0, 0), (1, 1, 0), (2, 0, 0)], 3: [(1, 0, 0), (1, 1, 0), (2, 0, 0)]}


def test_replies(spark):
    rows = [(1, 0, '{"layout_type": "table", "correct": "b) x"}'), (2, 0, '```json\n{"layout_type": "nope"}\n```'), (3, 0, 'Here: {"layout_type": "METRIC"} ok'), (4, 0, "{broken")]
    got = [(r.layout_type, r.answer) for r in W.parse_replies(spark.createDataFrame(rows, "doc_id long, unit_id int, raw string")).orderBy("doc_id").collect()]
    assert got == [("TABLE", "B"), ("MINIMAL_TEXT", "A"), ("METRIC", "A"), (None, "A")]


def test_admission_and_files(spark, tmp_path):
    """Empty, large, wrong and nested files; hidden ones are no files."""
    for name, text in (("a.txt", "hello"), ("b.exe", "x"), ("c.md", ""), ("deep/er/d.TXT", "nested"), ("deep/e.md", ""), ("deep/noext", "x"), ("_log/f.txt", "x"), (".g.txt", "x"), ("deep/two words.txt", "ok")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "hollow" / "inside").mkdir(parents=True)
    for path in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        got = {x.path.removeprefix(path.rstrip("/")): (x.length, x.reason) for x in R.admit_files(spark, path, most_bytes=5).collect()}
        assert got == {
            "/a.txt": (5, None), "/b.exe": (1, "extension"), "/c.md": (0, "empty"), "/deep/er/d.TXT": (6, "too large"), "/deep/e.md": (0, "empty"), "/deep/noext": (1, "extension"),
            "/deep/two words.txt": (2, None),
        }
    assert R.admit_files(spark, str(tmp_path / "hollow")).count() == 0
    assert ("a.txt", "hello") in [tuple(r) for r in R.read_text_files(spark, str(tmp_path)).collect()]


def test_a_thousand_folders_are_listed_by_many_tasks(spark, tmp_path):
    for i in range(1000):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "x.txt").write_text("x" * (i % 3))
    files = R.list_files(spark, str(tmp_path))
    assert files.count() == 1000 and files.where("length = 0").count() == 334


def test_placeholder_lines_and_gate(spark):
    docs = spark.createDataFrame([(1, "a\nimage.png\n![x](y.jpg)\n\n\n\nb"), (2, "Page 1 " * 200), (3, "w" * 130)], "doc_id long, markdown string")
    assert R.drop_placeholder_lines(docs).where("doc_id = 1").first().markdown == "a\n\nb"
    assert {r.doc_id: r.accepted for r in R.extraction_gate(docs).collect()} == {1: False, 2: False, 3: True}


def test_windowed_counts(spark, tmp_path):
    rows = [("a", "2024-01-01 00:01:00", 1.0), ("a", "2024-01-01 00:09:00", 2.0), ("b", "2024-01-01 00:11:00", 3.0)]
    events = spark.createDataFrame(rows, "stage string, ts string, seconds double").withColumn("ts", F.to_timestamp("ts"))
    want = sorted((r.stage, r.n, r.seconds) for r in I.windowed_stage_counts(events).collect())
    assert want == [("a", 2, 3.0), ("b", 1, 3.0)]
    events.write.parquet(str(tmp_path / "e"))
    stream = I.windowed_stage_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    query = stream.writeStream.outputMode("update").format("memory").queryName("stage_counts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.stage, r.n, r.seconds) for r in spark.table("stage_counts").collect()) == want
