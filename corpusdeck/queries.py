"""Registered queries of the corpus operators, each over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import assets as A
from .operators import chunks as C
from .operators import classify as K
from .operators import decks as D
from .operators import enhance as E
from .operators import layout as L
from .operators import sections as S
from .operators import signals as G
from .plans import specs as V
from .plans import transform as T
from .plans import visuals as P
from .sources import corpus as R
from .sources import shared as H
from .sources import sinks as W
from .functions import text as X
from .functions.rows import exploded
from .streaming import ingest as I
from .streaming import status as N

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, d):
    return _table(spark, d, "documents")


def _units(spark, d) -> DataFrame:
    """Documents as units: the source is the title, the text the body."""
    return _documents(spark, d).select("doc_id", F.lit(0).alias("unit_id"), F.coalesce("source", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def _turns(spark, d) -> DataFrame:
    """Conversation turns as units."""
    return _table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("unit_id"), F.coalesce("role", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")
    )


def _conversation_docs(spark, d):
    return R.conversations_to_markdown(_table(spark, d, "conversations"))


def _extras(spark, d) -> DataFrame:
    """Sentences of a turn as its enhancements: the first an example, questions as revision points."""
    said = F.col("sentences")
    asked = F.filter(said, lambda s: s.endswith("?"))
    rows = _turns(spark, d).select("doc_id", F.col("unit_id").alias("slide_ix"), X.sentences(F.col("text")).alias("sentences"))
    none = F.array().cast("array<string>")
    return rows.select("doc_id", "slide_ix", F.slice(said, 1, 1).alias("examples"), none.alias("analogies"), F.slice(said, 2, 1).alias("real_world_applications"), none.alias("common_mistakes"), asked.alias("revision_points"))


def _chunks(spark, d):
    return C.chunk_corpus(_turns(spark, d))


def _slides(spark, d):
    """A slide per turn of a conversation, its lines as bullets."""
    return K.structure_slides(_turns(spark, d).withColumnRenamed("unit_id", "chunk_id"))


def _lessons(spark, d) -> DataFrame:
    """Turns as lessons: their text, then steps, a comparison, a cause, a definition, two sentences in one line, a figure and a footer of their own words."""
    turns = _table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("unit_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = X.words(F.col("text"))
    part = lambda begin, n: F.array_join(F.slice(w, begin, n), " ")
    first, turn = F.coalesce(F.get(w, F.lit(0)), F.lit("")), F.col("unit_id")
    title = F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, F.lit(2), F.length(first)), F.lit(" "), part(2, 1), F.lit(": "), F.col("role"))
    lines = [
        F.col("text"), F.concat(F.lit("Step 1: check "), part(1, 3)), F.concat(F.lit("Step 2: "), part(4, 3)), F.concat(F.lit("Step 3: verify "), part(7, 3)),
        F.concat(part(1, 4), F.lit(" unlike "), part(5, 4), F.lit(".")), F.concat(part(2, 4), F.lit(" because "), part(6, 4), F.lit(".")),
        F.concat(F.lit("Lesson "), F.col("role"), F.lit(": "), part(3, 8), F.lit(".")), F.concat(part(1, 9), F.lit(". Second sentence of "), part(10, 9), F.lit(".")),
        F.concat(F.lit("In "), (1990 + turn).cast("string"), F.lit(" it grew by "), turn.cast("string"), F.lit("% with "), part(1, 12), F.lit(".")),
        F.concat(F.lit("Slide "), (turn + 1).cast("string"), F.lit(" of "), F.col("doc_id").cast("string")),
    ]
    return turns.select("doc_id", "unit_id", title.alias("title"), F.array_join(F.array(*lines), "\n").alias("text"))


def _lesson_records(spark, d) -> DataFrame:
    return K.unit_intelligence(_lessons(spark, d))


# -- sources and structure --


@query
def a1_read_corpus(spark, d):
    return R.read_corpus(_documents(spark, d)).select("doc_id", "source_name", F.length("markdown").alias("n_chars"), F.md5("markdown").alias("digest"))


@query
def a2_page_blocks(spark, d):
    return R.page_blocks(_table(spark, d, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))


@query
def a4_extraction_gate(spark, d):
    return R.extraction_gate(R.read_corpus(_documents(spark, d))).select("doc_id", "body_chars", "accepted")


@query
def a5_new_documents(spark, d):
    """Documents whose text no document of a smaller id has: ingest into an empty manifest."""
    return I.first_by_content(_documents(spark, d)).select("doc_id", "content_key")


@query
def a5_ingest_stream(spark, d):
    """The same as a stream into an empty corpus (a pattern as the path serves files and folders alike): contents are keyed state, and what the sink has committed is read back."""
    at = H.new_path(spark, "ingest")
    schema = _documents(spark, d).select("doc_id", "text").schema
    I.ingest_stream(spark, f"{d}/documents.parque[t]", schema, f"{at}/corpus", f"{at}/log").awaitTermination()
    return spark.read.parquet(f"{at}/corpus").select("doc_id", "content_key")


@query
def a6_drop_placeholder_lines(spark, d):
    docs = _documents(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("markdown"))
    return R.drop_placeholder_lines(docs).select("doc_id", F.md5("markdown").alias("digest"))


@query
def a8_list_decks(spark, d):
    return W.list_decks(_decks(spark, d)).select("user_id", "rank", "deck_id", "title")


@query
def a10_deck_payload(spark, d):
    return W.deck_payload(_slides(spark, d)).select("doc_id", "slide_ix", F.get_json_object("payload", "$.layout_type").alias("layout_type"), F.get_json_object("payload", "$.title").alias("title"))


@query
def a7_a9_deck_store(spark, d):
    """Decks saved, every third deleted, the store compacted, every ninth saved again under another title, every fifth then deleted: what is left."""
    path, decks = H.new_path(spark, "decks"), _decks(spark, d)
    number = F.col("deck_id").cast("long")
    W.save_decks(decks, path, version=1)
    W.delete_decks(decks.where(number % 3 == 0), path, version=2)
    W.compact(spark, path)
    W.save_decks(decks.where(number % 9 == 0).withColumn("title", F.concat("title", F.lit(" again"))), path, version=3)
    W.delete_decks(decks.where(number % 5 == 0), path, version=4)
    return W.list_decks(W.live_decks(spark, path)).select("user_id", "rank", "deck_id", "title")


@query
def a10_payload_fields(spark, d):
    """What each slide's JSON holds, field by field."""
    slides = _with_images(_slides(spark, d)).join(_turns(spark, d).select("doc_id", F.col("unit_id").alias("slide_ix"), "text"), ["doc_id", "slide_ix"])
    field = lambda name: F.get_json_object("payload", f"$.{name}").alias(name)
    out = W.deck_payload(slides)
    texts = ["layout_type", "title", "takeaway", "metric_value", "visual_source", "continued", "has_image", "question"]
    bullets = F.size(F.from_json(F.get_json_object("payload", "$.bullets"), "array<string>")).alias("n_bullets")
    return out.select("doc_id", "slide_ix", F.size(F.json_object_keys("payload")).alias("n_fields"), field("index").cast("int").alias("index"), *map(field, texts), bullets, F.md5(field("source_text")).alias("source_text"))


def _decks(spark, d):
    """Documents as stored decks: a user per source, newer ids later."""
    return _documents(spark, d).select(F.col("source").alias("user_id"), F.col("doc_id").cast("string").alias("deck_id"), F.col("lang").alias("title"), F.timestamp_seconds(F.col("doc_id")).alias("created_at"))


@query
def b1_explode_lines(spark, d):
    docs = _documents(spark, d).select("doc_id", F.col("text").alias("markdown"))
    return S.explode_lines(docs).select("doc_id", "line_no", F.length("line").alias("n_chars"))


@query
def b2_split_sections(spark, d):
    return S.split_sections(_conversation_docs(spark, d), inherit=False, merge=False).select("doc_id", "section_id", "title", "level", F.md5("text").alias("digest"))


@query
def b3_junk_headings(spark, d):
    """Lines of the corpus judged as headings."""
    line = F.trim("line")
    rows = S.explode_lines(_documents(spark, d).select("doc_id", F.col("text").alias("markdown"))).select("doc_id", "line_no", S.is_junk_heading(line).alias("junk"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("junk").cast("int")).alias("n_junk"))


@query
def b4_inherit_titles(spark, d):
    out = S.inherit_titles(S.with_sections(_conversation_docs(spark, d)))
    return out.select("doc_id", F.size("sections").alias("n_sections"), F.size(F.array_distinct(F.transform("sections", lambda s: s["title"]))).alias("n_titles"))


@query
def b5_merge_repeated_titles(spark, d):
    return S.split_sections(_conversation_docs(spark, d)).select("doc_id", "section_id", "title", F.length("text").alias("n_chars"))


@query
def b6_section_outline(spark, d):
    return S.section_outline(_conversation_docs(spark, d))


@query
def b7_sections_to_units(spark, d):
    sections = S.split_sections(R.pages_to_markdown(_table(spark, d, "pages")))
    return S.sections_to_units(sections).select("doc_id", "unit_id", "slide", F.size("content").alias("n_lines"))


@query
def b9_chunk_words(spark, d):
    paragraphs = _units(spark, d).select("doc_id", "unit_id", "title", F.lit(0).alias("para_no"), F.col("text").alias("paragraph"))
    return C.chunk_words(paragraphs).select("doc_id", "piece_no", F.size(F.filter(F.split("text", r"[ \t\n\x0b\f\r]+"), lambda w: w != "")).alias("n_words"))


@query
def b10_chunk_corpus(spark, d):
    return _chunks(spark, d).select("doc_id", "chunk_id", "unit_id", F.md5("text").alias("digest"))


@query
def b11_merge_chunks(spark, d):
    return C.merge_chunks_by_section(_chunks(spark, d)).select("doc_id", "chunk_id", "title", F.length("text").alias("n_chars"))


@query
def b12_chapter_regroup(spark, d):
    """Lines of documents as pages; every 17th opens one of three chapters of its document, so a chapter's pages lie apart."""
    lines = S.explode_lines(_documents(spark, d).select("doc_id", F.col("text").alias("markdown")))
    page = F.col("line_no")
    heading = F.when(page % 17 == 16, F.concat(F.lit("Chapter "), (F.floor(page / 17) % 3 + 1).cast("string")))
    out = L.chapter_regroup(lines.select("doc_id", page.alias("page"), heading.alias("heading"), F.col("line").alias("text")))
    return out.select("doc_id", "chapter", "part", "title", F.md5("text").alias("digest"))


def _spans(spark, d) -> DataFrame:
    """Elements of web pages as spans: three pages a document, sizes by tag, a place by their number, a width by their length."""
    pattern = r"<(h1|p|li|b|footer|a)( [^>]*)?>([^<]*)"
    tags, texts = (F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(pattern), F.lit(i)) for i in (1, 3))
    page = _table(spark, d, "pages").select(F.floor(F.col("page_id") / 3).alias("doc_id"), (F.col("page_id") % 3).cast("int").alias("page"), tags.alias("tags"), texts.alias("texts"))
    rows = exploded(page, F.arrays_zip("tags", "texts"), "doc_id", "page", pos="block")
    tag, n, length = F.col("x.tags"), F.col("block"), F.length("x.texts")
    size = F.when(tag == "h1", 24.0).when(tag == "b", 13.0).when(tag == "p", 12.0).when(tag == "footer", 8.0).otherwise(10.0)
    x0 = F.when(n % 2 == 0, 20.0).otherwise(320.0)
    text = F.when(tag == "li", F.concat(F.lit("• "), F.col("x.texts"))).otherwise(F.col("x.texts"))
    return rows.select(
        "doc_id", "page", "block", tag.alias("tag"), text.alias("text"), size.alias("size"), (tag == "b").alias("is_bold"), F.lit(600.0).alias("page_width"), x0.alias("x0"),
        (x0 + F.least(F.lit(560.0), length * 2.0)).alias("x1"), (F.floor(n / 2) * 14.3).alias("y0"),
    )


@query
def b13_infer_headings(spark, d):
    return L.infer_headings(_spans(spark, d)).select("doc_id", "page", "block", "median", "is_heading")


@query
def b13_page_titles(spark, d):
    return L.page_titles(_spans(spark, d)).select("doc_id", "page", F.md5("title").alias("title"))


@query
def b14_detect_columns(spark, d):
    return L.detect_columns(_spans(spark, d))


@query
def b15_reading_order(spark, d):
    return L.reading_order(_spans(spark, d)).select("doc_id", "page", "block", "column", "reading_order")


@query
def b16_multi_column_docs(spark, d):
    return L.multi_column_docs(_spans(spark, d))


@query
def b20_flag_blocks(spark, d):
    """Elements as blocks of a unit per page, the h1 of every second page in a title shape."""
    shape = (F.col("tag") == "h1") & (F.col("page") % 2 == 0)
    blocks = _spans(spark, d).select("doc_id", F.col("page").alias("unit_id"), F.col("block").alias("ord"), shape.alias("is_title_shape"), F.col("size").alias("font_size"), "text")
    return L.flag_blocks(blocks).select("doc_id", "unit_id", "ord", "is_heading", "heading_level", "bullet_level")


@query
def b17_pipe_tables(spark, d):
    return C.parse_pipe_tables(_documents(spark, d)).groupBy("doc_id").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.sum((F.col("value") != "").cast("int")).alias("n_filled"))


@query
def b18_unit_blocks(spark, d):
    return C.unit_blocks(_turns(spark, d)).select("doc_id", "unit_id", "ord", "block_id", "is_heading", F.length("text").alias("n_chars"))


@query
def b19_unit_text(spark, d):
    return C.unit_text(_turns(spark, d)).select("doc_id", "unit_id", F.md5("full_text").alias("digest"))


@query
def b19_full_unit_text(spark, d):
    """Turns with blocks of three levels, a table in every third and notes in every second."""
    turns = _turns(spark, d)
    body = F.filter(F.transform(X.lines(F.col("text")), X.without_marker), lambda x: x != "")
    block = lambda text, heading, level: F.struct(text.alias("text"), F.lit(heading).alias("is_heading"), F.lit(0).alias("heading_level"), level.alias("bullet_level"), F.lit(False).alias("is_bold"), F.lit(None).cast("double").alias("font_size"))
    blocks = F.concat(F.array(block(F.col("title"), True, F.lit(0))), F.transform(body, lambda x, i: block(x, False, i % 3)))
    cells = F.array(F.array(F.lit("lines"), F.size(body).cast("string")), F.array(F.lit("turn"), F.col("unit_id").cast("string")))
    table = F.struct(F.array(F.lit("what"), F.col("title")).alias("headers"), cells.alias("rows"))
    tables = F.when(F.col("unit_id") % 3 == 0, F.array(table))
    notes = F.when(F.col("unit_id") % 2 == 0, F.concat(F.lit("said by "), F.col("title")))
    return C.unit_text(turns.select("doc_id", "unit_id", "title", "text", blocks.alias("blocks"), tables.alias("tables"), notes.alias("notes"))).select("doc_id", "unit_id", F.md5("full_text").alias("digest"))


# -- assets --


@query
def c1_dedupe_assets(spark, d):
    """Texts as assets of their source: the first of equal contents stays."""
    assets = _documents(spark, d).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("ord"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return A.dedupe_assets(assets).select("doc_id", "ord", "sha256")


@query
def c3_anchor_assets(spark, d):
    """Turns as sections of their conversation, titled by their first line, and each turn as an asset taken from the turn before it."""
    turns = _turns(spark, d)
    first = F.element_at(F.split("text", "\n"), 1)
    sections = turns.select("doc_id", F.col("unit_id").alias("section_id"), first.alias("title"), "text")
    assets = turns.select("doc_id", F.col("unit_id").alias("asset_ix"), (F.col("unit_id") - 1).alias("unit_index"), F.col("title").alias("unit_title"), F.col("text").alias("unit_text"))
    return A.anchor_assets(sections, assets).select("doc_id", "asset_ix", "section_id", "tier")


@query
def c2_small_assets(spark, d):
    """Texts as assets whose sides follow from their length."""
    n = F.length(F.coalesce("text", F.lit("")))
    assets = _documents(spark, d).select("doc_id", (n % 260).alias("width"), (n % 170 + 40).alias("height"))
    return A.filter_small_assets(assets).select("doc_id", "width", "height", "kind")


def _anchored(spark, d) -> DataFrame:
    turns = _turns(spark, d)
    first = F.element_at(F.split("text", "\n"), 1)
    sections = turns.select("doc_id", F.col("unit_id").alias("section_id"), first.alias("title"), "text")
    assets = turns.select("doc_id", F.col("unit_id").alias("asset_ix"), (F.col("unit_id") - 1).alias("unit_index"), F.col("title").alias("unit_title"), F.col("text").alias("unit_text"))
    return A.anchor_assets(sections, assets)


@query
def c4_attach_assets(spark, d):
    """Turns with the assets that were anchored to them."""
    return A.attach_assets(_turns(spark, d), _anchored(spark, d)).select("doc_id", "unit_id", F.array_join(F.col("images").cast("array<string>"), ",").alias("images"), "image")


@query
def c5_attach_descriptions(spark, d):
    """Documents as chunks with their source's image; images of sources that end in 0 or 5 are described."""
    chunks = _documents(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.sha2("source", 256).alias("image_sha256"))
    described = _documents(spark, d).where(F.col("source").rlike("[05]$")).select(F.sha2("source", 256).alias("sha256"), F.concat(F.lit("an image of "), F.col("source")).alias("description")).distinct()
    return A.attach_descriptions(chunks, described).select("doc_id", F.md5("text").alias("digest"))


@query
def c6_needs_ocr(spark, d):
    """Documents as pages of their source, with counts that follow from their ids."""
    n = F.col("doc_id")
    pages = _documents(spark, d).select(F.col("source").alias("doc_id"), n.alias("page"), F.size(X.words(F.coalesce("text", F.lit("")))).alias("n_words"), (n % 3).alias("n_assets"), (n % 2).alias("n_image_blocks"))
    return A.needs_ocr_pages(pages).select("doc_id", "page", "n_words")


@query
def c7_primary_image(spark, d):
    """Texts as assets of units by source and id, every third without bytes; pages as rendered units, most of them of units without assets."""
    n = F.col("doc_id")
    content = F.when(n % 3 != 0, F.coalesce("text", F.lit("")).cast("binary"))
    assets = _documents(spark, d).select(F.col("source").alias("doc_id"), (n % 60).alias("unit_id"), n.alias("ord"), F.col("lang").alias("format"), content.alias("content"))
    page = F.col("page_id")
    rendered = _table(spark, d, "pages").select(F.concat(F.lit("src"), (page % 20).cast("string")).alias("doc_id"), (page % 90).alias("unit_id"), F.lit("html").alias("format"), F.col("html").cast("binary").alias("content"))
    out = A.primary_image(assets, rendered)
    return out.select("doc_id", "unit_id", "n_images", F.array_join("formats", ",").alias("formats"), "place", "format", F.sha2("content", 256).alias("sha256"))


# -- text and signals --


@query
def d1_normalise_text(spark, d):
    from .functions.text import normalise

    return _documents(spark, d).select("doc_id", F.length(normalise(F.coalesce("text", F.lit("")))).alias("n_chars"))


@query
def d2_truncate(spark, d):
    from .functions.text import squeeze, truncate_on_word

    return _documents(spark, d).select("doc_id", truncate_on_word(squeeze(F.coalesce("text", F.lit(""))), 120).alias("short"))


@query
def d4_sentences(spark, d):
    rows = G.sentence_table(_units(spark, d))
    return rows.select("doc_id", "ord", F.md5("sentence").alias("digest"))


@query
def e1_main_topics(spark, d):
    return G.main_topics(_turns(spark, d).withColumn("title", F.when(F.col("unit_id") % 2 == 0, "").otherwise(F.col("title"))))


@query
def e2_e15_phrase_signals(spark, d):
    return G.explode_signals(G.unit_signals(_units(spark, d))).select("doc_id", "kind", "ord", F.md5("value").alias("digest"))


@query
def e5_glossary(spark, d):
    return G.glossary(G.unit_signals(_units(spark, d)))


@query
def e9_comparisons(spark, d):
    rows = exploded(G.unit_signals(_units(spark, d)), "comparison", "doc_id", value="c")
    return rows.select("doc_id", "ord", F.col("c.left").alias("left_side"), F.col("c.right").alias("right_side"), "c.aspect")


@query
def e10_causes(spark, d):
    rows = exploded(G.unit_signals(_units(spark, d)), "cause", "doc_id", value="c")
    return rows.select("doc_id", "ord", "c.cause", "c.effect")


@query
def e9_lesson_comparisons(spark, d):
    rows = exploded(G.unit_signals(_lessons(spark, d)), "comparison", "doc_id", "unit_id", value="c")
    return rows.select("doc_id", "unit_id", "ord", F.col("c.left").alias("left_side"), F.col("c.right").alias("right_side"), "c.aspect")


@query
def e10_lesson_causes(spark, d):
    rows = exploded(G.unit_signals(_lessons(spark, d)), "cause", "doc_id", "unit_id", value="c")
    return rows.select("doc_id", "unit_id", "ord", "c.cause", "c.effect")


@query
def e14_steps(spark, d):
    return exploded(G.unit_signals(_units(spark, d)), "step", "doc_id", value="step")


@query
def e18_faqs(spark, d):
    rows = exploded(G.unit_signals(_units(spark, d)), "faq", "doc_id", value="f")
    return rows.select("doc_id", "ord", F.md5("f.question").alias("question"), F.md5("f.answer").alias("answer"))


@query
def e19_relationships(spark, d):
    """Links between the key concepts of documents, whose titles are the items of a glossary of the corpus' own frequent words."""
    rows = exploded(G.unit_signals(_titled(spark, d)), "relationship", "doc_id", value="r")
    return rows.select("doc_id", "ord", "r.subject", "r.predicate", "r.object", "r.confidence")


def _titled(spark, d) -> DataFrame:
    """Documents titled by their source and language, so that both are key concepts."""
    docs = _documents(spark, d)
    return docs.select("doc_id", F.lit(0).alias("unit_id"), F.concat_ws(": ", "source", "lang").alias("title"), F.coalesce("text", F.lit("")).alias("text"))


@query
def e20_complexity_signals(spark, d):
    return G.complexity_signals(_units(spark, d)).drop("unit_id")


@query
def e_signal_counts(spark, d):
    return G.signal_counts(G.unit_signals(_units(spark, d))).drop("unit_id")


@query
def e3_key_concepts(spark, d):
    return exploded(G.unit_signals(_titled(spark, d)), "concept", "doc_id", value="concept")


@query
def e4_supporting_concepts(spark, d):
    return exploded(G.unit_signals(_turns(spark, d)), "supporting", "doc_id", "unit_id", value="concept")


@query
def e7_numbers(spark, d):
    return exploded(G.unit_signals(_units(spark, d)), "number", "doc_id", value="number")


@query
def e11_chronology(spark, d):
    return exploded(G.unit_signals(_units(spark, d)), "chronology", "doc_id", value="item")


@query
def e16_formulas(spark, d):
    return exploded(G.unit_signals(_units(spark, d)), "formula", "doc_id", value="formula")


@query
def e17_lists(spark, d):
    rows = exploded(G.unit_signals(_units(spark, d)), "list", "doc_id", value="items")
    return rows.select("doc_id", "ord", F.size("items").alias("n"), F.md5(F.array_join("items", "\n")).alias("digest"))


@query
def d3_drop_restatements(spark, d):
    """Sentences of turns as bullets, those that restate an earlier one dropped."""
    return exploded(_turns(spark, d), X.drop_restatements(X.sentences(F.col("text"))), "doc_id", "unit_id", value="bullet")


@query
def d5_sentences_abbrev(spark, d):
    return exploded(_turns(spark, d), X.sentences_abbrev(F.col("text")), "doc_id", "unit_id", value="sentence")


@query
def d6_restore_missing_points(spark, d):
    """Slides with the sentences of their turn that their bullets leave out; the bullets are the turn's first line."""
    return exploded(_turns(spark, d), X.restore_missing_points(F.slice(X.lines(F.col("text")), 1, 1), F.col("text")), "doc_id", "unit_id", value="bullet")


@query
def d7_quantities(spark, d):
    return _turns(spark, d).select("doc_id", "unit_id", K.quantity(F.col("text")).alias("quantity"))


@query
def d8_labels(spark, d):
    """How often lines of the corpus carry each label."""
    lines = S.explode_lines(_documents(spark, d).select("doc_id", F.col("text").alias("markdown"))).select(X.split_label_body(F.col("line"), F.lit("")).alias("x"))
    return lines.groupBy(F.col("x.label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("x.body")).alias("n_chars"))


# -- classes and scores --


@query
def f1_intent_keywords(spark, d):
    return K.intent_keyword_scores(_units(spark, d)).select("doc_id", "intent", "hits", "score")


@query
def f2_structural_bonus(spark, d):
    return K.intent_structural_bonus(_units(spark, d)).select("doc_id", "intent", "bonus")


@query
def f3_classify_units(spark, d):
    return K.classify_units(_units(spark, d)).drop("unit_id")


@query
def f4_repeated_texts(spark, d):
    return K.repeated_texts(C.unit_blocks(_units(spark, d)))


@query
def f4_corpus_boilerplate(spark, d):
    return K.corpus_boilerplate(C.unit_blocks(_units(spark, d)))


@query
def f5_priorities(spark, d):
    return K.prioritise_blocks(_units(spark, d)).groupBy("doc_id", "priority").agg(F.count(F.lit(1)).alias("n"))


@query
def f6_opportunities(spark, d):
    return K.visual_opportunities(_units(spark, d)).drop("unit_id")


@query
def f7_complexity(spark, d):
    return K.complexity_score(_units(spark, d)).drop("unit_id")


@query
def f9_layout_class(spark, d):
    return K.layout_class(_turns(spark, d)).select("doc_id", "unit_id", "layout_type")


@query
def f10_structure_slides(spark, d):
    return _slides(spark, d).select("doc_id", "slide_ix", "layout_type", F.size("bullets").alias("n_bullets"), "metric_value")


@query
def f13_topic_tag(spark, d):
    return K.topic_tag(_units(spark, d), "text").groupBy("topic_tag").agg(F.count(F.lit(1)).alias("n"))


@query
def flagship_intents_by_language(spark, d):
    return K.intent_histogram(K.classify_units(_units(spark, d)), _documents(spark, d))


@query
def f8_unit_intelligence(spark, d):
    """The record of each turn: what later stages read, in numbers."""
    i = _records(spark, d)
    return i.select("doc_id", "unit_id", "topic", "level", "primary_intent", F.size("blocks").alias("n_rows"), F.size("visuals").alias("n_visuals"), "n_words", "n_blocks", F.size("hierarchy.level_4_details").alias("n_details"))


@query
def f11_plan_visual(spark, d):
    rows = exploded(P.plan_visual(_records(spark, d)), F.filter(F.array("plan"), lambda p: p.isNotNull()), "doc_id", "unit_id", value="plan")
    return rows.select("doc_id", "unit_id", "plan.layout_type", "plan.title", F.size("plan.bullets").alias("n_bullets"), "plan.metric_value", F.size("plan.table_rows").alias("n_rows"))


@query
def f12_enrich_slides(spark, d):
    out = P.enrich_slides(_slides(spark, d), P.plan_visual(_records(spark, d)))
    return out.groupBy("layout_type", "upgraded").agg(F.count(F.lit(1)).alias("n"))


# -- plans and specs --


def _records(spark, d) -> DataFrame:
    """The records of turns as units."""
    return K.unit_intelligence(_turns(spark, d))


def _alone(spark, d) -> DataFrame:
    """The same without the texts that repeat across the units of a document, which specifications don't read."""
    return K.unit_intelligence(_units(spark, d), across_units=False)


@query
def g1_text_actions(spark, d):
    return T.text_actions(_records(spark, d)).select("doc_id", "unit_id", "ord", "priority", "action")


@query
def g2_summaries(spark, d):
    return T.summarise_blocks(_records(spark, d))


@query
def g3_speaker_notes(spark, d):
    return T.speaker_notes(_records(spark, d)).select("doc_id", "unit_id", F.md5("speaker_notes").alias("digest"), F.length("speaker_notes").alias("n_chars"))


@query
def g4_compression(spark, d):
    return T.compression_stats(_records(spark, d))


@query
def g5_plan_confidence(spark, d):
    return T.plan_confidence(_alone(spark, d)).drop("unit_id")


@query
def g6_source_blocks(spark, d):
    return T.source_block_ids(_records(spark, d))


@query
def g7_visual_actions(spark, d):
    return T.visual_actions(_records(spark, d)).select("doc_id", "unit_id", "rank", "kind", "action", F.size("block_ids").alias("n_blocks"))


@query
def f5_lesson_priorities(spark, d):
    return K.prioritise_blocks(_lessons(spark, d)).select("doc_id", "unit_id", "ord", "priority")


@query
def f6_lesson_opportunities(spark, d):
    return K.visual_opportunities(_lessons(spark, d))


@query
def g1_lesson_actions(spark, d):
    """Actions on lessons, whose lines have footers, steps, comparisons and pairs of sentences."""
    return T.text_actions(_lesson_records(spark, d)).select("doc_id", "unit_id", "ord", "priority", "action")


@query
def g2_lesson_summaries(spark, d):
    return T.summarise_blocks(_lesson_records(spark, d))


@query
def g3_lesson_notes(spark, d):
    return T.speaker_notes(_lesson_records(spark, d)).select("doc_id", "unit_id", F.md5("speaker_notes").alias("digest"), F.length("speaker_notes").alias("n_chars"))


@query
def g5_lesson_confidence(spark, d):
    return T.plan_confidence(_lesson_records(spark, d))


@query
def h1_select_visuals(spark, d):
    return V.select_visuals(_alone(spark, d)).drop("unit_id")


@query
def h2_visual_density(spark, d):
    return V.visual_density(_alone(spark, d)).drop("unit_id")


@query
def h3_flow_nodes(spark, d):
    return V.flow_nodes(_alone(spark, d)).drop("unit_id")


@query
def h3_flow_edges(spark, d):
    return V.flow_edges(_alone(spark, d)).drop("unit_id")


@query
def h4_flow_text(spark, d):
    return V.flow_text(_alone(spark, d)).drop("unit_id")


@query
def h5_timeline(spark, d):
    return V.timeline_events(_alone(spark, d)).drop("unit_id")


@query
def h6_comparison_rows(spark, d):
    rows = V.comparison_rows(_alone(spark, d))
    return rows.select("doc_id", "ord", F.array_join("headers", "|").alias("headers"), F.array_join("cells", "|").alias("cells"))


@query
def h7_matrix_cells(spark, d):
    return V.matrix_cells(_alone(spark, d)).drop("unit_id")


@query
def h8_decision_rows(spark, d):
    return V.decision_rows(_alone(spark, d)).drop("unit_id")


@query
def h9_org_rows(spark, d):
    return V.org_rows(_alone(spark, d)).drop("unit_id")


@query
def h10_graph_series(spark, d):
    return V.graph_series(_alone(spark, d)).drop("unit_id")


@query
def h11_kpi_metrics(spark, d):
    return V.kpi_metrics(_alone(spark, d)).drop("unit_id")


@query
def h12_smartart(spark, d):
    return V.smartart_elements(_alone(spark, d)).drop("unit_id")


@query
def h13_hierarchy(spark, d):
    return V.hierarchy_rows(_alone(spark, d)).select("doc_id", "ord", "label", "level", F.array_join("children", "|").alias("children"))


@query
def h13_cycle(spark, d):
    return V.cycle_rows(_alone(spark, d)).drop("unit_id")


@query
def h14_mindmap(spark, d):
    return V.mindmap_branches(_alone(spark, d)).select("doc_id", "branch", "name", F.array_join("children", "|").alias("children"))


@query
def h15_icon_items(spark, d):
    return V.icon_items(_alone(spark, d)).drop("unit_id")


@query
def h16_checklist(spark, d):
    return V.checklist_items(_alone(spark, d)).drop("unit_id")


@query
def h17_image_prompts(spark, d):
    return V.image_prompts(_alone(spark, d)).drop("unit_id")


def _lesson(name: str, specification: Callable[[DataFrame], DataFrame], *change) -> None:
    """Registers a specification of lessons, whose turns have steps, figures, comparisons and definitions."""

    def over_lessons(spark, d):
        out = specification(_lesson_records(spark, d))
        return out.withColumns({c: F.array_join(c, "|") for c in change}) if change else out

    over_lessons.__name__ = name
    query(over_lessons)


_lesson("h3_lesson_edges", V.flow_edges)
_lesson("h4_lesson_flow_text", V.flow_text)
_lesson("h5_lesson_timeline", V.timeline_events)
_lesson("h6_lesson_tables", V.comparison_rows, "headers", "cells")
_lesson("h10_lesson_graphs", V.graph_series)
_lesson("h11_lesson_metrics", V.kpi_metrics)
_lesson("h12_lesson_smartart", V.smartart_elements)
_lesson("h15_lesson_icons", V.icon_items)
_lesson("h17_lesson_prompts", V.image_prompts)


# -- decks, scores, retrieval --


def _conversation_decks(spark, d) -> DataFrame:
    """A density per conversation; every fourth has none that is known."""
    n = F.col("conv_id")
    density = F.when(n % 4 == 0, "low").when(n % 4 == 1, "Heavy").when(n % 4 == 2, "medium").when(n % 8 == 3, "dense")
    return _table(spark, d, "conversations").select(n.alias("doc_id"), density.alias("density")).distinct()


@query
def p1_density_profiles(spark, d):
    """The numbers of each deck's profile."""
    out = D.density_profiles(_conversation_decks(spark, d))
    return out.select("doc_id", "max_bullets", "max_words", "max_chars", "max_rows", "max_steps", "max_cards", "extras", "enhanced")


@query
def p10_density_per_deck(spark, d):
    """Pages of each deck within its own profile, in one call."""
    return D.apply_density(_slides(spark, d), _conversation_decks(spark, d)).select("doc_id", "slide_ix", "page", "layout_type", F.size("bullets").alias("n_bullets"), "continued")


@query
def p9_extras_per_deck(spark, d):
    return D.fold_extras(_extras(spark, d), _conversation_decks(spark, d))


@query
def p3_balanced_pages(spark, d):
    lines = C.unit_blocks(_turns(spark, d)).where("not is_heading")
    return D.balanced_pages(lines, ["doc_id", "unit_id"], ["ord"], 5).groupBy("doc_id", "unit_id", "page").agg(F.count(F.lit(1)).alias("n"))


@query
def p2_trim_bullets(spark, d):
    trimmed = X.trim_bullet(F.col("bullet"), F.lit(20), F.lit(140))
    return _slides(spark, d).select("doc_id", "slide_ix", F.posexplode("bullets").alias("ord", "bullet")).select("doc_id", "slide_ix", "ord", trimmed.alias("trimmed"))


@query
def p4_title_restatements(spark, d):
    kept = D.without_title_restatements(F.col("bullets"), F.col("title"))
    return _slides(spark, d).select("doc_id", "slide_ix", F.size("bullets").alias("n_bullets"), F.size(kept).alias("n_kept"))


@query
def p9_fold_extras(spark, d):
    return D.fold_extras(_extras(spark, d), "heavy")


@query
def p10_with_extras(spark, d):
    out = D.apply_density(_slides(spark, d), "heavy", _extras(spark, d))
    return out.groupBy("doc_id", "slide_ix").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.size("bullets")).alias("n_bullets"))


@query
def p10_apply_density(spark, d):
    return D.apply_density(_slides(spark, d), "medium").select("doc_id", "slide_ix", "page", "layout_type", "title", F.size("bullets").alias("n_bullets"), "continued")


def _source_slides(spark, d) -> DataFrame:
    """Documents as slides of a deck per source; those with a question are quizzes."""
    quiz = F.when(F.col("text").contains("?"), "QUIZ").otherwise("MINIMAL_TEXT")
    return _documents(spark, d).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("slide_ix"), quiz.alias("layout_type"), F.col("lang").alias("title"), F.array().cast("array<string>").alias("bullets"), "text")


def _source_decks(spark, d) -> DataFrame:
    """A density per source, by its name's last character."""
    last = F.substring("source", -1, 1)
    density = F.when(last.isin("1", "4", "7"), "low").when(last.isin("2", "5"), "heavy").when(last == "3", "LOW")
    return _documents(spark, d).select(F.col("source").alias("doc_id"), density.alias("density")).distinct()


def _answers(spark, d) -> DataFrame:
    """Sentences of every second turn as a model's answers to it."""
    s = F.col("s")
    rows = _turns(spark, d).where("unit_id % 2 = 0").select("doc_id", "unit_id", "title", X.sentences(F.col("text")).alias("s"))
    return rows.select(
        "doc_id", "unit_id", F.get(s, F.lit(0)).alias("improved_explanation"), F.get(s, F.lit(3)).alias("simplified_explanation"), F.filter(s, lambda x: x.endswith("?")).alias("revision_points"),
        F.slice(s, 2, 1).alias("examples"), F.slice(s, 6, 1).alias("analogies"), F.slice(s, 4, 2).alias("interview_questions"), F.col("title").alias("mnemonic"), F.slice(s, 9, 1).alias("learning_tips"),
    )


@query
def p11_enhancement_eligible(spark, d):
    out = E.enhancement_eligible(_source_slides(spark, d), _source_decks(spark, d))
    return out.select("doc_id", "slide_ix", "rank", F.md5("text").alias("digest"))


@query
def p13_enhancement_confidence(spark, d):
    return E.enhancement_confidence(_lesson_records(spark, d), _answers(spark, d))


@query
def p12_enhancement_context(spark, d):
    """What a model would be told of each lesson: signals, intents, what its plan leaves on the slide, and the notes."""
    out = E.enhancement_context(_lesson_records(spark, d))
    return out.select("doc_id", "unit_id", F.md5("context").alias("digest"), "n_fields")


@query
def p14_quiz_batches(spark, d):
    return D.quiz_batches(_slides(spark, d)).select("doc_id", "batch", "n_slides", F.length("content").alias("n_chars"))


@query
def p15_interleave(spark, d):
    slides = _slides(spark, d)
    quizzes = _documents(spark, d).select(F.col("doc_id"), F.lit(1).alias("quiz_no"), F.col("lang").alias("question"), F.array("source", "lang").alias("options"), F.lit("A").alias("correct"))
    return D.interleave_quizzes(slides, quizzes, frequency=2).select("doc_id", "slide_ix", F.col("quiz.question").alias("question"))


@query
def p16_parse_replies(spark, d):
    """Replies as a model might give them for turns: plain, fenced, with words around, and broken."""
    layout = F.when(F.col("turn") % 3 == 0, "table").when(F.col("turn") % 3 == 1, "Metric").otherwise(F.col("role"))
    json = F.concat(F.lit('{"layout_type": "'), layout, F.lit('", "correct": "'), F.element_at(F.array(*[F.lit(x) for x in ("b) yes", "none", "Answer: D", "")]), (F.col("conv_id") % 4 + 1).cast("int")), F.lit('"}'))
    kind = F.col("turn") % 4
    raw = F.when(kind == 0, json).when(kind == 1, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here: "), json, F.lit(" as asked"))).otherwise(F.lit("{broken"))
    replies = _table(spark, d, "conversations").where("role is not null").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("unit_id"), raw.alias("raw"))
    return W.parse_replies(replies).select("doc_id", "unit_id", "json", "layout_type", "answer")


@query
def r1_keyword_top_k(spark, d):
    chunks = _turns(spark, d).select("doc_id", F.col("unit_id").alias("chunk_id"), "text")
    return D.keyword_top_k(chunks, _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query
def r2_chunk_counts(spark, d):
    return D.chunk_counts(_chunks(spark, d))


@query
def r3_join_vectors(spark, d):
    return D.join_vectors(_turns(spark, d), _table(spark, d, "embeddings")).select("doc_id", "unit_id", F.size("embedding").alias("n_dims"))


@query
def s1_score_slides(spark, d):
    return D.score_slides(_slides(spark, d))


def _with_images(slides: DataFrame) -> DataFrame:
    """Every third slide of a deck with an image."""
    return slides.withColumn("image", F.when(F.col("slide_ix") % 3 == 0, F.concat(F.lit("image"), F.col("slide_ix").cast("string"))))


@query
def s1_score_with_images(spark, d):
    return D.score_slides(_with_images(_slides(spark, d)))


@query
def s2_score_decks(spark, d):
    return D.score_decks(D.score_slides(_slides(spark, d)))


@query
def s3_score_breakdown(spark, d):
    return D.score_breakdown(D.score_slides(_slides(spark, d))).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


def _events(spark, d):
    return _table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), "ts", "event_id", F.col("value").alias("seconds"))


@query
def s5_stage_metrics(spark, d):
    return D.stage_metrics(_events(spark, d)).withColumn("mean_seconds", F.round("mean_seconds", 4))


def _outcomes(spark, d) -> DataFrame:
    """Events as outcomes of stages: some failed, skipped or still running."""
    n = F.col("event_id")
    status = F.when(n % 11 == 0, "failed").when(n % 13 == 0, "skipped").when(n % 5 == 0, "running").when(n % 17 != 0, "ok")
    return _events(spark, d).withColumns({"status": status, "detail": F.concat(F.lit("event "), n.cast("string"))})


@query
def s4_run_summary(spark, d):
    """Conversations as decks, documents with questions as quizzes, users' events as stages: runs that some of them know."""
    quizzes = _documents(spark, d).where(F.col("text").contains("?")).select((F.col("doc_id") % 90).alias("doc_id"))
    slides = _slides(spark, d)
    out = D.run_summary(slides, quizzes, D.score_slides(slides), _outcomes(spark, d), _conversation_decks(spark, d))
    listed = F.array_join(F.transform("stages", lambda x: F.concat_ws(":", x["name"], x["status"], x["detail"])), "|")
    return out.select("run", "slide_count", "quiz_count", "overall_score", "density_profile", "total_seconds", listed.alias("stages"))


@query
def s5_stage_outcomes(spark, d):
    return D.stage_outcomes(_outcomes(spark, d)).withColumn("mean_seconds", F.round("mean_seconds", 4))


@query
def s5_run_progress(spark, d):
    """How far along the stages, in order of name, each user's events reach."""
    return D.run_progress(_events(spark, d), _stages(spark, d)).select("run", F.round("progress", 6).alias("progress"))


@query
def s6_latest_status(spark, d):
    return D.latest_status(_events(spark, d)).select("run", "stage", "event_id")


def _job_events(spark, d) -> DataFrame:
    """Events as those of jobs, a job per user; every seventh names no owner."""
    owner = F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("team"), (F.col("user_id") % 5).cast("string")))
    return _table(spark, d, "events").select(F.col("user_id").alias("run"), owner.alias("owner"), F.col("event_type").alias("stage"), "ts", "event_id", F.col("value").alias("seconds"))


def _stages(spark, d) -> list[str]:
    """The stages of the events, in order of name: as many as there are kinds of events."""
    return [x[0] for x in _table(spark, d, "events").select("event_type").distinct().orderBy("event_type").collect()]


@query
def s6_run_status(spark, d):
    """Status and progress of jobs, those of one owner left out."""
    out = N.run_status(_job_events(spark, d), _stages(spark, d)).where("owner <> 'team3'")
    return out.select("run", "owner", "stage", "event_id", "n_events", F.round("seconds", 3).alias("seconds"), F.round("progress", 6).alias("progress"))


@query
def s6_live_status(spark, d):
    """The same from a stream of the events: each batch's updates, of which the last of a run is its status."""
    at, events = H.new_path(spark, "status"), _table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")
    owner = F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("team"), (F.col("user_id") % 5).cast("string")))
    jobs = stream.select(F.col("user_id").alias("run"), owner.alias("owner"), F.col("event_type").alias("stage"), "ts", "event_id", F.col("value").alias("seconds"))
    N.write_status(N.live_status(jobs, _stages(spark, d)), f"{at}/updates", f"{at}/log").awaitTermination()
    out = N.latest(spark.read.parquet(f"{at}/updates")).where("owner <> 'team3'")
    return out.select("run", "owner", "stage", "event_id", "n_events", F.round("seconds", 3).alias("seconds"), F.round("progress", 6).alias("progress"))
