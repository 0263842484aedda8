"""Chapters over long documents, running values in blocks, and page layout."""

import random

from pyspark.sql import functions as F

from corpusdeck.functions.running import carried, summed
from corpusdeck.operators import layout as L

PAGES = "doc_id long, page int, heading string, text string"


def regroup(rows, per):
    """Chapters in one pass over each document's pages."""
    out = {}
    for doc in {r[0] for r in rows}:
        chapter, texts = "Introduction", {}
        for _, _, heading, text in sorted((r for r in rows if r[0] == doc), key=lambda r: (r[1], r[3] or "")):
            if heading and heading.startswith(("Chapter", "2.")):
                chapter = heading.strip()
            texts.setdefault(chapter, []).extend((text or "").split())
        for chapter, words in texts.items():
            for i in range(max(1, -(-len(words) // per))):
                out[doc, chapter, i + 1] = " ".join(words[i * per : (i + 1) * per]) or "(Visual Content)"
    return out


def test_chapters_against_one_pass(spark):
    r = random.Random(2)
    rows = [(d, p, r.choice([None] * 6 + ["Chapter 1", "Chapter 2", "2. Title", "not a heading"]), r.choice([None, "", "one", "a b c d e f g", "w " * 40])) for d in (1, 2, None) for p in range(120)]
    rows += [(3, 0, "Chapter 9", None), (4, 5, None, "x " * 1000), (4, 5, None, "y")]
    df = spark.createDataFrame(rows, PAGES).repartition(5)
    for block in (1, 7, 4096):
        got = {(x.doc_id, x.chapter, x.part): x.text for x in L.chapter_regroup(df, 10, block_pages=block).collect()}
        assert got == regroup(rows, 10)
    assert L.chapter_regroup(df.where("false")).count() == 0
    assert L.chapter_regroup(df.withColumn("page", F.lit(None).cast("int"))).count() == 0


def test_images_go_to_parts_in_order(spark):
    pages = spark.createDataFrame([(1, 0, None, "a b c d e"), (1, 1, "Chapter 1", "f"), (1, 2, None, "g h i")], PAGES)
    images = spark.createDataFrame([(1, 0, 1, "two"), (1, 0, 0, "one"), (1, 2, 0, "three"), (1, 1, 0, "zero"), (1, 1, 1, "x"), (9, 0, 0, "nobody's")], "doc_id long, page int, ord int, image string")
    got = {(x.chapter, x.part): (x.text, x.image) for x in L.chapter_regroup(pages, 2, images).collect()}
    assert got == {
        ("Introduction", 1): ("a b", "one"), ("Introduction", 2): ("c d", "two"), ("Introduction", 3): ("e", None),
        ("Chapter 1", 1): ("f g", "zero"), ("Chapter 1", 2): ("h i", "x"),
    }


def test_one_document_of_a_million_lines_is_many_tasks(spark):
    lines = spark.range(1_000_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page"), F.when(F.col("id") % 100_003 == 5, F.concat(F.lit("Chapter "), F.col("id").cast("string"))).alias("heading"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    named = carried(lines.withColumnRenamed("heading", "mark"), "mark", "chapter", ["doc_id"], "page")
    counted = named.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(counted) >= 3 and max(x["count"] for x in counted) < 600_000
    out = L.chapter_regroup(lines).groupBy("chapter").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("last")).collect()
    got = {x.chapter: (x.n, x["last"]) for x in out}
    ends = [0, *range(5, 1_000_000, 100_003), 1_000_000]
    names = ["Introduction", *(f"Chapter {x}" for x in ends[1:-1])]
    assert got == {c: (-(-(b - a) // 150),) * 2 for c, a, b in zip(names, ends, ends[1:], strict=False)}


def test_running_values(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", None]), i, r.choice([None, None, 1, 5])) for i in range(-50, 150)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {(x.k, x.i): (x.last, x.total) for x in summed(carried(df.withColumn("w", F.col("v")), "v", "last", ["k"], "i", 8), "w", "total", ["k"], "i", 8).collect()}
    want, state = {}, {}
    for k, i, v in rows:
        last, total = state.get(k, (None, 0))
        want[k, i] = (v if v is not None else last, total)
        state[k] = (v if v is not None else last, total + (v or 0))
    assert got == want


SPAN = "doc_id long, page int, block int, size double, is_bold boolean, text string"


def test_headings_by_the_upper_median(spark):
    sizes = [10.0, 10.0, 12.0, 12.0, 12.5, 13.0, 15.0, None]
    rows = [(1, 0, i, s, i == 5, f"t{i}") for i, s in enumerate(sizes)] + [(1, 1, 0, None, None, "x"), (2, 0, 0, 15.0, False, "y" * 200), (2, 0, 1, 1.0, True, "z"), (None, 0, 0, 9.0, None, "n")]
    got = {(x.doc_id, x.page, x.block): (x.median, x.is_heading) for x in L.infer_headings(spark.createDataFrame(rows, SPAN)).collect()}
    known = sorted(s for s in sizes if s is not None)
    median = known[len(known) // 2]
    for i, s in enumerate(sizes):
        assert got[1, 0, i] == (median, s is not None and (s >= 1.25 * median or (i == 5 and s >= 1.05 * median)))
    assert got[1, 1, 0] == (12.0, False) and got[2, 0, 0] == (15.0, False)
    assert {(x.doc_id, x.page): x.title for x in L.page_titles(spark.createDataFrame(rows, SPAN)).collect()} == {(1, 0): "t5"}


BLOCK = "doc_id long, page int, block int, page_width double, x0 double, x1 double, y0 double"


def test_columns_and_reading_order(spark):
    two = [(1, 0, i, 600.0, 20.0 if i % 2 else 320.0, 280.0 if i % 2 else 580.0, 100.0 + i) for i in range(6)] + [(1, 0, 9, 600.0, 20.0, 580.0, 10.0)]
    one = [(1, 1, i, 600.0, 20.0, 580.0, 300.0 - 10 * i) for i in range(4)]
    df = spark.createDataFrame(two + one, BLOCK)
    assert {(x.doc_id, x.page): x.columns for x in L.detect_columns(df).collect()} == {(1, 0): 2, (1, 1): 1}
    order = {(x.page, x.block): (x.column, x.reading_order) for x in L.reading_order(df).collect()}
    assert [b for (p, b), _ in sorted(order.items(), key=lambda x: x[1][1]) if p == 0] == [9, 1, 3, 5, 0, 2, 4]
    assert [b for (p, b), _ in sorted(order.items(), key=lambda x: x[1][1]) if p == 1] == [3, 2, 1, 0]
    assert L.multi_column_docs(df).first().multi_column and L.reading_order(df.where("false")).count() == 0


def test_flagged_blocks(spark):
    rows = [(1, 0, 0, None, 22.0, "First"), (1, 0, 1, None, 30.0, "• point"), (1, 0, 2, True, 12.0, " - shape"), (1, 1, 0, False, 19.0, "small"), (1, 2, 0, True, None, "no size")]
    got = {(x.unit_id, x.ord): (x.is_heading, x.heading_level, x.bullet_level) for x in L.flag_blocks(spark.createDataFrame(rows, "doc_id long, unit_id int, ord int, is_title_shape boolean, font_size double, text string")).collect()}
    assert got == {(0, 0): (True, 2, 0), (0, 1): (False, 0, 1), (0, 2): (True, 3, 1), (1, 0): (False, 0, 0), (2, 0): (True, 3, 0)}
