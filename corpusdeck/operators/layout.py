"""Page layout from spans and blocks: headings, columns and reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import inlined
from ..functions.running import carried, summed
from ..functions.text import let, words

#: A block wider than this share of its page spans columns (fixed value).
SPANNING = 0.62


def infer_headings(spans: DataFrame) -> DataFrame:
    """spans (doc_id, page, block, size, is_bold, text) plus median and is_heading.

    The median is the upper one of the page, 12 for pages without sizes; a heading has 1.25 times that size,
    or is bold with 1.05 times. The median comes from a count per size, not from a list of all spans.
    """
    counts = spans.where("size is not null").groupBy("doc_id", "page", "size").agg(F.count(F.lit(1)).alias("n"))
    page = Window.partitionBy("doc_id", "page")
    upto = F.sum("n").over(page.orderBy("size"))
    placed = counts.select("doc_id", "page", "size", upto.alias("upto"), F.sum("n").over(page).alias("total"))
    median = placed.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("doc_id", "page").agg(F.min("size").alias("median"))
    out = spans.join(median, ["doc_id", "page"], "left").withColumn("median", F.coalesce("median", F.lit(12.0)))
    bold = F.coalesce("is_bold", F.lit(False)) & (F.col("size") >= F.col("median") * 1.05)
    return out.withColumn("is_heading", F.coalesce((F.col("size") >= F.col("median") * 1.25) | bold, F.lit(False)))


def page_titles(spans: DataFrame) -> DataFrame:
    """(doc_id, page, title): the first heading below 120 characters."""
    heads = infer_headings(spans).where(F.col("is_heading") & (F.length("text") < 120))
    return heads.groupBy("doc_id", "page").agg(F.min_by("text", "block").alias("title"))


def detect_columns(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, columns) of blocks (doc_id, page, page_width, x0, x1, ...): 2 for pages with enough blocks on either side."""
    wide = (F.col("x1") - F.col("x0")) > F.col("page_width") * SPANNING
    left = ~wide & ((F.col("x0") + F.col("x1")) / 2 < F.col("page_width") / 2)
    per = blocks.groupBy("doc_id", "page").agg(F.count_if(left).alias("l"), F.count_if(~wide & ~left).alias("r"), F.count_if(wide).alias("w"))
    two = (F.col("l") + F.col("r") >= 4) & (F.col("l") >= 2) & (F.col("r") >= 2) & (F.col("w") <= (F.col("l") + F.col("r")) / 2)
    return per.select("doc_id", "page", F.when(two, 2).otherwise(1).alias("columns"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks plus column and reading_order: by column on two-column pages, then downward, then to the right."""
    joined = blocks.join(detect_columns(blocks), ["doc_id", "page"])
    wide = (F.col("x1") - F.col("x0")) > F.col("page_width") * SPANNING
    side = F.when(wide | ((F.col("x0") + F.col("x1")) / 2 < F.col("page_width") / 2), 0).otherwise(1)
    placed = joined.withColumn("column", F.when(F.col("columns") == 2, side).otherwise(0))
    order = Window.partitionBy("doc_id", "page").orderBy("column", F.bround("y0", 1), "x0")
    return placed.withColumn("reading_order", F.row_number().over(order) - 1).drop("columns")


def multi_column_docs(blocks: DataFrame) -> DataFrame:
    """(doc_id, multi_column): whether half of a document's first four pages (one at least) have two columns."""
    first = detect_columns(blocks).where("page < 4").groupBy("doc_id").agg(F.count_if(F.col("columns") == 2).alias("two"), F.count(F.lit(1)).alias("n"))
    return first.select("doc_id", (F.col("two") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2))).alias("multi_column"))


def flag_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, unit_id, ord, is_title_shape, font_size, text) plus is_heading, heading_level, bullet_level."""
    first = F.row_number().over(Window.partitionBy("doc_id", "unit_id").orderBy("ord")) == 1
    size = F.coalesce("font_size", F.lit(0.0))
    heading = F.coalesce("is_title_shape", F.lit(False)) | (first & (size >= 20))
    out = blocks.withColumn("is_heading", heading)
    bullet = F.col("text").rlike(r"^\s*[•◦▪‣·*-]\s")
    return out.withColumns({"heading_level": F.when(F.col("is_heading"), F.when(size >= 16, 2).otherwise(3)).otherwise(0), "bullet_level": F.when(bullet, 1).otherwise(0)})


#: The chapter of pages before the first heading, the text of a chapter without words, and what opens a chapter (fixed values).
FIRST_CHAPTER, NO_WORDS = "Introduction", "(Visual Content)"
CHAPTER = r"(?i)^\s*((chapter|unit|module|lesson|part)\s+[0-9ivxlc]+\b|[0-9]+\.\s+\S)"


def chapter_regroup(pages: DataFrame, words_per_part: int = 150, images: DataFrame | None = None, block_pages: int = 4096) -> DataFrame:
    """(doc_id, chapter, part, title, text, image) of pages (doc_id, page, heading, text).

    A heading 'Chapter n', 'Unit n' or 'n. Title' opens a chapter, carried forward from 'Introduction'; all
    pages of a chapter name go together, in order of page, and are cut every words_per_part words. A chapter
    without words is one part with a placeholder. images (doc_id, page, ord, image) go to the parts of their
    page's chapter, the i-th to the i-th; further ones are left out.

    No task sees a whole document: headings are carried and words counted in blocks of block_pages page
    numbers, whose ends meet in a small table, and a part is put together from the pieces that fall into it.
    Rows with a null page number are left out; a null text has no words; pages that repeat a number follow each
    other by text. A null doc_id is one document. An empty table gives an empty table.
    """
    known = pages.where(F.col("page").isNotNull())
    mark = F.when(F.coalesce("heading", F.lit("")).rlike(CHAPTER), F.trim("heading"))
    named = carried(known.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"), mark.alias("_mark")), "_mark", "chapter", ["doc_id"], "page", block_pages)
    named = named.withColumn("chapter", F.coalesce("chapter", F.lit(FIRST_CHAPTER))).withColumn("_n", F.size(words(F.col("text"))))
    placed = summed(named, "_n", "_start", ["doc_id", "chapter"], "page", block_pages)
    per = F.lit(words_per_part)

    def piece(w: Column, part: Column) -> Column:
        low = F.greatest(F.lit(0), part * per - F.col("_start"))
        high = F.least(F.col("_n"), (part + 1) * per - F.col("_start"))
        return F.struct(part.alias("part"), F.col("_start").alias("start"), F.array_join(F.slice(w, (low + 1).cast("int"), (high - low).cast("int")), " ").alias("text"))

    inside = F.sequence(F.floor(F.col("_start") / per), F.floor((F.col("_start") + F.col("_n") - 1) / per))
    pieces = let(words(F.col("text")), lambda w: F.transform(inside, lambda p: piece(w, p)))
    cut = inlined(placed.where("_n > 0"), pieces, "doc_id", "chapter", key="part")
    parts = cut.groupBy("doc_id", "chapter", "part").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("all"))
    parts = parts.select("doc_id", "chapter", "part", F.array_join(F.transform("all", lambda x: x["text"]), " ").alias("text"))
    empty = named.groupBy("doc_id", "chapter").agg(F.max("_n").alias("most")).where("most = 0").select("doc_id", "chapter", F.lit(0).cast("long").alias("part"), F.lit(NO_WORDS).alias("text"))
    out = parts.unionByName(empty)
    if images is None:
        out = out.withColumn("image", F.lit(None).cast("string"))
    else:
        chapters = named.groupBy("doc_id", "page").agg(F.min("chapter").alias("chapter"))
        shown = images.select(F.col("doc_id").alias("_doc"), F.col("page").alias("_page"), "ord", "image").join(chapters, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_page") == F.col("page")))
        order = Window.partitionBy("doc_id", "chapter").orderBy("page", "ord", "image")
        shown = shown.select(F.col("doc_id").alias("_doc"), F.col("chapter").alias("_chapter"), (F.row_number().over(order) - 1).alias("_part"), "image")
        out = out.join(shown, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("chapter") == F.col("_chapter")) & (F.col("part") == F.col("_part")), "left")
    number = (F.col("part") + 1).cast("int")
    return out.select("doc_id", "chapter", number.alias("part"), F.concat("chapter", F.lit(" — Part "), number.cast("string")).alias("title"), "text", "image")
