"""Lines, sections and units of markdown documents.

A document is one row, so its lines, sections and titles are arrays of that row: nothing here shuffles, and
a corpus of any size is a chain of narrow projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import MERGED_CHARS
from ..functions.rows import exploded
from ..functions.text import heading_level, heading_text, is_junk_heading, lines, strip, words

SECTION = "array<struct<title:string,level:int,text:string>>"


def explode_lines(docs: DataFrame, text_col: str = "markdown") -> DataFrame:
    """(doc_id, line_no, line)."""
    return docs.select("doc_id", F.posexplode(lines(F.col(text_col))).alias("line_no", "line"))


def _opens(line: Column, max_level: int) -> Column:
    level = heading_level(line)
    return (level > 0) & (level <= max_level) & ~is_junk_heading(heading_text(line))


def _body_line(line: Column) -> Column:
    return F.when(heading_level(line) > 0, heading_text(line)).otherwise(line)


def with_sections(docs: DataFrame, max_level: int = 2) -> DataFrame:
    """Adds sections: [(title, level, text)]; headings up to max_level open one, what comes before has level 0.

    Deeper and junk headings are body lines without their hashes. A first part without title and text is none.
    """
    marked = docs.withColumn("_lines", lines(F.col("markdown")))
    opens = F.filter(F.transform("_lines", lambda x, i: F.when(_opens(x, max_level), i)), lambda i: i.isNotNull())
    marked = marked.withColumn("_at", F.concat(F.array(F.lit(-1)), opens, F.array(F.size("_lines"))))

    def section(k: Column) -> Column:
        here, after = F.element_at(F.col("_at"), k), F.element_at(F.col("_at"), k + 1)
        head = F.element_at(F.col("_lines"), F.greatest(here, F.lit(0)) + 1)
        body = F.transform(F.slice(F.col("_lines"), here + 2, after - here - 1), _body_line)
        return F.struct(
            F.when(here < 0, "").otherwise(heading_text(head)).alias("title"),
            F.when(here < 0, 0).otherwise(heading_level(head)).cast("int").alias("level"),
            strip(F.array_join(body, "\n")).alias("text"),
        )

    all_sections = F.transform(F.sequence(F.lit(1), F.size("_at") - 1), section)
    return marked.withColumn("sections", F.filter(all_sections, lambda s: (s["title"] != "") | (s["text"] != ""))).drop("_lines", "_at")


def inherit_titles(docs: DataFrame) -> DataFrame:
    """Sections without a title, or titled page, section or slide n, take the last real title before them."""

    def own(s: Column) -> Column:
        return (s["title"] != "") & ~s["title"].rlike(r"(?i)^(page|section|slide)\s*[0-9]+$")

    def titled(s: Column, i: Column) -> Column:
        # With nothing real before it, a numbered title stands and is handed on.
        before = F.slice(F.col("sections"), F.lit(1), i)
        real = F.filter(before, own)
        numbered = F.filter(before, lambda x: x["title"] != "")
        last = F.when(F.size(real) > 0, F.element_at(real, -1)["title"]).when(F.size(numbered) > 0, F.element_at(numbered, 1)["title"])
        return F.struct(F.when(own(s), s["title"]).otherwise(F.coalesce(last, s["title"])).alias("title"), s["level"].alias("level"), s["text"].alias("text"))

    return docs.withColumn("sections", F.transform("sections", titled))


def merge_repeated_titles(docs: DataFrame, most_chars: int = MERGED_CHARS) -> DataFrame:
    """Consecutive sections with one title (in any case) become one while their text stays within most_chars."""

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        same = (F.size(kept) > 0) & (s["title"] != "") & (F.lower(strip(s["title"])) == F.lower(strip(last["title"])))
        body = strip(s["text"])
        fits = F.length(last["text"]) + F.length(body) <= most_chars
        joined = F.when(body == "", last["text"]).otherwise(strip(F.concat(F.rtrim(last["text"]), F.lit("\n"), body)))
        merged = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(F.struct(last["title"].alias("title"), last["level"].alias("level"), joined.alias("text"))))
        return F.when(F.size(kept) == 0, F.array(s)).when(same & fits, merged).otherwise(F.concat(kept, F.array(s)))

    return docs.withColumn("sections", F.aggregate("sections", F.array().cast(SECTION), step))


def split_sections(docs: DataFrame, max_level: int = 2, inherit: bool = True, merge: bool = True) -> DataFrame:
    """(doc_id, section_id, title, level, text) of markdown documents."""
    out = with_sections(docs.select("doc_id", "markdown"), max_level)
    out = inherit_titles(out) if inherit else out
    out = merge_repeated_titles(out) if merge else out
    return exploded(out, "sections", "doc_id", pos="section_id").select("doc_id", "section_id", "x.title", "x.level", "x.text")


def section_outline(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sections, outline): titles and levels in order, one row per document."""
    out = merge_repeated_titles(inherit_titles(with_sections(docs.select("doc_id", "markdown"))))
    outline = F.transform("sections", lambda s: F.concat_ws(":", s["level"].cast("string"), s["title"]))
    return out.select("doc_id", F.size("sections").alias("n_sections"), F.array_join(outline, "|").alias("outline"))


def sections_to_units(sections: DataFrame) -> DataFrame:
    """(doc_id, unit_id, slide, title, text, content): sections as units, content being the lines that are not blank."""
    content = F.filter(lines(F.col("text")), lambda x: strip(x) != "")
    title = F.when(F.col("title") == "", F.concat(F.lit("Section "), (F.col("section_id") + 1).cast("string"))).otherwise(F.col("title"))
    return sections.select("doc_id", F.col("section_id").alias("unit_id"), (F.col("section_id") + 1).alias("slide"), title.alias("title"), "text", content.alias("content"))
