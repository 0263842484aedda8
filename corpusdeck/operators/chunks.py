"""Paragraphs, word chunks, blocks and pipe tables of units; all narrow, a unit's lines being one row's array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import CHUNK_WORDS
from ..functions.rows import exploded
from ..functions.text import lines, strip, without_marker, words
from .signals import with_items

#: The line ahead of a table (fixed value).
TABLE_MARK = "[TABLE DATA]"
_MARKED = r"^[ \t]*([-*+•]|[0-9]+[.)])[ \t]+"
_STATE = "struct<done:array<string>,open:array<string>,mode:int>"
#: Modes of the paragraph fold.
_NONE, _LIST, _TABLE = 0, 1, 2


def split_paragraphs(units: DataFrame) -> DataFrame:
    """(doc_id, unit_id, para_no, paragraph): the paragraphs of a unit's text.

    A list run is one paragraph, its items' markers dropped and further lines appended to the last item; a
    [TABLE DATA] run stays whole until a blank line or heading; '## ' opens a paragraph with the heading's
    text; a blank line ends one; prose lines are joined by a space.
    """

    def flush(s: Column, joint: Column) -> Column:
        text = strip(F.array_join(s["open"], "\x00"))
        return F.when(text == "", s["done"]).otherwise(F.concat(s["done"], F.array(strip(F.replace(text, F.lit("\x00"), joint)))))

    def state(done: Column, now: Column, mode) -> Column:
        return F.struct(done.alias("done"), now.alias("open"), F.lit(mode).cast("int").alias("mode"))

    def step(s: Column, raw: Column) -> Column:
        line = strip(raw)
        none, space, newline = F.array().cast("array<string>"), F.lit(" "), F.lit("\n")
        item = strip(F.regexp_replace(line, _MARKED, ""))
        is_item, blank, is_table, is_head = line.rlike(_MARKED), line == "", line.startswith("[TABLE DATA]"), line.startswith("## ")
        last = F.element_at(s["open"], F.size(s["open"]))
        longer = F.concat(F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1), F.array(F.concat(last, space, line)))
        in_list = (
            F.when(is_item, state(s["done"], F.concat(s["open"], F.array(item)), _LIST))
            .when(blank, state(flush(s, newline), none, _NONE))
            .otherwise(state(s["done"], longer, _LIST))
        )
        in_table = (
            F.when(line.startswith("##"), state(flush(s, newline), F.array(line), _NONE))
            .when(blank, state(flush(s, newline), none, _NONE))
            .otherwise(state(s["done"], F.concat(s["open"], F.array(line)), _TABLE))
        )
        plain = (
            F.when(is_item, state(flush(s, space), F.array(item), _LIST))
            .when(is_table, state(flush(s, space), F.array(line), _TABLE))
            .when(is_head, state(flush(s, space), F.array(strip(F.substring(line, 4, 1 << 30))), _NONE))
            .when(blank, state(flush(s, space), none, _NONE))
            .otherwise(state(s["done"], F.concat(s["open"], F.array(line)), _NONE))
        )
        return F.when(s["mode"] == _LIST, in_list).when(s["mode"] == _TABLE, in_table).otherwise(plain)

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(_NONE).alias("mode")).cast(_STATE)
    folded = F.aggregate(lines(F.col("text")), zero, step, lambda s: flush(s, F.when(s["mode"] == _NONE, F.lit(" ")).otherwise(F.lit("\n"))))
    return exploded(units, folded, "doc_id", "unit_id", "title", pos="para_no", value="paragraph")


def chunk_words(paragraphs: DataFrame, most: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, unit_id, title, para_no, piece_no, text): paragraphs beyond most words in pieces of most words; tables stay whole."""
    w = words(F.col("paragraph"))
    whole = F.col("paragraph").startswith("[TABLE DATA]") | F.col("paragraph").contains(" | ") | (F.size(w) <= most)
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / most).cast("int") - 1), lambda i: F.array_join(F.slice(w, i * most + 1, F.lit(most)), " "))
    return exploded(paragraphs, F.when(whole, F.array("paragraph")).otherwise(pieces), "doc_id", "unit_id", "title", "para_no", pos="piece_no", value="text")


def chunk_corpus(units: DataFrame, most: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, chunk_id, unit_id, title, text): chunks in order, numbered from 0 in each document; a unit without text gives its title."""
    text = F.when(strip(F.coalesce("text", F.lit(""))) == "", F.col("title")).otherwise(F.col("text"))
    pieces = chunk_words(split_paragraphs(units.select("doc_id", "unit_id", "title", text.alias("text"))), most)
    order = Window.partitionBy("doc_id").orderBy("unit_id", "para_no", "piece_no")
    return pieces.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_id"), "unit_id", "title", "text")


def merge_chunks_by_section(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, title, text): chunks of one title in a document as one, in the order of their first."""
    merged = chunks.groupBy("doc_id", "title").agg(F.min("chunk_id").alias("first"), F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("parts"))
    order = Window.partitionBy("doc_id").orderBy("first")
    return merged.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_id"), "title", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))


def unit_blocks(units: DataFrame) -> DataFrame:
    """(doc_id, unit_id, ord, block_id, text, is_heading, bullet_level): the title, then each line that is not blank."""
    body = F.filter(F.transform(lines(F.col("text")), without_marker), lambda x: x != "")
    title = F.when(F.col("title") == "", F.array().cast("array<string>")).otherwise(F.array("title"))
    has_title = F.col("title") != ""
    rows = units.select("doc_id", "unit_id", has_title.alias("has_title"), F.posexplode(F.concat(title, body)).alias("ord", "text"))
    heading = F.col("has_title") & (F.col("ord") == 0)
    return rows.select(
        "doc_id", "unit_id", "ord", F.concat(F.lit("s"), F.col("unit_id").cast("string"), F.lit("_tb_"), F.col("ord").cast("string")).alias("block_id"),
        "text", heading.alias("is_heading"), F.when(heading, 0).otherwise(1).alias("bullet_level"),
    )


def unit_text(units: DataFrame) -> DataFrame:
    """(doc_id, unit_id, full_text): '## heading', '- bullet' indented by level and plain blocks in reading order, then tables and notes.

    A table with headers is a mark, its headers and its rows, cells parted by bars. Units may have the optional
    columns of signals.with_items; where they have blocks, these take the place of title and text.
    """
    whole = with_items(units)

    def line(b: Column) -> Column:
        level = F.coalesce(b["bullet_level"], F.lit(0))
        bullet = F.concat(F.repeat(F.lit("  "), F.greatest(level - 1, F.lit(0))), F.lit("- "), b["text"])
        return F.when(F.coalesce(b["is_heading"], F.lit(False)), F.concat(F.lit("## "), b["text"])).when(level > 0, bullet).otherwise(b["text"])

    def table(t: Column) -> Column:
        return F.concat(F.array(F.lit(TABLE_MARK), F.array_join(t["headers"], " | ", "")), F.transform(t["rows"], lambda r: F.array_join(r, " | ", "")))

    tables = F.flatten(F.transform(F.filter("tables", lambda t: F.size(t["headers"]) > 0), table))
    notes = F.when(F.col("notes") != "", F.array(F.concat(F.lit("[Speaker Notes: "), F.col("notes"), F.lit("]")))).otherwise(F.array().cast("array<string>"))
    return whole.select("doc_id", "unit_id", F.array_join(F.concat(F.transform("_items", line), tables, notes), "\n").alias("full_text"))


def pipe_table(text: Column) -> Column:
    """[[cell]] of a text's pipe rows: lines with two pipes or more, separator rows dropped, padded to the widest; null under two rows."""
    rows = F.filter(F.transform(lines(text), strip), lambda x: (F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2) & ~x.rlike(r"^[|\s:-]+$"))
    cells = F.transform(rows, lambda x: F.transform(F.split(F.btrim(x, F.lit("|")), r"\|"), strip))
    widest = F.array_max(F.transform(cells, F.size))
    return F.when(F.size(rows) >= 2, F.transform(cells, lambda r: F.concat(r, F.array_repeat(F.lit(""), widest - F.size(r)))))


def parse_pipe_tables(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, row, col, value): the cells of each document's pipe table; row 0 is the header."""
    tables = docs.select("doc_id", F.posexplode(pipe_table(F.col(text_col))).alias("row", "cells"))
    return tables.select("doc_id", "row", F.posexplode("cells").alias("col", "value"))
