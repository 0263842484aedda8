"""Line dedup with DataFrame functions only.

Normalised lines are exploded and hashed, a partial aggregate counts the distinct documents of each
hash, and only positions of dropped lines travel back to the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, free_names

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _fold(text: Column) -> Column:
    """A-Z lower-cased, nothing else; lower() is the fast way where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, keys): the text's line keys in order, as 128-bit hashes; null for lines that are too short to count."""
    return docs.select(F.col(id_col).alias("doc"), F.split(_fold(F.coalesce(F.col(text_col), F.lit(""))), "\n").alias("keys"))


def _hashed(lines: DataFrame, min_chars: int) -> DataFrame:
    key = F.btrim(F.col("line"), F.lit(WHITE))
    long = lines.withColumn("line", key).where(F.length("line") >= min_chars)
    return long.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")}).drop("line")


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, dropped): positions of the lines that a document loses, ascending; documents that lose none are absent.

    Each line counts once per document id, whatever white space is at its ends and however many rows repeat
    the id. The ids of a hash are made distinct by (hash, id) first, so a line that a third of all documents
    hold spreads over all tasks, and their number and the largest come from a map-side combined aggregate.
    The join back to the lines is a plain equi-join whose hot side adaptive execution splits.
    """
    keys = _keys(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    distinct = _hashed(keys.select("doc", F.explode(F.array_distinct("keys")).alias("line")), min_chars)
    hot = (
        # The third grouping column keeps the aggregate's partitioning from being the join's, so the join
        # gets exchanges of its own, which adaptive execution can split.
        distinct.groupBy("h1", "h2", F.pmod("h1", F.lit(1024)).alias("_spread"))
        .agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper"), F.min("doc").alias("least"))
        .where((F.col("n") >= min_docs) & (F.col("least") < F.col("keeper")))
        .select("h1", "h2", "keeper")
    )
    lines = _hashed(keys.select("doc", F.posexplode("keys").alias("pos", "line")), min_chars)
    hit = lines.join(hot, ["h1", "h2"]).where(F.col("doc") < F.col("keeper"))
    return hit.groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text rid of lines that at least min_docs documents hold, but for the largest id's; plus n_lines, n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased; keys below min_chars code
    points never count. A null or empty text is one empty line and becomes an empty text. Rows with a null
    id keep all lines and count for no key. Rows that repeat an id are one document for min_docs and lose the
    same positions. An empty table gives an empty table. The columns n_lines and n_dropped of docs are
    replaced; all other columns stay.
    """
    plain = docs.drop("n_lines", "n_dropped")
    doc, dropped, lines, borders = free_names(docs.columns, "_doc", "_dropped", "_lines", "_borders")
    gone = dropped_lines(docs, min_chars, min_docs, id_col, text_col).select(F.col("doc").alias(doc), F.col("dropped").alias(dropped))
    joined = plain.join(gone, F.col(id_col) == F.col(doc), "left").drop(doc)
    out = joined.withColumn(lines, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    # What stays are the slices between neighbouring dropped positions: linear in the lines.
    out = out.withColumn(borders, F.concat(F.array(F.lit(-1)), F.col(dropped), F.array(F.size(lines))))
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size(dropped) + 1),
            lambda k: F.slice(F.col(lines), F.element_at(F.col(borders), k) + 2, F.element_at(F.col(borders), k + 1) - F.element_at(F.col(borders), k) - 1),
        )
    )
    text = F.when(F.col(dropped).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return out.withColumns(
        {
            text_col: text,
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.coalesce(F.size(dropped), F.lit(0)).cast("long"),
        }
    ).drop(lines, borders, dropped)
