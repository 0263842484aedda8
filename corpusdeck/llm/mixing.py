"""Mixing sources to target weights by capped water-filling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, free_names

#: Weights of the sources in code point order, repeating (fixed values of the contract).
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Adds target to (source, weight, source_size): weight x level, at most max_epochs x source_size, summing to all sizes.

    Sources fill up in the order of capacity over weight. With the first i of them full, the level of the
    others is what is left over their weights; the level that holds is the first that fills no further
    source. That is the end of clamping and resharing until no source is above its cap, in one pass of
    prefix sums. The table has a row per source, already aggregated, so its window is small.
    """
    cap = F.col("source_size") * max_epochs
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    filled = (
        sources.withColumns({"_cap": cap, "_ratio": cap / F.col("weight"), "_total": F.sum("source_size").over(whole), "_weights": F.sum("weight").over(whole)})
        .withColumns({"_full": F.coalesce(F.sum("_cap").over(order), F.lit(0)), "_gone": F.coalesce(F.sum("weight").over(order), F.lit(0))})
        .withColumn("_level", (F.col("_total") - F.col("_full")).cast("double") / (F.col("_weights") - F.col("_gone")).cast("double"))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct(F.col("_ratio"), F.col("_gone"), F.col("_level")))).over(whole)["_level"])
    )
    target = F.least(F.col("weight") * F.coalesce(F.col("_level"), F.lit(0.0)), F.col("_cap").cast("double"))
    return filled.withColumn("target", target).select(*sources.columns, "target")


def source_targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = 3, source_col: str = "source") -> DataFrame:
    """(source, source_size, n_docs, weight, target) of documents with a size column."""
    per = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    choice = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    return water_fill(per.withColumn("weight", choice.cast("long")), max_epochs)


def mix_sources(
    docs: DataFrame,
    weights=WEIGHTS,
    max_epochs: int = 3,
    seed: int = 17,
    bucket_docs: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """docs plus size, source_size, target, taken: how many words the mix takes of each document.

    A source is repeated target / source_size times. Every document gets the whole part of that number; the
    fractional part goes, in buckets of about bucket_docs documents, to whole documents in a seeded order
    until the bucket's share is used up, and the document at the border gives the words that are still
    missing. So the words taken of a bucket are its share, rounded. A hot source is many buckets, so none is
    more than a task's work. Order and buckets depend on id, text and seed alone: reruns agree.

    A null text has size 0. Null is a source of its own, the last one. Rows with null or repeated ids are
    dealt and ordered by their text as well; rows equal in id and text share a place in any order, which gives
    them the same multiset of results. An empty table gives an empty table. Columns size, source_size, target
    and taken of docs are replaced; all other columns stay.
    """
    plain = docs.drop("size", "source_size", "target", "taken")
    own, n_docs, whole, part, order, bucket, before, share = free_names(docs.columns, "_source", "_docs", "_whole", "_part", "_order", "_bucket", "_before", "_share")
    sized = plain.withColumn("size", word_count(F.col(text_col)))
    targets = source_targets(sized, weights, max_epochs, source_col).select(F.col("source").alias(own), "source_size", "target", F.col("n_docs").alias(n_docs))
    joined = sized.join(targets, F.col(source_col).eqNullSafe(F.col(own))).drop(own)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = joined.withColumns(
        {
            whole: F.floor(rate),
            part: rate - F.floor(rate),
            order: F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)),
        }
    ).withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), F.col(order)), F.ceil(F.col(n_docs) / bucket_docs)))
    group = Window.partitionBy(source_col, bucket)
    ahead = group.orderBy(order, id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    shared = dealt.withColumns({before: F.coalesce(F.sum("size").over(ahead), F.lit(0)), share: F.round(F.sum("size").over(group) * F.col(part)).cast("long")})
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col(share) - F.col(before)))
    out = shared.withColumn("taken", (F.col(whole) * F.col("size") + extra).cast("long"))
    return out.drop(n_docs, whole, part, order, bucket, before, share)
