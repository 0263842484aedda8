"""Running values over long sequences, without a window over a whole sequence.

A sequence is cut into blocks of equal ranges of its order column. Each block's own value comes from an
aggregate, a window over the blocks (a row each) carries values from block to block, and a window inside
each block does the rest. Blocks are the unit of work, so one long sequence is as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_block(rows: DataFrame, order: str, size: int) -> DataFrame:
    return rows.withColumn("_block", F.floor(F.col(order) / size).cast("long"))


def _joined(rows: DataFrame, blocks: DataFrame, keys: list[str], column: str) -> DataFrame:
    """rows with column of their block; null keys are keys."""
    side = blocks.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_block").alias("_of"), column)
    same = F.col("_block") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return rows.join(side, same, "left").drop("_of", *[f"_key{i}" for i in range(len(keys))])


def _ties(rows: DataFrame, keys: list[str], order: str) -> list[Column]:
    """The order inside a block: by the order column, then by all others that can be compared."""
    others = [f.name for f in rows.schema if f.name not in (*keys, order, "_block") and f.dataType.typeName() not in ("map", "variant")]
    return [F.col(order), *[F.col(c) for c in others]]


def carried(rows: DataFrame, value: str, out: str, keys: list[str], order: str, block: int = 4096) -> DataFrame:
    """rows with value replaced by out: the last value that is not null up to each row, in each sequence of keys.

    order is a whole number, not null; rows with the same number go by their other columns.
    """
    cut = _with_block(rows, order, block)
    group = [*keys, "_block"]
    last = F.max(F.when(F.col(value).isNotNull(), F.struct(*_ties(cut, keys, order)))).alias("_last")
    ends = cut.groupBy(*group).agg(last).select(*group, F.col(f"_last.{value}").alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(before))
    inside = Window.partitionBy(*group).orderBy(*_ties(cut, keys, order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = _joined(cut, ends, keys, "_before")
    return joined.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_before")).drop(value, "_before", "_block")


def summed(rows: DataFrame, value: str, out: str, keys: list[str], order: str, block: int = 4096) -> DataFrame:
    """rows plus out: the sum of value over the rows before each row, in each sequence of keys; see carried for order."""
    cut = _with_block(rows, order, block)
    group = [*keys, "_block"]
    totals = cut.groupBy(*group).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    inside = Window.partitionBy(*group).orderBy(*_ties(cut, keys, order)).rowsBetween(Window.unboundedPreceding, -1)
    joined = _joined(cut, totals, keys, "_before")
    return joined.withColumn(out, (F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")).drop("_before", "_block")
