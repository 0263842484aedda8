"""Incremental ingest: new contents join the corpus once, in batches or as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: Keeps state on local disk with checkpoints in the shared folder, so that it may outgrow memory.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Contents of a batch meet in 4,096 buckets, by the first digits of their keys; a task holds one bucket's different contents.
BUCKET_DIGITS = 3


def content_key(text_col: str = "text", mode: str = "") -> F.Column:
    """The first 32 digits of the content's SHA-256, with the mode appended."""
    key = F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256), 1, 32)
    return F.concat(key, F.lit(mode)) if mode else key


def first_by_content(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus content_key, the smallest id of each content only. Texts stay where they are until the winners are known."""
    keyed = docs.withColumn("content_key", content_key(text_col))
    first = keyed.groupBy("content_key").agg(F.min(id_col).alias(id_col))
    return keyed.join(first, ["content_key", id_col], "left_semi")


def new_contents(docs: DataFrame, manifest: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose content_key the manifest lacks, one per content."""
    return first_by_content(docs, id_col, text_col).join(manifest.select("content_key"), "content_key", "left_anti")


def unseen(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs of a stream plus content_key: the row with the smallest id of each content that no earlier batch had.

    Equal contents of one batch meet in their bucket of keys, of which each content's smallest id goes on (null
    ids last). Seen contents are keyed state, one small row each: a batch looks up its own keys and nothing
    else, so its work does not grow with the corpus. A restart finds the state of the last batch that was
    finished, so a batch that is run again gives what it gave before. A null text is an empty one.
    """
    keyed = docs.withColumn("content_key", content_key(text_col))
    order = [("content_key", "ascending"), (id_col, "ascending")]

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if best is None else [*best, batch])
            at = pc.sort_indices(rows.select(["content_key", id_col]), sort_keys=order, null_placement="at_end")
            keys = rows["content_key"].take(at).to_numpy()
            best = rows.take(at.filter(pa.array(np.append(True, keys[1:] != keys[:-1])))).to_batches()
        yield from best or []

    out: StructType = keyed.schema
    return keyed.groupBy(F.substring("content_key", 1, BUCKET_DIGITS)).applyInArrow(least, out).dropDuplicates(["content_key"])


def ingest_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, files_per_batch: int | None = None, provider: str = ROCKS) -> StreamingQuery:
    """Takes all files of source that were not taken before, in batches of files_per_batch, and appends unseen contents to target.

    The file sink commits a batch as a whole, so replayed batches add nothing. provider is set as the session's
    state store; a checkpoint goes on with the one it began with.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return unseen(reader.parquet(source)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_stage_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, stage, n, seconds) of a stream or table of stage events (stage, ts, seconds) by time window; late rows count until the watermark."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.window("ts", window).alias("w"), "stage").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds")).select(F.col("w.start").alias("start"), "stage", "n", "seconds")
