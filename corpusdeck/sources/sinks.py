"""Stored decks: a log of saves and deletions, a compacted base beside it, and what is read from both."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import folders, remove, rename

#: Ids that may name a folder (fixed value).
SAFE_ID = r"^[A-Za-z0-9_\-]{1,128}$"
_KEY = ["user_id", "deck_id"]


def _version(version: int | None) -> int:
    return time.time_ns() // 1000 if version is None else version


def _append(rows: DataFrame, path: str, op: str, version: int | None) -> None:
    safe = rows.where(F.col("user_id").rlike(SAFE_ID) & F.col("deck_id").rlike(SAFE_ID))
    marked = safe.select(*rows.columns, F.lit(op).alias("_op"), F.lit(_version(version)).cast("long").alias("_version"), _shelf(F.col("user_id")).alias("_shelf"))
    marked.write.partitionBy("_shelf").mode("append").parquet(f"{path}/log")


def _shelf(user_id: Column) -> Column:
    """The name of a user's folder, which is never taken for a number."""
    return F.concat(F.lit("u-"), user_id)


def save_decks(decks: DataFrame, path: str, version: int | None = None) -> None:
    """Appends decks (user_id, deck_id, ...) with safe ids to the log under path, a folder per user. A deck saved again replaces its older state.

    version orders saves and deletions; it is the time in microseconds unless given. A job that is run again
    with its version changes nothing.
    """
    _append(decks, path, "save", version)


def delete_decks(keys: DataFrame, path: str, version: int | None = None) -> None:
    """Appends a tombstone for each (user_id, deck_id). Nothing is read or rewritten, whatever the store's size."""
    _append(keys.select(*_KEY), path, "delete", version)


def _base(spark: SparkSession, path: str) -> int | None:
    """The version up to which the newest complete base goes."""
    found = [int(name[5:]) for name in folders(spark, f"{path}/base") if name.startswith("upto=")]
    return max(found, default=None)


def _state(spark: SparkSession, path: str, user_id: str | None = None, upto: int | None = None) -> DataFrame:
    """The last row per deck, deletions included: the newest base and the log's later rows (up to a version)."""
    base, rows = _base(spark, path), spark.read.option("mergeSchema", "true").parquet(f"{path}/log")
    if upto is not None:
        rows = rows.where(F.col("_version") <= upto)
    if base is not None:
        rows = spark.read.parquet(f"{path}/base/upto={base}").unionByName(rows.where(F.col("_version") > base), allowMissingColumns=True)
    if user_id is not None:
        rows = rows.where(F.col("_shelf") == _shelf(F.lit(user_id)))
    # A deletion goes before a save of the same version; of several rows of one save the largest counts.
    content = F.to_json(F.struct(*sorted(set(rows.columns) - {*_KEY, "_op", "_version", "_shelf"}), F.lit(0).alias("_")))
    last = Window.partitionBy(*_KEY).orderBy(F.desc("_version"), F.when(F.col("_op") == "delete", 1).otherwise(0), F.desc(content))
    return rows.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")


def live_decks(spark: SparkSession, path: str, user_id: str | None = None) -> DataFrame:
    """The decks under path that were not deleted after they were last saved. With a user, only that user's folders are read."""
    return _state(spark, path, user_id).where("_op = 'save'").drop("_op", "_version", "_shelf")


def delete_deck(spark: SparkSession, path: str, user_id: str, deck_id: str, version: int | None = None) -> bool:
    """Deletes one deck; False if it was not there. Only the user's folder is read."""
    if live_decks(spark, path, user_id).where(F.col("deck_id") == deck_id).isEmpty():
        return False
    delete_decks(spark.createDataFrame([(user_id, deck_id)], "user_id string, deck_id string"), path, version)
    return True


def compact(spark: SparkSession, path: str, settle_seconds: int = 3600) -> int | None:
    """Writes the live decks as a new base beside the one in use, then makes it current by renaming its folder; returns its version.

    Readers and writers go on meanwhile: a base stands for the log up to its version only, and the log is not
    touched. Versions of the last settle_seconds stay in the log, so a job has that long to commit what it
    began. A failure before the rename leaves a folder that nobody reads; vacuum removes it. The rename is one
    step on HDFS and local disks; on object stores it copies, and a base must not be read until it is done.
    """
    settled = F.col("_version") <= _version(None) - settle_seconds * 1_000_000
    upto = spark.read.parquet(f"{path}/log").where(settled).agg(F.max("_version")).first()[0]
    if upto is None or upto == _base(spark, path):
        return upto
    draft = f"{path}/base/draft-{uuid.uuid4().hex}"
    _state(spark, path, upto=upto).where("_op = 'save'").write.partitionBy("_shelf").parquet(draft)
    rename(spark, draft, f"{path}/base/upto={upto}")
    return upto


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes bases that a newer one has replaced and drafts that never became one; returns how many. No reader may be at work on them."""
    current = _base(spark, path)
    old = [name for name in folders(spark, f"{path}/base") if name != f"upto={current}"]
    for name in old:
        remove(spark, f"{path}/base/{name}")
    return len(old)


def list_decks(decks: DataFrame, user_id: str | None = None) -> DataFrame:
    """decks plus rank: each user's decks, newest first; ties by id."""
    own = decks if user_id is None else decks.where(F.col("user_id") == user_id)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("deck_id"))))


def get_deck(decks: DataFrame, user_id: str, deck_id: str) -> DataFrame:
    return decks.where((F.col("user_id") == user_id) & (F.col("deck_id") == deck_id))


#: Text fields of a slide that are null unless it has them (fixed values).
OPTIONAL = ["mermaid_code", "table_headers", "table_rows", "metric_value", "metric_label", "metric_desc", "question", "options", "correct"]


def deck_payload(slides: DataFrame) -> DataFrame:
    """(doc_id, slide_ix, payload): each slide as a JSON object of 18 fields, with defaults for those that are missing or null.

    index is slide_ix, the title without one its number from 1, and has_image tells whether there is an
    image; source_text is the text that the slide was made of. Fields without a default are null in the object. A column
    that slides lack counts as null.
    """

    def own(column: str, kind: str = "string") -> Column:
        return F.col(column) if column in slides.columns else F.lit(None).cast(kind)

    number = F.concat(F.lit("Slide "), (F.col("slide_ix") + 1).cast("string"))
    fields = {
        "index": F.col("slide_ix"),
        "layout_type": F.upper(F.coalesce(own("layout_type"), F.lit("MINIMAL_TEXT"))),
        "title": F.coalesce(own("title"), number),
        "bullets": F.coalesce(own("bullets", "array<string>"), F.array().cast("array<string>")),
        "takeaway": F.coalesce(own("takeaway"), F.lit("")),
        **{c: own(c) for c in OPTIONAL},
        "visual_source": F.coalesce(own("visual_source"), F.lit("router")),
        "continued": F.coalesce(own("continued", "boolean"), F.lit(False)),
        "has_image": own("image").isNotNull(),
        "source_text": F.coalesce(own("text"), F.lit("")),
    }
    whole = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})
    return slides.select("doc_id", "slide_ix", whole.alias("payload"))


def parse_replies(replies: DataFrame) -> DataFrame:
    """(doc_id, unit_id, json, layout_type, answer) of stored model replies.

    The reply as it is, else without code fences, else from its first to its last brace; null if none of
    these is a JSON object. Unknown layouts are MINIMAL_TEXT; an answer is the first of A to D, else A.
    """
    raw = F.trim("raw")
    fenced = F.trim(F.regexp_replace(raw, r"^```[a-zA-Z]*\s*|\s*```$", ""))
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    json = F.coalesce(*[F.when(F.json_object_keys(x).isNotNull(), x) for x in (raw, fenced, braces)])
    layout = F.upper(F.get_json_object(json, "$.layout_type"))
    known = F.when(layout.isin("FLOWCHART", "TABLE", "METRIC", "CARD_GRID", "MINIMAL_TEXT"), layout).otherwise("MINIMAL_TEXT")
    answer = F.regexp_extract(F.upper(F.coalesce(F.get_json_object(json, "$.correct"), F.lit(""))), "[A-D]", 0)
    return replies.select("doc_id", "unit_id", json.alias("json"), F.when(json.isNotNull(), known).alias("layout_type"), F.when(answer == "", "A").otherwise(answer).alias("answer"))
