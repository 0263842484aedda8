"""Sources: corpora, web pages and conversations as markdown documents, and admission."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import LEAST_CHARS
from ..functions.text import squeeze
from .shared import new_path


def read_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str = "source") -> DataFrame:
    """(doc_id, source_name, markdown): a text without any heading becomes one section under its source's name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = F.concat(F.lit("## "), F.coalesce(F.col(name_col), F.lit("")), F.lit("\n\n"), text)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(name_col).alias("source_name"), F.when(text.rlike(r"(?m)^[ \t]*#{1,6}[ \t]+"), text).otherwise(whole).alias("markdown"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_name, text): each file of a folder is one document."""
    return spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_name").alias("source_name"), F.col("value").alias("text"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, text): paragraphs of each page in order, tags and entities resolved; scripts, ads and navigation are no paragraphs."""
    body = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<script>.*?</script>|<style>.*?</style>|<nav>.*?</nav>|<div class=\"ad\">.*?</div>|<!--.*?-->", " ")
    parts = F.regexp_extract_all(body, F.lit(r"(?s)<p>(.*?)(?:</p>|<br>)"), F.lit(1))
    return pages.select("page_id", F.posexplode(F.filter(F.transform(parts, _plain), lambda x: x != "")).alias("block_no", "text"))


def _plain(html):
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeeze(out)


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """(doc_id, source_name, markdown): the page's first h1 as a heading, and a line per paragraph; row-local."""
    body = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<script>.*?</script>|<style>.*?</style>|<nav>.*?</nav>|<div class=\"ad\">.*?</div>|<!--.*?-->", " ")
    title = _plain(F.regexp_extract(body, r"(?s)<h1>(.*?)</h1>", 1))
    parts = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"(?s)<p>(.*?)(?:</p>|<br>)"), F.lit(1)), _plain), lambda x: x != "")
    return pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("source_name"), F.concat(F.lit("## "), title, F.lit("\n\n"), F.array_join(parts, "\n")).alias("markdown"))


def conversations_to_markdown(turns: DataFrame) -> DataFrame:
    """(doc_id, source_name, markdown): a section per turn under its role, in the order of turns."""
    part = F.concat(F.lit("## "), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    whole = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"))
    return whole.select("doc_id", F.concat(F.lit("conversation "), F.col("doc_id").cast("string")).alias("source_name"), F.array_join(F.transform("parts", lambda x: x["part"]), "\n").alias("markdown"))


_LISTED = "path string, length long, is_folder boolean"
#: Stores whose folders tasks can list by themselves.
_OPEN = ("file", "hdfs", "viewfs", "s3", "gs", "abfs")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is in the folders of a column path, with names spelled as the folders are."""
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            store, at = FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
            found = [x for x in store.get_file_info(FileSelector(at, allow_not_found=True)) if not x.base_name.startswith(("_", "."))]
            names = [f"{folder.rstrip('/')}/{x.base_name}" for x in found]
            kinds = [x.type == FileType.Directory for x in found]
            sizes = [None if k else x.size for x, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(kinds, pa.bool_())], ["path", "length", "is_folder"])


def list_files(spark: SparkSession, path: str, folders_per_task: int = 64) -> DataFrame:
    """(path, length) of all files below path, empty ones too, which Spark's file sources leave out.

    Folders are listed by tasks, level by level: each level's findings are a table in the shared folder, whose
    folders are the next level's work, so the driver holds neither files nor folders. Names that begin with
    an underscore or a dot are left out, as by Spark. A missing or empty folder has no files.
    """
    folders, found = spark.createDataFrame([(path,)], "path string"), None
    while not folders.isEmpty():
        tasks = max(1, -(-folders.count() // folders_per_task))
        at = new_path(spark, "listing")
        folders.repartition(tasks).mapInArrow(_listed, _LISTED).write.parquet(at)
        level = spark.read.schema(_LISTED).parquet(at)
        files = level.where("not is_folder").select("path", "length")
        found = files if found is None else found.unionByName(files)
        folders = level.where("is_folder").select("path")
    return found


def admit_files(spark: SparkSession, path: str, extensions=("txt", "md", "html", "parquet"), most_bytes: int = 50 << 20) -> DataFrame:
    """(path, length, reason): files under path, nested ones too; reason is null for admitted ones, else extension, empty or too large. Contents are not read.

    Stores that tasks cannot list by themselves are listed by Spark's binary file source, which reports no empty files.
    """
    scheme = path.split(":", 1)[0] if "://" in path or path.startswith("file:") else "file"
    if scheme in _OPEN:
        files = list_files(spark, path)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reason = F.when(~extension.isin(*extensions), "extension").when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too large")
    return files.withColumn("reason", reason)


def extraction_gate(docs: DataFrame, typed_col: str | None = None) -> DataFrame:
    """Adds body_chars and accepted: whether a markdown document has LEAST_CHARS characters beside page numbers; typed ones always pass."""
    body = squeeze(F.regexp_replace(F.coalesce("markdown", F.lit("")), r"(?i)page [0-9]+", ""))
    typed = F.coalesce(F.col(typed_col), F.lit(False)) if typed_col else F.lit(False)
    return docs.withColumn("body_chars", F.length(body)).withColumn("accepted", typed | (F.col("body_chars") >= LEAST_CHARS))


def drop_placeholder_lines(docs: DataFrame) -> DataFrame:
    """docs without image placeholder lines; three or more line ends in a row become two."""
    from ..functions.text import lines, strip

    kept = F.filter(lines(F.col("markdown")), lambda x: ~strip(x).rlike(r"(?i)^!\[[^\]]*\]\([^)]*\)$|^[A-Za-z0-9_.-]+\.(png|jpe?g|gif|bmp|svg)$"))
    return docs.withColumn("markdown", F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))
