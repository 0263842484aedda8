"""WARC archives: writing pages as request, response or revisit, and metadata records, and reading captures back.

Spark's text sink writes the records (a record ends in CR LF CR LF, whose last LF is the sink's line end),
so archives land in any file system that Spark reaches. Reading goes by Content-Length, and a capture's
records are joined through WARC-Concurrent-To.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

#: Payloads below this many bytes are always stored whole.
MIN_REVISIT_BYTES = 100
#: Records per archive file.
FILE_RECORDS = 3000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(kind: str, key: Column) -> Column:
    """A record id that depends on the capture's key alone."""
    hexes = F.md5(F.concat(F.lit(kind + ":"), key).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One WARC record without its last LF; fields whose value is null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return plain.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "size": F.octet_length("html").cast("long")})


def revisits(keyed: DataFrame) -> DataFrame:
    """(page_id, digest, first): pages whose payload a smaller page id has too.

    Only ids and digests are shuffled. The grouping column _spread keeps the aggregate's partitioning apart
    from the join's, so the join has exchanges of its own and adaptive execution can split a digest that a
    third of all pages share.
    """
    ids = keyed.where((F.col("size") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = ids.groupBy("digest", F.substring("digest", 1, 2).alias("_spread")).agg(F.min("page_id").alias("first"), F.max("page_id").alias("_last"))
    several = first.where(F.col("first") < F.col("_last")).select("digest", "first")
    return ids.join(several, "digest").where(F.col("page_id") > F.col("first")).distinct()


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes three records per page to gzipped archives under path.

    The payload is the html in UTF-8; null counts as empty. Of equal payloads of at least MIN_REVISIT_BYTES
    the page with the smallest id is a response and the others are revisits of it; pages without an id are
    responses. A null url is about:blank in headers and stays null in the metadata record.
    """
    keyed = _keyed(pages, id_col, url_col, html_col)
    again = revisits(keyed).withColumnsRenamed({"page_id": "_id", "digest": "_digest"})
    rows = keyed.join(again, (F.col("page_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")

    def key(page_id: Column) -> Column:
        return F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("-")), F.col("digest"))

    own = F.concat_ws("/", key(F.col("page_id")), F.coalesce(F.md5(F.col("url").cast("binary")), F.lit("-")))
    first, main = F.col("first"), _urn("response", own)
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("about:blank"))
    host = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    target = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    refers = F.when(first.isNotNull(), _urn("capture", key(first)))
    response = _record(
        F.when(first.isNull(), F.lit("response")).otherwise(F.lit("revisit")),
        [
            ("WARC-Record-ID", main),
            *common,
            digest,
            ("WARC-Profile", F.when(first.isNotNull(), F.lit(_PROFILE))),
            ("WARC-Refers-To", refers),
            ("X-WARC-Capture-ID", _urn("capture", key(F.col("page_id")))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(http, F.when(first.isNull(), F.col("html")).otherwise("")),
    )
    request = _record(
        F.lit("request"),
        [("WARC-Record-ID", _urn("request", own)), *common, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")),
    )
    metadata = _record(
        F.lit("metadata"),
        [("WARC-Record-ID", _urn("metadata", own)), *common, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/json"))],
        F.to_json(F.struct("page_id", "url")),
    )
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, headers by lower-cased name; a broken tail ends the reading with an error."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record is cut off")
        yield headers, block


_KINDS = {
    "record_id": pa.string(), "type": pa.string(), "target_uri": pa.string(), "capture_id": pa.string(), "concurrent_to": pa.string(), "refers_to": pa.string(),
    "payload_bytes": pa.int64(), "payload_digest": pa.string(), "page_id": pa.int64(), "url": pa.string(), "head": pa.string(), "payload": pa.binary(),
}
_SCHEMA = "record_id string, type string, target_uri string, capture_id string, concurrent_to string, refers_to string, payload_bytes long, payload_digest string, page_id long, url string, head string, payload binary"


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind = headers["warc-type"]
    head, payload, size, digest, page_id, url = None, None, None, None, None, None
    if kind in ("response", "revisit", "request"):
        head, _, payload = block.partition(b"\r\n\r\n")
        size, digest = len(payload), None
        if kind == "response":
            digest = hashlib.sha256(payload).hexdigest()
        elif kind == "revisit":
            # The payload is elsewhere; its size and digest are on record.
            lengths = [line.partition(b":")[2] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
            size, digest = int(lengths[0]), headers["warc-payload-digest"].rpartition(":")[2]
    elif kind == "metadata":
        known = json.loads(block)
        page_id, url = known.get("page_id"), known.get("url")
    return (
        headers["warc-record-id"], kind, headers.get("warc-target-uri"), headers.get("x-warc-capture-id"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
        size, digest, page_id, url, head.decode() if head is not None else None, payload if payloads and kind == "response" else None,
    )


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under path; payloads: with the bytes of responses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parse_warc(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    rows.append(_row(headers, block, payloads))
                    size += len(block) if payloads else 500
                    if size > 1 << 23:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)], list(_KINDS))


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, url, response, request, metadata_id, refers_to.

    Requests and metadata join the record that they are concurrent to; the key is unique to a capture, so no
    group is large. A capture without a request or metadata record has nulls there. refers_to is the page id
    of the response that a revisit points to, null if the archives lack it.
    """
    group = F.coalesce("concurrent_to", "record_id")
    main = F.col("type").isin("response", "revisit")
    response = F.struct("record_id", "type", "target_uri", "payload_bytes", "payload_digest", "head", "payload")
    request = F.struct("record_id", "head")
    joined = records.groupBy(group.alias("capture"), F.substring(group, 11, 2).alias("_spread")).agg(
        F.max(F.when(F.col("type") == "metadata", F.struct("page_id", "url", "record_id"))).alias("m"),
        F.max(F.when(main, response)).alias("response"),
        F.max(F.when(F.col("type") == "request", request)).alias("request"),
        F.max(F.when(main, F.col("capture_id"))).alias("capture_id"),
        F.max(F.when(main, F.col("refers_to"))).alias("refers"),
    )
    whole = joined.where("response is not null")
    # Which page a revisit refers to.
    pages = whole.where("response.type = 'response'").select(F.col("capture_id").alias("refers"), F.col("m.page_id").alias("refers_to"))
    pages = pages.groupBy("refers", F.substring("refers", 11, 2).alias("_s")).agg(F.min("refers_to").alias("refers_to")).drop("_s")
    out = whole.join(pages, "refers", "left")
    return out.select(F.col("m.page_id").alias("page_id"), F.col("m.url").alias("url"), "response", "request", F.col("m.record_id").alias("metadata_id"), "refers_to")


def archive_round_trip(pages: DataFrame, path: str | None = None, payloads: bool = True, **columns) -> DataFrame:
    """Writes pages to path (a new folder beside the checkpoints if none is given) and reads their captures back.

    Rows that repeat id, url and html are one capture; rows that share an id but differ are captures each. An
    empty table gives an empty table. Columns of pages other than the three named ones play no part.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, **columns)
    return captures(read_warc(spark, path, payloads))
