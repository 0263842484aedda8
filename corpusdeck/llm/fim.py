"""Fill-in-middle transformation by secondary-sort assembly.

Each text is cut into units (a word with the white space before it, or trailing white space) and, at two
places drawn from a hash of its id, into prefix, middle and suffix. Map tasks emit chunks of whole units as
pieces keyed by document and output position. One exchange by document with a sort by position inside its
partitions (repartitionAndSortWithinPartitions, in its DataFrame form) brings each document's pieces in the
order of the output, and a streaming pass feeds them to an incremental digest. For the way back the same
pass reads the segments off the markers in the output, and a second sort inside the partitions, without
another exchange, streams the pieces in the original order. No task holds a whole document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import WHITE_BYTES, chunks, text_bytes, words_of

#: Markers before prefix, suffix and middle (fixed values of the contract).
MARKERS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
#: Order of the segments in the output of each form (fixed values of the contract).
ORDERS = {"psm": "PSM", "spm": "SPM"}
#: Bytes of a piece, about; a longer unit is cut between code points.
PIECE_BYTES = 16 << 10
_PLACE = {"P": 0, "M": 1, "S": 2}
_KEY = ["doc_id", "k1", "k2"]
_FACTS = "form string, n long, prefix_chars long, middle_chars long"
_PIECE = f"doc_id long, k1 long, k2 long, seat int, {_FACTS}, chunk binary"


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits from the document's id; a missing id is the empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12)]


def _cuts(raw: bytes, ends: np.ndarray, low: int, high: int) -> list[bytes]:
    """raw[low:high] in chunks that end with a unit (ends: all units' ends) or, in long units, with a code point."""
    out = []
    while low < high:
        to = low + PIECE_BYTES
        if to >= high:
            to = high
        else:
            unit = int(np.searchsorted(ends, to, "right")) - 1
            if unit >= 0 and ends[unit] > low:
                to = int(ends[unit])
            else:
                while raw[to] & 0xC0 == 0x80:
                    to -= 1
        out.append(raw[low:to])
        low = to
    return out


def _pieces_of(doc_id: int | None, raw: bytes, ends: np.ndarray, seed: int, share: int, spm_share: int) -> Iterator[tuple]:
    """Rows (form, n, prefix_chars, middle_chars, seat, chunk) of one text."""
    n = len(ends)
    h = draws(doc_id, seed)
    if not raw or any(m in raw for m in MARKERS.values()) or h[2] % 100 >= share:
        form, prefix, middle, segments = "plain", None, None, [("", 0, len(raw))]
    else:
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b = (int(ends[x - 1]) if x else 0 for x in (a, b))
        form = "spm" if h[3] % 100 < spm_share else "psm"
        bound = {"P": (0, a), "M": (a, b), "S": (b, len(raw))}
        prefix, middle = (len(raw[x:y].decode()) for x, y in (bound["P"], bound["M"]))
        segments = [(x, *bound[x]) for x in ORDERS[form]]
    seat = 0
    for name, low, high in segments:
        parts = _cuts(raw, ends, low, high) or [b""]
        parts[0] = MARKERS.get(name, b"") + parts[0]
        for part in parts:
            yield form, n, prefix, middle, seat, part
            seat += 1


def fim_pieces(docs: DataFrame, seed: int = 42, share: int = 50, spm_share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, seat, form, n, prefix_chars, middle_chars, chunk): the outputs in pieces.

    All pieces of a document are in one partition and follow each other by seat; concatenated, their chunks
    are the output in UTF-8. k1 and k2 are a hash of the text, so different texts under one id, or without an
    id, are documents of their own. Rows equal in id and text give each piece once per row.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            words = words_of(batch.column(1))
            data, at = text_bytes(batch.column(1))
            rows = []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                low, high = int(at[i]), int(at[i + 1])
                ends = words.end[words.first[i] : words.first[i + 1]] - low
                if high > low and WHITE_BYTES[data[high - 1]]:
                    ends = np.append(ends, high - low)
                raw = data[low:high].tobytes()
                key = np.frombuffer(hashlib.sha256(raw).digest()[:16], np.int64).tolist()
                rows += [(doc_id, *key, seat, *facts, part) for *facts, seat, part in _pieces_of(doc_id, raw, ends, seed, share, spm_share)]
            yield _batch(rows, _PIECE)

    return plain.mapInArrow(emit, _PIECE).repartition(*_KEY).sortWithinPartitions(*_KEY, "seat")


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _grouped(batches: Iterator[pa.RecordBatch], own, schema: str) -> Iterator[pa.RecordBatch]:
    """Streams rows that are sorted by _KEY through own(key), a generator that is sent each further row of the
    key and at last None, and yields lists of output rows."""
    key = group = None
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != key:
                if group is not None:
                    rows += group.send(None)
                key, group = row[:3], own(row[:3])
                next(group)
            new = group.send(row[3:])
            rows += new
            size += sum(len(x[-1] or b"") for x in new)
            if len(rows) >= 4096 or size > 4 << 20:
                yield _batch(rows, schema)
                rows, size = [], 0
    if group is not None:
        rows += group.send(None)
    if rows:
        yield _batch(rows, schema)


_SORTED = f"doc_id long, k1 long, k2 long, place int, seat int, {_FACTS}, copies long, output_sha256 string, chunk binary"
_DIGEST = f"doc_id long, {_FACTS}, output_sha256 string, restored_sha256 string"
_OPENED = {m: name for name, m in MARKERS.items()}


def _digest_output(key: tuple):
    """Takes pieces in output order; gives the same pieces without markers, with their segment's place in the original,
    and a last row with the output's digest."""
    digest, copies, last, place, facts, out = hashlib.sha256(), 0, -1, 0, None, []
    while (row := (yield out)) is not None:
        seat, form, n, prefix, middle, chunk = row
        out = []
        copies += seat == 0
        if seat == last:  # The same piece of an equal row.
            continue
        last, facts = seat, (form, n, prefix, middle)
        digest.update(chunk)
        if form != "plain" and (name := _OPENED.get(chunk[:3])):
            place, chunk = _PLACE[name], chunk[3:]
        out.append((*key, place, seat, None, None, None, None, None, None, chunk))
    yield [(*key, 3, 0, *facts, copies, digest.hexdigest(), None)]


def _digest_restored(key: tuple):
    """Takes pieces in the original's order, then the row with the output's digest; gives a row per copy."""
    digest, out = hashlib.sha256(), []
    while (row := (yield out)) is not None:
        place, _, *facts, copies, output, chunk = row
        out = []
        if place == 3:
            out = [(key[0], *facts, output, digest.hexdigest())] * copies
        else:
            digest.update(chunk)
    yield []


def fim_digests(pieces: DataFrame) -> DataFrame:
    """(doc_id, form, n, prefix_chars, middle_chars, output_sha256, restored_sha256) of fim_pieces' rows, one per document.

    The restored digest is that of the text rebuilt from the output and its form: segments are told by the
    markers in the output. A null or empty text has form plain, no units and two digests of nothing; a null id
    draws as the empty string. Repeated rows give repeated rows. An empty table gives an empty table.
    """
    out = pieces.mapInArrow(lambda b: _grouped(b, _digest_output, _SORTED), _SORTED)
    return out.sortWithinPartitions(*_KEY, "place", "seat").mapInArrow(lambda b: _grouped(b, _digest_restored, _DIGEST), _DIGEST)


_TEXT = f"doc_id long, {_FACTS}, text string"


def _join(key: tuple):
    parts, copies, last, facts, out = [], 0, -1, None, []
    while (row := (yield out)) is not None:
        seat, *facts, chunk = row
        copies += seat == 0
        if seat != last:
            parts.append(chunk)
        last = seat
    yield [(key[0], *facts, b"".join(parts).decode())] * copies


def fill_in_middle(docs: DataFrame, seed: int = 42, share: int = 50, spm_share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, form, n, prefix_chars, middle_chars, text): each document's output as a text; see fim_pieces.

    share percent of the documents are cut, spm_share percent of those suffix first. Texts that are empty or
    hold a marker stay plain. Other columns of docs play no part.
    """
    pieces = fim_pieces(docs, seed, share, spm_share, id_col, text_col)
    return pieces.mapInArrow(lambda b: _grouped(b, _join, _TEXT), _TEXT)


def restored(text: Column, form: Column) -> Column:
    """The original of an output of fill_in_middle."""
    first = {"psm": (r"(?s)^<P>(.*)<S>(.*)<M>(.*)$", (1, 3, 2)), "spm": (r"(?s)^<S>(.*)<P>(.*)<M>(.*)$", (2, 3, 1))}
    out = text
    for name, (pattern, order) in first.items():
        out = F.when(form == name, F.concat(*[F.regexp_extract(text, pattern, i) for i in order])).otherwise(out)
    return out
