"""Benchmark decontamination by pigeonhole edit matching.

A test item of n words may differ from a passage in at most e words. Cut into e + 1 pieces, at least one
piece is then unchanged, so exact piece hits find every passage; Myers' bit-parallel distance over words
verifies the surroundings of each hit. Documents are only scanned, never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import NOT_ALNUM_BYTES, U64, chunks, grams, inside, words_of

#: Share of an item's words that may be inserted, deleted or replaced.
ERROR_SHARE = 0.2
#: Bound on the characters of items in one broadcast; more items are taken in several scans.
MAX_ITEM_CHARS = 32_000_000
_BITS = 20


def _words(column: pa.Array):
    return words_of(pc.utf8_lower(column.fill_null("") if column.null_count else column), NOT_ALNUM_BYTES)


def best_match(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(distance, end): the least edit distance of pattern to any stretch of text, and that stretch's first end."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[int, int] = defaultdict(int)
    for i, x in enumerate(pattern):
        at[x] |= 1 << i
    plus, minus, score, best = full, 0, m, (m, 0)
    for j, x in enumerate(text):
        equal = at.get(x, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = (minus | ~(horizontal | plus)) & full
        down = plus & horizontal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical
        if score < best[0]:
            best = (score, j + 1)
    return best


class Pieces:
    """Items as word hashes, and their pieces by length and hash."""

    def __init__(self, ids: list[int], texts: list[str], error_share: float):
        words = _words(pa.array(texts, pa.string()))
        self.ids, self.items, self.budget = [], [], []
        by_length: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for i, item_id in enumerate(ids):
            item = words.hash[words.first[i] : words.first[i + 1]]
            if not len(item):
                continue
            errors = int(error_share * len(item))
            borders = [len(item) * j // (errors + 1) for j in range(errors + 2)]
            for a, b in zip(borders, borders[1:], strict=False):
                by_length[b - a][int(grams(item[a:b], b - a)[0])].append((len(self.items), a))
            self.ids.append(item_id)
            self.items.append(item.tolist())
            self.budget.append(errors)
        self.tables = []
        for length, pieces in sorted(by_length.items()):
            known = np.array(sorted(pieces), U64)
            maybe = np.zeros(1 << _BITS, bool)
            maybe[(known >> U64(64 - _BITS)).astype(np.int64)] = True
            self.tables.append((length, known, maybe, [pieces[int(x)] for x in known]))

    def hits(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, distance, end word) of every row and item within the item's budget."""
        words = _words(column)
        doc, found = words.doc(), defaultdict(set)
        for length, known, maybe, places in self.tables:
            at = inside(words.first, length)
            if not len(at):
                continue
            value = grams(words.hash, length)[at]
            some = maybe[(value >> U64(64 - _BITS)).astype(np.int64)]
            value, at = value[some], at[some]
            slot = np.minimum(np.searchsorted(known, value), len(known) - 1)
            same = known[slot] == value
            for s, p in zip(slot[same].tolist(), at[same].tolist(), strict=True):
                for item, offset in places[s]:
                    found[int(doc[p]), item].add(p - offset)
        for (row, item), begins in found.items():
            errors, n = self.budget[item], len(self.items[item])
            low, high = int(words.first[row]), int(words.first[row + 1])
            spans: list[list[int]] = []
            for begin in sorted(begins):
                a, b = max(low, begin - errors), min(high, begin + n + errors)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            best = min((*best_match(self.items[item], words.hash[a:b].tolist()), a) for a, b in spans)
            if best[0] <= errors:
                yield row, item, best[0], best[2] + best[1] - low


def _indexes(items: DataFrame, error_share: float, id_col: str, text_col: str) -> Iterator[Pieces]:
    """One index per bounded share of the items; usually one in all."""
    plain = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    chars = plain.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shares = max(1, -(-chars // MAX_ITEM_CHARS))
    for share in range(shares):
        rows = plain.where(F.pmod(F.xxhash64("id", "text"), F.lit(shares)) == share).orderBy("id", "text").collect()
        yield Pieces([r["id"] for r in rows], [r["text"] for r in rows], error_share)


def benchmark_hits(
    docs: DataFrame, items: DataFrame, error_share: float = ERROR_SHARE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, distance, item_words, end_word): items that a document holds within their error budget.

    Words are runs of letters and digits (every non-ASCII character counts as a letter), lower-cased. An item
    of n words has a budget of floor(error_share * n) word edits. One row per document and item gives the
    least distance and the position after the first passage that has it. Null or empty texts hold nothing,
    items without words are left out, an item without an id is reported with a null one, null document ids pass through, repeated documents or items
    give repeated rows. Empty tables give an empty table; other columns play no part.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for pieces in _indexes(items, error_share, item_id, item_text):
        shared = spark.sparkContext.broadcast(pieces)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in chunks(batches, "text"):
                found = list(index.hits(batch.column(1)))
                if found:
                    row, item, distance, end = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(row)),
                            pa.array([index.ids[i] for i in item], pa.int64()),
                            pa.array(distance, pa.int32()),
                            pa.array([len(index.items[i]) for i in item], pa.int32()),
                            pa.array(end, pa.int64()),
                        ],
                        ["doc_id", "item_id", "distance", "item_words", "end_word"],
                    )

        part = plain.mapInArrow(scan, "doc_id long, item_id long, distance int, item_words int, end_word long")
        out = part if out is None else out.unionAll(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, error_share: float = ERROR_SHARE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item (see benchmark_hits); the columns stay as they are."""
    spark, place = docs.sparkSession, docs.columns.index(text_col)
    for pieces in _indexes(items, error_share, item_id, item_text):
        shared = spark.sparkContext.broadcast(pieces)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, text_col):
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in shared.value.hits(batch.column(place))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
