"""Exact top-k search by inner product on a bit-sliced index.

Rows are dealt into blocks of bounded size, and each block keeps one bitmap per attribute and bit of its
coarsened values. The queries, a small part of the rows, are sent to the blocks and stream through them in
batches, so a row is shuffled a fixed number of times, an index is built once, and a task holds one block.
For a query the slices are added up, weighted, with carry-save bitmap arithmetic, into the slices of a
coarse score; the top rows are then selected from its most significant slice downward. Coarse scores have
a known error, so rows within it of the k-th are the boundary, and their exact scores decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits that a block's attributes and a query's weights are coarsened to.
ATTRIBUTE_BITS, QUERY_BITS = 6, 6
#: Most rows of a block on average; and as few as blocks may have where that gives all cores work.
BLOCK_ROWS, LEAST_ROWS = 1 << 16, 1 << 11
#: Products below this are exact in double precision.
_EXACT = 1 << 53


def _coarse(value: np.ndarray, bits: int) -> int:
    """How many low bits to drop so that non-negative values fit into bits."""
    return max(0, int(value.max(initial=0)).bit_length() - bits)


def _add_up(waiting: list[list[np.ndarray]]) -> None:
    """Carry-save addition until each place has two arrays at most: three of a place become one there and one in the next."""
    place = 0
    while place < len(waiting):
        row = waiting[place]
        while len(row) >= 3:
            a, b, c = row.pop(), row.pop(), row.pop()
            x = a ^ b
            if place + 1 == len(waiting):
                waiting.append([])
            waiting[place + 1].append((a & b) | (x & c))
            row.append(x ^ c)
        place += 1


def _digits(stacks: list[list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Bitmaps of the binary digits of a sum of stacks of slices, listed by the place of their lowest slice."""
    _add_up(stacks)
    single: list[list[np.ndarray]] = [[] for _ in range(len(stacks) + ATTRIBUTE_BITS)]
    for place, row in enumerate(stacks):
        for stack in row:
            for b in range(ATTRIBUTE_BITS):
                single[place + b].append(stack[b])
    _add_up(single)
    out, carry, place = [], None, 0
    while place < len(single) or carry is not None:
        row = (single[place] if place < len(single) else []) + ([carry] if carry is not None else [])
        carry = None
        if len(row) == 3:
            a, b, c = row
            x = a ^ b
            row, carry = [x ^ c], (a & b) | (x & c)
        elif len(row) == 2:
            a, b = row
            row, carry = [a ^ b], a & b
        out.append(row[0] if row else np.zeros(words, np.uint64))
        if carry is not None and not carry.any():
            carry = None
        place += 1
    return out


def _signed_digits(n: int) -> list[tuple[int, int]]:
    """(place, 1 or -1): n as a sum of few signed powers of two."""
    out, place = [], 0
    while n:
        if n & 1:
            digit = 2 - (n & 3)
            out.append((place, digit))
            n -= digit
        n >>= 1
        place += 1
    return out


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


class BitSlicedIndex:
    """The different rows of one block, and how many copies each stands for."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, copies: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.copies = np.ones(len(ids), np.int64) if copies is None else copies[order]
        rows, self.dims = self.values.shape
        self.words = -(-rows // 64)
        self.low = self.values.min(axis=0)
        above = self.values - self.low
        self.drop = _coarse(above, ATTRIBUTE_BITS)
        coarse = above >> self.drop
        # The rest of a value lies between 0 and this.
        self.rest = (above - (coarse << self.drop)).max(axis=0, initial=0)
        self.stack = [np.stack([self._bitmap((coarse[:, d] >> b) & 1) for b in range(ATTRIBUTE_BITS)]) for d in range(self.dims)]
        self.real = self._bitmap(np.ones(rows, np.int64))
        self.reach = np.abs(self.values).max(initial=0)

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 64, np.uint8)
        out[: len(bits)] = bits
        return np.packbits(out, bitorder="little").view(np.uint64)

    def _boundary(self, query: np.ndarray, k: int) -> np.ndarray:
        """Places of all rows that may be among the k best: everything within the coarse score's error."""
        weight = np.abs(query)
        drop = _coarse(weight, QUERY_BITS)
        # Nearest coarse weights; what they miss enters the error.
        coarse = (weight + (1 << drop >> 1)) >> drop
        stacks: list[list[np.ndarray]] = [[] for _ in range(QUERY_BITS + 2)]
        for d in np.flatnonzero(coarse):
            for place, digit in _signed_digits(int(coarse[d])):
                # A negative weight adds the complement, which shifts all scores alike.
                stacks[place].append(self.stack[d] ^ self.real if digit * query[d] < 0 else self.stack[d])
        digits = _digits(stacks, self.words)
        # Exact score = coarse score << (drop + self.drop), plus what was left out, between these two.
        top = (self.values.max(axis=0) - self.low) >> self.drop << self.drop
        missed = query - np.sign(query) * (coarse << drop)
        kept = np.sign(query) * (coarse << drop)
        least = np.minimum(kept * self.rest, 0).sum() + np.minimum(missed * (top + self.rest), 0).sum()
        most = np.maximum(kept * self.rest, 0).sum() + np.maximum(missed * (top + self.rest), 0).sum()
        error = int(-((least - most) // (1 << (drop + self.drop)))) + 1
        # The k-th largest coarse score, from the most significant slice downward.
        alive, kth = self.real, 0
        need = min(k, len(self.ids))
        for place in range(len(digits) - 1, -1, -1):
            ones = alive & digits[place]
            n = _count(ones)
            if n >= need:
                alive, kth = ones, kth | 1 << place
            else:
                need -= n
                alive = alive & ~digits[place]
        # Rows whose coarse score is at least kth - error, compared slice by slice.
        bound = max(0, kth - error)
        equal, above = self.real, np.zeros(self.words, np.uint64)
        for place in range(len(digits) - 1, -1, -1):
            if bound >> place & 1:
                equal = equal & digits[place]
            else:
                above = above | (equal & digits[place])
                equal = equal & ~digits[place]
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little")[: len(self.ids)])

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows other than the query's own, ties to smaller ids."""
        own = int((self.ids == query_id).sum())
        near = self._boundary(query, k + own) if len(self.ids) > 4 * (k + own) else np.arange(len(self.ids))
        near = near[self.ids[near] != query_id]
        bound = int(self.reach) * int(np.abs(query).max(initial=0)) * self.dims
        if bound < _EXACT:
            score = (self.values[near].astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
        else:
            score = self.values[near] @ query
        best = np.lexsort((self.ids[near], -score))[:k]
        best = np.repeat(best, self.copies[near][best])[:k]
        return self.ids[near][best], score[best]


def _lengths(table: pa.Table) -> np.ndarray:
    return np.diff(np.asarray(table.column("v").combine_chunks().offsets))


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    """Integer vectors of dims components: shorter ones are filled up with zeros, longer ones cut."""
    length = _lengths(table)
    flat = np.asarray(table.column("v").combine_chunks().flatten(), np.int64)
    row = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    out, fits = np.zeros((len(length), dims), np.int64), place < dims
    out[row[fits], place[fits]] = flat[fits]
    return out


def _index(parts: list[pa.RecordBatch]) -> BitSlicedIndex:
    rows = pa.Table.from_batches(parts).combine_chunks()
    return BitSlicedIndex(np.asarray(rows.column("id"), np.int64), _matrix(rows, int(_lengths(rows).max(initial=0))), np.asarray(rows.column("copies"), np.int64))


def _search(k: int):
    """(block, is_query, id, v, copies), a block's rows before the queries sent to it, to (query_id, vec_id, score)."""

    def answers(index: BitSlicedIndex, asked: pa.RecordBatch) -> pa.RecordBatch:
        table = pa.Table.from_batches([asked])
        parts = []
        # What a query has beyond the block's longest vector meets zeros only.
        for query_id, query in zip(table.column("id").to_pylist(), _matrix(table, index.dims), strict=True):
            ids, scores = index.search(query_id, query, k)
            parts.append((np.full(len(ids), query_id), ids, scores))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, is_query = np.asarray(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if block[a] != now:
                    now, rows, index = block[a], [], None
                part = batch.slice(a, b - a)
                if not is_query[a]:
                    rows.append(part)
                    continue
                if index is None and rows:
                    index, rows = _index(rows), []
                if index is not None:
                    yield answers(index, part)

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query with all other rows.

    Components become floor(scale * x). Queries are the rows whose id is divisible by every; every row but
    the query's own id is a candidate, and ties go to the smaller id. Vectors that are null or hold null, NaN
    or infinite components take no part, nor do rows with a null id; empty vectors have score 0 with all.
    Vectors of different lengths are compared as if filled up with zeros. Rows that repeat an id are
    candidates each; copies of one row travel as one with a count, as more than k of them never matter. Of
    queries that repeat an id, one vector (the smallest) counts. An empty table gives an empty table; other
    columns play no part.
    """
    x = F.col(vector_col)
    fit = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & fit).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")
    )
    n = rows.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // BLOCK_ROWS), min(cores, n // LEAST_ROWS))
    kinds = rows.groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies"))
    dealt = kinds.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"), F.lit(False).alias("is_query"), "id", "v", "copies")
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(True).alias("is_query"), "id", "v", F.lit(0).cast("long").alias("copies"))
    met = dealt.unionAll(asked).repartition(blocks, "block").sortWithinPartitions("block", "is_query")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
