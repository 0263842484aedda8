"""Vectorised tokens of Arrow text columns: word borders, 64-bit word hashes and rolling n-gram hashes.

Everything works on the UTF-8 bytes of a whole Arrow batch, in slices of bounded size, so no Python
loop runs per word and a single very long text only costs memory in proportion to its own length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import WHITE

U64 = np.uint64
_SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_ODD = 0x9E3779B97F4A7C15
_ODD_INV = pow(_ODD, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))

WHITE_BYTES = np.zeros(256, bool)
WHITE_BYTES[[ord(c) for c in WHITE]] = True
#: For texts that were lower-cased before: anything in ASCII but letters and digits separates.
NOT_ALNUM_BYTES = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
FOLD = np.arange(256)
FOLD[65:91] += 32

_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _SLICE + 1), base, U64)
        have[0] = 1
        np.cumprod(have, out=have)
        _POWERS[base] = have
    return have[:n]


@dataclass
class Words:
    """Words of several texts: byte borders in data, the text each word is in, and where each text's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count())


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most bytes of text (a longer text is a batch of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            to = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
            yield batch.slice(row, to - row)
            row = to


def words_of(column: pa.Array, separators: np.ndarray = WHITE_BYTES, fold: bool = False) -> Words:
    """Words of each text, at every separator byte; fold: hash A-Z as a-z."""
    data, at = text_bytes(column)
    inside = ~separators[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edge = at[:-1][at[:-1] < at[1:]]
    before[edge] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, at)
    return Words(data, start, end, first, _hash(data, start, end, _BYTE[FOLD] if fold else _BYTE))


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 from prefix sums; the odd base has an inverse that removes a word's place."""
    out, i = np.empty(len(start), U64), 0
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(end, lo + _SLICE, "right")))
        n = int(end[j - 1] - lo)
        total = value[data[lo : lo + n]]
        total *= _powers(_ODD, n)
        np.cumsum(total, out=total)
        a, b = start[i:j] - lo, end[i:j] - lo - 1
        part = total[b]
        part[a > 0] -= total[a[a > 0] - 1]
        out[i:j] = part * _powers(_ODD_INV, n)[a]
        i = j
    return mix(out ^ (end - start).astype(U64))


def grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row, across texts too (see inside)."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(_ODD)
        out += word[j : j + n]
    return mix(out)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Word positions at which k words of one text begin."""
    count = np.diff(first)
    full = np.maximum(count - k + 1, 0)
    skip = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(full)[:-1])), full)
    return np.arange(int(full.sum())) + skip


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """The least (or by best) of each width values in a row, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out
