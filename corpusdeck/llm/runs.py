"""Periodic runs of words, found by multi-scale minimizers.

Inside a run of period q, what stands q words apart is the same, so the minima of equal windows lie q apart
too. For each scale m, periods in (m, 2m], every stretch of 2m words has a hash, and the least hash of each m
neighbouring ones is a minimizer. A run of at least four periods holds two equal windows one period apart,
and within it equal stretches are never closer than a period; so neighbours among equal minimizers are a
pair one period apart. Each such pair is a seed, extended to both sides as far as words q apart agree. Periods
up to LAGS words are too short for that and are scanned directly, lag by lag. Scales double up to a quarter
of the longest text, so the work is near linear in the words, whatever repeats. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import _ODD, U64, Words, chunks, mix, sliding, words_of

#: Periods up to this many words are found by comparing words at that lag.
LAGS = 8
#: Words of a run at least, and its periods at least.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Two primes below 2**31 and a base for each: hashes of stretches of any length, for extension.
_FIELDS = ((2147483647, 1103515245), (2147483629, 747796405))
_SLICE = 4 << 20
RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each stretch of true values."""
    edge = np.diff(np.concatenate(([0], same.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _at_lag(word: np.ndarray, doc: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal stretch in which words lag apart are the same, the last lag words included."""
    begin, end = _stretches((word[:-lag] == word[lag:]) & (doc[:-lag] == doc[lag:]))
    return begin, end + lag


class _Stretch:
    """Compares stretches of words of any length by prefix sums of two polynomial hashes."""

    def __init__(self, word: np.ndarray):
        self.fields = []
        for prime, base in _FIELDS:
            p, power = U64(prime), np.ones(1, U64)
            step = U64(base)
            while len(power) <= len(word):
                power = np.concatenate((power, power * step % p))
                step = step * step % p
            total = np.zeros(len(word) + 1, U64)
            np.cumsum(word % p * power[: len(word)] % p, out=total[1:])
            self.fields.append((p, power, total % p))

    def same(self, at: np.ndarray, lag: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.ones(len(at), bool)
        for p, power, total in self.fields:
            here = (total[at + length] + p - total[at]) % p
            there = (total[at + lag + length] + p - total[at + lag]) % p
            out &= here * power[lag] % p == there
        return out

    def longest(self, at: np.ndarray, lag: np.ndarray, most: np.ndarray, backward: bool) -> np.ndarray:
        """How many words from at on (or up to at) are as those lag later, most at most; by bisection."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = self.same(at - middle if backward else at, lag, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low


def _seeds(word: np.ndarray, doc: np.ndarray, stop: np.ndarray, longest: int, periods: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the pairs of neighbouring equal minimizers, scale by scale."""
    gram, length = word, 1
    while length < 2 * LAGS:
        gram, length = mix(gram[:-length] * U64(_ODD) + gram[length:]), 2 * length
    m = length // 2
    while periods * (m + 1) <= longest:
        inside = np.arange(len(gram)) + length <= stop[: len(gram)]
        value = np.where(inside, gram, U64(2**64 - 1))
        low = sliding(value, m)
        padded = np.zeros(len(low) + 2 * (m - 1), U64)
        padded[m - 1 : m - 1 + len(low)] = low
        # A place is a minimizer if a window around it has its value for a minimum.
        place = np.flatnonzero((value == sliding(padded, m, np.maximum)) & inside)
        place = place[np.argsort(value[place], kind="stable")]
        a, b = place[:-1], place[1:]
        good = (value[a] == value[b]) & (b - a > m) & (b - a <= 2 * m) & (doc[a] == doc[b])
        yield a[good], (b - a)[good]
        gram, length, m = mix(gram[:-length] * U64(_ODD) + gram[length:]), 2 * length, 2 * m


def find_runs(words: Words, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Rows (doc, start, end, period) in order of document, start, period; start and end are positions in words."""
    if min_periods < MIN_PERIODS:
        raise ValueError(f"runs of fewer than {MIN_PERIODS} periods can lie between minimizers")
    word, count = words.hash, words.count()
    longest = int(count.max(initial=0))
    doc, start, stop = words.doc(), np.repeat(words.first[:-1], count), np.repeat(words.first[1:], count)
    found = []
    for lag in range(1, min(LAGS, longest // min_periods) + 1):
        a, b = _at_lag(word, doc, lag)
        found.append(np.stack((a, b, np.full_like(a, lag)), axis=1))
    seeds = [x for x in _seeds(word, doc, stop, longest, min_periods) if len(x[0])] if longest >= min_periods * (LAGS + 1) else []
    if seeds:
        at, lag = (np.concatenate(x).astype(np.int64) for x in zip(*seeds, strict=True))
        hashes = _Stretch(word)
        right = hashes.longest(at, lag, stop[at] - at - lag, backward=False)
        left = hashes.longest(at, lag, at - start[at], backward=True)
        runs = np.unique(np.stack((at - left, at + lag + right, lag), axis=1), axis=0)
        for a, b, q in runs[runs[:, 1] - runs[:, 0] >= min_periods * runs[:, 2]].tolist():
            if np.array_equal(word[a : b - q], word[a + q : b]):
                found.append(np.array([[a, b, q]]))
            else:  # The hashes of two different stretches agreed: all runs of that lag, by comparing words.
                lo, hi = int(start[a]), int(stop[a])
                x, y = _at_lag(word[lo:hi], doc[lo:hi], q)
                found.append(np.stack((x + lo, y + lo, np.full_like(x, q)), axis=1))
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(min_words, min_periods * runs[:, 2])]
    # A run is found at multiples of its period too; the least counts.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return np.concatenate((doc[runs[:, 0]].reshape(-1, 1), runs), axis=1)


def _join_words(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    index = np.flatnonzero(keep)
    doc = words.doc()[index]
    last = np.ones(len(index), bool)
    last[:-1] = doc[1:] != doc[:-1]
    size = words.end[index] - words.start[index] + ~last
    end = np.concatenate(([0], np.cumsum(size)))
    data, out = np.append(words.data, np.uint8(32)), np.empty(int(end[-1]), np.uint8)
    i = 0
    while i < len(index):
        j = max(i + 1, int(np.searchsorted(end, end[i] + _SLICE, "right")) - 1)
        part = size[i:j]
        at = np.arange(end[i], end[j]) + np.repeat(words.start[index[i:j]] - end[i:j], part)
        out[end[i] : end[j]] = data[at]
        i = j
    space = end[1:][~last] - 1
    out[space] = 32
    per = np.bincount(doc, weights=size, minlength=len(words.first) - 1).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(per)))
    return pa.LargeStringArray.from_buffers(len(per), pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, text_col: str = "text") -> DataFrame:
    """docs plus runs, array<struct<start, length, period>> by start and period, and collapsed, the text without repetitions.

    Words are what stands between ASCII white space, numbered from 0. A run is a stretch of consecutive words
    with smallest period q (words q apart are the same), of at least min_words words and min_periods periods,
    that no neighbouring word extends. collapsed holds the words that no run has after its first q words,
    joined by one space. min_periods is 4 at least.

    A null or empty text, or one of white space only, has no runs and an empty collapsed text. Rows are judged
    one by one: repeated rows and ids, null ids and all other columns stay as they are, but columns runs and
    collapsed of docs are replaced. A very long text is one task's work, in memory of some hundred bytes per
    word. An empty table gives an empty table.
    """
    plain = docs.drop("runs", "collapsed")
    place = plain.columns.index(text_col)
    names = [*plain.columns, "runs", "collapsed"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col, 1 << 20):
            words = words_of(batch.column(place))
            runs = find_runs(words, min_words, min_periods)
            doc, a, b, q = runs.T
            edge = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(edge, a + q, 1)
            np.add.at(edge, b, -1)
            keep = np.cumsum(edge[:-1]) == 0
            parts = [pa.array(x, pa.int64()) for x in (a - words.first[doc], b - a, q)]
            offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=batch.num_rows)))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed, _join_words(words, keep)], names)

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in plain.schema), f"runs {RUN_TYPE}", "collapsed string"])
    return plain.mapInArrow(scan, schema)
