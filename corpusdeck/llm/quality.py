"""Quality scores: random Fourier features of document statistics, a ridge fit and isotonic calibration.

The statistics of the labelled rows are normalised and mapped to cosines that approximate a Gaussian
kernel. Each partition sums its own normal equations; Spark adds the sums up, and only matrices of a fixed
size reach the driver. Isotonic regression on a histogram of the fitted scores turns them into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import U64, chunks, text_bytes, words_of

#: Random Fourier features, width of the kernel in standard deviations, ridge strength per row.
FEATURES, WIDTH, RIDGE = 192, 6.0, 1e-4
#: Bins of the calibration histogram over raw scores from -1 to 2.
BINS = 1536

STATISTICS = (
    "log_words", "word_bytes", "distinct_words", "top_word", "upper", "digit", "space", "newline", "pipe", "exclamation", "symbol", "stop_comma",
    "not_ascii", "symbol_end", "no_letter", "long_words", "short_words", "upper_words", "log_line_words", "repeated_pairs", "byte_entropy",
)


def _share(data: np.ndarray, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Share of a text's bytes that are ones."""
    total = np.concatenate(([0], np.cumsum(ones, dtype=np.int64)))
    return (total[at[1:]] - total[at[:-1]]) / np.maximum(1, np.diff(at))


def _in_text(first: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Mean over a text's words."""
    total = np.concatenate(([0.0], np.cumsum(value, dtype=np.float64)))
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(1, np.diff(first))


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and how often its most frequent one occurs."""
    key = np.sort((doc.astype(U64) << U64(40)) | (value >> U64(24)))
    begin = np.flatnonzero(np.diff(key, prepend=~key[:1])) if len(key) else np.zeros(0, np.int64)
    owner = (key[begin] >> U64(40)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, owner, np.diff(np.append(begin, len(key))))
    return np.bincount(owner, minlength=n), top


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text; an empty text has zeros where there is nothing to divide."""
    data, at = text_bytes(column)
    w, n = words_of(column), len(column)
    doc, count, size = w.doc(), w.count(), w.end - w.start
    distinct, top = _distinct(doc, w.hash, n)
    pairs = np.maximum(0, count - 1)
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    different, _ = _distinct(doc[inner], w.hash[inner] * U64(0x9E3779B97F4A7C15) + w.hash[inner + 1] if len(inner) else w.hash[:0], n)
    byte = np.arange(256)
    is_upper, is_digit = (byte >= 65) & (byte <= 90), (byte >= 48) & (byte <= 57)
    is_letter = is_upper | ((byte >= 97) & (byte <= 122)) | (byte >= 128)
    is_symbol = np.isin(byte, [ord(c) for c in "#$%&*@^~<>{}[]\\_=+"])
    lines = np.maximum(1, _share(data, data == 10, at) * np.diff(at) + 1)
    letters = np.concatenate(([0], np.cumsum(is_letter[data], dtype=np.int64)))
    uppers = np.concatenate(([0], np.cumsum(is_upper[data], dtype=np.int64)))
    last = data[w.end - 1] if len(w.end) else data[:0]
    entropy = np.zeros(n)
    for i in range(n):
        p = np.bincount(data[at[i] : at[i + 1]], minlength=1)
        p = p[p > 0] / max(1, at[i + 1] - at[i])
        entropy[i] = -(p * np.log(p)).sum()
    columns = [
        np.log1p(count),
        _in_text(w.first, size),
        distinct / np.maximum(1, count),
        top / np.maximum(1, count),
        *[_share(data, ones[data], at) for ones in (is_upper, is_digit, byte == 32, byte == 10, byte == 124, byte == 33, is_symbol, (byte == 44) | (byte == 46), byte >= 128)],
        _in_text(w.first, is_symbol[last]),
        _in_text(w.first, letters[w.end] == letters[w.start]),
        _in_text(w.first, size > 12),
        _in_text(w.first, size <= 3),
        _in_text(w.first, (uppers[w.end] - uppers[w.start]) * 2 > size),
        np.log1p(count / lines),
        np.where(pairs > 0, 1 - different / np.maximum(1, pairs), 0),
        entropy,
    ]
    return np.stack(columns, axis=1)


@dataclass
class Model:
    """Scales of the statistics, the cosines' directions and phases, ridge weights and calibration points."""

    mean: np.ndarray
    scale: np.ndarray
    direction: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    probability: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.direction + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate((waves, z, np.ones((len(z), 1))), axis=1)

    def fitted(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.fitted(x), self.raw, self.probability)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to value in weighted squares, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(n), s / w) for s, w, n in blocks]) if blocks else np.zeros(0)


def _sums(rows: DataFrame, make) -> np.ndarray:
    """Adds up the vectors that make(x, y) gives for each partition's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, len(STATISTICS))
                part = make(x, np.asarray(batch.column(1)).astype(float))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

    found = rows.select("x", "y").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(found))
    for r in found:
        out[r["k"]] = r["v"]
    return out


def statistics_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) per row of docs: its STATISTICS, a few hundred bytes whatever the text's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            x = statistics(batch.column(1))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(STATISTICS), dtype=np.int32), x.reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", modulus: int = 4, held_out: int = 2, seed: int = 3) -> Model | float:
    """A model of all labelled rows whose crc32(id as text) modulo modulus is not held_out; a constant if labels have one class.

    stats comes from statistics_of; only these narrow rows meet the labels.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held_out)
    rows = cut(stats.join(known, "doc_id").select("x", "y"))
    d = len(STATISTICS)
    first = _sums(rows, lambda x, y: np.concatenate(([len(y), y.sum()], x.sum(axis=0), (x * x).sum(axis=0))))
    if not len(first) or first[1] in (0, first[0]):
        return float(first[1] / first[0]) if len(first) else 0.5
    mean = first[2 : 2 + d] / first[0]
    scale = np.sqrt(np.maximum(first[2 + d :] / first[0] - mean * mean, 1e-12)) + 1e-6
    r = np.random.default_rng(seed)
    size = FEATURES + d + 1
    model = Model(mean, scale, r.standard_normal((d, FEATURES)) / WIDTH, r.uniform(0, 2 * np.pi, FEATURES), np.zeros(size), np.zeros(1), np.zeros(1))
    upper = np.triu_indices(size)
    # Both classes weigh the same, so the fit separates them though one is rare.
    weigh = (0.5 * first[0] / (first[0] - first[1]), 0.5 * first[0] / first[1])

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f, w = model.features(x), np.where(y == 1, weigh[1], weigh[0])
        return np.concatenate((((f * w[:, None]).T @ f)[upper], (f * w[:, None]).T @ y))

    second = _sums(rows, equations)
    square = np.zeros((size, size))
    square[upper] = second[: len(upper[0])]
    square = square + square.T - np.diag(np.diag(square))
    model.weights = np.linalg.solve(square + RIDGE * first[0] * np.eye(size), second[len(upper[0]) :])

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        place = np.clip(((model.fitted(x) + 1) / 3 * BINS).astype(np.int64), 0, BINS - 1)
        return np.concatenate((np.bincount(place, minlength=BINS), np.bincount(place, y, BINS)))

    third = _sums(rows, histogram)
    full = np.flatnonzero(third[:BINS])
    model.raw = (full + 0.5) / BINS * 3 - 1
    # One row of the general share in each bin keeps sparse ends from certainty.
    share = first[1] / first[0]
    model.probability = isotonic((third[BINS:][full] + share) / (third[:BINS][full] + 1), third[:BINS][full] + 1)
    return model


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs; nothing but the text goes into a score.

    Null texts count as empty ones, which are scored from their statistics, all zero. Rows with a null id are
    scored and not held out; rows that repeat an id each get their row. Labels that are null or not 0 or 1
    are left out; without labels of both classes every score is their share (0.5 without any). An empty
    table gives an empty table; other columns play no part.
    """
    stats = cut(statistics_of(docs, id_col, text_col))
    model = docs.sparkSession.sparkContext.broadcast(train(stats, labels, id_col, label_col))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, x = model.value, np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, len(STATISTICS))
            found = np.full(batch.num_rows, m) if isinstance(m, float) else m.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    scored = stats.mapInArrow(score, "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
