"""Toxicity scores: a bidirectional gated recurrent network over all overlapping windows of each text.

Only documents are labelled, so training is multiple-instance: each toxic document is represented by the
windows that look worst so far, first by word log odds and then by the network itself.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gru import WINDOW, Network, vocabulary, windows
from .tokens import NOT_ALNUM_BYTES, Words, chunks, words_of

#: The labelled rows that a fit takes at most, in the order of a seeded hash of their id, and the longest
#: text among them: the documented bound of the training sample. Scoring has no such bounds.
SAMPLE_DOCS, SAMPLE_CHARS = 5000, 20_000
EPOCHS, BATCH, RATE, ROUNDS = 4, 512, 0.02, 3
#: Windows drawn per document that is not toxic, and the share of documents kept for calibration.
CLEAN_WINDOWS, KEPT_SHARE = 4, 0.2


def _words(column: pa.Array) -> Words:
    return words_of(pc.utf8_lower(column.fill_null("") if column.null_count else column), NOT_ALNUM_BYTES)


@dataclass
class Model:
    """The network (None where labels had one class) and the calibration of a document's largest window logit."""

    network: Network | None
    slope: float
    shift: float

    def largest(self, words: Words) -> np.ndarray:
        """Each text's largest logit; -inf where a text has no words."""
        out = np.full(len(words.first) - 1, -np.inf)
        text, begin, size = windows(words.first)
        if self.network is not None and len(text):
            vocab, which = vocabulary(words)
            np.maximum.at(out, text, self._logits(self.network.gates(vocab), which, begin, size))
        return out

    def _logits(self, gates, which: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.concatenate([self.network.scores(gates, which, begin[i : i + 8192], size[i : i + 8192]) for i in range(0, len(begin), 8192)])

    def scores(self, column: pa.Array) -> np.ndarray:
        most = self.largest(_words(column))
        calibrated = self.slope * np.maximum(most, -30.0) + self.shift
        return 1 / (1 + np.exp(-np.clip(calibrated, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, seed: int = 11) -> Model:
    """A model of texts with labels 0 and 1; with one class only, a constant score."""
    labels = np.asarray(labels, np.int64)
    if not len(labels) or labels.min() == labels.max():
        return Model(None, 0.0, 4.0 if len(labels) and labels[0] else -4.0)
    r = np.random.default_rng(seed)
    words = _words(pa.array(texts, pa.string()))
    vocab, which = vocabulary(words)
    text, begin, size = windows(words.first)
    # Log odds of each distinct word by the documents that hold it.
    held = np.unique(words.doc() * np.int64(len(vocab.slot)) + which)
    doc, word = held // len(vocab.slot), held % len(vocab.slot)
    toxic = np.bincount(word, labels[doc], len(vocab.slot))
    clean = np.bincount(word, 1 - labels[doc], len(vocab.slot))
    odds = np.log((toxic + 0.5) / (labels.sum() + 1)) - np.log((clean + 0.5) / ((1 - labels).sum() + 1))
    odds[toxic < 3] = np.minimum(odds[toxic < 3], 0)
    reach = np.minimum(begin[:, None] + np.arange(WINDOW), (begin + size - 1)[:, None])
    look = odds[which[reach]].max(axis=1)
    kept = r.random(len(labels)) < KEPT_SHARE
    if len(np.unique(labels[kept])) < 2 or len(np.unique(labels[~kept])) < 2:
        kept[:] = False
    learned = ~kept[text]
    is_toxic, network, model = labels[text] == 1, Network(seed), None
    cutoff = np.quantile(look[~is_toxic], 0.999) if (~is_toxic).any() else -np.inf
    for _ in range(ROUNDS):
        chosen = np.flatnonzero(learned & is_toxic & (look > cutoff))
        if not len(chosen):
            chosen = np.flatnonzero(learned & is_toxic)
        # Clean windows: the worst looking ones, and some at random.
        other = np.flatnonzero(learned & ~is_toxic)
        hard = other[np.argsort(-look[other])[: 3 * len(chosen)]]
        some = r.choice(other, min(len(other), CLEAN_WINDOWS * int((labels == 0).sum())), replace=False) if len(other) else other
        rows = np.unique(np.concatenate((chosen, hard, some)))
        y = is_toxic[rows].astype(np.float32)
        weight = np.where(y == 1, max(1.0, (y == 0).sum() / max(1, y.sum()) / 4), 1.0).astype(np.float32)
        for epoch in range(EPOCHS):
            order = r.permutation(len(rows))
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                network.train(vocab, which, begin[rows[part]], size[rows[part]], y[part], weight[part], RATE * 0.7**epoch)
        model = Model(network, 1.0, 0.0)
        look = model._logits(network.gates(vocab), which, begin, size)
        cutoff = np.quantile(look[~is_toxic], 0.999) if (~is_toxic).any() else -np.inf
    # Calibrated on documents that the network has not seen, so new clean ones are not held for toxic.
    most = np.full(len(labels), -30.0)
    np.maximum.at(most, text, look)
    unseen = kept if kept.any() else ~kept
    model.slope, model.shift = _logistic(most[unseen], labels[unseen])
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a little ridge."""
    w, design = np.zeros(2), np.stack((x / 10, np.ones_like(x)), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        curve = design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        w = w + np.clip(np.linalg.solve(curve, design.T @ (y - p) - 1e-2 * w), -2, 2)
    return float(w[0] / 10), float(w[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out_of: int = 5) -> Model:
    """A model from a bounded sample of the labelled rows whose crc32(id as text) is no multiple of held_out_of."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    known = known.where(F.crc32(F.col("id").cast("string").cast("binary")) % held_out_of != 0)
    short = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    # Twice the bound of ids, as some documents may be missing or too long.
    few = known.orderBy(F.xxhash64("id"), "id", "y").limit(2 * SAMPLE_DOCS)
    rows = short.join(F.broadcast(few), "id").orderBy(F.xxhash64("id"), "id", "y", "text").limit(SAMPLE_DOCS)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, np.array(y)))], pa.binary())], ["model"])

    # The sample is one task's work by its bound; the driver only sees the model, whose size is fixed.
    found = rows.select("text", "y").mapInArrow(learn, "model binary").first()
    return pickle.loads(found["model"]) if found else fit([], np.zeros(0))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out_of: int = 5, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs.

    Words are runs of letters and digits, lower-cased. Every window of WINDOW words (a new one every STRIDE)
    is scored, and the largest score counts, calibrated on the training documents. Texts without words (null
    too) get the lowest score. Rows with a null id are scored and not held out. Rows that repeat an id each
    get their row. Without labels of both classes every score is the same. Labels that are null or not 0 or
    1 are left out. An empty table gives an empty table; other columns play no part.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, held_out_of))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(batch.column(1)))], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out_of == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.5, **columns) -> DataFrame:
    """docs without the rows that score threshold or more; the columns stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col=text_col, **columns))
    place = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col, 1 << 20):
            yield batch.filter(pa.array(model.value.scores(batch.column(place)) < threshold))

    return docs.mapInArrow(clean, docs.schema)
