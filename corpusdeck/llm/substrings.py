"""Substring dedup: suffix automata of reference shards, and documents streamed through them.

The reference holds the first occurrence of every word window that occurs more than once. Which windows
those are is found by content-defined anchors: each window has one anchor (its least 8-word hash), equal
windows have equal anchors, and an anchor seen once rules its windows out. Reference spans and document
segments meet in shards by anchor, whose number follows from the number of repeated anchors. Each shard's
task builds a suffix automaton of its reference and reads matching statistics of its segments; a shard with
many segments is several tasks with a copy of the automaton each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, stored_alone
from .tokens import U64, Words, chunks, grams, inside, mix, sliding, text_bytes, words_of

#: Words of an anchor.
ANCHOR = 8
#: Occurrences of repeated anchors that a shard has on average, and that one task of a shard takes.
SHARD_ANCHORS, TASK_ANCHORS = 8_000, 16_000


class SuffixAutomaton:
    """The substrings of several word sequences."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The state that p reaches by word, cut down to the length that p gives it."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, word)
                continue
            now, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = now
                p = self.link[p]
            if p >= 0:
                self.link[now] = self._split(p, word)
            last = now

    def matches(self, words: list[bytes], least: int) -> list[int]:
        """Positions of words at which a match of at least least words ends."""
        state, size, out = 0, 0, []
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                size += 1
            if size >= least:
                out.append(i)
        return out


class _Windows:
    """The windows of a batch: where they begin, and their text, hash and anchor."""

    def __init__(self, words: Words, window: int):
        self.words, self.window = words, window
        self.at = inside(words.first, window)
        self.doc = np.searchsorted(words.first, self.at, "right") - 1
        self.gram = grams(words.hash, ANCHOR)
        least = sliding(self.gram, window - ANCHOR + 1)
        self.anchor = least[self.at] if len(self.at) else np.zeros(0, U64)

    def hashes(self) -> np.ndarray:
        return grams(self.words.hash, self.window)[self.at] if len(self.at) else np.zeros(0, U64)

    def anchors(self) -> np.ndarray:
        """Word positions of all anchors: an anchor is the greatest of the window minima around it."""
        if not len(self.at):
            return self.at
        width = self.window - ANCHOR + 1
        minima = np.zeros(len(self.gram) + width - 1, U64)
        minima[self.at + width - 1] = self.anchor
        return np.flatnonzero(sliding(minima, width, np.maximum) == self.gram)

    def of(self, lists: pa.Array, values: np.ndarray) -> np.ndarray:
        """Whether each window's value is in its text's list."""
        offsets = np.asarray(lists.offsets)
        size = np.diff(offsets)
        known = np.asarray(lists.values[offsets[0] : offsets[-1]], np.int64).view(U64) ^ mix(np.repeat(np.arange(len(size)), size).astype(U64) + U64(1))
        return np.isin(values ^ mix(self.doc.astype(U64) + U64(1)), known)


def _filled(lists: pa.Array) -> pa.Array:
    return lists.fill_null([]) if lists.null_count else lists


def _anchors(window: int):
    """(doc_id, h, text) to (anchor, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = _Windows(words_of(batch.column(2)), window)
            at = found.anchors()
            if len(at):
                owner = pa.array(np.searchsorted(found.words.first, at, "right") - 1)
                yield pa.RecordBatch.from_arrays([pa.array(found.gram[at].view(np.int64)), batch.column(0).take(owner)], ["anchor", "doc_id"])

    return run


def _distinct(found: _Windows, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows at, those that begin their value in their text, and how often it occurs there."""
    _, first, count = np.unique(value[at] ^ mix(found.doc[at].astype(U64) + U64(1)), return_index=True, return_counts=True)
    return at[first], count


def _repeating(window: int):
    """(doc_id, h, text, anchors) to (window, doc_id) for windows whose anchor repeats, twice for those that repeat in their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = _Windows(words_of(batch.column(2)), window)
            value = found.hashes()
            at, count = _distinct(found, np.flatnonzero(found.of(_filled(batch.column(3)), found.anchor)), value)
            at = np.repeat(at, np.minimum(count, 2))
            if len(at):
                owner = pa.array(found.doc[at])
                yield pa.RecordBatch.from_arrays([pa.array(value[at].view(np.int64)), batch.column(0).take(owner)], ["window", "doc_id"])

    return run


def _pieces(window: int):
    """(doc_id, h, text, anchors, firsts) to segments and reference spans (anchor, is_reference, piece, places).

    Equal pieces of a batch are one row with the (doc_id, h, start) of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = _Windows(words_of(batch.column(2)), window)
            value, words = found.hashes(), found.words
            segment = np.flatnonzero(found.of(_filled(batch.column(3)), found.anchor))
            reference, _ = _distinct(found, segment[found.of(_filled(batch.column(4)), value)[segment]], value)
            for is_reference, at in ((False, segment), (True, np.sort(reference))):
                if not len(at):
                    continue
                # Neighbouring windows with one anchor are one piece.
                new = np.ones(len(at), bool)
                new[1:] = (found.at[at[1:]] != found.at[at[:-1]] + 1) | (found.anchor[at[1:]] != found.anchor[at[:-1]])
                begin = np.flatnonzero(new)
                last = np.append(begin[1:], len(at)) - 1
                a, b = found.at[at[begin]], found.at[at[last]] + window - 1
                text, owner = words.data.tobytes(), found.doc[at[begin]]
                equal: dict[bytes, list[int]] = {}
                for i, (x, y) in enumerate(zip(words.start[a].tolist(), words.end[b].tolist(), strict=True)):
                    equal.setdefault(text[x:y], []).append(i)
                row = np.array([i for rows in equal.values() for i in rows])
                edge = np.cumsum([0, *map(len, equal.values())])
                places = [batch.column(0).take(pa.array(owner[row])), batch.column(1).take(pa.array(owner[row])), pa.array((a - words.first[owner])[row])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.anchor[at[begin]][row[edge[:-1]]].view(np.int64)),
                        pa.array(np.full(len(equal), is_reference)),
                        pa.array(list(equal), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays(places, ["doc_id", "h", "start"])),
                    ],
                    ["anchor", "is_reference", "piece", "places"],
                )

    return run


def _match(window: int):
    """Builds a shard's automaton and streams its segments: (doc_id, h, a, b) for spans of words to remove."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(pieces: pa.Table) -> pa.Table:
        automaton, firsts, known = SuffixAutomaton(), set(), {}
        is_reference = pieces.column("is_reference")
        references, segments = (list(zip(*(x.column(c).to_pylist() for c in ("piece", "places")), strict=True)) for x in (pieces.filter(is_reference), pieces.filter(pc.invert(is_reference))))
        for piece, places in references:
            words = piece.split()
            automaton.add(words)
            firsts.update((at["doc_id"], at["h"], at["start"] + i) for at in places for i in range(len(words) - window + 1))
        out: list[tuple[int, int, int, int]] = []
        for piece, places in segments:
            ends = known.get(piece)
            if ends is None:
                ends = known[piece] = automaton.matches(piece.split(), window)
            for at in places:
                doc, h, span = at["doc_id"], at["h"], None
                for end in ends:
                    a = at["start"] + end - window + 1
                    if (doc, h, a) in firsts:
                        continue
                    if span and a <= span[1]:
                        span = (span[0], a + window)
                    else:
                        if span:
                            out.append((doc, h, *span))
                        span = (a, a + window)
                if span:
                    out.append((doc, h, *span))
        return pa.table([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema) if out else schema.empty_table()

    return run


def removed_spans(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, spans): word spans to remove of docs (doc_id, h, text), as (h, a, b), where h names one of the texts of an id.

    The texts are shuffled twice, by id: for the windows, and for pieces and result, which share that
    exchange. Otherwise only anchors, windows behind repeated ones and their pieces are shuffled.
    """
    anchors = docs.mapInArrow(_anchors(window), "anchor long, doc_id long")
    # A further grouping column keeps the aggregate's partitioning from being the join's, so the join gets
    # exchanges of its own and adaptive execution can split an anchor that many texts have.
    repeated = anchors.groupBy("anchor", F.pmod("anchor", F.lit(1024)).alias("_spread")).count().where("count > 1").select("anchor")
    # Repeated anchors and first windows are tables: what found them need not be kept or run again, and its
    # shuffle files are gone before the pieces are shuffled.
    per_doc = stored_alone(anchors.join(repeated, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")))
    total = per_doc.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-total // SHARD_ANCHORS)))).alias("shard")
    # Only shards of more than one task are listed. The table's size is known, so it's broadcast if it is small.
    loads = per_doc.select(F.explode("anchors").alias("anchor")).groupBy(shard).agg(F.ceil(F.count(F.lit(1)) / TASK_ANCHORS).cast("int").alias("tasks"))
    loads = stored(loads.where("tasks > 1"))
    some = docs.join(per_doc, "doc_id").select("doc_id", "h", "text", "anchors")
    windows = some.mapInArrow(_repeating(window), "window long, doc_id long")
    reference = windows.groupBy("window").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = stored_alone(reference.groupBy("doc_id").agg(F.collect_list("window").alias("firsts")))
    pieces = some.join(firsts, "doc_id", "left").select("doc_id", "h", "text", "anchors", "firsts").mapInArrow(
        _pieces(window), "anchor long, is_reference boolean, piece binary, places array<struct<doc_id:bigint,h:bigint,start:bigint>>"
    )
    tasks = F.coalesce("tasks", F.lit(1))
    task = F.explode(F.when(F.col("is_reference"), F.sequence(F.lit(0), tasks - 1)).otherwise(F.array(F.pmod(F.xxhash64(F.col("places")[0]), tasks).cast("int"))))
    placed = pieces.withColumn("shard", shard).drop("anchor").join(loads, "shard", "left").withColumn("task", task)
    spans = placed.groupBy("shard", "task").applyInArrow(_match(window), "doc_id long, h long, a long, b long")
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("h", "a", "b")).alias("spans"))


def _cut(place: int):
    """Rows with a text at place, h after it and spans at the end, to rows with the text cut by its own spans and two counts more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, at = text_bytes(batch.column(place))
            raw, kept, count, left = data.tobytes(), [], [], []
            for a, b, h, cuts in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(place + 1).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                words = raw[a:b].split()
                count.append(len(words))
                if cuts:
                    keep = np.ones(len(words), bool)
                    for span in cuts:
                        if span["h"] == h:
                            keep[span["a"] : span["b"]] = False
                    words = list(compress(words, keep.tolist()))
                left.append(len(words))
                kept.append(b" ".join(words).decode())
            columns = [*batch.columns[:place], pa.array(kept, pa.string()), *batch.columns[place + 2 : -1]]
            names = [*batch.schema.names[: place + 1], *batch.schema.names[place + 2 : -1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64()), pa.array(np.subtract(count, left), pa.int64())], [*names, "n_words", "n_removed"])

    return run


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, n_removed) per row of docs, the text rid of words that repeat an earlier passage.

    Words are split at ASCII white space and kept ones are joined by one space. A word goes if a window of
    window words around it has a word sequence that also starts earlier: in a smaller id, or in the same
    document further ahead. Texts below window words, null and empty ones lose nothing (null becomes empty).
    Rows with a null id lose nothing and count for nothing. Rows that repeat an id are one document if their
    texts are equal; different texts of an id are each judged against smaller ids and themselves. An empty table
    gives an empty table; other columns of docs play no part.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    # Rows without an id go their own way, so that all joins share one exchange of the texts.
    known = plain.where("doc_id is not null")
    joined = known.join(removed_spans(known, window), "doc_id", "left").select("doc_id", "text", "h", "spans")
    others = plain.where("doc_id is null").select("doc_id", "text", "h", F.lit(None).cast("array<struct<h:bigint,a:bigint,b:bigint>>").alias("spans"))
    schema = "doc_id long, text string, n_words long, n_removed long"
    return joined.mapInArrow(_cut(1), schema).unionAll(others.mapInArrow(_cut(1), schema))
