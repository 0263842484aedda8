"""A bidirectional gated recurrent network with attention pooling, in numpy.

The network reads windows of words. A word's input is its hashed word vector beside the mean of its hashed
character-triple vectors. Both depend on the word alone, so the input side of the gates is computed once per
distinct word, and the recurrence runs over many windows at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .tokens import U64, Words

F32 = np.float32
WORD_SLOTS, WORD_DIM = 1 << 15, 8
CHAR_SLOTS, CHAR_DIM = 1 << 14, 6
HIDDEN = 8
#: An update gate that stays shut.
SHUT = 1e9
#: Words of a vocabulary whose inputs are in memory at a time.
_SOME_WORDS = 1 << 15
#: Words of a window, and words between the starts of overlapping windows.
WINDOW, STRIDE = 32, 24


def _softsign(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: the squashing function, far cheaper than tanh; its slope is (1 - |value|) ** 2."""
    np.abs(x, out=room)
    room += F32(1)
    x /= room
    return x


def _slope(value: np.ndarray) -> np.ndarray:
    return np.square(F32(1) - np.abs(value))


def _by_row(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the values that share a row."""
    out = np.zeros((rows, value.shape[1]), F32)
    order = np.argsort(row, kind="stable")
    begin = np.flatnonzero(np.diff(row[order], prepend=-1))
    out[row[order][begin]] = np.add.reduceat(value[order], begin, axis=0)
    return out


@dataclass
class Vocabulary:
    """Distinct words: their word slot, and their character triples' slots one word after the other."""

    slot: np.ndarray
    chars: np.ndarray
    begin: np.ndarray
    count: np.ndarray


def vocabulary(words: Words) -> tuple[Vocabulary, np.ndarray]:
    """Distinct words of some texts, and which of them each word is."""
    _, at, which = np.unique(words.hash, return_index=True, return_inverse=True)
    start, count = words.start[at], (words.end - words.start)[at]
    begin = np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    byte = np.arange(int(count.sum())) + np.repeat(start - begin, count)
    left, here, right = (words.data[np.clip(byte + j, 0, len(words.data) - 1)].astype(np.uint32) for j in (-1, 0, 1))
    left[begin] = right[begin + count - 1] = 32
    slot = (words.hash[at] >> U64(64 - 15)).astype(np.int64)
    return Vocabulary(slot, (((left * 257 + here) * 257 + right) * np.uint32(2654435761) >> np.uint32(18)).astype(np.int32), begin, count), which.reshape(-1)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all overlapping windows of all texts; a text without words has none."""
    count = np.diff(first)
    many = np.where(count > 0, np.maximum(0, -(-(count - WINDOW) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(count)), many)
    nth = np.arange(int(many.sum())) - np.repeat(np.concatenate(([0], np.cumsum(many)[:-1])), many)
    begin = nth * STRIDE
    return text, first[text] + begin, np.minimum(WINDOW, count[text] - begin)


class Network:
    """Parameters by name, with scores of windows and one step of training."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN

        def some(*shape: int, scale: float) -> np.ndarray:
            return (r.standard_normal(shape) * scale).astype(F32)

        # Words start at zero, so one that training never met says nothing by itself.
        self.p = {"word": np.zeros((WORD_SLOTS, WORD_DIM), F32), "char": some(CHAR_SLOTS, CHAR_DIM, scale=0.1)}
        for way in "fb":
            self.p |= {f"x{way}": some(d, 3 * h, scale=d**-0.5), f"c{way}": np.zeros(3 * h, F32), f"u{way}": some(h, 3 * h, scale=h**-0.5)}
        self.p |= {"attend": some(2 * h, scale=0.3), "out": some(2 * h, scale=0.3), "bias": np.zeros(1, F32)}
        self.moments: dict[str, list[np.ndarray]] = {}
        self.steps = 0

    def inputs(self, v: Vocabulary, a: int = 0, b: int | None = None) -> np.ndarray:
        """Inputs of words a to b of the vocabulary."""
        b = len(v.slot) if b is None else b
        if a == b:
            return np.zeros((0, WORD_DIM + CHAR_DIM), F32)
        chars = self.p["char"][v.chars[v.begin[a] : v.begin[b - 1] + v.count[b - 1]]]
        mean = np.add.reduceat(chars, v.begin[a:b] - v.begin[a], axis=0) / v.count[a:b, None].astype(F32)
        return np.concatenate((self.p["word"][v.slot[a:b]], mean), axis=1)

    def gates(self, v: Vocabulary) -> list[list[np.ndarray]]:
        """For both directions the input side of the update, reset and candidate gates, a row per distinct word.

        The last row is padding: its update gate is shut, so the state passes it unchanged.
        """
        n, h = len(v.slot), HIDDEN
        out = [[np.zeros((n + 1, h), F32) for _ in range(3)] for _ in "fb"]
        for a in range(0, n, _SOME_WORDS):
            b = min(n, a + _SOME_WORDS)
            x = self.inputs(v, a, b)
            for gates, way in zip(out, "fb", strict=True):
                whole = x @ self.p[f"x{way}"] + self.p[f"c{way}"]
                for k in range(3):
                    gates[k][a:b] = whole[:, k * h : (k + 1) * h]
        for gates in out:
            gates[0][-1] = SHUT
        return out

    def _run(self, way: str, gates: list[np.ndarray], grid: np.ndarray, keep: list | None) -> np.ndarray:
        """States (step, window, unit)."""
        h, n = HIDDEN, grid.shape[1]
        u = [np.ascontiguousarray(self.p[f"u{way}"][:, k * h : (k + 1) * h]) for k in range(3)]
        state, out = np.zeros((n, h), F32), np.empty((WINDOW, n, h), F32)
        x, y, room = (np.empty((n, h), F32) for _ in range(3))
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            value = []
            for k in range(2):
                np.take(gates[k], grid[t], axis=0, out=x, mode="clip")
                s = np.matmul(state, u[k])
                s += x
                value.append(_softsign(s, room))
            np.matmul(state, u[2], out=y)
            np.take(gates[2], grid[t], axis=0, out=x, mode="clip")
            z, r = value[0] * F32(0.5), value[1] * F32(0.5)
            r += F32(0.5)
            c = r * y
            c += x
            _softsign(c, room)
            if keep is not None:
                keep.append((t, state, *value, r, c, y.copy()))
            step = c - state
            np.subtract(F32(0.5), z, out=z)
            step *= z
            state = np.add(state, step, out=out[t])
        return out

    def scores(self, gates: list[list[np.ndarray]], which: np.ndarray, begin: np.ndarray, size: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """A logit for each window of words which[begin : begin + size]."""
        h, step = HIDDEN, np.arange(WINDOW)[:, None]
        real = step < size
        grid = np.where(real, which[np.minimum(begin + step, max(0, len(which) - 1))], len(gates[0][0]) - 1)
        runs: list[list | None] = [None if keep is None else [] for _ in "fb"]
        both = [self._run(way, gates[k], grid, runs[k]) for k, way in enumerate("fb")]
        e = np.where(real, both[0] @ self.p["attend"][:h] + both[1] @ self.p["attend"][h:], F32(-1e9))
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.concatenate([np.einsum("tn,tnh->nh", a, x) for x in both], axis=1)
        if keep is not None:
            keep |= {"runs": runs, "both": both, "a": a, "pooled": pooled, "grid": grid}
        return pooled @ self.p["out"] + self.p["bias"]

    def train(self, v: Vocabulary, which: np.ndarray, begin: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray, rate: float) -> float:
        """One Adam step on the weighted logistic loss of some windows; returns the loss."""
        used, local = np.unique(np.concatenate([which[b : b + s] for b, s in zip(begin, size, strict=True)]), return_inverse=True)
        lengths = v.count[used]
        at = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        triples = v.chars[np.arange(int(lengths.sum())) + np.repeat(v.begin[used] - at, lengths)]
        small = Vocabulary(v.slot[used], triples, at, lengths)
        begin = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        keep: dict = {}
        x = self.inputs(small)
        logit = self.scores(self.gates(small), local.reshape(-1), begin, size, keep)
        p = F32(1) / (F32(1) + np.exp(-np.clip(logit, -30, 30)))
        g: dict[str, np.ndarray] = {}
        d = ((p - label) * weight / weight.sum()).astype(F32)
        a, both, h = keep["a"], np.concatenate(keep["both"], axis=2), HIDDEN
        g["bias"], g["out"] = np.array([d.sum()], F32), keep["pooled"].T @ d
        d_pooled = d[:, None] * self.p["out"]
        d_a = np.einsum("tnh,nh->tn", both, d_pooled)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["attend"] = np.einsum("tn,tnh->h", d_e, both)
        d_both = a[:, :, None] * d_pooled + d_e[:, :, None] * self.p["attend"]
        d_x = np.zeros_like(x)
        for k, way in enumerate("fb"):
            u, d_u = self.p[f"u{way}"], np.zeros_like(self.p[f"u{way}"])
            d_pres, d_state = np.empty((WINDOW, len(d), 3 * h), F32), np.zeros((len(d), h), F32)
            for t, state, sz, sr, r, c, y in reversed(keep["runs"][k]):
                d_state = d_state + d_both[t, :, k * h : (k + 1) * h]
                open_ = F32(0.5) - F32(0.5) * sz
                d_c = d_state * open_ * _slope(c)
                d_z = d_state * (state - c) * F32(0.5) * _slope(sz)
                d_r = d_c * y * F32(0.5) * _slope(sr)
                d_pres[t] = np.concatenate((d_z, d_r, d_c), axis=1)
                d_y = np.concatenate((d_z, d_r, d_c * r), axis=1)
                d_u += state.T @ d_y
                d_state = d_state * (F32(1) - open_) + d_y @ u.T
            d_gate = _by_row(keep["grid"].reshape(-1), d_pres.reshape(-1, 3 * h), len(x) + 1)[:-1]
            g[f"u{way}"], g[f"x{way}"], g[f"c{way}"] = d_u, x.T @ d_gate, d_gate.sum(axis=0)
            d_x += d_gate @ self.p[f"x{way}"].T
        slots, place = np.unique(small.slot, return_inverse=True)
        g["word"] = _by_row(place.reshape(-1), d_x[:, :WORD_DIM], len(slots))
        g["char"] = _by_row(small.chars, np.repeat(d_x[:, WORD_DIM:] / lengths[:, None].astype(F32), lengths, axis=0), CHAR_SLOTS)
        self._adam(g, rate, {"word": slots})
        return float((weight * (np.logaddexp(0, logit) - label * logit)).sum() / weight.sum())

    def _adam(self, g: dict[str, np.ndarray], rate: float, rows: dict[str, np.ndarray]) -> None:
        """rows: for a gradient of some rows only, which; the moments of the others wait."""
        self.steps += 1
        for name, value in g.items():
            moments = self.moments.setdefault(name, [np.zeros_like(self.p[name]), np.zeros_like(self.p[name])])
            at = rows.get(name, slice(None))
            first = moments[0][at] + F32(0.1) * (value - moments[0][at])
            second = moments[1][at] + F32(0.001) * (value * value - moments[1][at])
            moments[0][at], moments[1][at] = first, second
            up, down = first / F32(1 - 0.9**self.steps), np.sqrt(second / F32(1 - 0.999**self.steps)) + F32(1e-7)
            self.p[name][at] -= F32(rate) * up / down
