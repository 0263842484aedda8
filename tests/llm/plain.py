"""Brute-force versions of the operators' results, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(rows, least=20, docs=3):
    """rows: (doc_id, text) to {(doc_id, n_lines, n_dropped, text)} as a list."""
    split = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda line: fold(line).strip(" \t\n\x0b\x0c\r")
    count, keeper = defaultdict(int), {}
    for d, lines in split:
        if d is None:
            continue
        for k in {key(x) for x in lines}:
            count[k] += 1
            keeper[k] = max(keeper.get(k, d), d)
    out = []
    for d, lines in split:
        gone = [d is not None and len(key(x)) >= least and count[key(x)] >= docs and keeper[key(x)] > d for x in lines]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


def shingles(text, k=5):
    w = WORD.findall(fold(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(sets, percent):
    """sets: {doc_id: set} to {doc_id: smallest reachable id}."""
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def substring_dedup(rows, window=20):
    """rows: (doc_id, text) with distinct ids to {doc_id: (n_words, n_removed, text)}."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if x in seen:
                gone[i : i + window] = [True] * window
            seen.add(x)
        out[d] = (len(w), sum(gone), " ".join(a for a, g in zip(w, gone, strict=True) if not g))
    return out


def edit_distance_within(pattern, text):
    """Least edit distance of pattern to any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)
