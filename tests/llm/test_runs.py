import random
import zlib

import numpy as np
import pyarrow as pa

from corpusdeck.llm import queries
from corpusdeck.llm.runs import find_runs, periodic_runs
from corpusdeck.llm.tokens import words_of

from . import plain


def runs_of(w, least=6, times=4):
    """Maximal stretches by comparing words at every lag, with their smallest period."""
    best = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and j > i:
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words(r, n, letters):
    return [r.choice(letters) for _ in range(n)]


def texts():
    r = random.Random(13)
    out = ["", " \t\n", "a", "a a a a a", "a a a a a a", "a b " * 2 + "a b a", "a b " * 4, "b " * 7 + "a b " * 6]
    for n in (7, 30, 90, 300):
        out += [" ".join(words(r, n, "ab")) for _ in range(60)]
        out += [" ".join(words(r, n, "abc")) for _ in range(20)]
    for q in (1, 2, 3, 5, 7, 8, 9, 10, 15, 16, 17, 31, 32, 33, 40, 64, 65):  # around every scale's borders
        for times in (3.9, 4, 4.1, 7.3):
            unit = words(r, q, "abcdefgh")
            body = (unit * 9)[: round(q * times)]
            out.append(" ".join(words(r, r.randint(0, 9), "xyz") + body + words(r, r.randint(0, 9), "xyz")))
    a, b = ["a"], ["a", "b"]
    while len(b) < 600:
        a, b = b, b + a
    thue = [str(bin(i).count("1") % 2) for i in range(2048)]
    inner = (["a", "b"] * 5 + ["c"]) * 6  # runs inside the periods of a run
    return [*out, " ".join(b), " ".join(thue), " ".join(thue[:300] * 5), " ".join(inner), "\x0b".join(inner + inner[::-1]), "é\xa0é " * 40]


def test_runs_against_brute_force():
    all_texts = texts()
    found = find_runs(words_of(pa.array(all_texts)))
    at = words_of(pa.array(all_texts)).first
    for i, text in enumerate(all_texts):
        got = [(int(a - at[i]), int(b - a), int(q)) for d, a, b, q in found.tolist() if d == i]
        assert got == runs_of(plain.WORD.findall(text)), text[:200]


def test_period_longer_than_many_words():
    """One text of 400,000 words: a period of 70,001 words found by the largest scale, beside a short one."""
    r = np.random.default_rng(5)
    unit = [f"w{x}" for x in r.integers(0, 10**9, 70_001)]
    w = ["x", "y"] * 10 + unit * 4 + unit[:77] + ["z"] * 50_000
    found = find_runs(words_of(pa.array([" ".join(w)])))
    assert found.tolist() == [[0, 0, 20, 2], [0, 20, 20 + 4 * 70_001 + 77, 70_001], [0, 20 + 4 * 70_001 + 77, len(w), 1]]


def test_extension_survives_hash_collisions(monkeypatch):
    """With fields of a few elements every comparison by hash is doubtful; results stay the same."""
    monkeypatch.setattr("corpusdeck.llm.runs._FIELDS", ((3, 2), (5, 3)))
    test_runs_against_brute_force()


def test_rows_columns_and_nulls(spark):
    rows = [(1, None, "r", 1), (None, "a b " * 9, "s", 2), (2, "a b " * 9, "t", 3), (2, "a b " * 9, "t", 3), (3, "", None, 4), (4, "q " * 30_000 + "w", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, `start` int")
    out = periodic_runs(df)
    assert out.columns == ["doc_id", "text", "start", "runs", "collapsed"]
    got = sorted(((x.start, x.doc_id, [tuple(r) for r in x.runs], x.collapsed) for x in out.collect()))
    pair = [(0, 18, 2)]
    assert got == [(1, 1, [], ""), (2, None, pair, "a b"), (3, 2, pair, "a b"), (3, 2, pair, "a b"), (4, 3, [], ""), (5, 4, [(0, 30_000, 1)], "q w")]
    assert periodic_runs(df.where("false")).count() == 0


def contract(doc_id, text):
    w = plain.WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_of(w)
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, plain.sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), plain.sha(collapsed(w, runs)))


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, " ".join(words(r, r.randint(0, 120), "abcdefghijklmnop"))) for i in range(-40, 360)]
    rows += [(None, "a " * 9), (900, None), (7, rows[47][1]), *((1000 + i, t) for i, t in enumerate(texts()[-30:]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((contract(*x) for x in rows), key=str)
    assert sum(x.n_runs > 0 and x.doc_id is not None and x.doc_id < 360 for x in got) > 10
