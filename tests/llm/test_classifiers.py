import random
import zlib

import numpy as np

from corpusdeck.llm import toxicity as toxic
from corpusdeck.llm.quality import isotonic, quality
from corpusdeck.llm.toxicity import keep_clean, toxicity

SCHEMA = "doc_id long, text string, score string"


def made(seed, n):
    """Texts of invented words; toxic ones hold marked words, poor ones symbols."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(r.choice(("th", "er", "on", "an", "re", "in")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 150))]
        bad, poor = r.random() < 0.25, r.random() < 0.3
        if bad:
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(("Zorgo", "zorgik", "vaklum,"))
        if poor:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(not poor), int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = made(1, 700)
    extra = [(None, "zorgo " * 5, "s"), (5, rows[5][1], "s"), (9000, None, "s"), (9001, "", "s"), (9002, " ".join(["on"] * 20_000 + ["zorgo", "vaklum"]), "s"), (9003, "on " * 20_000, "s")]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    known = spark.createDataFrame([*labels, (3, None, None), (None, 1, 1), (4, 7, 7)], "doc_id long, quality int, toxic int")
    got = toxicity(docs, known).collect()
    assert len(got) == len(rows) + len(extra)
    by, truth = {x.doc_id: x for x in got}, {d: t for d, _, t in labels}
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    held = [d for d in truth if by[d].held_out]
    assert np.mean([by[d].predicted == truth[d] for d in held]) > 0.95
    assert by[None].predicted == 1 and by[9000].predicted == by[9001].predicted == 0 and by[9002].predicted == 1 and by[9003].predicted == 0
    clean = keep_clean(docs, known)
    assert clean.columns == docs.columns and sorted(str(x.doc_id) for x in clean.collect()) == sorted(str(x.doc_id) for x in got if not x.predicted)


def test_quality_on_held_out_rows(spark):
    rows, labels = made(2, 700)
    docs = spark.createDataFrame([*rows, (None, "x ###", "s"), (9000, None, "s"), (9001, "", "s"), (9002, "on " * 50_000, "s")], SCHEMA)
    known = spark.createDataFrame([*labels, (3, None, None), (4, 7, 7)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality(docs, known).collect()}
    assert len(got) == 704 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got.values())
    assert all(x.held_out == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d, x in got.items())
    held = [(got[d].predicted, q) for d, q, _ in labels if got[d].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert got[9000].score == got[9001].score


def test_without_two_classes(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "c", "s")], SCHEMA)
    none, one = (spark.createDataFrame(x, "doc_id long, quality int, toxic int") for x in ([], [(1, 1, 0), (2, 1, 0)]))
    assert {x.score for x in quality(docs, none).collect()} == {0.5} and {x.score for x in quality(docs, one).collect()} == {1.0}
    assert {x.predicted for x in toxicity(docs, none).collect()} == {0} and {x.predicted for x in toxicity(docs, one).collect()} == {0}
    assert quality(docs.where("false"), one).count() == 0 and toxicity(docs.where("false"), one).count() == 0


def test_isotonic():
    r = np.random.default_rng(1)
    for _ in range(20):
        v, w = r.random(15), r.random(15) + 0.1
        got = isotonic(v, w)
        assert (np.diff(got) >= -1e-12).all()
        # The least-squares fit is the largest of the least weighted means.
        want = [max(min(np.average(v[a : b + 1], weights=w[a : b + 1]) for b in range(i, 15)) for a in range(i + 1)) for i in range(15)]
        assert np.allclose(got, want)


def test_gradients(monkeypatch):
    import pyarrow as pa

    from corpusdeck.llm import gru

    monkeypatch.setattr(gru, "F32", np.float64)
    net = gru.Network(3)
    noise = np.random.default_rng(1)
    net.p = {k: x.astype(float) + noise.normal(size=x.shape) * 0.1 for k, x in net.p.items()}
    words = toxic._words(pa.array(["aa bb cc dd ee ff " * 9, "xx yy aa"]))
    vocab, which = gru.vocabulary(words)
    _, begin, size = gru.windows(words.first)
    y = np.arange(len(begin)) % 2.0
    found = {}
    monkeypatch.setattr(net, "_adam", lambda g, rate, rows: found.update(g, rows=rows))
    net.train(vocab, which, begin, size, y, np.ones(len(y)), 0.1)

    def loss():
        logit = net.scores(net.gates(vocab), which, begin, size)
        return (np.logaddexp(0, logit) - y * logit).mean()

    for name in ("xf", "uf", "cb", "ub", "attend", "out", "bias", "char"):
        at = np.unravel_index(np.abs(found[name]).argmax(), found[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        down = loss()
        net.p[name][at] = old
        assert abs(found[name][at] - (up - down) / 2e-5) < 1e-6


def test_windows_overlap_and_cover():
    from corpusdeck.llm.gru import STRIDE, WINDOW, windows

    for counts in ([0], [1, 0, 5], [WINDOW], [WINDOW + 1, 400, 33]):
        first = np.concatenate(([0], np.cumsum(counts)))
        text, begin, size = windows(first)
        for i, n in enumerate(counts):
            own = sorted((int(b - first[i]), int(s)) for t, b, s in zip(text, begin, size, strict=True) if t == i)
            assert set().union(*[range(b, b + s) for b, s in own]) == set(range(n)) if n else not own
            assert all(c - b == STRIDE for (b, _), (c, _) in zip(own, own[1:], strict=False))
