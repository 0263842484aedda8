import gzip
import io
import random

import numpy as np
import pytest

from corpusdeck.llm.topk import top_k
from corpusdeck.llm.warc import archive_round_trip, parse_warc, read_warc, write_warc

from . import plain

SCHEMA = "page_id long, url string, html string, record_type string"


def test_round_trip(spark):
    big, other = "<p>é" * 50, "x" * 100
    rows = [
        (5, "http://a.example/x?y#z", big, "q"), (2, "http://b.example", big, "q"), (9, None, big, None), (3, "no url \r\n at all", other, "q"), (4, "http://c/", other, "q"), (1, "u", "x" * 99, "q"),
        (6, "u", "x" * 99, "q"), (7, "u", None, "q"), (8, "u", "", "q"), (10, "u", "WARC/1.1\r\n\r\n\r\nContent-Length: 3\r\n\r\n" * 9, "q"), (None, "n", big, "q"), (11, "v", "z" * 3_000_000, "q"), (12, "w", "line\nline\r\n", "q"),
    ]
    got = {x.page_id: x for x in archive_round_trip(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    first = {big: 2, other: 3}
    for page_id, url, html, _ in rows:
        x, payload = got[page_id], (html or "").encode()
        refers = first.get(html) if page_id is not None and first.get(html) != page_id else None
        assert (x.url, x.response.type, x.refers_to) == (url, "revisit" if refers else "response", refers)
        assert (x.response.payload_bytes, x.response.payload_digest) == (len(payload), plain.sha(html or ""))
        assert x.response.payload == (None if refers else payload)
        assert x.request.head.startswith("GET /") and x.metadata_id


def test_repeated_rows_and_nothing(spark):
    rows = [(1, "u", "p" * 200, "q")] * 2 + [(1, "u", "r" * 200, "q"), (2, "u", "p" * 200, "q")]
    got = sorted((x.page_id, x.response.payload_digest, x.response.type, x.refers_to) for x in archive_round_trip(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([(1, plain.sha("p" * 200), "response", None), (1, plain.sha("r" * 200), "response", None), (2, plain.sha("p" * 200), "revisit", 1)])
    assert archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_are_well_formed(spark, tmp_path):
    write_warc(spark.createDataFrame([(i, f"http://h/{i}", "é" * i, "q") for i in range(40)], SCHEMA), str(tmp_path / "w"))
    seen = []
    for path in (tmp_path / "w").glob("part-*"):
        raw = gzip.decompress(path.read_bytes())
        seen += list(parse_warc(io.BytesIO(raw)))
        assert not raw or raw.endswith(b"\r\n\r\n")
    ids = {h["warc-record-id"] for h, _ in seen}
    assert len(ids) == len(seen) == 120
    assert all(h["warc-concurrent-to"] in ids for h, _ in seen if h["warc-type"] in ("request", "metadata"))
    assert read_warc(spark, str(tmp_path / "w"), payloads=False).where("payload is not null").count() == 0
    with pytest.raises(ValueError):
        list(parse_warc(io.BytesIO(b"WARC/1.1\r\ncontent-length: 9\r\n\r\nshort")))
    with pytest.raises(ValueError):
        list(parse_warc(io.BytesIO(b"nonsense\r\n")))


def brute(rows, k, every=20):
    import math

    fit = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({i: w for i, w in reversed(sorted(fit)) if i % every == 0}.items()):
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in fit if i != q)[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "odd"])
def test_top_k_against_brute_force(spark, kind):
    r = np.random.default_rng(1)
    n = 700
    if kind == "normal":
        rows = [(i, (r.standard_normal(16) / 4).tolist()) for i in range(n)]
    elif kind == "ties":
        same = [0.5, -0.25, 0.0, 1.0]
        rows = [(i, same if i % 3 else r.integers(-1, 2, 4).astype(float).tolist()) for i in range(n)]
    elif kind == "wide":
        rows = [(i, (r.standard_normal(8) * 10.0 ** r.integers(-3, 6)).tolist()) for i in range(n)]
    else:
        rows = [(i, r.standard_normal(r.integers(0, 6)).tolist()) for i in range(200)]
        rows += [(None, [1.0]), (20, [0.5, 0.5]), (40, None), (300, None), (320, [1.0, None]), (340, [float("nan")]), (360, [float("inf"), 1.0]), (380, [])]
        rows = [x for i, x in enumerate(rows) if i not in (20, 40)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted(tuple(x) for x in top_k(df).collect())
    assert got == sorted(brute(rows, 20))


def test_top_k_small(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(x) for x in top_k(df).collect()) == [(0, 1, 1, 8192), (0, 2, 2, 8192)]
    assert top_k(df.where("false")).count() == 0


def test_index_uses_its_slices():
    from corpusdeck.llm.topk import BitSlicedIndex

    r = random.Random(1)
    ids, values = np.arange(5000), np.array([[r.randint(-40, 40) for _ in range(32)] for _ in range(5000)])
    index = BitSlicedIndex(ids, values)
    for q in range(0, 100, 20):
        near = index._boundary(values[q], 21)
        score = values @ values[q]
        assert 21 <= len(near) < 1500 and set(np.argsort(-score, kind="stable")[:21]) <= set(near.tolist())
