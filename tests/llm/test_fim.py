import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusdeck.llm import fim, queries
from corpusdeck.llm.fim import fill_in_middle, fim_digests, fim_pieces, restored

from . import plain

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def whole(doc_id, text, share=50, spm=80):
    """(doc_id, form, n, prefix_chars, middle_chars, output)."""
    text = text or ""
    u = UNIT.findall(text)
    n, digest = len(u), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= share:
        return doc_id, "plain", n, None, None, text
    x, y, z = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm:
        return doc_id, "spm", n, len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return doc_id, "psm", n, len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def rows():
    r = random.Random(6)
    parts = ["a", " ", "\n", "\t", "wort", "ñandú", "\xa0", "日本", "<", "P>", "😀", "\x0b", "\x1c"]
    out = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 60)))) for i in range(-50, 250)]
    out += [(300, None), (301, ""), (302, "   "), (None, "no id here"), (None, "no id here"), (None, "another"), (5, out[55][1]), (5, "other text under five")]
    out += [(310 + i, "a <S> b") for i in range(3)]
    out += [(400 + i, "é" * 50_000 + " " + "word " * 9_000 + "x" * 40_000 + "\n") for i in range(8)]  # units longer than a piece
    return out


def test_texts_and_digests_against_brute_force(spark):
    given = rows()
    df = spark.createDataFrame([(*x, "extra", 1) for x in given], "doc_id long, text string, form string, k1 int").repartition(5)
    want = Counter(whole(*x) for x in given)
    texts = fill_in_middle(df)
    assert Counter(map(tuple, texts.collect())) == want
    assert {x[1] for x in want} == {"plain", "spm", "psm"}
    digests = fim_digests(fim_pieces(df)).collect()
    assert Counter(map(tuple, digests)) == Counter((*x[:5], plain.sha(x[5]), plain.sha(given_text(given, x))) for x in want.elements())
    back = texts.select("doc_id", restored(F.col("text"), F.col("form")).alias("text"))
    assert Counter(map(tuple, back.collect())) == Counter((d, t or "") for d, t in given)


def given_text(given, x):
    """The text of a row of whole()."""
    return next(t or "" for d, t in given if d == x[0] and whole(d, t) == x)


def test_restored_comes_from_the_output(spark):
    """A changed piece of the output changes the restored digest too."""
    df = spark.createDataFrame([(i, f"some words of text {i}") for i in range(60)], "doc_id long, text string")
    pieces = fim_pieces(df, share=100)
    changed = pieces.withColumn("chunk", F.when(F.col("doc_id") == 7, F.expr("cast(replace(cast(chunk as string), 'words', 'WORDS') as binary)")).otherwise(F.col("chunk")))
    changed = changed.repartition("doc_id", "k1", "k2").sortWithinPartitions("doc_id", "k1", "k2", "seat")
    got = {x.doc_id: x for x in fim_digests(changed).collect()}
    assert got[7].restored_sha256 == plain.sha("some WORDS of text 7") and got[8].restored_sha256 == plain.sha("some words of text 8")


@pytest.mark.parametrize("size", [1, 3, 64])
def test_small_pieces(spark, monkeypatch, size):
    """Many pieces per document, in the emitting function itself: their concatenation is the output."""
    monkeypatch.setattr(fim, "PIECE_BYTES", max(size, 4))
    for doc_id, text in rows()[:300]:
        raw = (text or "").encode()
        ends = [m.end() for m in UNIT.finditer(text or "")]
        ends = [len((text or "")[:e].encode()) for e in ends]
        parts = list(fim._pieces_of(doc_id, raw, fim.np.array(ends, int), 42, 50, 80))
        assert b"".join(p[-1] for p in parts).decode() == whole(doc_id, text)[5]
        assert all(len(p[-1]) <= max(size, 4) + 3 for p in parts) and [p[4] for p in parts] == list(range(len(parts)))


def test_one_exchange(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = fim_digests(fim_pieces(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2


def test_empty_table_and_query(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert fim_digests(fim_pieces(df.where("false"))).count() == 0 and fill_in_middle(df.where("false")).count() == 0
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_fill_in_middle(spark, str(tmp_path)).count() == 2
